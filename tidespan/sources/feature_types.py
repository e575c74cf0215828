"""The feature types of the Sequence Ontology's subset for annotation."""

# The names of the public term list, in its order.
FEATURE_TYPES = """
Sequence Ontology, region, interior coding exon, satellite DNA, PCR product, read pair, scRNA, match set, match part, gene part, operator,
nuclease binding site, transposable element, expressed sequence match, clone insert end, polypeptide, sequence variant obs, sequence
feature, primer, proviral region, methylated C, protein coding primary transcript, ribosome entry site, attenuator, terminator, assembly
component, exon, supercontig, contig, read, clone, deletion, methylated A, splice site, five prime cis splice site, five prime splice site,
three prime cis splice site, three prime splice site, enhancer, promoter, cross genome match, operon, clone insert start, translated
nucleotide match, non transcribed region, primary transcript, repeat family, intron, RFLP fragment, coding exon, five prime coding exon
coding region, five prime exon coding region, three prime coding exon coding region, three prime exon coding region, noncoding exon, five
prime coding exon, UTR, five prime UTR, three prime UTR, rRNA primary transcript, mature transcript, mRNA, TF binding site, ORF, flanking
region, rRNA, tRNA, snRNA, snoRNA, miRNA, microsatellite, inverted repeat, origin of replication, clip, modified base, modified base site,
methylated base feature, CpG island, direct repeat, TSS, CDS, start codon, stop codon, tag, rRNA large subunit primary transcript, SAGE tag,
conserved region, STS, coding conserved region, exon junction, nc conserved region, pseudogene, RNAi reagent, chromosome, chromosome band,
match, splice enhancer, EST, nucleotide match, protein match, sequence assembly, codon, insertion site, transposable element insertion site,
small regulatory ncRNA, enzymatic RNA, ribozyme, rRNA 5 8S, rRNA 5.8S, hammerhead ribozyme, RNase MRP RNA, RNase P RNA, telomerase RNA, U1
snRNA, U2 snRNA, U4 snRNA, U4atac snRNA, U5 snRNA, U6 snRNA, U6atac snRNA, U11 snRNA, U12 snRNA, U14 snoRNA, vault RNA, Y RNA, rRNA 18S,
binding site, protein binding site, restriction fragment, sequence difference, signal peptide, mature protein region, ARS, ss oligo, ds
oligo, rasiRNA, pseudogenic region, decayed exon, golden path fragment, tiling path, tiling path fragment, nc primary transcript, three
prime coding exon noncoding region, five prime coding exon noncoding region, virtual sequence, transcribed region, polyA signal sequence,
polyA site, centromere, cap, group I intron, autocatalytically spliced intron, SRP RNA, C D box snoRNA, guide RNA, group II intron,
intergenic region, polyA sequence, branch site, polypyrimidine tract, transcription end site, telomere, silencer, insulator, chromosomal
structural element, minisatellite, antisense RNA, antisense primary transcript, siRNA, stRNA, small subunit rRNA, large subunit rRNA, rRNA
5S, rRNA 28S, ncRNA, repeat region, dispersed repeat, spliceosomal intron, insertion, EST match, transcript, nuclease sensitive site,
deletion junction, golden path, cDNA match, SNP, reagent, oligo, junction, remark, possible base call error, possible assembly error,
experimental result region, gene, tandem repeat, trans splice acceptor site, nucleotide motif, RNA motif, reading frame, ultracontig
""".replace("\n", " ").strip().split(", ")
