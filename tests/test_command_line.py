"""The command line end to end on a small SAM text."""

import pytest

from tidespan.__main__ import main
from tidespan.sources.sam import read_sam, read_sam_refs, write_bam

HEADER = "@SQ\tSN:seq1\tLN:1000\n@SQ\tSN:seq2\tLN:1000\n@SQ\tSN:seq0\tLN:1000\n"
_STARTS = [9] * 5 + [189] * 2 + [200] * 2 + [250] * 2 + [299, 379, 400, 650]


@pytest.fixture()
def files(tmp_path):
    rows = [(0, "seq1", a) for a in _STARTS] + [(f, "seq2", 499) for f in (0, 16) for _ in range(5)]
    text = HEADER + "".join(f"r{i}\t{f}\t{c}\t{a + 1}\t60\t100M\t*\t0\t0\t*\t*\n" for i, (f, c, a) in enumerate(rows))
    for name in ("mini.sam", "other.sam"):
        (tmp_path / name).write_text(text)
    (tmp_path / "t.bed").write_text("seq1\t5\t112\tinclude_5\nseq1\t410\t532\toverlap_2\nseq1\t800\t950\tempty1_0\nseq2\t300\t532\tshared1_10\nseq2\t566\t769\tshared2_10\nseq0\t100\t200\tnull_0\n")
    return tmp_path


def _run(capsys, *args):
    main([str(a) for a in args])
    return capsys.readouterr().out.splitlines()


def test_coverage_and_report(spark, capsys, files):
    lines = _run(capsys, "coverage", files / "mini.sam", "-r", files / "t.bed", "-o", files / "report", "--skip-output")
    assert lines == []
    report = [r["value"].split("\t") for r in spark.read.text(f"{files}/report").collect()]
    assert ["interval", "mini_bases", "mini_mean", "mini_min", "mini_max", "length"] in report and len(report) == 7
    lines = _run(capsys, "coverage", files / "mini.sam")
    assert len(lines) == 21 and lines[1] == "seq1\t9\t109\t5" and lines[-1] == "seq0\t0\t1000\t0"
    assert _run(capsys, "coverage", files / "mini.sam", "-w", 250)[:5] == ["fixedStep chrom=seq1 start=1 step=250 span=250", "5", "6", "1", "0"]
    assert {x.split("\t")[3] for x in _run(capsys, "coverage", files / "mini.sam", "-q", "2,4")} == {"0-1", "2-3", "4-"}
    with pytest.raises(SystemExit):
        main(["coverage", str(files / "mini.sam"), str(files / "other.sam")])


def test_counts(spark, capsys, files):
    for line in _run(capsys, "counts", files / "mini.sam", "-r", files / "t.bed"):
        name, count = line.split("\t")
        assert name.rpartition("_")[2] == count
    assert [x.split("\t")[0] for x in _run(capsys, "counts", files / "mini.sam", "-r", files / "t.bed")][-1] == "null_0"
    both = _run(capsys, "counts", files / "mini.sam", files / "other.sam", "-r", files / "t.bed")
    assert both[0] == "#Feature\tmini\tother" and "include_5\t5\t5" in both
    assert _run(capsys, "refcounts", files / "mini.sam") == ["ViralSequence\tmini", "seq0\t0", "seq1\t15", "seq2\t10"]


def test_other_commands(spark, capsys, files):
    assert _run(capsys, "regions", "-r", files / "t.bed")[0] == "seq0\t100\t200\tnull_0"
    assert "[0] 5 112 include_5" in _run(capsys, "regions", files / "mini.sam", "-r", files / "t.bed")
    assert _run(capsys, "regions", files / "mini.sam", "-r", files / "t.bed", "-a")[0] == "seq1\t0\t5"
    (files / "c.bed").write_text("seq1\t0\t100\t2\nseq9\t0\t5\t1\n")
    assert "include_5\t190" in _run(capsys, "totarget", files / "c.bed", "-r", files / "t.bed")
    assert _run(capsys, "lowcov", files / "mini.sam", files / "other.sam", "--max", 0)[0] == "seq1\t0\t9\t2"


def test_standard_input_and_bam(spark, capsys, files, monkeypatch):
    whole = _run(capsys, "coverage", files / "mini.sam")
    with open(files / "mini.sam", "rb") as text:
        monkeypatch.setattr("sys.stdin", type("In", (), {"buffer": text}))
        assert _run(capsys, "coverage", "-") == whole
    refs = read_sam_refs(spark, str(files / "mini.sam"))
    write_bam(read_sam(spark, str(files / "mini.sam"), refs).coalesce(1), refs, str(files / "out"))
    assert _run(capsys, "coverage", files / "out" / "part-00000.bam") == whole


def test_older_habits_and_bed_output(spark, capsys, files):
    text = (files / "mini.sam").read_text() + "low\t0\tseq0\t121\t0\t10M\t*\t0\t0\t*\t*\n"
    (files / "low.sam").write_text(text)
    assert "null_0\t1" in _run(capsys, "counts", files / "low.sam", "-r", files / "t.bed")
    assert "null_0\t0" in _run(capsys, "counts", files / "low.sam", "-r", files / "t.bed", "--compat")
    (files / "c.bed").write_text("seq1\t0\t100\t2\n")
    assert "seq1\t5\t112\tinclude_5\t190" in _run(capsys, "totarget", files / "c.bed", "-r", files / "t.bed", "-b")
