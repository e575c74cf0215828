"""Readers of SAM text and BAM files."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

from tidespan.functions.alignments import UNMAPPED, has_flag, reference_length, sample_name
from tidespan.schema import ALIGNMENTS, REFS
from tidespan.sources.files import has_files, list_files, open_file, replacing_file
from tidespan.sources.regions import _lines, _number

_COLUMNS = [c.split()[0] for c in ALIGNMENTS.split(", ")]


def read_sam_refs(spark: SparkSession, path: str) -> DataFrame:
    """The reference dictionary of a SAM text: tid, name, length in the header's order."""
    from tidespan.sources.regions import _numbered

    head = _lines(spark, path).where(F.col("line").startswith("@SQ"))
    tag = lambda t: F.regexp_extract("line", rf"\t{t}:([^\t]*)", 1)
    rows = head.select(tag("SN").alias("name"), _number(tag("LN")).alias("length"), "place")
    return _numbered(rows.groupBy("name", "length").agg(F.min("place").alias("place")))


def read_sam(spark: SparkSession, path: str, refs: DataFrame | None = None) -> DataFrame:
    """Alignments of SAM texts; ``tid`` follows ``refs`` (default: the header's dictionary), null for none.

    The sample is the file's name up to its first dot. ``stop`` is the start plus the
    reference length of the CIGAR, at least one position for a placed read.
    """
    return parse_sam(_lines(spark, path), refs if refs is not None else read_sam_refs(spark, path))


def stream_sam(spark: SparkSession, path: str, refs: DataFrame) -> DataFrame:
    """The same as a stream of the files that come into a folder, for ``stream_coverage``."""
    lines = spark.readStream.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"))
    # a dictionary of references is small, and a stream can't number the lines that it came from
    fixed = spark.createDataFrame(refs.select("tid", "name", "length").collect(), REFS)
    return parse_sam(lines, fixed)


def parse_sam(lines: DataFrame, refs: DataFrame) -> DataFrame:
    """Alignments from lines (``line``, ``file``); header lines and those of under 11 fields are left out."""
    data = lines.where(~F.col("line").startswith("@") & (F.col("line") != ""))
    f = F.split("line", "\t")
    rows = data.where(F.size(f) >= 11).select(
        sample_name(F.col("file")).alias("sample"), f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("rname"), (_number(f[3]) - 1).alias("start"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"),
        F.when(f[6] == "=", f[2]).otherwise(f[6]).alias("mate"), (_number(f[7]) - 1).alias("mate_pos"), f[8].cast("bigint").alias("isize"), f[9].alias("seq"), f[10].alias("qual"),
    )
    known = refs.select("tid", "name")
    rows = rows.join(known.select(F.col("tid"), F.col("name").alias("rname")), "rname", "left").join(known.select(F.col("tid").alias("mate_tid"), F.col("name").alias("mate")), "mate", "left")
    span = F.greatest(F.lit(1).cast("bigint"), reference_length(F.col("cigar")))
    return rows.withColumn("stop", F.col("start") + F.when(has_flag(F.col("flag"), UNMAPPED), F.lit(1)).otherwise(span)).select(*_COLUMNS)


def register_bam(spark: SparkSession) -> None:
    """Makes ``spark.read.format("bam")`` known.

    Options: ``table`` is ``alignments`` (default) or ``header``; ``columns``, names with commas,
    are all that is decoded (default: all); ``splitBytes`` of compressed blocks make a partition.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamDataSource)


def read_bam(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Alignments of a BAM file or of the BAM files of a folder, local or on any store that pyarrow knows (hdfs, s3, gs).

    With ``columns`` only these are decoded: depth needs no bases and no names.
    """
    register_bam(spark)
    reader = spark.read.format("bam")
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)


#: What depth and counts are made from.
DEPTH_COLUMNS = ["sample", "flag", "tid", "start", "stop", "mapq", "isize"]


def read_bam_refs(spark: SparkSession, path: str) -> DataFrame:
    register_bam(spark)
    return spark.read.format("bam").option("table", "header").load(path)


def refuse_cram(path: str) -> None:
    """CRAM needs a decoder that isn't here."""
    if path.lower().endswith(".cram"):
        raise NotImplementedError("CRAM isn't read; convert it to BAM or SAM")


class BamDataSource(DataSource):
    """BAM files; one partition per file and about ``splitBytes`` of compressed blocks.

    A split starts at the first block from which records can be followed for ``_CHAIN``
    records; blocks are found by their magic and length. Filters on tid, mapq and flag are
    applied to the fixed fields before anything else of a record is decoded; fields are
    decoded for many records at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        if self.options.get("table") == "header":
            return REFS
        wanted = self.options.get("columns")
        fields = {c.split()[0]: c for c in ALIGNMENTS.split(", ")}
        return ", ".join(fields[c.strip()] for c in wanted.split(",")) if wanted else ALIGNMENTS

    def reader(self, schema) -> BamReader:
        return BamReader(self.options, [f.name for f in schema])


class _Split(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop = path, start, stop


class BamReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        path = options.get("path")
        if not path:
            raise ValueError("give a path")
        refuse_cram(path)
        self.header, self.columns = options.get("table") == "header", columns
        self.files = list_files(path, ".bam")
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        kinds = {EqualTo: "eq", EqualNullSafe: "eq", GreaterThan: "gt", GreaterThanOrEqual: "ge", In: "in"}
        for f in filters:
            kind = kinds.get(type(f))
            if not self.header and kind and f.attribute in (("tid",), ("mapq",), ("flag",)) and f.value is not None:
                self.tests.append((f.attribute[0], kind, f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if not self.files:
            return []
        if self.header:
            return [_Split(self.files[0][0], 0, 0)]
        return [_Split(path, at, min(size, at + self.split_bytes)) for path, size in self.files for at in range(0, max(size, 1), self.split_bytes)]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        with open_file(partition.path) as f:
            refs, first = _header(_Blocks(f, 0))
            if self.header:
                yield pa.RecordBatch.from_pydict({"tid": pa.array(range(len(refs)), pa.int32()), "name": [r[0] for r in refs], "length": pa.array([r[1] for r in refs], pa.int64())})
                return
            sample = os.path.basename(partition.path).split(".")[0]
            begin = first if partition.start == 0 else _find_record(f, partition.start, partition.stop, len(refs))
            if begin is None:
                return
            for data, at in _record_starts(_Blocks(f, *begin), partition.stop):
                records = _Records(data, at)
                keep = np.ones(len(at), bool)
                for column, kind, value in self.tests:
                    keep &= _passes(records.fixed(column), kind, value)
                if keep.any():
                    yield (records if keep.all() else _Records(data, at[keep])).batch(self.columns, sample)


def _passes(x: np.ndarray, kind: str, value) -> np.ndarray:
    # a missing tid is -1, which is null in the result
    found = np.isin(x, list(value)) if kind == "in" else x == value if kind == "eq" else x > value if kind == "gt" else x >= value
    return found & (x >= 0)


def _block_size(head: bytes) -> int | None:
    """The whole size of the BGZF block that ``head`` (18 bytes or more) starts, if it does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    at = 12
    while at + 4 <= min(len(head), 12 + extra):
        kind, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and size == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


class _Blocks:
    """The uncompressed bytes from a block on; ``block`` is the file position of the block of the next byte."""

    #: Bytes of the file that are fetched at a time.
    AHEAD = 1 << 20

    def __init__(self, f, block: int, skip: int = 0):
        self.f, self.next, self.data, self.at = f, block, b"", 0
        self.block = block
        self.fetched, self.fetched_at = b"", block
        if skip:
            self.take(skip)

    def _bytes(self, at: int, n: int) -> bytes:
        low = at - self.fetched_at
        if low < 0 or low + n > len(self.fetched):
            self.f.seek(at)
            self.fetched, self.fetched_at, low = self.f.read(max(n, self.AHEAD)), at, 0
        return self.fetched[low : low + n]

    def more(self) -> bool:
        """Goes on to the next block; False at the end."""
        size = _block_size(self._bytes(self.next, 64))
        if size is None:
            return False
        raw = self._bytes(self.next, size)
        extra = struct.unpack_from("<H", raw, 10)[0]
        self.block, self.data, self.at = self.next, zlib.decompress(raw[12 + extra : -8], -15), 0
        self.next += size
        return True

    def take(self, n: int) -> bytes | None:
        """The next ``n`` bytes, or None at the end."""
        parts = []
        while n:
            if self.at == len(self.data):
                if not self.more():
                    return None
                continue
            part = self.data[self.at : self.at + n]
            parts.append(part)
            self.at += len(part)
            n -= len(part)
        return parts[0] if len(parts) == 1 else b"".join(parts)

    def here(self) -> tuple[int, int]:
        """Where the next byte lies: its block and the place in it."""
        return (self.next, 0) if self.at == len(self.data) else (self.block, self.at)


def _header(blocks: _Blocks) -> tuple[list[tuple[str, int]], tuple[int, int]]:
    """The references, and where the first record lies."""
    if blocks.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    blocks.take(struct.unpack("<i", blocks.take(4))[0])
    refs = []
    for _ in range(struct.unpack("<i", blocks.take(4))[0]):
        name = blocks.take(struct.unpack("<i", blocks.take(4))[0])
        refs.append((name.rstrip(b"\x00").decode(), struct.unpack("<i", blocks.take(4))[0]))
    return refs, blocks.here()


_FIXED = struct.Struct("<iiBBHHHiiii")
_CHAIN = 3


def _plausible(body: bytes, size: int, n_refs: int) -> bool:
    if size < 32 or len(body) < 32:
        return False
    tid, pos, name, _, _, cigar, _, bases, mate, mate_pos, _ = _FIXED.unpack_from(body)
    return -1 <= tid < n_refs and -1 <= mate < n_refs and pos >= -1 and mate_pos >= -1 and name >= 1 and bases >= 0 and 32 + name + 4 * cigar + (bases + 1) // 2 + bases <= size and (len(body) < 32 + name or body[31 + name] == 0)


def _find_record(f, start: int, stop: int, n_refs: int) -> tuple[int, int] | None:
    """The first record that begins in a block at or after ``start``, and before ``stop``."""
    f.seek(start)
    window = f.read(stop - start + (1 << 17))
    at = window.find(b"\x1f\x8b\x08\x04")
    while 0 <= at and start + at < stop:
        size = _block_size(window[at : at + 64])
        after = at + (size or 0)
        if size and (after >= len(window) or _block_size(window[after : after + 64])):
            try:
                probe = _Blocks(f, start + at)
                first = probe.take(1)
                if first is not None:
                    length = len(probe.data)
                    for offset in range(length):
                        if _follows(_Blocks(f, start + at, offset), n_refs):
                            return start + at, offset
            except (zlib.error, struct.error):
                pass
        at = window.find(b"\x1f\x8b\x08\x04", at + 1)
    return None


def _follows(blocks: _Blocks, n_refs: int) -> bool:
    for i in range(_CHAIN):
        head = blocks.take(4)
        if head is None:
            return i > 0
        size = struct.unpack("<i", head)[0]
        if not 32 <= size < 1 << 28:
            return False
        body = blocks.take(size)
        if body is None or not _plausible(body, size, n_refs):
            return False
    return True


#: Uncompressed bytes that are decoded at a time.
_CHUNK = 4 << 20


def _record_starts(blocks: _Blocks, stop: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Bytes and where in them the bodies of records begin, for the records that begin in a block before file position ``stop``."""
    held = blocks.data[blocks.at :]
    if blocks.block >= stop and held:
        return
    more = True
    while more:
        parts, size = [held], len(held)
        while size < _CHUNK and blocks.next < stop and (more := blocks.more()):
            parts.append(blocks.data)
            size += len(blocks.data)
        more = more and blocks.next < stop
        data = b"".join(parts)
        starts, at = _walk(data)
        held = data[at:]
        if starts:
            yield data, np.array(starts)
    if held:
        # the record that the last block begins ends in a later one
        while (need := 4 if len(held) < 4 else 4 + struct.unpack_from("<i", held)[0]) > len(held):
            if not blocks.more():
                return
            held += blocks.data
        yield held[:need], np.array([4])


def _walk(data: bytes) -> tuple[list[int], int]:
    starts, at, end = [], 0, len(data)
    size_at = struct.Struct("<i").unpack_from
    while at + 4 <= end:
        after = at + 4 + size_at(data, at)[0]
        if after > end:
            break
        starts.append(at + 4)
        at = after
    return starts, at


_FIELDS = np.dtype([("tid", "<i4"), ("pos", "<i4"), ("n_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("n_seq", "<i4"), ("mate_tid", "<i4"), ("mate_pos", "<i4"), ("isize", "<i4")])
_OPERATIONS = np.frombuffer(b"MIDNSHP=X???????", np.uint8)
_SPANS = np.isin(_OPERATIONS, np.frombuffer(b"MDN=X", np.uint8))
_BASES = np.frombuffer(b"=ACMGRSVTWYHKDBN", np.uint8)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _strings(chars: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings of ``lengths`` from the characters of all; ``*`` for an empty one."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    found = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(chars)))
    return pc.if_else(pa.array(lengths == 0), "*", found)


class _Records:
    """Records whose bodies begin at ``at`` in ``data``, decoded a column at a time."""

    def __init__(self, data: bytes, at: np.ndarray):
        self.data, self.at = np.frombuffer(data, np.uint8), at
        self.fields = np.ascontiguousarray(self.data[at[:, None] + np.arange(_FIELDS.itemsize)]).view(_FIELDS).ravel()
        self.cigar_at = at + 32 + self.fields["n_name"]
        self.seq_at = self.cigar_at + 4 * self.fields["n_cigar"].astype(np.int64)
        self.qual_at = self.seq_at + (self.fields["n_seq"].astype(np.int64) + 1) // 2

    def fixed(self, name: str) -> np.ndarray:
        return self.fields["pos" if name == "start" else name]

    def _operations(self) -> np.ndarray:
        n = self.fields["n_cigar"].astype(np.int64)
        return np.ascontiguousarray(self.data[_ranges(self.cigar_at, 4 * n)]).view("<u4")

    def column(self, name: str, sample: str) -> pa.Array:
        fields = self.fields
        if name == "sample":
            return pa.array([sample] * len(self.at), pa.string())
        if name in ("tid", "mate_tid"):
            return pa.array(fields[name], pa.int32(), mask=fields[name] < 0)
        if name in ("flag", "mapq"):
            return pa.array(fields[name].astype(np.int32))
        if name in ("start", "mate_pos", "isize"):
            return pa.array(self.fixed(name).astype(np.int64))
        if name == "stop":
            operations, n = self._operations(), fields["n_cigar"].astype(np.int64)
            span = np.bincount(np.repeat(np.arange(len(n)), n), weights=(operations >> 4) * _SPANS[operations & 15], minlength=len(n)).astype(np.int64)
            return pa.array(fields["pos"] + np.where(fields["flag"] & UNMAPPED, 1, np.maximum(1, span)))
        if name == "qname":
            n = fields["n_name"].astype(np.int64) - 1
            return _strings(self.data[_ranges(self.at + 32, n)], n)
        if name == "cigar":
            operations, n = self._operations(), fields["n_cigar"].astype(np.int64)
            parts = [f"{x}{chr(o)}" for x, o in zip((operations >> 4).tolist(), _OPERATIONS[operations & 15].tolist())]
            ends = np.cumsum(n).tolist()
            return pa.array(["".join(parts[b - k : b]) or "*" for b, k in zip(ends, n.tolist())], pa.string())
        n = fields["n_seq"].astype(np.int64)
        if name == "seq":
            within = _ranges(np.zeros(len(n), np.int64), n)
            packed = self.data[np.repeat(self.seq_at, n) + within // 2]
            return _strings(_BASES[np.where(within % 2 == 0, packed >> 4, packed & 15)], n)
        # qualities that weren't kept are bytes of 255
        lost = (n > 0) & (self.data[np.minimum(self.qual_at, len(self.data) - 1)] == 255)
        n = np.where(lost, 0, n)
        return _strings(self.data[_ranges(self.qual_at, n)] + np.uint8(33), n)

    def batch(self, columns: list[str], sample: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.column(c, sample) for c in columns], names=columns)


def write_bam(reads: DataFrame, refs: DataFrame, path: str) -> None:
    """BAM files of reads (the columns of ``read_bam``, in the frame's order) in a folder, one for each partition.

    Each file has the whole header and is moved into place when it is complete, so that a task
    that runs twice leaves one. The reference dictionary goes to every task. A folder that
    has BAM files already isn't written to; an empty frame leaves one file without records.
    """
    if has_files(path, ".bam"):
        raise FileExistsError(path)
    known = [(r["name"], r["length"]) for r in refs.orderBy("tid").select("name", "length").collect()]
    shipped = reads.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}.bam"
        with replacing_file(path, name, str(context.taskAttemptId())) as out:
            body = bytearray(_bam_header(shipped.value))
            for batch in batches:
                for row in batch.to_pylist():
                    body += _packed_record(row)
                    while len(body) >= _BLOCK:
                        out.write(_bgzf(bytes(body[:_BLOCK])))
                        del body[:_BLOCK]
            if body:
                out.write(_bgzf(bytes(body)))
            out.write(_bgzf(b""))
        yield pa.RecordBatch.from_pydict({"name": [name]})

    if not reads.select(*(c for c in _COLUMNS if c != "sample")).mapInArrow(run, "name string").count():
        head = _bam_header(known)
        with replacing_file(path, "part-00000.bam", "0") as out:
            for at in range(0, len(head), _BLOCK):
                out.write(_bgzf(head[at : at + _BLOCK]))
            out.write(_bgzf(b""))


#: Bytes of a block that is written; incompressible ones still fit a block's size of 65,536.
_BLOCK = 65_000


def _bgzf(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = packer.compress(raw) + packer.flush()
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(data) + 25) + data + struct.pack("<II", zlib.crc32(raw), len(raw))


def _bam_header(refs: list[tuple[str, int]]) -> bytes:
    text = "".join(f"@SQ\tSN:{name}\tLN:{length}\n" for name, length in refs).encode()
    listed = b"".join(struct.pack("<i", len(name.encode()) + 1) + name.encode() + b"\x00" + struct.pack("<i", length) for name, length in refs)
    return b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs)) + listed


_NIBBLES = {chr(c): i for i, c in enumerate(_BASES)}
_CODES = {chr(c): i for i, c in enumerate(_OPERATIONS[:9])}
_OPERATION = re.compile(r"(\d+)([MIDNSHP=X])")


def _packed_record(row: dict) -> bytes:
    name = (row["qname"] or "*").encode()[:254] + b"\x00"
    operations = [int(n) << 4 | _CODES[o] for n, o in _OPERATION.findall(row["cigar"] or "")]
    seq = "" if row["seq"] in (None, "*") else row["seq"]
    pairs = [_NIBBLES.get(c, 15) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(pairs[::2], pairs[1::2]))
    quality = bytes(ord(c) - 33 for c in row["qual"]) if seq and row["qual"] not in (None, "*") else b"\xff" * len(seq)
    start = -1 if row["start"] is None else row["start"]
    number = lambda c, none: none if row[c] is None else row[c]
    body = _FIXED.pack(number("tid", -1), start, len(name), number("mapq", 255), _bin(start, row["stop"]), len(operations), row["flag"], len(seq), number("mate_tid", -1), number("mate_pos", -1), number("isize", 0))
    body += name + struct.pack(f"<{len(operations)}I", *operations) + packed + quality
    return struct.pack("<i", len(body)) + body


def _bin(start: int, stop: int | None) -> int:
    """The bin of the usual index: the smallest of 16 kb to 512 Mb that holds the read."""
    last = max(start, (stop or start + 1) - 1)
    for level, shift in ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26)):
        if start >> shift == last >> shift:
            return (level + (start >> shift)) & 0xFFFF
    return 0
