"""Block-compressed alignment files of any size, read by many tasks each."""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ALIGNMENTS = "file string, name string, flag int, chrom string, pos long, cigar string, seq string, tags map<string,string>"
# fixed values: letters of the packed formats, and the sizes of a tag's numbers
OPERATIONS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_SIZES = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
_PAIRS = [a + b for a in BASES for b in BASES]
#: Rows handed on at once, bytes of a block's head that begin every block of a file alike, consecutive records that must be
#: sound where reading begins inside a file, and the longest record that is looked for there.
ROWS, MARK, CHAIN, LONGEST = 8192, 16, 5, 1 << 26


def tags(raw: bytes) -> dict[str, str]:
    """The tags behind a record's fixed part; arrays of numbers are left out."""
    out, at = {}, 0
    while at + 3 <= len(raw):
        key, kind = raw[at : at + 2].decode("latin-1"), chr(raw[at + 2])
        at += 3
        if kind == "A":
            out[key], at = chr(raw[at]), at + 1
        elif kind in _SIZES:
            n = struct.calcsize(_SIZES[kind])
            out[key], at = str(struct.unpack_from(_SIZES[kind], raw, at)[0]), at + n
        elif kind in "ZH":
            end = raw.index(b"\0", at)
            out[key], at = raw[at:end].decode("utf-8", "replace"), end + 1
        elif kind == "B":
            n = struct.unpack_from("<i", raw, at + 1)[0]
            at += 5 + n * struct.calcsize(_SIZES[chr(raw[at])])
        else:
            return out
    return out


def header(data: bytes) -> tuple[list[str], int] | None:
    """The references' names and where records begin; None if data ends before."""
    if data[:4] != b"BAM\1"[: len(data[:4])]:
        raise ValueError("no BAM file")
    try:
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        n, names = struct.unpack_from("<i", data, at)[0], []
        at += 4
        for _ in range(n):
            size = struct.unpack_from("<i", data, at)[0]
            if at + 8 + size > len(data):
                return None
            names.append(data[at + 4 : at + 3 + size].decode())
            at += 8 + size
    except struct.error:
        return None
    return names, at


def record(raw: bytes, names: list[str]) -> tuple:
    """(name, flag, chrom, pos, cigar, seq, tags) of a record without its size; pos counts from 1, 0 where unplaced."""
    ref, pos, n_name, _, _, n_cigar, flag, n_seq = struct.unpack_from("<iiBBHHHi", raw)
    at = 32 + n_name
    cigar = "".join([f"{x >> 4}{OPERATIONS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", raw, at)])
    name, at = raw[32 : at - 1].decode("latin-1"), at + 4 * n_cigar
    end = at + (n_seq + 1) // 2
    seq = "".join([_PAIRS[b] for b in raw[at:end]])[:n_seq]
    return name, flag, names[ref] if ref >= 0 else None, pos + 1, cigar or "*", seq, tags(raw[end + n_seq :])


def inflated(row: bytes) -> bytes:
    """The content of a block from which the head's first MARK bytes are taken off."""
    if len(row) < 10 or struct.unpack_from("<H", row)[0] + 1 != len(row) + MARK:
        raise ValueError("a block doesn't have the size that its head says")
    out = zlib.decompress(row[2:-8], -15)
    if (zlib.crc32(out), len(out)) != struct.unpack_from("<II", row, len(row) - 8):
        raise ValueError("a block doesn't have the checksum that its tail says")
    return out


def first_record(data: bytes, n_refs: int, ended: bool) -> int | None:
    """The first place in data from which CHAIN sound records follow each other, or as many as there are if the data has ended
    (the last may be cut off); None if there is none."""
    n = len(data) - 36
    if n <= 0:
        return None
    raw = np.frombuffer(data, np.uint8)
    byte = lambda k: raw[k : k + n].astype(np.int64)
    number = lambda k: byte(k) | byte(k + 1) << 8 | byte(k + 2) << 16 | (byte(k + 3) ^ 128) - 128 << 24
    size, ref, pos, n_name, n_cigar, n_seq, mate, mate_pos = number(0), number(4), number(8), byte(12), byte(16) | byte(17) << 8, number(20), number(24), number(28)
    least = 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq
    sound = (size >= least) & (size < LONGEST) & (ref >= -1) & (ref < n_refs) & (mate >= -1) & (mate < n_refs) & (pos >= -1) & (mate_pos >= -1) & (n_name > 1) & (n_seq >= 0)
    names_end = np.arange(n) + 35 + n_name
    sound &= raw[np.minimum(names_end, len(raw) - 1)] == 0

    def named(at: int) -> bool:
        name = data[at + 36 : at + 35 + int(n_name[at])]
        return all(32 < c < 127 for c in name)

    for start in np.flatnonzero(sound).tolist():
        at, chain = start, 0
        while at < n and sound[at] and named(at) and chain < CHAIN:
            at, chain = at + 4 + int(size[at]), chain + 1
        if chain == CHAIN or ended and chain and (at >= n):
            return start
    return None


class Scan:
    """The records of one split: its blocks are put in one by one, and it says which bytes belong to its neighbours."""

    def __init__(self, names: list[str], begins: bool):
        self.names, self.begins, self.synced, self.head, self.rest = names, begins, False, b"", b""

    def put(self, content: bytes, ended: bool = False) -> Iterator[bytes]:
        self.rest += content
        if not self.synced:
            if self.begins:
                found = header(self.rest)
                at = found[1] if found else None
            else:
                at = first_record(self.rest, len(self.names), ended)
            if at is None:
                return
            self.synced, self.head, self.rest = True, b"" if self.begins else self.rest[:at], self.rest[at:]
        at, data = 0, self.rest
        while at + 4 <= len(data) and (end := at + 4 + struct.unpack_from("<i", data, at)[0]) <= len(data):
            yield data[at + 4 : end]
            at = end
        self.rest = data[at:]


def _splits(batches, names: dict[str, list[str]]) -> Iterator[tuple[str, int, Scan, Iterator[bytes]]]:
    """(file, start, scan, records) for each split in turn; records must be used up before the next one is asked for."""
    rows = ((f, s, v) for b in batches for f, s, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True))
    row = next(rows, None)
    while row is not None:
        file, start = row[:2]
        scan = Scan(names[file], start == 0)

        def found(file=file, start=start, scan=scan):
            nonlocal row
            while row is not None and row[:2] == (file, start):
                body = row[2].as_py()
                if body:
                    yield from scan.put(inflated(body))
                row = next(rows, None)
            if not scan.synced:
                yield from scan.put(b"", True)

        yield file, start, scan, found()


def _rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of (file, record's fields)."""
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
    fields = [x.split()[0] for x in ALIGNMENTS.split(", ")]
    some: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*some, strict=True)]
        columns[-1] = [list(t.items()) for t in columns[-1]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], fields)

    for row in found:
        some.append(row)
        if len(some) == ROWS:
            yield batch()
            some.clear()
    if some:
        yield batch()


def _head(spark: SparkSession, file: str, n: int) -> bytes:
    """The first bytes of a file, wherever the session can read it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def _reference_names(spark: SparkSession, file: str) -> list[str]:
    """From the blocks at the file's start, as many as its header takes."""
    n = 1 << 16
    while True:
        raw, data = _head(spark, file, n), b""
        at = 0
        while at + 18 <= len(raw) and (end := at + struct.unpack_from("<H", raw, at + MARK)[0] + 1) <= len(raw):
            data += inflated(raw[at + MARK : end])
            at = end
        if found := header(data):
            return found[0]
        if len(raw) < n:
            raise ValueError(f"{file} ends in its header")
        n *= 4


def _blocked(spark: SparkSession, files: list[str], mark: bytes) -> DataFrame:
    """The records of files whose blocks all begin with mark."""
    names = {f: _reference_names(spark, f) for f in files}
    # the text source splits a file wherever its separator stands, so a row is a block and any file system will do
    rows = spark.read.option("encoding", "ISO-8859-1").option("lineSep", mark.decode("latin-1")).text(files)
    blocks = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))

    def inside(batches):
        return _rows((file, *record(r, scan.names)) for file, _, scan, found in _splits(batches, names) for r in found)

    def edges(batches):
        for file, start, scan, found in _splits(batches, names):
            for _ in found:
                pass
            yield pa.RecordBatch.from_pydict({"file": [file], "start": pa.array([start], pa.int64()), "synced": [scan.synced], "head": [scan.head], "rest": [scan.rest]})

    def across(key, table):
        table, file = table.sort_by([("start", "ascending"), ("part", "ascending")]), key[0].as_py()
        scan = Scan(names[file], False)
        scan.synced = True
        found = [(file, *record(r, scan.names)) for r in scan.put(b"".join(table.column("bytes").to_pylist()))]
        if scan.rest:
            raise ValueError(f"{file}: records around byte {table.column('start')[0].as_py()} can't be joined; the file is cut off or damaged")
        return pa.Table.from_batches(list(_rows(iter(found))), schema) if found else schema.empty_table()

    schema = pa.schema([(f, t) for f, t in zip([x.split()[0] for x in ALIGNMENTS.split(", ")], [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())], strict=True)])
    ends = blocks.mapInArrow(edges, "file string, start long, synced boolean, head binary, rest binary")
    place = F.sum(F.col("synced").cast("long")).over(Window.partitionBy("file").orderBy("start"))
    # what lies before a split's first record ends the run of the split before; a split without any is all middle
    parts = F.array(F.struct((F.col("at") - F.col("synced").cast("long")).alias("run"), F.lit(0).alias("part"), F.col("head").alias("bytes")), F.struct(F.col("at").alias("run"), F.lit(1).alias("part"), F.col("rest").alias("bytes")))
    pieces = ends.withColumn("at", place).select("file", "start", F.explode(parts).alias("x")).select("file", "start", "x.*").where(F.length("bytes") > 0)
    return blocks.mapInArrow(inside, ALIGNMENTS).unionByName(pieces.groupBy("file", "run").applyInArrow(across, ALIGNMENTS))


def _whole(spark: SparkSession, files: list[str]) -> DataFrame:
    """The records of files that aren't made of blocks: a file of 2 GB at most, in one task."""

    def records(content: bytes) -> Iterator[tuple]:
        with gzip.open(io.BytesIO(content)) as stream:
            data = stream.read()
        names, at = header(data)
        while at + 4 <= len(data):
            end = at + 4 + struct.unpack_from("<i", data, at)[0]
            yield record(data[at + 4 : end], names)
            at = end

    def read(batches):
        return _rows((file, *r) for b in batches for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True) for r in records(content.as_py()))

    return spark.read.format("binaryFile").load(files).select("path", "content").repartition("path").mapInArrow(read, ALIGNMENTS)


def bam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The records of BAM files: file, name, flag, chrom, pos (from 1; 0 if unplaced), cigar, seq, tags.

    A file made of compressed blocks is split like text: each task finds the next block after its first byte and there the first
    place from which sound records follow each other. What a record has on both sides of a split's border is put
    together from the two splits' edges, in a second pass that only counts through; were a border found at a wrong place, the edges
    wouldn't be whole records, and that is an error. spark.sql.files.maxPartitionBytes sets the size of a split.
    Files compressed as one stream are read by one task each, up to 2 GB. The driver reads each file's header only."""
    files = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    kinds: dict[bytes, list[str]] = {}
    for f in files:
        mark = _head(spark, f, MARK)
        kinds.setdefault(mark if mark[:4] == b"\x1f\x8b\x08\x04" and mark[12:] == b"BC\2\0" else b"", []).append(f)
    if not kinds:
        return spark.createDataFrame([], ALIGNMENTS)
    out = None
    for mark, some in kinds.items():
        df = _blocked(spark, some, mark) if mark else _whole(spark, some)
        out = df if out is None else out.unionByName(df)
    return out
