"""CSV whose quoted fields hold line ends, and gzip files, read by many tasks a file.

Where a record ends can't be told from the middle of a file: a line end counts only outside quotes. But whether a place is inside quotes only depends on the parity of the
quotes before it. So there are two passes:

1. each block of a file counts its quotes; a running sum over a file's blocks (one small row a block) tells for each block whether it begins inside quotes;
2. each block cuts itself into records. What lies before its first record end belongs to a record of the block before, and what lies behind its last one goes on in the next
   block: these fragments, two a block at most, meet by file and are put together.

Blocks of plain files are the splits of Spark's own line reader, so files may be in any store that Spark reaches. Blocks of gzip files are their members: files made
by block compressors or by putting compressed parts together have many. Members are found by their magic bytes, and one only counts if it can be decompressed to its end and its
checksum is right; the index must cover the file without a gap. A file of a single member is one task's work, as nothing in it can be decompressed from the middle.
Gzip files are opened by pyarrow's file systems.

Records go through Spark's CSV parser one by one, in the session's dialect (quotes doubled), so values are the ones that a whole-file read gives. Defined results: empty lines
outside quotes are skipped, line ends inside quotes stay as they are, a record may span any number of blocks, a file without a last line end loses nothing, a file of
a header alone or an empty one has no rows. A quote that is never closed makes the rest of its file one record, as for a whole-file read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.numbering import materialise

#: Kinds of what a block is cut into: a record, or a piece of one that began before it, goes on behind it, or both.
RECORD, HEAD, TAIL, MIDDLE = 0, 1, 2, 3
_READ = 1 << 20
#: Blocks of one read, whose table (a short row each) goes to every task: 128 TB in Spark's splits of 128 MB.
MOST_BLOCKS = 1_000_000


class Cutter:
    """Cuts one block. `feed` takes its bytes in order and gives records; `close` gives what is left."""

    def __init__(self, inside: bool, first: bool):
        self.inside, self.held = inside, []
        self.head = not first  # what comes before the first record end belongs to a record that began before

    def feed(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        begin = 0
        while begin < len(data):
            if self.inside:
                end = data.find(b'"', begin) + 1
                if not end:
                    break
                self.held.append(data[begin:end])
                self.inside, begin = False, end
            else:
                line, quote = data.find(b"\n", begin), data.find(b'"', begin)
                if quote >= 0 and (line < 0 or quote < line):
                    self.held.append(data[begin : quote + 1])
                    self.inside, begin = True, quote + 1
                elif line >= 0:
                    self.held.append(data[begin:line])
                    yield (HEAD if self.head else RECORD), b"".join(self.held)
                    self.held, self.head, begin = [], False, line + 1
                else:
                    break
        if begin < len(data):
            self.held.append(data[begin:])

    def close(self) -> Iterator[tuple[int, bytes]]:
        yield (MIDDLE if self.head else TAIL), b"".join(self.held)


_CUT = "file string, at bigint, first boolean, kind int, record binary"


def _rows(file: str, at: int, cut: list[tuple[int, bytes]], begun: bool) -> pa.RecordBatch:
    """begun: the first of them is the first record of its block."""
    n = len(cut)
    first = [begun and k == 0 for k in range(n)]
    columns = [pa.array([file] * n), pa.array([at] * n, pa.int64()), pa.array(first, pa.bool_()), pa.array([k for k, _ in cut], pa.int32()), pa.array([r for _, r in cut], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["file", "at", "first", "kind", "record"])


def _cut_block(file: str, at: int, inside: bool, parts: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    cutter, held, size, begun = Cutter(inside, at == 0), [], 0, True
    for data in parts:
        for x in cutter.feed(data):
            held.append(x)
            size += len(x[1])
            if size > 4 * _READ:
                yield _rows(file, at, held, begun)
                held, size, begun = [], 0, False
    yield _rows(file, at, held + list(cutter.close()), begun)


def _parities(blocks: DataFrame) -> DataFrame:
    """file, at, quotes -> file, at, inside: whether the block begins inside quotes. Materialised; a row a block."""
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    return materialise(blocks.withColumn("inside", inside))


def _whole(cut: DataFrame) -> DataFrame:
    """Put fragments together: file, first (of its file), record (text). `cut` is read twice."""
    records = cut.where(F.col("kind") == RECORD)
    # A file's fragments, in order: a tail, any number of middles, a head. A record is numbered by the tails up to it.
    order = Window.partitionBy("file").orderBy("at", F.col("kind") == TAIL)
    pieces = cut.where(F.col("kind") != RECORD).withColumn("nth", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    piece = F.struct("at", F.col("kind") == TAIL, "record")
    joined = pieces.groupBy("file", "nth").agg(F.sort_array(F.collect_list(piece)).alias("p"), F.min("at").alias("at"))
    together = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["record"]))
    # A file whose first record isn't over in its first block has it as its first tail.
    begins = cut.where((F.col("at") == 0) & F.col("first") & (F.col("kind") == RECORD)).select("file", F.lit(True).alias("has_first"))
    spanned = joined.join(begins, "file", "left").select("file", (F.col("has_first").isNull() & (F.col("nth") == 1)).alias("first"), together.alias("record"))
    out = records.select("file", ((F.col("at") == 0) & F.col("first")).alias("first"), "record").union(spanned)
    text = F.regexp_replace(F.col("record").cast("string"), "\r$", "")
    return out.select("file", "first", text.alias("record")).where("record <> ''")


def _parsed(records: DataFrame, schema: str, sep: str) -> DataFrame:
    parsed = F.from_csv("record", F.lit(schema), {"sep": sep, "escape": '"', "multiLine": "true"})
    return records.where("not first").select(parsed.alias("r")).select("r.*")


def _schema(spark: SparkSession, path, schema: str | None, sep: str) -> str:
    """The given schema, or the names of the header as strings."""
    if schema:
        return schema
    names = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep).csv(path).columns
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)


def read_csv_blocks(spark: SparkSession, path, schema: str | None = None, sep: str = ",") -> DataFrame:
    """As readers.read_csv, for plain files: each of Spark's splits is cut by a task of its own."""
    meta = F.col("_metadata")
    # Line ends are "\n" alone here, so that what stands before one, and inside quotes, stays.
    lines = spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("at"), "value")
    quotes = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("bigint")
    blocks = _parities(lines.groupBy("file", "at").agg(F.sum(quotes).alias("quotes")))
    if blocks.count() > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} blocks: read fewer files at a time, or larger splits (spark.sql.files.maxPartitionBytes)")
    # Both passes must see the same splits; a block that the first one didn't see fails the query, which can then be run again.
    known = F.when(F.col("inside").isNull(), F.raise_error(F.lit("splits changed between two passes")).cast("boolean")).otherwise(F.col("inside"))
    marked = lines.join(F.broadcast(blocks.select("file", "at", "inside")), ["file", "at"], "left").withColumn("inside", known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(k).to_pylist() for k in range(4)))

        stream = rows()
        row = next(stream, None)
        while row:
            file, at, inside = row[0], row[1], row[3]

            def parts() -> Iterator[bytes]:
                nonlocal row
                while row and row[0] == file and row[1] == at:
                    yield row[2].encode() + b"\n"
                    row = next(stream, None)

            yield from _cut_block(file, at, inside, parts())

    cut = materialise(marked.select("file", "at", "value", "inside").mapInArrow(run, _CUT))
    return _parsed(_whole(cut), _schema(spark, path, schema, sep), sep)


def _opened(uri: str):
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    store, at = fs.FileSystem.from_uri(uri)
    return store.open_input_file(at)


def inflated(handle, at: int) -> Iterator[bytes | int]:
    """The content of the gzip member at a place, in pieces, and then the place behind it; zlib.error if there is none."""
    handle.seek(at)
    member = zlib.decompressobj(31)
    while not member.eof:
        data = member.unconsumed_tail or handle.read(_READ)
        if not data:
            raise zlib.error("the file ends inside a member")
        piece = member.decompress(data, _READ)
        if piece:
            yield piece
    yield handle.tell() - len(member.unused_data)


def gzip_members(spark: SparkSession, path, span: int = 32 << 20) -> DataFrame:
    """file, at, quotes: the members of gzip files. Each task looks for those that begin in its range of `span` bytes."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    ranges = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(span).cast("bigint"))).alias("begin"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def members(handle, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
        at = begin
        while at < end:
            handle.seek(at)
            window = handle.read(min(_READ, end - at) + 2)
            found = window.find(b"\x1f\x8b\x08")
            if found < 0:
                at += max(1, len(window) - 2)
                continue
            try:
                quotes = 0
                for piece in inflated(handle, at + found):
                    if isinstance(piece, bytes):
                        quotes += piece.count(b'"')
                yield at + found, piece, quotes
                at = piece
            except zlib.error:
                at += found + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, length, begin in zip(*(c.to_pylist() for c in b.columns)):
                with _opened(file) as handle:
                    found = list(members(handle, begin, min(begin + span, length)))
                n = len(found)
                columns = [pa.array([file] * n, pa.string()), pa.array([length] * n, pa.int64()), *(pa.array([x[k] for x in found], pa.int64()) for k in range(3))]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "length", "at", "stop", "quotes"])

    found = ranges.repartition(parts, "file", "begin").mapInArrow(run, "file string, length bigint, at bigint, stop bigint, quotes bigint")
    # A range's first find can lie inside a member that began before it, if that holds a gzip file as it is: only the chain from 0 counts.
    own = Window.partitionBy("file").orderBy("at")
    upto = F.coalesce(F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chain = found.withColumn("upto", upto).where("at >= upto")
    hole = (F.col("at") != F.col("upto")) | (F.lead("at").over(own).isNull() & (F.col("stop") != F.col("length")))
    broken = F.raise_error(F.concat(F.lit("not gzip members alone: "), F.col("file"))).cast("bigint")
    return chain.select("file", "at", F.when(hole, broken).otherwise(F.col("quotes")).alias("quotes"))


def read_gzip_csv(spark: SparkSession, path, schema: str | None = None, sep: str = ",", span: int = 32 << 20) -> DataFrame:
    """As readers.read_csv, for gzip files: each member is decompressed and cut by one task, and tasks share a file's members."""
    blocks = _parities(gzip_members(spark, path, span))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, at, inside in zip(*(c.to_pylist() for c in b.columns)):
                with _opened(file) as handle:
                    yield from _cut_block(file, at, inside, (x for x in inflated(handle, at) if isinstance(x, bytes)))

    dealt = blocks.select("file", "at", "inside").repartition(parts, "file", "at")
    cut = materialise(dealt.mapInArrow(run, _CUT))
    return _parsed(_whole(cut), _schema(spark, path, schema, sep), sep)
