"""Indexed archive containers for masses of tiny files, and the records in them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.functions.geometry import NUMBER
from terraframe.plans import stage

BLOCK_BYTES = 8 << 20
MOST_FILES = 1 << 18  # entries of a merged block, for masses of empty files
_BLOCKS = "block_id string, payload binary, entries array<struct<file_id: bigint, path: string, offset: bigint, length: bigint, crc32: bigint>>"
_FILES = "file_id bigint, path string, content binary, intact boolean"


def pack(df: DataFrame, file_id: str = "file_id", path: str = "path", content: str = "content",
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pack files into blocks of about `block_bytes`: (block_id, payload, entries).

    `content` is text (stored as UTF-8) or binary; `entries` lists file id, path,
    offset, length and CRC-32 of each file. Every row is stored, also empty ones
    and repeated paths; a null content is stored as an entry of length null, a
    null path stays null. A file larger than the block size gets a block alone.

    Files are packed along each input partition into a written stage, which reads
    them once; then the last, under-full blocks of the partitions are merged, so
    that the number of blocks follows the bytes and not the input split. Only
    those last blocks are shuffled, at most one per partition.
    """
    body = F.col(content)
    if dict(df.dtypes)[content] == "string":
        body = F.encode(body, "UTF-8")
    rows = df.select(F.col(file_id).cast("long").alias("i"), F.col(path).cast("string").alias("p"), body.alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(last: bool) -> pa.RecordBatch:
            b = _block(parts, held)
            return pa.RecordBatch.from_arrays([*b.columns, *[pa.array([x]) for x in (at, len(held), part, last)]], names=[*b.schema.names, "bytes", "files", "part", "last"])

        part = TaskContext.get().partitionId()
        parts: list[bytes] = []
        held: list[dict] = []
        at = 0
        for batch in batches:
            for i, p, c in zip(*[col.to_pylist() for col in batch.columns], strict=True):
                if held and at + len(c or b"") > block_bytes:
                    yield block(False)
                    parts, held, at = [], [], 0
                held.append({"file_id": i, "path": p, "offset": at, "length": None if c is None else len(c), "crc32": None if c is None else zlib.crc32(c)})
                if c:
                    parts.append(c)
                    at += len(c)
        if held:
            yield block(True)

    def planned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = at = files = 0
        for batch in batches:
            into = []
            for size, k in zip(batch["bytes"], batch["files"], strict=True):
                if files and (at + size > block_bytes or files + k > MOST_FILES):
                    n, at, files = n + 1, 0, 0
                at, files = at + size, files + k
                into.append(n)
            yield pd.DataFrame({"part": batch["part"], "into": into})

    def merged(blocks: pa.Table) -> pa.Table:
        parts, held, at = [], [], 0
        for b in blocks.sort_by("part").select(["payload", "entries", "bytes"]).to_pylist():
            held += [{**e, "offset": e["offset"] + at} for e in b["entries"]]
            parts.append(b["payload"])
            at += b["bytes"]
        return pa.Table.from_batches([_block(parts, held)])

    packed = stage(rows.mapInArrow(run, f"{_BLOCKS}, bytes bigint, files bigint, part bigint, last boolean"), "blocks")
    last = packed.filter("last")
    # one short row per input partition, planned in one task
    plan = last.select("part", "bytes", "files").repartition(1).sortWithinPartitions("part").mapInPandas(planned, "part bigint, into bigint")
    full = packed.filter("not last").select("block_id", "payload", "entries")
    return full.unionByName(last.join(plan, "part").groupBy("into").applyInArrow(merged, _BLOCKS))


def _block(parts: list[bytes], held: list[dict]) -> pa.RecordBatch:
    body = b"".join(parts)
    entry = pa.struct([("file_id", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("crc32", pa.int64())])
    columns = [pa.array([f"{held[0]['file_id']}-{len(held)}-{zlib.crc32(body):08x}"]), pa.array([body], pa.binary()), pa.array([held], pa.list_(entry))]
    return pa.RecordBatch.from_arrays(columns, names=["block_id", "payload", "entries"])


def write_archive(df: DataFrame, target: str, **kw) -> DataFrame:
    """Pack df and write the blocks as container files to `target`; gives the archive as read back."""
    pack(df, **kw).write.mode("overwrite").option("compression", "zstd").parquet(target)
    return df.sparkSession.read.schema(_BLOCKS).parquet(target)


def archive_index(blocks: DataFrame) -> DataFrame:
    """(path, file_id, block_id, offset, length, crc32) of each stored file; payloads are not read."""
    return blocks.select("block_id", F.explode("entries").alias("e")).select(
        "e.path", "e.file_id", "block_id", "e.offset", "e.length", "e.crc32")


def unpack(blocks: DataFrame) -> DataFrame:
    """The stored files again, byte for byte: (file_id, path, content, intact).

    Blocks are read in parallel; `intact` tells whether the checksum holds
    (null content counts as intact).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, entries in zip(batch.column(0), batch.column(1), strict=True):
                body, out = memoryview(body.as_buffer()), []
                for e in entries.as_py():
                    c = None if e["length"] is None else bytes(body[e["offset"]:e["offset"] + e["length"]])
                    out.append((e["file_id"], e["path"], c, c is None or zlib.crc32(c) == e["crc32"]))
                kinds = (pa.int64(), pa.string(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["file_id", "path", "content", "intact"])

    return blocks.select("payload", "entries").mapInArrow(run, _FILES)


def lookup(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Files of the archive whose path is in `paths`; only blocks that hold one are unpacked."""
    want = paths.select("path").distinct()
    ids = archive_index(blocks).join(want, "path", "left_semi").select("block_id").distinct()
    return unpack(blocks.join(ids, "block_id", "left_semi")).join(want, "path", "left_semi")


BOX_FIELDS = ("x0", "y0", "x1", "y1", "label", "score", "epsg", "res", "x_min", "y_max")
_RECORD = r"^[ \t]*" + r"[ \t]+".join(r"[^ \t\r]+" if n == "label" else NUMBER for n in BOX_FIELDS) + r"[ \t\r]*$"


def box_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """Box records of prediction texts: file_id, line_no and the ten fields.

    Lines end with LF or CR LF and count from 1, blank ones too; a byte-order
    mark is no part of the first. A record has ten fields separated by blanks or
    tabs of which all but the label are finite decimal numbers; other lines
    (headers, cut-off lines, unreadable values) and null contents give no row.
    """
    text = F.col(content)
    if dict(files.dtypes)[content] == "binary":
        text = F.decode(text, "UTF-8")
    text = F.regexp_replace(text, "^\ufeff", "")
    lines = files.select("file_id", F.posexplode(F.split(text, "\r?\n")).alias("n", "line")).filter(F.col("line").rlike(_RECORD))
    f = F.split(F.regexp_replace("line", r"^[ \t]+|[ \t\r]+$", ""), r"[ \t]+")
    rec = lines.select("file_id", (F.col("n") + 1).cast("long").alias("line_no"), f.alias("f"))
    return rec.select("file_id", "line_no", *[F.col("f")[i].alias(n) if n == "label" else F.col("f")[i].cast("double").alias(n) for i, n in enumerate(BOX_FIELDS)])


def distinct_boxes(records: DataFrame) -> DataFrame:
    """One row per record: label (case ignored) and all numbers equal; the smallest file_id, then line_no, stays.

    One aggregation with map-side combine, so a record repeated in a third of
    all files costs one row per task.
    """
    nums = [c for c in BOX_FIELDS if c != "label"]
    return records.groupBy(F.lower("label").alias("key"), *nums).agg(
        F.min(F.struct("file_id", "line_no")).alias("first"), F.min_by("label", F.struct("file_id", "line_no")).alias("label"),
        F.count(F.lit(1)).alias("copies"),
    ).select("first.file_id", "first.line_no", *BOX_FIELDS, "copies")
