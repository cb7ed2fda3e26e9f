"""Box files, label files and logs as text, one file per tile or patch where that form is wanted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.functions.scalars import half_even

LEGACY_CLASSES = (None, "enclosure", "barrow", "ringfort")  # fixed values: class numbers of the older models


def small_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Text files under a folder as rows: file_id (stable hash of the path), file_path, content.

    The engine passes over files of no bytes, as the box reader does.
    """
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return f.select(F.xxhash64("path").alias("file_id"), F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("content"))


def box_file_name(stem: Column, label: Column) -> Column:
    return F.concat(stem, F.lit("_"), label, F.lit("_bounding_boxes.txt"))


def legacy_label(number: Column) -> Column:
    """Class name of an older model's class number; 0 and unknown numbers are null."""
    return F.element_at(F.create_map(*[F.lit(v) for k, c in enumerate(LEGACY_CLASSES) if c for v in (k, c)]), number)


def legacy_box_text(boxes: DataFrame) -> DataFrame:
    """`line` in the older form: rounded pixels, class, plain score, no georeference."""
    px = [half_even(F.col(c)).cast("string") for c in ("x0", "y0", "x1", "y1")]
    return boxes.withColumn("line", F.concat_ws(" ", *px, "label", F.col("score").cast("string")))


def write_texts(files: DataFrame, folder: str, name: str = "name", text: str = "text") -> DataFrame:
    """Write each row as a file of its own, empty texts too; gives name and n_bytes. Null texts are written empty.

    Runs when the result is read. This is the interchange form; masses of such
    files are better kept as a table or packed by `operators.archive`.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        plain = folder.removeprefix("file:") if folder.startswith("file:") else folder
        where, base = fs.FileSystem.from_uri(plain) if "://" in plain else (fs.LocalFileSystem(), plain)
        for b in batches:
            out = []
            for n, t in zip(b[name], b[text], strict=True):
                at = f"{base}/{n}"
                where.create_dir(at.rpartition("/")[0], recursive=True)
                body = (t or "").encode()
                with where.open_output_stream(at) as f:
                    f.write(body)
                out.append((n, len(body)))
            yield pd.DataFrame(out, columns=["name", "n_bytes"])

    return files.select(name, text).mapInPandas(run, "name string, n_bytes long")
