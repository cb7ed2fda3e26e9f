"""How plans are cut and stored: shared folder, written stages."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_staged: list[str] = []


def clear_stages(spark: SparkSession) -> int:
    """Delete the stages written so far; call it once their results are stored. Gives their number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _staged:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Only where the session names none and runs on one machine, as in tests, a
    temporary folder is taken and set for this session; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not folder.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = folder.get() if folder.isDefined() else tempfile.mkdtemp(prefix="terraframe-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def held(path: str) -> str:
    """Note a folder that was written, so that `clear_stages` deletes it too."""
    _staged.append(path)
    return path


def tasks(df: DataFrame) -> int:
    """Number of shuffle partitions, for `repartition` before work whose rows are few but costly: with a number given, adaptive plans do not coalesce it."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    The lineage ends there: a lost executor costs a re-read, not a recomputation.
    The size of the files, compressed, lets Catalyst choose joins by what was
    really written; adaptive plans correct it by the rows read.
    """
    spark = df.sparkSession
    path = held(f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that they need no copy of it on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="terraframe-")) / "terraframe.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)
