"""What the operators of this package share: durable intermediate tables and row keys."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separator of the text operators.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without: it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/quarrymill"


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


#: Shuffle files of a write are of no use once it is done.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go when the query that made them ends, not when the driver's garbage is collected."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write the rows once to the shared folder and read them back.

    Cuts the lineage, so that a lost executor costs a reread and not a recomputation, and pins
    values such as row keys. `forget` deletes what no later step reads.
    """
    path = new_dir(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*written: DataFrame) -> None:
    """Delete what `materialise` wrote for these frames. No frame made from them may be run afterwards."""
    for df in written:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path of any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def free_name(df: DataFrame, base: str) -> str:
    """base, or base with underscores where the frame already has that column (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """A unique long for each row.

    It is a function of the input's partitions and the order in them, so the input must be
    replayable (files or a written table), which every caller here guarantees or states.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def partitions(spark: SparkSession, factor: float = 1.0) -> int:
    return max(1, round(int(spark.conf.get("spark.sql.shuffle.partitions")) * factor))
