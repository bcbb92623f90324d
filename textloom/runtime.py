"""Session, table access and lineage cutting shared by every operator.

``materialize`` is the one way operators cut lineage: it writes parquet into the folder the
cluster names in ``spark.checkpoint.dir`` (shared by all executors, so a lost executor loses
nothing) and reads it back.  Only where the setting is absent, as in tests, a local folder is made.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests, benches and notebooks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(master)
        .appName("textloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a private one only where none is configured."""
    there = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if there:
        return there
    # sparkContext's own setting counts too, for callers of setCheckpointDir()
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    made = "file://" + tempfile.mkdtemp(prefix="textloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once into the shared folder and read it back."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"textloom-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing lazy reads any more (what was made of them is materialized itself)."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/textloom-" in f}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the project's tables, a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Rows of a slim table (a few numbers each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to have at most ``rows`` rows; for materialized tables."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= rows else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for a session."""
    import shutil

    sc = spark.sparkContext
    if getattr(sc, "_textloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="textloom-code-"), "textloom")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
    sc._textloom_shipped = True
