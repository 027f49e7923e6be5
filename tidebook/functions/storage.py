"""Where intermediate results live, and how lineage is cut.

A result that several later jobs read, or that an iteration replaces, is
written once as Parquet into the folder that ``spark.checkpoint.dir`` names.
That folder is shared by the driver and all executors, so a lost executor
loses nothing, and the plan that reads it back starts at a file scan.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one only in local mode with none set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table", session: SparkSession | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it, in
    another session if one is given."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return (session or spark).read.schema(df.schema).parquet(path)


#: Rows that ``spread`` gives to a partition, at most on average, and at least if it can.
SPREAD_ROWS, SPREAD_LEAST = 250_000, 20_000


def spread(df: DataFrame, keys: list[str], rows: int, each: int = SPREAD_ROWS) -> DataFrame:
    """``df``, of about so many rows, dealt by keys over so many partitions that what a
    task sorts or gathers doesn't grow with the input; groups and windows by the keys
    need no other shuffle then."""
    return df.repartition(_parts(df.sparkSession, rows, each), *keys)


def _parts(spark: SparkSession, rows: int, each: int) -> int:
    usual = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, -(-rows // each), min(usual, -(-rows // SPREAD_LEAST)))


def spread_session(spark: SparkSession, rows: int, each: int = SPREAD_ROWS) -> SparkSession:
    """A session of its own whose shuffles all have as many partitions as ``spread`` would
    deal so many rows to."""
    return own_session(spark, {"spark.sql.shuffle.partitions": str(_parts(spark, rows, each)), "spark.sql.adaptive.coalescePartitions.enabled": "false"})


def discard(df: DataFrame) -> None:
    """Remove a written table that nothing will read again."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def reopened(df: DataFrame, session: SparkSession) -> DataFrame:
    """A written table as another session reads it."""
    folders = sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})
    return session.read.schema(df.schema).parquet(*folders) if folders else session.createDataFrame([], df.schema)


def broadcast_if_small(df: DataFrame, most: int = 16 << 20) -> DataFrame:
    """``df`` marked for broadcast if its rows take at most ``most`` bytes as text;
    past that Spark joins by shuffle. ``df`` must be cheap to read."""
    held = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if held <= most else df


def own_session(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session with the settings of ``spark`` and some of its own, which
    queries that run beside this one don't see."""
    made = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and made.conf.isModifiable(key):
            made.conf.set(key, value)
    for key, value in settings.items():
        made.conf.set(key, value)
    return made


def worker_imports(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver started."""
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *known])
