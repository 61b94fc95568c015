"""Session settings, and the one place that decides where intermediate results are kept."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a few narrow columns that may be broadcast: at most some tens of megabytes.
BROADCAST_ROWS = 1_000_000


def build_session(app: str = "velotide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC wall-clock semantics and adaptive execution. ANSI mode stays on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and stage tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a single-machine session may fall back to
    a temporary folder: on a cluster that would be a different disk on every machine.
    """
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="velotide-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the files, so that a lost executor costs
    a re-read instead of a recomputation, and several consumers do not each re-run the plan."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A side of a join that should be small, written once and counted: broadcast when it is.

    Meant for joins straight onto a scan of trips. There the adaptive planner would learn the size
    of this side only after the other one, with all its weight on one busy station, was shuffled.
    Beyond the bound the join is left to the planner and its handling of skew.
    """
    kept = materialize(df)
    return F.broadcast(kept) if kept.count() <= max_rows else kept


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder, for tables that pass between two stages. What is
    there when the program ends is deleted."""
    if not _SCRATCH:
        atexit.register(_drop_scratch)
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


def _drop_scratch() -> None:
    """Delete the scratch tables of this program, as long as its session still runs."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for name in _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: unlike a checkpoint it is compressed, and
    later passes read only the columns that they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
