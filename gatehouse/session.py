"""Session construction and the shared scratch folder."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gatehouse", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; explicit ``conf`` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # Rule evaluation generates long methods; above HotSpot's limit they would run interpreted.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``, else by the session's checkpoint folder; a temporary one only in
    local mode."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="gatehouse-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: The checkpoints made since the innermost :func:`settle` began; None outside of one.
_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)
#: Seconds between two collections that let Spark drop the files of shuffles that nothing can read any more.
_COLLECT_S = 10
_collected = 0.0


def _noted(checkpoint: DataFrame) -> DataFrame:
    made = _MADE.get()
    if made is not None:
        made.append(checkpoint)
    return checkpoint


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so later readers see one fixed set of rows."""
    scratch_root(df.sparkSession)
    return _noted(df.checkpoint(eager=True))


def settle(build: Callable[[], DataFrame]) -> DataFrame:
    """:func:`materialize` of ``build()``; the checkpoints that it makes on the way are released."""
    token = _MADE.set([])
    try:
        df = build()
        scratch_root(df.sparkSession)
        kept, made = df.checkpoint(eager=True), _MADE.get()
    finally:
        _MADE.reset(token)
    del df
    release(*made)
    return _noted(kept)


def release(*checkpoints: DataFrame) -> None:
    """Delete the files of what :func:`materialize` made and nothing reads any more. Rounds over a large table would
    keep those of every round, since Spark drops a checkpoint's files at best, and a shuffle's, when its own references
    are collected."""
    global _collected
    for df in checkpoints:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if checkpoints and time.monotonic() - _collected > _COLLECT_S:
        _collected = time.monotonic()
        checkpoints[0].sparkSession._jvm.System.gc()


SPLIT_BYTES = 128 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, in compressed bytes for scans; a plan that explodes rows has no bound."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return 1 << 62 if "Generate " in plan.toString() else int(plan.stats().sizeInBytes())


def spread(df: DataFrame) -> DataFrame:
    """Before CPU-heavy work, give an input too small to have a split per core one partition per core.

    A larger input, or one of unknown size, already has its own splits and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if estimated_bytes(df) < SPLIT_BYTES * cores else df
