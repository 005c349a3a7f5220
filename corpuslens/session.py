"""Spark session defaults and lineage helpers.

Cluster settings (shuffle partitions, memory, checkpoint folder) are taken
from the session when present; defaults here only fill gaps for local runs
and tests.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on. AQE re-plans joins at run time: a side whose
# measured shuffle output is under the broadcast threshold becomes a broadcast,
# everything else stays a sort-merge join with skew splitting.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # texts can be 20,000 words: keep scorer batches to a few thousand rows
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "corpuslens") -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    master = master or os.environ.get("CORPUSLENS_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName(app_name)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", os.environ.get("CORPUSLENS_DRIVER_MEMORY", "8g"))
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session.  Where it is unset, a private
    folder is made for a ``local[...]`` master (local runs and tests); any other
    master raises, as its executors do not see the driver's folders.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext  # absent under Spark Connect
    except Exception:  # noqa: BLE001
        sc = None
    if sc is None:
        return current or private_folder(spark.conf.get("spark.master", "remote"))
    if not current:  # the setting cannot be changed in a running session: the folder is kept by application
        current = sc.getCheckpointDir() or _private.get(sc.applicationId) or private_folder(sc.master)
        _private[sc.applicationId] = current
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


_private: dict[str, str] = {}


def private_folder(master: str) -> str:
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir is not set: master {master!r} needs a folder that all executors share")
    return tempfile.mkdtemp(prefix="corpuslens-ckpt-")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: computed once, not held
    in executor memory, and safe against lost executors."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 32 << 20


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a (stored) table take at most ``limit`` bytes, as text with a few bytes each on top."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))) + 32)
    return (df.agg(size.alias("n")).first()["n"] or 0) <= limit


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", hint: bool = False) -> DataFrame:
    """Join on ``keys`` where null equals null; the key columns come once, from ``left``."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(F.broadcast(renamed) if hint else renamed, cond, how).drop(*[f"_r_{k}" for k in keys])
