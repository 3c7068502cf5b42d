"""Lineage cuts in the folder all executors share.

``materialise`` writes a frame as Parquet below ``spark.checkpoint.dir`` and reads it back, so that a lost
executor costs a re-read and never a recomputation of what lies before.  Only where that setting is absent and the
master is local (as in tests and on a laptop) a temporary folder of this machine stands in for it; elsewhere its
absence is an error, as executors would write where nobody else can read.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be broadcast at most, and bytes; beyond either, callers shuffle instead.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 16 << 20

_local: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for this application's intermediate tables."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if app not in _local:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="weftline-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _local[app] = f"file://{folder}"
            spark.sparkContext.setCheckpointDir(_local[app])
        root = _local[app]
    return f"{root.rstrip('/')}/weftline-{app}"


def reserve(spark: SparkSession) -> str:
    """A path for one more intermediate table."""
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to shared storage and return a scan of what was written."""
    spark = df.sparkSession
    path = reserve(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_weftline_path", None)
        if path:
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all of this application's intermediate tables; results that were not written yet go with them."""
    _delete(spark, scratch_root(spark))


def small_enough(df: DataFrame, row_bytes: int = 16) -> bool:
    """Whether ``df`` (cheap to count) stays below both broadcast bounds: its values are measured, as JSON, and a row
    counts as ``row_bytes`` at least."""
    if df.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return False
    size = F.greatest(F.lit(row_bytes), F.octet_length(F.to_json(F.struct(*[df[c] for c in df.columns]))))
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def attach(big: DataFrame, lookup: DataFrame, key: str, row_bytes: int = 64, hot_share: float = 0.001) -> DataFrame:
    """Left join of ``big`` to ``lookup`` (one row a key), safe for hot keys.

    A lookup of checked size is broadcast.  A larger one is joined by a shuffle, but keys that hold more than
    ``hot_share`` of ``big`` (1/hot_share of them at most) are joined by a broadcast of just their lookup rows, so
    no key gathers its rows in one task; should even these rows be too large, the planner splits the skewed
    partitions.  Null keys match nothing.
    """
    if small_enough(lookup, row_bytes):
        return big.join(F.broadcast(lookup), key, "left")
    counts = big.where(F.col(key).isNotNull()).groupBy(key).count()
    bound = max(1000.0, big.count() * hot_share)
    hot = materialise(counts.where(F.col("count") > bound).select(key))
    if hot.isEmpty():
        return big.join(lookup.hint("merge"), key, "left")
    hot_lookup = materialise(lookup.join(F.broadcast(hot), key, "left_semi"))
    if not small_enough(hot_lookup, row_bytes):
        return big.join(lookup.hint("merge"), key, "left")
    first = big.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(hot_lookup), key, "left")
    rest = big.join(F.broadcast(hot), key, "left_anti").join(lookup.hint("merge"), key, "left")
    return first.unionByName(rest)


def without(big: DataFrame, drop: DataFrame, key: str) -> DataFrame:
    """Rows of ``big`` whose key is not in ``drop``; ``drop`` is broadcast only below the bounds."""
    if small_enough(drop, 32):
        return big.join(F.broadcast(drop), key, "left_anti")
    return big.join(drop.hint("merge"), key, "left_anti")
