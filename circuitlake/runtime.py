"""Session-level helpers: table access, checkpoints, guarded broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when a bounded count proves it has at most this many rows.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir.

    Only a local master without that setting gets a folder of its own; a cluster
    without one is refused, as a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = os.path.join(tempfile.gettempdir(), "circuitlake-checkpoints")
    sc.setCheckpointDir(shared)


#: Tables written by `cut`, as (application, path); removed by `release` and when the process ends.
_WRITTEN: list[tuple[str, str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Materialise df as a table in the shared checkpoint folder and drop its lineage.

    A written table is compressed, columnar and read again column by column, so it costs
    less disk than a checkpoint of rows; like one it survives the loss of any executor.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/tables/{uuid.uuid4().hex}"
    _WRITTEN.append((sc.applicationId, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder beside the tables of `cut`, removed with them."""
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/files/{uuid.uuid4().hex}"
    _WRITTEN.append((sc.applicationId, path))
    return path


def spread(df: DataFrame) -> DataFrame:
    """df itself, or dealt out over all cores if it is a scan in fewer than half as many parts (small files).

    Plans with an exchange are left alone: counting their parts would run them.
    """
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * plan.toRdd().getNumPartitions() <= cores else df


def release(spark: SparkSession) -> None:
    """Delete the tables `cut` wrote in this application; results built on them must be stored before."""
    sc = spark.sparkContext
    mine = [path for app, path in _WRITTEN if app == sc.applicationId]
    for path in mine:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN[:] = [w for w in _WRITTEN if w[1] not in mine]


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            release(spark)
    except Exception:  # the session is gone; its folder is its owner's
        pass
    for _, path in _WRITTEN:
        if path.startswith("file:"):
            shutil.rmtree("/" + path[5:].lstrip("/"), ignore_errors=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if, and only if, df provably has at most `rows` rows.

    The proof is a count of df.limit(rows + 1), so it costs a bounded read; larger
    sides are returned unhinted and the join stays a shuffle join.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded_rows(df: DataFrame, rows: int, what: str) -> list:
    """Collect a side that must be small by nature; refuse it when it is not."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"{what} has more than {rows} rows")
    return got


#: A key counts as hot beyond this many rows, and beyond its ten-thousandth of all rows.
HOT_ROWS = 100_000


def join_skewed(left: DataFrame, right: DataFrame, key: str, size: str, total: int, how_many: int = 10_000) -> DataFrame:
    """Inner join on `key`, where right has one row a key and in `size` the number of left's rows of that key.

    Rows of hot keys are not shuffled: at most `how_many` keys can hold more than a
    `how_many`-th of all rows each, so their side is broadcast; the rest is shuffled.
    """
    if total <= HOT_ROWS:
        return left.join(right, key)
    hot = right.filter(F.col(size) > max(HOT_ROWS, total // how_many))
    if hot.limit(1).count() == 0:
        return left.join(right, key)
    keys = F.broadcast(hot.select(key))
    rest = left.join(keys, key, "left_anti").join(right.join(keys, key, "left_anti"), key)
    return left.join(F.broadcast(hot), key).unionByName(rest)
