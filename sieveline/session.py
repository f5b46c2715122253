"""Session defaults, table access and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "sieveline", cores: str = "*") -> SparkSession:
    """A local session with the settings the engine is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where the driver is the only machine may it be unset."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sieveline-")
        sc.setCheckpointDir(folder)
    return folder


#: Folders written so far that still stand.
_standing: set[str] = set()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one, if the JVM is still there."""
    _standing.discard(path)
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already
        pass


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed by release() or when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _standing:
        atexit.register(release, spark)
    _standing.add(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete everything cut() has written: for long sessions, once a query's result is stored."""
    for path in list(_standing):
        remove(spark, path)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: later stages survive the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what cut() wrote for df, once nothing reads it any more (a round that the next one has replaced)."""
    if path := getattr(df, "_cut_path", None):
        remove(df.sparkSession, path)


def small(df: DataFrame, bound: int) -> DataFrame:
    """df to be broadcast if it has at most `bound` rows, as it is if it has more. Reads bound + 1 rows at most."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_split_join(facts: DataFrame, lookup: DataFrame, keys: Sequence[str], weight: str, hot: int = 1000) -> DataFrame:
    """Inner join of many facts with a lookup unique on keys, whose column `weight` counts the facts of each key.

    The `hot` heaviest keys (at most that many rows, so their broadcast is bounded whatever the data) are joined
    without moving their facts; what is left has no key above 1/hot of the facts and is joined by shuffle, where adaptive
    execution splits what is still too large for a task. The lookup is read three times: cut() one that is costly to compute.
    Rows with a null key match nothing.
    """
    keys = list(keys)
    top = lookup.orderBy(F.desc(weight), *keys).limit(hot)
    near = facts.join(F.broadcast(top), keys)
    far = facts.join(F.broadcast(top.select(*keys)), keys, "left_anti").join(lookup, keys)
    return near.unionByName(far)
