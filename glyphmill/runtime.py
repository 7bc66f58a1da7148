"""Session helpers: tables, checkpoints, bounded broadcasts, skew-safe lookups."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder; a table is one file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a scan has fewer tasks than there are cores, as with one small file.

    df is a scan, whose tasks are told without running it. A scan of many files is left as it is, so large inputs aren't
    shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster shares.

    The folder is spark.checkpoint.dir of the session; only where that is unset (tests on one machine) a folder
    of this machine is used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "glyphmill-checkpoints"))
    return df.checkpoint(eager=True)


def salted_lookup(rows: DataFrame, keyed: DataFrame, keys: list[str], spread: str, salts: int = 8) -> DataFrame:
    """Inner join of `rows` with `keyed` (one row a key) where a key may hold a third of `rows`.

    Rows get one of `salts` salts by the hash of column `spread`; each keyed row is repeated once a salt, so a hot
    key is spread over `salts` tasks. Rows with a null key find nothing, as in any inner join.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")
