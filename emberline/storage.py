"""Shared folder, written steps, hot keys, and names that clash with no column: used by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks that the rows of one key are dealt to.
SALTS = 64


def find_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package; on a cluster it is installed or sent with --py-files."""
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[1])
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share: spark.checkpoint.dir.

    Where none is named a local master (tests, a laptop) has a temporary folder set once; a cluster must name one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        known = sc._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="emberline-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable eager checkpoint in the shared folder; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    The files are part of the result's lineage, so they can't go before the result does; whoever runs the job clears the folder after it.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> Column:
    """The column of this very name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """`name`, with signs added until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_spread(rows: DataFrame, values: DataFrame, key: str, by: str, salts: int = SALTS) -> DataFrame:
    """`rows` with the columns of `values` (one row a key), so that a key with very many rows is dealt to `salts` tasks by a hash of the column `by`.

    The keys and salts that occur are combined before they are shuffled: a key meets its value in `salts` rows at most.
    """
    salt = unused(rows, "salt")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(salts)))
    met = salted.select(key, salt).distinct().join(values, key)
    return salted.join(met, [key, salt]).drop(salt)
