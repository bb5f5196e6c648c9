"""Small helpers shared by the operators: table access, checkpoints, key normalisation."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as people see it: control blanks, Unicode separators, zero-width marks.
BLANKS = r"[\s\x{85}\p{Z}\x{200B}\x{FEFF}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and streaming state.

    Taken from ``spark.checkpoint.dir``; only where that is unset (tests) a folder of this machine is used.
    """
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        base = conf
    else:
        base = getattr(sc, "_mnemolith_dir", None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="mnemolith-")
            sc._mnemolith_dir = base
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh path inside the shared folder."""
    return os.path.join(checkpoint_dir(spark), f"{purpose}-{uuid.uuid4().hex}")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def materialise(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back (compressed, column-pruned lineage cut)."""
    spark = df.sparkSession
    path = scratch(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trim_blanks(c: Column) -> Column:
    """Strip every kind of blank from both ends."""
    return F.regexp_replace(c, rf"^{BLANKS}+|{BLANKS}+$", "")


def key_of(c: Column) -> Column:
    """Identifier as compared: without letter case and surrounding blanks; blank becomes null."""
    t = F.lower(trim_blanks(c))
    return F.when(t != "", t)


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers that don't share the driver's path (once per application)."""
    sc = spark.sparkContext
    if getattr(sc, "_mnemolith_shipped", False):
        return spark
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="mnemolith-zip-"), "mnemolith.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)  # sent by the driver's file server
    sc._mnemolith_shipped = True
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores if the input has fewer partitions than there are cores, as small single files have.

    Larger inputs have more partitions than that and are left alone, so no shuffle is added at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
