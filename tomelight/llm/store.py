"""Durable intermediate tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Up to this many ids (about 60 bytes each as a hash table, which the driver builds) a set of ids is sent to every executor; larger sets are shuffled.
BROADCAST_IDS = 500_000


def scratch(spark: SparkSession) -> str:
    """The shared folder; one of our own only where the session names none and runs in one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tomelight-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and any executor may go."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/tomelight/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove a table that durable() wrote and nothing will read again."""
    jvm, files = df.sparkSession._jvm, df.inputFiles()
    if files:
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def unused(df: DataFrame, name: str) -> str:
    """name, with more underscores while df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_col: str, text_col: str) -> Column:
    """A 64-bit hash of a row's id and text: rows that share an id, a null one too, are told apart by it."""
    return F.xxhash64(F.col(id_col).isNull(), id_col, text_col)


def restrict(docs: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """docs whose key is (left_semi) or is not (left_anti) in ids.

    ids is a durable table with the one column key. Its size is counted first: a
    small set is broadcast, so that texts stay where they are; a large one is shuffled,
    also where its files are small enough for Spark to broadcast it.
    Keys are compared by plain equality, for which Spark packs a number into a table of
    longs (a null-safe comparison takes twice the memory); null keys are looked at apart.
    """
    size, nulls = ids.agg(F.count("*"), F.count_if(F.col(key).isNull())).first()
    ids = ids.select(F.col(key).alias("__id")).where("__id is not null")
    found = docs.join(F.broadcast(ids) if size <= BROADCAST_IDS else ids.hint("merge"), docs[key] == ids["__id"], how)
    if not nulls:
        return found
    return found.where(F.col(key).isNotNull()) if how == "left_anti" else found.unionByName(docs.where(F.col(key).isNull()))


def shards(spark: SparkSession, size: float, target: float) -> int:
    """How many owners a quantity of `size` is dealt to, so that each gets about `target`."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // target) + 1)
