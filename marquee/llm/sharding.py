"""Sharding by jump consistent hashing, in DataFrame functions only.

A 64-bit key k jumps from bucket to bucket: k <- k * JUMP + 1 modulo 2**64, and
from bucket b to floor((b + 1) * 2**31 / ((k >> 33) + 1)) until that passes the
number of shards (Lamping and Veach, 2014). No ring table is kept, and with
one more shard rows move only into the new one. The key is the id itself where
it is a whole number and xxhash64 of it otherwise; null has the key 0. Equal
ids share a shard.

The slot numbers the rows of a shard from 0 without gaps in the order of the
ids, of equal ids by CRC and size. Rows are range-partitioned in this order, so
that an id that many rows share is split as well, and written once; counts of
(partition, shard), at most the partitions plus the shards of them, are summed
up and joined, so that no task numbers more than its own partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from marquee.llm.shared import columns, cut, shuffle_parts

#: Fixed value of the published algorithm.
JUMP = 2862933555777941757


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a 64-bit key. Every jump goes up by one at
    least, so ``shards`` steps are room for any key; a key makes ln(shards) + 1
    jumps on average and passes the other steps on as it is."""
    unsigned = F.when(key < 0, key.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(key.cast("decimal(20,0)"))

    def step(s: Column, _: Column) -> Column:
        k = ((s["k"] * F.lit(JUMP).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")) % F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")
        high = F.floor(k / F.lit(1 << 33).cast("decimal(10,0)")).cast("double")
        return F.when(s["j"] >= shards, s).otherwise(F.struct(s["j"].alias("b"), k.alias("k"), F.floor((s["j"] + 1) * (F.lit(float(1 << 31)) / (high + 1))).cast("long").alias("j")))

    start = F.struct(F.lit(-1).cast("long").alias("b"), unsigned.cast("decimal(20,0)").alias("k"), F.lit(0).cast("long").alias("j"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``size`` (bytes of the text and 1), ``text_crc32``
    (of the UTF-8 text; null: of nothing, 0), ``law`` ``key``, ``shard``,
    ``slot``, ``grown_shard`` (with one shard more). Repeated rows keep slots of
    their own; null and empty texts have size 1."""
    spark = docs.sparkSession
    rows = columns(docs, id=id_col, text=text_col)
    whole = isinstance(rows.schema["id"].dataType, IntegralType)
    key = F.coalesce(F.col("id").cast("long") if whole else F.xxhash64("id"), F.lit(0))
    rows = rows.select("id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), jump_hash(key, shards).alias("shard"), jump_hash(key, shards + 1).alias("grown_shard"))
    # a number of each row's own splits ranges even among rows that are all the same
    rows = rows.withColumn("own", F.monotonically_increasing_id()).repartitionByRange(shuffle_parts(spark), "shard", "id", "text_crc32", "size", "own").drop("own")
    rows = cut(rows.withColumn("part", F.spark_partition_id()), "shards")
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    turn = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "text_crc32", "size"))
    out = rows.withColumn("turn", turn).join(F.broadcast(before), ["shard", "part"])  # as many rows as partitions and shards
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("turn") - 1).cast("long").alias("slot"), "grown_shard")
