"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, by DataFrame operations alone.

The ring has ``POINTS`` points. Each shard owns ``vnodes`` virtual nodes on it, at points from their md5; a
document's point is the start of its doc_id's md5. A document belongs to the shard of the first virtual
node clockwise, unless that shard is full: then it goes on clockwise to the next shard that is not. A shard is
full at (1000 + ``slack``) thousandths of the mean bytes, so ``bytes`` is the law that holds: no shard has more than that and one
unit, and those not full share what is left. One more shard moves what it takes over and little else.

Documents of a point move together, as a unit, so that overflow is settled on at most ``2 * POINTS`` rows, however
many the documents: in round r each unplaced unit asks its r-th shard clockwise, and a shard takes units, larger
ones first, until it is full, so that what overfills it is small. A shard that refuses stays full, and the shards together hold more than there is, so as many rounds as
there are shards place all. A point with more than 1/4,096 of all bytes is cut into units by a hash of doc_id
and text, and where it has 64 rows or more (one doc_id on a third of the table) by the row's place as well; units are bounded in number
still. Slots are counted unit by unit, so nothing runs by shard but windows over units.

Defined results: a null text has size 1 and the crc32 of the empty text; a null doc_id reads as an empty one and is
the first of its unit; rows that are equal get slots in either order; an empty table gives an empty result. Other columns are
not read, whatever their names; texts of any length are measured in their row. Single documents are never cut: one that is larger than a
shard's bound overfills its shard by as much.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _scratch

POINTS = 1 << 16
HEAVY = 1 << 12
ROUNDS_A_TABLE = 4


def _hashed(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def ring(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """``point, walk`` for every point: the shards in the order in which they are met clockwise."""
    n = shards * vnodes
    name = F.concat(F.lit("shard "), F.col("own").cast("string"), F.lit(" "), F.floor(F.col("id") / shards).cast("string"))
    nodes = spark.range(0, n, 1, 1).withColumn("own", (F.col("id") % shards).cast("int"))
    nodes = nodes.select("own", _hashed(name, 4).alias("at"), F.md5(name).alias("tie"))
    clockwise = Window.orderBy("at", "tie", "own")
    nodes = nodes.withColumn("i", F.row_number().over(clockwise) - 1)
    ahead = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    met = [(F.when(F.col("own") == s, F.col("i")), s) for s in range(shards)]
    turns = F.array(*[F.struct(F.coalesce(F.min(i).over(ahead), F.min(i).over(whole) + n).alias("turn"), F.lit(s).alias("own")) for i, s in met])
    nodes = nodes.select(
        "i", "at", F.lag("at", 1, -1).over(Window.orderBy("i")).alias("back"), F.max("at").over(whole).alias("last"),
        F.transform(F.array_sort(turns), lambda x: x["own"]).alias("walk"),
    )
    none = F.array().cast("array<bigint>")
    own = F.when(F.col("at") > F.col("back"), F.sequence(F.col("back") + 1, F.col("at"))).otherwise(none)
    over = F.when((F.col("i") == 0) & (F.col("last") < POINTS - 1), F.sequence(F.col("last") + 1, F.lit(POINTS - 1).cast("long"))).otherwise(none)
    return nodes.select(F.explode(F.concat(own, over)).alias("point"), "walk")


def _place(units: DataFrame, shards: int, full: int) -> DataFrame:
    """``shard`` of every unit (point, sub, bytes, walk)."""
    now = units.withColumn("shard", F.lit(None).cast("int"))
    for r in range(shards):
        goal = F.coalesce("shard", F.col("walk")[r])
        earlier = Window.partitionBy("goal").orderBy(F.col("shard").isNull(), F.desc("bytes"), "point", "sub").rowsBetween(Window.unboundedPreceding, -1)
        now = now.withColumn("goal", goal).withColumn("before", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)))
        now = now.withColumn("shard", F.when(F.col("shard").isNotNull() | (F.col("before") < full), F.col("goal"))).drop("goal", "before")
        if (r + 1) % ROUNDS_A_TABLE == 0 and r + 1 < shards:
            now = _scratch.write_table(now, "placed")
            if now.where("shard is null").isEmpty():
                break
    return now


def assign(docs: DataFrame, shards: int = 16, vnodes: int = 256, slack: int = 1) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    slim = _scratch.write_table(slim.select("*", _hashed(name, 4).alias("point"), F.monotonically_increasing_id().alias("row")), "sizes")
    points = _scratch.write_table(slim.groupBy("point").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "points")
    total = points.agg(F.sum("bytes")).first()[0] or 0
    parts = F.least("rows", F.ceil(F.col("bytes") * POINTS / F.lit(max(total, 1))))
    heavy = points.where(F.col("bytes") * HEAVY > total).select("point", parts.alias("parts"), (F.col("rows") >= 64).alias("many"))
    mark = F.concat_ws(":", name, F.col("text_crc32").cast("string"), F.when(F.col("many"), F.col("row").cast("string")))
    slim = slim.join(F.broadcast(heavy), "point", "left").withColumn("sub", F.when(F.col("parts") > 1, _hashed(mark, 8) % F.col("parts")).otherwise(F.lit(0)))
    slim = slim.select("doc_id", "size", "text_crc32", "point", "sub")
    units = slim.groupBy("point", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    units = units.join(F.broadcast(ring(spark, shards, vnodes)), "point")
    full = -(-total * (1000 + slack) // (1000 * shards))
    placed = _place(_scratch.write_table(units, "units"), shards, full)
    below = Window.partitionBy("shard").orderBy("point", "sub").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("point", "sub", "shard", F.coalesce(F.sum("rows").over(below), F.lit(0)).alias("base"))
    inside = Window.partitionBy("point", "sub").orderBy("doc_id", "text_crc32", "size")
    slim = slim.join(F.broadcast(placed), ["point", "sub"])
    return slim.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.row_number().over(inside) - 1).cast("long").alias("slot"))
