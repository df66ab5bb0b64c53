"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters whole records uniformly into buckets by a seeded hash; the
number of buckets follows from the number and the bytes of the records, so a
bucket stays small at any size of the table. Pass two orders each bucket by a
seeded Fisher-Yates permutation of its row numbers (the ``shuffle`` function), so
no row ever holds more than one record and an array of numbers. The buckets one
after the other are the shuffled table: prefix sums of their sizes place each
record, and the shards are equal cuts of it, so their row counts are at most one
apart. ``write_shards`` writes them: a record crosses the network once.

Records are counted by a hash first. Only those whose hash comes again are
compared as a whole, numbered, and then scattered, so copies spread over all
buckets and one record may hold any share of the rows.

The order is a function of the rows and the seed, whatever the partitions.

Defined results: null keys are keys like any other; equal records are
interchangeable; a record of any length crosses whole, in a row of its own; an
empty table gives an empty result; more shards than rows leave shards empty; new
columns get underscores before their names where the records have such a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scoreloom.llm.shared import fresh, materialize

BUCKET_ROWS = 50_000
BUCKET_BYTES = 32 << 20
#: Copies of one record that one task makes.
BLOCK = 1_000
#: Partitions in which the permutations are made, at most; a part of the seed.
ORDER_TASKS = 2_000
SEED = 42


def _prefix_sums(sizes: DataFrame, key: str, value: str) -> DataFrame:
    """``before`` for each row: the sum of the rows before it. ``sizes`` has one row a bucket."""
    return sizes.withColumn("before", F.coalesce(F.sum(value).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _record_bytes(records: DataFrame) -> Column:
    size = F.lit(16 * len(records.columns)).cast("long")
    for f in records.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            c = F.to_json(F.struct(c))
        elif not isinstance(f.dataType, T.StringType | T.BinaryType):
            continue
        size += F.coalesce(F.octet_length(c), F.lit(0))
    return size


def _numbered_copies(records: DataFrame, hashed: Column, seen: DataFrame) -> DataFrame:
    """``(record, key, copy)``, where ``copy`` counts from 1 among the records of one hash."""
    record = F.struct(*(f"`{c}`" for c in records.columns)).alias("record")
    rows = records.select(record, hashed.alias("key"))
    again = materialize(seen.where("n > 1").select("key"), "repeated")
    if again.isEmpty():
        return rows.withColumn("copy", F.lit(1).cast("long"))
    single = rows.join(again, "key", "left_anti").select("record", "key", F.lit(1).cast("long").alias("copy"))
    counted = rows.join(again, "key", "left_semi").groupBy("key", "record").agg(F.count("*").alias("n"))
    # Different records of one hash share its numbers.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return single.union(_dealt_copies(counted.withColumn("before", before)).select("record", "key", (F.col("before") + F.col("at")).alias("copy")))


def _dealt_copies(counted: DataFrame) -> DataFrame:
    """Each row ``n`` times, with ``at`` from 1: blocks of ``BLOCK`` copies are dealt to tasks before they are spelled out."""
    first = F.explode(F.sequence(F.lit(1).cast("long"), "n", F.lit(BLOCK).cast("long")))
    blocks = counted.withColumn("first", first).repartition("key", "first")
    return blocks.withColumn("at", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + BLOCK - 1, "n")))).drop("first")


def external_shuffle(records: DataFrame, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All records in a seeded random order: their columns and ``position`` from 0, without gaps."""
    columns = [F.col(f"`{c}`") for c in records.columns]
    hashed = F.xxhash64(F.lit(seed), *columns, *(c.isNull() for c in columns))
    seen = materialize(records.select(hashed.alias("key"), _record_bytes(records).alias("bytes")).groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")), "records")
    rows, total = (x or 0 for x in seen.agg(F.sum("n"), F.sum("bytes")).first())
    buckets = max(1, -(-rows // bucket_rows), -(-total // bucket_bytes))
    bucket = F.pmod(F.xxhash64("key", "copy", F.lit(seed)), F.lit(buckets)).cast("int").alias("bucket")
    # The permutation of each bucket needs no more than its size.
    once = seen.where("n = 1").select("key", F.lit(1).cast("long").alias("copy"))
    entries = once.union(_dealt_copies(seen.where("n > 1").select("key", "n")).select("key", F.col("at").alias("copy")))
    starts = _prefix_sums(entries.groupBy(bucket).agg(F.count("*").alias("rows")), "bucket", "rows")
    order = F.shuffle(F.sequence(F.lit(0), F.col("rows").cast("int") - 1), F.lit(seed))
    # ``shuffle`` draws on from row to row of a partition: the deal and the order of the buckets are fixed, so the permutations are.
    dealt = starts.repartition(min(buckets, ORDER_TASKS), "bucket").sortWithinPartitions("bucket")
    orders = materialize(dealt.select("bucket", "before", order.alias("order")), "orders")
    # Pass one.
    scattered = _numbered_copies(records, hashed, seen).select(bucket, "key", "copy", "record")
    # Pass two: numbered by hash, so that the order of arrival does not matter.
    at = F.row_number().over(Window.partitionBy("bucket").orderBy("key", "copy"))
    placed = scattered.withColumn("at", at).join(orders, "bucket")
    position = F.col("before") + F.element_at("order", F.col("at"))
    return placed.select("record.*", position.alias(fresh("position", records.columns)))


def shard_of(position: Column, rows: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a position: the first ``rows % shards`` shards hold one row more."""
    size, larger = divmod(rows, shards)
    cut = larger * (size + 1)
    early = F.floor(position / (size + 1))
    late = F.floor((position - cut) / max(1, size)) + larger
    shard = F.when(position < cut, early).otherwise(late).cast("int")
    slot = F.when(position < cut, position % (size + 1)).otherwise((position - cut) % max(1, size))
    return shard, slot.cast("long")


def shuffled_shards(records: DataFrame, shards: int, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``external_shuffle`` with ``shard`` and ``slot``; slots of a shard run from 0 without gaps."""
    placed = external_shuffle(records, seed, bucket_rows, bucket_bytes)
    shard, slot = shard_of(F.col(placed.columns[-1]), records.count(), shards)
    return placed.withColumns({fresh("shard", placed.columns): shard, fresh("slot", placed.columns): slot})


def write_shards(placed: DataFrame, path: str) -> None:
    """Writes shuffled shards as Parquet, one folder a shard, rows by slot."""
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
