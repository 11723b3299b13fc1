"""A reproducible shuffle of all rows into equal shards, without moving the rows.

Row numbers in id order are permuted by a Feistel network over the smallest
square that holds them, walking its cycles until the number is a row again.
Shard and slot are the permuted number's remainder and quotient, so anyone who
knows a row's number and the row count can compute its place, and back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.session import settle

ROUNDS = 6
#: Multipliers and modulus of the round function (products stay below 2^62).
MIX_A, MIX_B, MODULUS = 1_103_515_245, 1_664_525_223, (1 << 31) - 1


def round_keys(seed: int) -> list[int]:
    """One key for each round, from the seed by a linear congruence."""
    keys, state = [], seed % MODULUS
    for _ in range(ROUNDS):
        state = (state * 48_271 + 11) % MODULUS
        keys.append(state)
    return keys


def side_of(rows: int) -> int:
    """Side of the smallest square with room for all rows."""
    side = math.isqrt(max(rows, 1))
    return side if side * side >= rows else side + 1


def walk_bound(rows: int) -> int:
    """Steps after which no walk is still outside: all outside numbers used, or odds below 1e-30."""
    outside = side_of(rows) ** 2 - rows
    if not outside:
        return 0
    share, bound = outside / side_of(rows) ** 2, 1
    while bound <= outside and rows * share**bound > 1e-30:
        bound += 1
    return bound


def whole(value: Column, by: int) -> Column:
    """Whole-number quotient of a count."""
    return F.call_function("div", value, F.lit(by).cast("long"))


def permuted(number: Column, rows: int, seed: int) -> Column:
    """The permutation of 0 .. rows-1, as one expression."""
    side = side_of(rows)
    keys = F.array(*[F.lit(k).cast("long") for k in round_keys(seed)])

    def mix(value: Column, key: Column) -> Column:
        first = ((value + key) * F.lit(MIX_A)) % F.lit(MODULUS)
        second = first.bitwiseXOR(F.shiftright(first, 15))
        return (second * F.lit(MIX_B)) % F.lit(MODULUS)

    def network(value: Column) -> Column:
        start = F.struct(whole(value, side).alias("left"), (value % side).alias("right"))
        return F.aggregate(
            keys, start,
            lambda s, k: F.struct(s["right"].alias("left"), ((s["left"] + mix(s["right"], k)) % side).alias("right")),
            lambda s: s["left"] * side + s["right"],
        )

    once = network(number)
    bound = walk_bound(rows)
    if not bound:
        return once
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(bound)), once, lambda v, _: F.when(v < rows, v).otherwise(network(v)))
    return F.when(walked < rows, walked).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long"))


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, UTF-8 bytes, CRC and row number of every row, in the order of key, bytes and CRC.

    The text is read once; only the narrow rows are sorted.  Rows equal in all
    three (however many) are told apart by reading position, so that they
    spread over the ranges like any others.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    narrow = settle(docs.select(
        F.col(key).alias("key"), F.octet_length(raw).cast("long").alias("octets"), F.crc32(F.encode(raw, "UTF-8")).alias("crc"),
        F.monotonically_increasing_id().alias("read"),
    ))
    order = ["key", "octets", "crc", "read"]
    ranged = settle(
        narrow.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("piece", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    # One row for each range: bounded by the number of shuffle partitions.
    offsets = ranged.groupBy("piece").count().select("piece", (F.sum("count").over(Window.orderBy("piece")) - F.col("count")).alias("before"))
    return ranged.join(F.broadcast(offsets), "piece").select("key", "octets", "crc", (F.col("before") + F.col("at")).alias("number"))


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16, seed: int = 2024) -> DataFrame:
    """One row for each row of ``docs``: key, octets, crc, number, shard and slot.

    Shards differ by at most one row; slots run from 0 without gaps.  A null
    text counts as empty, a null key sorts first, repeated rows and keys get a
    place each; other columns are not looked at.  An empty table gives no rows.
    The places depend on the rows alone, not on files or partitions, except
    among rows that are equal in key, length and CRC.
    """
    rows = numbered(docs, key, text)
    place = permuted(F.col("number"), rows.count(), seed)
    return rows.withColumn("place", place).select(
        "key", "octets", "crc", "number",
        (F.col("place") % shards).cast("int").alias("shard"), whole(F.col("place"), shards).alias("slot"),
    )
