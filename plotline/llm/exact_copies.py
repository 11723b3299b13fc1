"""Equal texts by distributed MSD radix partitioning.

A text's digits are its length and then successive runs of its bytes, each
sixteen times longer than the one before.  A level deals all members of the
open groups out by their next digit; a group of one is done, and so is a group
whose texts have ended, for its members then agree in every byte.  No digest
decides equality.

Only counts of a group's members meet, added up before each shuffle, so a group
that holds a third of all rows is never gathered; the join that takes a level's
result back to the members has plain shuffles on both sides, which Spark splits
where one key is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.session import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of the first digit, growth of the digits, and their longest.
FIRST, GROWTH, LONGEST = 64, 16, 1 << 20
#: Bits of the fixed-size map by which the second reading of the texts passes over most rows that are alone already.
MAP_BITS = 1 << 26


def normal(text: Column) -> Column:
    """A-Z made small; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _spot(octets: Column, digit: Column) -> Column:
    return F.pmod(F.xxhash64(octets, digit), F.lit(MAP_BITS)) + 1


def _groups(members: DataFrame) -> DataFrame:
    """What a digit's groups (members: part, digit, row, id) come to: their size, least row and greatest id."""
    return members.groupBy("part", "digit").agg(
        F.count("*").alias("n"), F.min("row").alias("least"), F.max("id").alias("keep_id"), F.max_by("row", "id").alias("keep_row"),
    ).withColumn("keep_row", F.coalesce("keep_row", "least"))


def _open_rows(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows whose first digit the map of ``shared`` groups has, and few others: part, digit, row, id, tail.

    The map is at most MAP_BITS / 32768 rows of 4 KiB, whatever the input.
    """
    spot = _spot(F.col("part"), F.col("digit"))
    bits = shared.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    place = F.bitmap_bit_position("spot")
    octet = F.conv(F.hex(F.substring("bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = docs.withColumn("spot", spot).withColumn("bucket", F.bitmap_bucket_number("spot")).join(F.broadcast(bits), "bucket")
    found = found.where(F.call_function("getbit", octet, (place % 8).cast("int")) == 1)
    return found.select("part", "digit", "row", "id", F.substring(F.encode(normal(F.col("text")), "UTF-8"), F.lit(FIRST + 1), F.col("part").cast("int")).alias("tail"))


def exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, id, keep_id, keep_row, group_size, kept, text_sha256 for every row of ``docs``.

    Texts are equal when they are so byte for byte after A-Z are made small; a
    null text is empty.  Of equal texts the row with the greatest id stays; rows
    without id yield to others, and among equal greatest ids one row is chosen.
    If no row of a group has an id, its first as read stays and keep_id is null.
    ``row`` numbers the rows as read from files, twice alike.  Texts may be of any
    length, each longer digit costing one level; an empty table gives no rows;
    other columns, whatever their names, are ignored.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    body = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), raw.alias("text"), F.octet_length(raw).cast("long").alias("part"))
    # The first FIRST characters have the first FIRST bytes.
    body = body.withColumn("digit", F.substring(F.encode(normal(F.substring("text", 1, FIRST)), "UTF-8"), 1, FIRST))
    rows = settle(body.select("row", "id", "part", "digit", F.unhex(F.sha2(F.encode(normal(F.col("text")), "UTF-8"), 256)).alias("sha")))
    shared = settle(_groups(rows).where("n > 1"))
    longest = shared.agg(F.max("part")).first()[0]
    done = rows.select("row", F.lit(None).cast("long").alias("n"), F.lit(None).cast(rows.schema["id"].dataType).alias("keep_id"), F.lit(None).cast("long").alias("keep_row")).limit(0)
    if longest is not None:
        # Texts that have ended in the first digit need no second reading.
        ended = rows.where(F.col("part") <= FIRST).join(shared, ["part", "digit"])
        done = done.union(ended.select("row", "n", "keep_id", "keep_row"))
    if longest is not None and longest > FIRST:
        members = _open_rows(body.where(F.col("part") > FIRST), shared)
        deep, width = FIRST, FIRST
        while True:
            found = members.join(shared.withColumnRenamed("part", "p").withColumnRenamed("digit", "d"), (F.col("part") == F.col("p")) & (F.col("digit") == F.col("d")))
            # The group goes on under its least row; what is left of a text travels with it.
            found = settle(found.select("row", "id", F.col("least").alias("part"), "n", "keep_id", "keep_row", F.when(F.octet_length("tail") > 0, F.col("tail")).alias("tail")))
            done = done.union(found.where(F.col("tail").isNull()).select("row", "n", "keep_id", "keep_row"))
            if deep >= longest:
                break
            deep, width = deep + min(width * GROWTH, LONGEST), min(width * GROWTH, LONGEST)
            members = found.where(F.col("tail").isNotNull()).select(
                "part", F.substring("tail", 1, width).alias("digit"), "row", "id",
                F.substring(F.col("tail"), F.lit(width + 1), F.octet_length("tail")).alias("tail"),
            )
            shared = settle(_groups(members).where("n > 1"))
    named = rows.join(done, "row", "left")
    alone = F.col("n").isNull()
    return named.select(
        "row", "id", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("keep_row", "row").alias("keep_row"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
