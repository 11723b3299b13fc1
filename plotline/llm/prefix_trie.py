"""The trie of all conversations' prefixes, by ROLLUP over positional columns of turn ids.

A turn's id holds its digest and its length, so texts are read once and never
move.  ``BLOCK`` turns of a conversation are one row of positional columns;
ROLLUP over them gives all prefixes of the block at once, and grouping_id tells
their depth.  Conversations that still share the block's last node go on in a
further block, keyed by that node; one that is alone there needs no more
grouping, for each of its further nodes has itself as only member.  Sums over
subtrees are a second ROLLUP, over the nodes, from the last block to the first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.session import settle

#: Positional columns of a block; bytes of a turn id (digest, length).
BLOCK, DIGEST, WIDTH = 8, 16, 24
#: Remainders by which a conversation chooses where it starts from, and how much of that it takes.
FAMILY, HEAD = 5, 9
#: Conversations (by id) whose ids are joined into one string before they meet the others of their node.
LISTED_BITS = 12
SLOTS = [f"t{i}" for i in range(1, BLOCK + 1)]
ROLLED = ", ".join(SLOTS)


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes of the digest of role and text, and 8 of the text's length."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.unhex(F.sha2(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256))
    return F.concat(F.substring(digest, 1, DIGEST), F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 2 * (WIDTH - DIGEST), "0")))


def _octets(path: Column) -> Column:
    """Length of the text of a path's last turn."""
    return F.coalesce(F.conv(F.hex(F.substring(path, DIGEST - WIDTH, WIDTH - DIGEST)), 16, 10).cast("long"), F.lit(0))


def _slots(path: Column) -> list[Column]:
    return [F.when(F.octet_length(path) >= WIDTH * i, F.substring(path, WIDTH * (i - 1) + 1, WIDTH)).alias(f"t{i}") for i in range(1, BLOCK + 1)]


def _path() -> Column:
    """The turn ids of a row's columns in turn (all after the first null are null)."""
    return F.concat(*[F.coalesce(t, F.lit(b"")) for t in SLOTS])


def positions(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """conv, pos, id of every turn, and conv, len.

    Numbers come from one range sort of narrow rows, so a conversation of any
    length spans many tasks.
    """
    narrow = settle(turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), turn_id(F.col(role), F.col(text)).alias("id"), F.monotonically_increasing_id().alias("read")))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("id"), F.col("read")]
    ranged = settle(
        narrow.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv", "id", F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"))
    )
    # One row for each range: bounded by the number of shuffle partitions.
    before = ranged.groupBy("piece").count().select("piece", (F.sum("count").over(Window.orderBy("piece")) - F.col("count")).alias("before"))
    numbered = ranged.join(F.broadcast(before), "piece").select("conv", "id", (F.col("before") + F.col("at")).alias("number"))
    lens = settle(numbered.groupBy("conv").agg(F.min("number").alias("first"), F.count("*").alias("len")))
    return settle(numbered.join(lens, "conv").select("conv", (F.col("number") - F.col("first")).alias("pos"), "id")), lens.select("conv", "len")


def rebuilt(turns: DataFrame, lens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv, pos, id of every rebuilt conversation's turns, and conv, n (their number, 0 too)."""
    convs = lens.withColumn("base", F.col("conv") - F.col("conv") % FAMILY).withColumn("h", (F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % HEAD).cast("long"))
    known = lens.select(F.col("conv").alias("base"), F.col("len").alias("base_len"))
    convs = convs.join(known, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_len", F.lit(0))))
    convs = settle(convs.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("n")))
    # At most HEAD - 1 rows of a conversation are another's head, each of a few conversations'.
    heads = turns.where(F.col("pos") < HEAD - 1).join(convs.select(F.col("conv").alias("c"), F.col("base").alias("conv"), "h"), "conv").where("pos < h").select(F.col("c").alias("conv"), "pos", "id")
    own = turns.join(convs, "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "id")
    return settle(heads.union(own)), convs.select("conv", "n")


def _packed(turns: DataFrame) -> DataFrame:
    """conv, block, t1 .. : BLOCK turns to a row."""
    packed = turns.groupBy("conv", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("ids"))
    return settle(packed.select("conv", "block", *[F.get("ids", F.lit(i))["id"].alias(t) for i, t in enumerate(SLOTS)]))


def _prefixes(members: DataFrame) -> DataFrame:
    """key, path, level and members of every prefix within a block."""
    rolled = members.sparkSession.sql(
        f"SELECT key, {ROLLED}, {BLOCK} - bit_count(grouping_id()) AS level, count(*) AS n_convs, min(conv) AS conv, max(n) AS longest FROM {{members}} GROUP BY key, ROLLUP ({ROLLED})",
        members=members,
    ).withColumn("path", _path())
    # Rows of shorter conversations have no turn in the last columns.
    return settle(rolled.where(F.octet_length("path") == F.col("level") * WIDTH).select("key", "path", "level", "n_convs", "conv", "longest"))


def _ends(ends: DataFrame) -> DataFrame:
    """block, key, path, ends: the digest of the listed ids of the conversations that end at a node.

    Ids are joined first within ranges of 2^LISTED_BITS ids, so few strings of a node meet.
    """
    part = F.shiftright("conv", LISTED_BITS)
    listed = ends.groupBy("block", "key", "path", part.alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "ids"))), lambda s: s["ids"]), ",")
    return listed.groupBy("block", "key", "path").agg(F.sha2(F.encode(whole, "UTF-8"), 256).alias("ends"))


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv (its least member), depth,
    parent_conv, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn``, null first, equal ones by role and text (their
    digest).  Null role and text are empty, of any length otherwise; rows without
    conversation id are left out; equal rows are turns of their own.  An empty
    table gives no node, not even a root.  Other columns are ignored.  Rounds grow
    with the longest prefix that two conversations share (``BLOCK`` turns each),
    not with the longest conversation.  The ids that end at one node are one
    string, as its digest is sequential: up to 2 GB.
    """
    placed, lens = positions(turns, conv, turn, role, text)
    seqs, convs = rebuilt(placed, lens)
    root = convs.agg(F.min("conv")).first()[0]
    packed = _packed(seqs)
    first = packed.where("block = 0").drop("block")
    members = convs.join(first, "conv", "left").select(F.lit(root).cast("long").alias("key"), "conv", "n", *SLOTS)
    levels: list[DataFrame] = []
    ends: list[DataFrame] = []
    while True:
        block, stop = len(levels), BLOCK * (len(levels) + 1)
        if block:
            members = settle(members)
        nodes = _prefixes(members)
        levels.append(nodes)
        ends.append(members.where(F.col("n") <= stop).select(F.lit(block).alias("block"), "key", _path().alias("path"), "conv"))
        shared = nodes.where((F.col("level") == BLOCK) & (F.col("n_convs") > 1) & (F.col("longest") > stop))
        if shared.isEmpty():
            break
        onward = members.where(F.col("n") > stop).select("key", _path().alias("path"), F.col("conv").alias("c"), "n")
        onward = onward.join(shared.select("key", "path", "conv"), ["key", "path"]).select(F.col("conv").alias("key"), F.col("c").alias("conv"), "n")
        members = onward.join(packed.where(F.col("block") == block + 1).drop("block"), "conv").select("key", "conv", "n", *SLOTS)

    hashes = settle(_ends(reduce(DataFrame.union, ends)))
    above, rows, tails = None, [], []
    for block in reversed(range(len(levels))):
        nodes, stop = levels[block], BLOCK * (block + 1)
        up = F.substring("path", F.lit(1), (WIDTH * (F.col("level") - 1)).cast("int"))
        kids = nodes.where("level > 0").groupBy("key", up.alias("path")).agg(F.count("*").alias("kids"))
        full = nodes.join(kids, ["key", "path"], "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
        # A conversation alone at the block's end has a chain of nodes below, with one leaf.
        tail = (F.col("level") == BLOCK) & (F.col("n_convs") == 1) & (F.col("longest") > stop)
        full = full.withColumn("kids", F.when(tail, F.lit(1)).otherwise(F.col("kids"))).withColumn("leaves", F.when((F.col("kids") == 0) | tail, F.lit(1)).otherwise(F.lit(0)))
        full = full.withColumn("saved", (F.col("n_convs") - 1) * _octets(F.col("path")))
        if above is not None:
            # What the next block's nodes come to, at the node that they hang on.
            below = above.select(F.col("key").alias("conv"), F.lit(BLOCK).alias("level"), F.col("kids").alias("more_kids"), F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
            full = full.join(below, ["conv", "level"], "left")
            for name in ("kids", "saved"):
                full = full.withColumn(name, F.col(name) + F.coalesce(f"more_{name}", F.lit(0)))
            full = full.withColumn("leaves", F.coalesce("more_leaves", "leaves"))
        full = settle(full.select("key", "path", "level", "conv", "n_convs", "kids", "leaves", "saved", "longest"))
        # The next block's root is this block's node, counted there.
        counted = full.where("level > 0" if block else "true").select("key", *_slots(F.col("path")), "leaves", "saved")
        sums = counted.sparkSession.sql(
            f"SELECT key, {ROLLED}, {BLOCK} - bit_count(grouping_id()) AS level, sum(leaves) AS leaves, sum(saved) AS saved FROM {{counted}} GROUP BY key, ROLLUP ({ROLLED})", counted=counted,
        ).withColumn("path", _path())
        sums = settle(sums.where(F.octet_length("path") == F.col("level") * WIDTH).select("key", "path", "level", "leaves", "saved"))
        found = full.drop("leaves", "saved").join(sums.drop("level"), ["key", "path"])
        parents = full.where(f"level > 0 AND level < {BLOCK}").select("key", F.col("path").alias("up"), F.col("conv").alias("parent"))
        found = found.where("level > 0" if block else "true").withColumn("up", F.when(F.col("level") > 1, up)).join(parents, ["key", "up"], "left")
        found = found.join(hashes.where(F.col("block") == block).drop("block"), ["key", "path"], "left")
        rows.append(found.select(
            "conv", (F.col("level") + BLOCK * block).cast("long").alias("depth"),
            F.when(F.col("level") > 1, F.col("parent")).when(F.lit(block > 0) | (F.col("level") == 1), F.col("key")).alias("parent_conv"),
            "n_convs", F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
        ))
        alone = full.where((F.col("level") == BLOCK) & (F.col("n_convs") == 1) & (F.col("longest") > stop)).select("conv", F.col("longest").alias("n"))
        tails.append(seqs.where(F.col("pos") >= stop).select("conv", "pos").join(alone, "conv"))
        above = full.where("level = 0").select("key", "kids").join(sums.where("level = 0").drop("path", "level"), "key")
    chain = reduce(DataFrame.union, tails)
    last = F.col("pos") + 1 == F.col("n")
    rows.append(chain.select(
        "conv", (F.col("pos") + 1).alias("depth"), F.col("conv").alias("parent_conv"), F.lit(1).cast("long"), F.when(last, F.lit(0)).otherwise(F.lit(1)).cast("long"),
        F.lit(1).cast("long"), F.lit(0).cast("long"), F.when(last, F.sha2(F.encode(F.col("conv").cast("string"), "UTF-8"), 256)).otherwise(F.sha2(F.lit(b""), 256)),
    ))
    return reduce(DataFrame.union, rows)
