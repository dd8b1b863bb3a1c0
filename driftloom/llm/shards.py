"""Balanced shards by label propagation. DataFrame functions only.

Rows of a text of at most ``FAN`` copies are parts of their own; those of any other are contracted into
``FAN`` parts, or as many more as keep parts below about ``PART`` rows, or a quarter of a shard. Parts
are nodes that weigh as many rows as they hold; the parts of a text are linked in a tree of fan-out
``FAN``, so that no node has many links and no task a whole group. Each node starts in a shard drawn by
a hash. In each round nodes look at the shards of what they are linked to, count the rows there, and ask
to move to the shard with most; requests are granted, by a hash of the node, as far as a shard's quota of
rows allows. Nodes that move at the same time would chase each other, so each round lets half of them move.
Only linked nodes take part in the rounds.

After the rounds parts join the shard that holds most rows of their text. Rows without a copy fill what
room the shards have left. Then rows are numbered in the order of their shards, equal texts side by side,
and cut into equal counts: whatever a shard has too many goes to the next one, at its edge. So counts
differ by one at most, slots have no gaps, and a text of ``n`` copies lies in at most
``ceil(n / room) + 1`` shards of ``room`` rows.

A row's size is the UTF-8 bytes of its text plus one; a null text has none, the checksum 0, and equals
other null and empty texts. Rows with the same or no id are rows of their own. An empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.storage import cut

ROUNDS = 10
#: Rows of a text that move as one, at most; also a quarter of a shard, so that parts fit beside others.
PART = 5_000
#: Parts of a text that are linked to the same part.
FAN = 32
#: A shard may hold this much more than its share while rows move.
SLACK = 1.25
#: Rows that are numbered together, about.
STRIDE = 1_000


def numbered(docs: DataFrame) -> DataFrame:
    """Rows with a number of their own, their size, checksum and a key that equal texts share."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("key"),
    )
    return cut(rows)  # the numbers hold from here on


def parts_of_texts(rows: DataFrame, part: int = PART) -> DataFrame:
    """(row, key, part) of the rows whose text is repeated; every such text has several parts, which propagation brings together."""
    groups = rows.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    number = F.expr(f"if(copies <= {FAN}, row, pmod(xxhash64(row), greatest({FAN}, ceil(copies / {part}))))")
    return rows.select("row", "key").join(groups, "key").select("row", "key", number.alias("part"))


def weighted_nodes(parts: DataFrame) -> DataFrame:
    """(node, weight, key, part): a node for each part, named by its first row."""
    return parts.groupBy("key", "part").agg(F.min("row").alias("node"), F.count("*").alias("weight"))


def tree_links(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """(a, b): the nodes of a text in the order of their parts, each linked to one of the earlier.

    A part without rows has no node, so the order counts nodes; only texts of several parts are ordered.
    """
    several = nodes.where("part > 0").select("key").distinct()
    place = F.row_number().over(Window.partitionBy("key").orderBy("part")) - 1
    ordered = cut(nodes.join(several, "key", "left_semi").select("key", "node", place.alias("place")))
    below = ordered.where("place > 0").select("key", F.col("node").alias("a"), F.floor((F.col("place") - 1) / fan).alias("place"))
    return below.join(ordered.withColumnRenamed("node", "b"), ["key", "place"]).select("a", "b")


def _granted(demand: dict[tuple[int, int], int], sizes: dict[int, int], most: float) -> dict[tuple[int, int], float]:
    """Share of the requests from one shard to another that fits; ``demand`` has a row for each pair of shards."""
    share = dict.fromkeys(demand, 1.0)
    for _ in range(20):
        moved = {pair: n * share[pair] for pair, n in demand.items()}
        for shard in {to for _, to in demand}:
            leaving = sum(n for (a, _), n in moved.items() if a == shard)
            coming = sum(n for (_, b), n in moved.items() if b == shard)
            room = max(0.0, most - sizes.get(shard, 0) + leaving)
            if coming > room:
                for pair in demand:
                    if pair[1] == shard:
                        share[pair] *= room / coming
    return share


def propagate(nodes: DataFrame, links: DataFrame, shards: int, total: int, rounds: int = ROUNDS) -> DataFrame:
    """(node, weight, shard) after label propagation under quotas in rows; ``total`` rows are to be placed in all."""
    start = nodes.select("node", "weight", F.expr(f"cast(pmod(xxhash64(node), {shards}) as int)").alias("shard"))
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = cut(start.join(ends, "node", "left_semi"))
    alone = start.join(ends, "node", "left_anti")
    fixed = _rows_by_shard(alone)
    both = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")))
    for number in range(rounds):
        there = labels.select(F.col("node").alias("v"), "weight", "shard")
        votes = both.join(there, "v").groupBy("u", "shard").agg(F.sum("weight").alias("votes"))
        wanted = votes.groupBy(F.col("u").alias("node")).agg(F.max(F.struct("votes", (-F.col("shard")).alias("back"))).alias("top"))
        wanted = wanted.select("node", (-F.col("top.back")).alias("wish"))
        turn = F.expr(f"pmod(xxhash64(node, {number}), 2) = 0")
        asks = cut(labels.join(wanted, "node").where((F.col("wish") != F.col("shard")) & turn).select("node", "weight", "shard", "wish"))
        # a row for each pair of shards
        demand = {(r.shard, r.wish): r.weight for r in asks.groupBy("shard", "wish").agg(F.sum("weight").alias("weight")).collect()}
        if not demand:
            continue
        sizes = _rows_by_shard(labels)
        sizes = {s: sizes.get(s, 0) + fixed.get(s, 0) for s in range(shards)}
        share = _granted(demand, sizes, SLACK * total / shards)
        quota = labels.sparkSession.createDataFrame([(a, b, s) for (a, b), s in share.items()], "shard int, wish int, share double")
        drawn = F.expr(f"pmod(xxhash64(node, {number}, 'quota'), 1000000) / 1000000D")
        moved = asks.join(F.broadcast(quota), ["shard", "wish"]).where(drawn < F.col("share")).select("node", "wish")
        labels = cut(labels.join(moved, "node", "left").select("node", "weight", F.coalesce("wish", "shard").alias("shard")))
    return labels.unionByName(alone)


def _rows_by_shard(labels: DataFrame) -> dict[int, int]:
    return {r.shard: r.weight for r in labels.groupBy("shard").agg(F.sum("weight").alias("weight")).collect()}


def home_shards(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, shard): the shard that holds most rows of a text after propagation, the smaller of two."""
    held = nodes.select("node", "key").join(labels, "node").groupBy("key", "shard").agg(F.sum("weight").alias("held"))
    best = held.groupBy("key").agg(F.max(F.struct("held", (-F.col("shard")).alias("back"))).alias("top"))
    return best.select("key", (-F.col("top.back")).alias("shard"))


def filling(taken: dict[int, int], shards: int, total: int) -> Column:
    """A shard for each row without a copy, drawn by its hash in proportion to the room that is left."""
    room = [max(0.0, total / shards - taken.get(s, 0)) for s in range(shards)]
    room = room if sum(room) else [1.0] * shards
    ends, at = [], 0.0
    for r in room:
        at += r
        ends.append(at / sum(room))
    drawn = F.expr("pmod(xxhash64(row, 'fill'), 1000000) / 1000000D")
    full = F.array(*[F.lit(e) for e in ends])
    return F.least(F.size(F.filter(full, lambda e: e <= drawn)), F.lit(shards - 1)).cast("int")


def equal_counts(placed: DataFrame, shards: int, total: int) -> DataFrame:
    """``placed`` (row, shard, key, part) with ``shard`` and ``slot`` such that counts are at most one apart.

    Rows are numbered by shard, then by text. Rows without a copy (null key) come at both ends of a shard,
    so that it is mostly these that change shards. Numbers come from counts within parts of a text, sums
    over the parts of a block and sums over blocks, so no task sorts a shard or a large group.
    """
    blocks = max(1, total // (3 * shards * STRIDE))
    alone = 2 * blocks * F.expr("pmod(xxhash64(row, 'end'), 2)") + F.expr(f"pmod(xxhash64(row), {blocks})")
    block = F.when(F.col("key").isNull(), alone).otherwise(blocks + F.expr(f"pmod(xxhash64(key), {blocks})"))
    piece = ["shard", "block", "key", "part"]
    dealt = placed.select("row", "shard", block.alias("block"), F.coalesce("key", F.lit("")).alias("key"), F.coalesce("part", F.lit(0)).alias("part"))
    counts = cut(dealt.groupBy(*piece).agg(F.count("*").alias("n")))
    inside = F.sum("n").over(Window.partitionBy("shard", "block").orderBy("key", "part")) - F.col("n")
    by_block = counts.groupBy("shard", "block").agg(F.sum("n").alias("n"))
    within = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    by_shard = counts.groupBy("shard").agg(F.sum("n").alias("size"))
    earlier = by_shard.select(F.col("shard").alias("_s"), F.col("size").alias("_n"))
    # as many rows as there are shards
    before = by_shard.join(F.broadcast(earlier), F.col("_s") < F.col("shard"), "left").groupBy("shard").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("before"))
    starts = by_block.select("shard", "block", within.alias("within")).join(F.broadcast(before), "shard").select("shard", "block", (F.col("within") + F.col("before")).alias("start"))
    offsets = counts.select(*piece, inside.alias("inside")).join(starts, ["shard", "block"]).select(*piece, (F.col("inside") + F.col("start")).alias("offset"))
    place = F.row_number().over(Window.partitionBy(*piece).orderBy("row")) - 1
    ranked = dealt.withColumn("place", place).join(offsets, piece).withColumn("rank", F.col("place") + F.col("offset"))
    shard = F.expr(f"cast(rank * {shards} div {max(1, total)} as int)")
    start = F.expr(f"(shard * {max(1, total)}L + {shards - 1}) div {shards}")
    return ranked.drop("shard").withColumn("shard", shard).withColumn("slot", F.col("rank") - start).select("row", "shard", "slot")


def assign_shards(docs: DataFrame, shards: int = 16, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row, by links between equal texts."""
    rows = numbered(docs)
    total = rows.count()
    parts = cut(parts_of_texts(rows, min(PART, max(2, total // (4 * shards)))))
    nodes = cut(weighted_nodes(parts))
    labels = propagate(nodes, cut(tree_links(nodes)), shards, total, rounds)
    homes = cut(home_shards(nodes, labels))
    weights = nodes.groupBy("key").agg(F.sum("weight").alias("weight"))
    taken = _rows_by_shard(homes.join(weights, "key"))
    copies = parts.join(homes, "key").select("row", "shard", "key", "part")
    single = rows.join(parts.select("row"), "row", "left_anti").select("row", filling(taken, shards, total).alias("shard"))
    placed = cut(copies.unionByName(single, allowMissingColumns=True))
    # places are written once: a lost executor does not have them numbered again
    return rows.join(cut(equal_counts(placed, shards, total)), "row").select("doc_id", "size", "text_crc32", "shard", "slot")


def cut_links(placed: DataFrame, key: str = "text_crc32", shard: str = "shard") -> DataFrame:
    """One row: ``links`` (rows of each group beyond its first) and ``cut`` (rows outside the group's largest shard)."""
    held = placed.groupBy(key, shard).agg(F.count("*").alias("n"))
    groups = held.groupBy(key).agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("links"), F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0)).alias("cut"))
