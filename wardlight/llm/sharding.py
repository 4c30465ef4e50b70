"""Balanced sharding by label propagation under quotas.

Documents of equal text are linked. Every document starts with the label of a shard drawn from its
row. In a round the members of a group vote with their labels, and the whole group moves to the
label with the most votes among the shards that have room for it; a group whose labels are all full
also considers a shard drawn in proportion to the room left. Quotas are granted per shard, larger
groups first, as far as the room goes; a refused group votes again in the next round. Documents
without an equal text have no neighbours to follow and give up their places: they fill the gaps at
the end.

Larger groups go through their rounds before smaller ones, as they find room least easily: those
above a half of a shard, a quarter, and so on to a fiftieth, then all others together. A group of a
shard or more first takes whole shards, those with most of its votes.

What is still cut when no round grants a move any more is repaired: groups above a fiftieth of a
shard are seated on the driver (less than fifty per shard), the others laid on a line by running
sums and cut into stretches in proportion to the room left; one that fits nowhere fills the
emptiest shards in turn.

The law that holds is `rows`: counts are at most one apart.

Defined results: a null text has no bytes and the checksum of the empty text, and belongs to
the group of empty texts; repeated rows and null ids are rows like any other. With fewer rows
than shards the first shards hold one row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from wardlight.llm.common import materialize

SHARDS = 24
#: Groups of more than this part of a shard move before the others, and are repaired on the driver.
LARGE = 50
#: Rounds of one size of groups; what they leave is repaired.
ROUNDS = 8
#: Rows of one numbering task, and the least number of such tasks.
CHUNK_ROWS, CHUNKS = 50_000, 256


def _chunk(key: str, n_rows: int) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(int(max(CHUNKS, -(-n_rows // CHUNK_ROWS))))).cast("int")


def _numbered(rows: DataFrame, key: str, order: list, n_rows: int) -> DataFrame:
    """rows with `place`: 0, 1, ... within each key by `order` (hashed into chunks, so no key meets in one task)."""
    cut = rows.withColumn("chunk", _chunk("row", n_rows))
    rank = Window.partitionBy(key, *order[:-1], "chunk").orderBy(order[-1])
    counts = cut.groupBy(key, *order[:-1], "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy(*order[:-1], "chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, *order[:-1], "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = cut.withColumn("within", F.row_number().over(rank) - 1)
    joined = placed.join(offsets, [key, *order[:-1], "chunk"])
    return joined.withColumn("place", F.col("offset") + F.col("within")).drop("chunk", "within", "offset")


def _seats(sizes: list[int], room: list[int]) -> list[list[tuple[int, int]]]:
    """(shard, rows) parts of each group, given largest first; takes the seats from `room`."""
    out = []
    for size in sizes:
        parts = []
        while size:
            fits = [i for i, x in enumerate(room) if x >= size]
            i = min(fits, key=lambda i: room[i]) if fits else max(range(len(room)), key=lambda i: room[i])
            taken = min(size, room[i])
            parts.append((i, taken))
            room[i] -= taken
            size -= taken
        out.append(parts)
    return out


def _line(groups: DataFrame, n_rows: int) -> DataFrame:
    """groups(link, size) with `start`: the rows of all groups before it."""
    cut = groups.withColumn("chunk", _chunk("link", n_rows))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("chunk").agg(F.sum("size").alias("total"))
    offsets = totals.select("chunk", F.coalesce(F.sum("total").over(earlier(Window.partitionBy(F.lit(0)).orderBy("chunk"))), F.lit(0)).alias("offset"))  # a row per chunk
    within = F.coalesce(F.sum("size").over(earlier(Window.partitionBy("chunk").orderBy("link"))), F.lit(0))
    return cut.withColumn("within", within).join(offsets, "chunk").select("link", "size", (F.col("offset") + F.col("within")).alias("start"))


def _stretch(place: str, lengths: list[int]) -> F.Column:
    """The shard in whose stretch a place lies; shards follow each other with these lengths."""
    to, edge = F.lit(None).cast("int"), 0
    for i, x in enumerate(lengths):
        edge += x
        to = F.coalesce(to, F.when(F.col(place) < edge, F.lit(i)))
    return to


def _take_whole_shards(groups: DataFrame, votes: DataFrame, room: list[int]) -> tuple[list, list[list[tuple[int, int]]]]:
    """Groups of a shard or more, and the (shard, rows) parts they take by votes; at most one group a shard."""
    least = min(room)
    big = sorted(((r["link"], r["size"]) for r in groups.filter(F.col("size") >= max(2, least)).collect()), key=lambda g: (-g[1], str(g[0])))
    cast = {}
    if big:
        for r in votes.filter(F.col("size") >= max(2, least)).collect():
            cast.setdefault(r["link"], {})[r["shard"]] = r["votes"]
    parts = []
    for link, size in big:
        taken = []
        by_votes = sorted(range(len(room)), key=lambda i: (-cast[link].get(i, 0), i))
        for whole in (True, False):  # first whole shards, then a place for the rest
            for i in by_votes:
                if size and room[i] and (room[i] <= size if whole else room[i] >= size):
                    rows = min(size, room[i])
                    taken.append((i, rows))
                    room[i] -= rows
                    size -= rows
        if size:
            taken += _seats([size], room)[0]
        parts.append(taken)
    return [link for link, _ in big], parts


def _granted(voting: DataFrame, room: list[int], n_rows: int, round_: int) -> DataFrame:
    """link, size, shard of the groups that may move in this round.

    `voting` has link, size, shard, votes. Within a shard, larger classes of size (powers of two)
    come first; a group is granted if it fits behind those before it.
    """
    room_at = F.element_at(F.array(*map(F.lit, room)), F.col("shard") + 1)
    total = sum(room)
    drawn = voting.select("link", "size").distinct().withColumn("_at", F.pmod(F.xxhash64("link", F.lit(round_)), F.lit(max(1, total))))
    drawn = drawn.select("link", "size", _stretch("_at", room).alias("shard"), F.lit(0).cast("long").alias("votes"))
    choices = voting.unionByName(drawn).filter(room_at >= F.col("size"))
    best = F.max_by("shard", F.struct(F.col("votes"), F.xxhash64("link", "shard", F.lit(round_))))
    wishes = choices.groupBy("link", "size").agg(best.alias("shard"))
    wishes = wishes.withColumns({"cls": -F.floor(F.log2(F.col("size").cast("double"))).cast("int"), "chunk": _chunk("link", n_rows)})
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = wishes.groupBy("shard", "cls", "chunk").agg(F.sum("size").alias("total"))
    ahead = F.sum("total").over(before(Window.partitionBy("shard").orderBy("cls", "chunk")))
    offsets = totals.select("shard", "cls", "chunk", F.coalesce(ahead, F.lit(0)).alias("offset"))
    within = F.coalesce(F.sum("size").over(before(Window.partitionBy("shard", "cls", "chunk").orderBy("link"))), F.lit(0))
    placed = wishes.withColumn("within", within).join(offsets, ["shard", "cls", "chunk"])
    return placed.filter(F.col("offset") + F.col("within") + F.col("size") <= room_at).select("link", "size", "shard")


def propagate(votes: DataFrame, room: list[int], share: int, n_rows: int) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of moves: tables (link, size, shard) of the groups that found a shard, and the votes of the others.

    `room` is brought up to date; `share` is the size of a shard.
    """
    settled, left, round_ = [], votes, 0
    limits = {share // 2**k for k in range(1, LARGE.bit_length())} | {share // LARGE, 0}
    for limit in sorted(limits, reverse=True):
        for _ in range(ROUNDS):
            round_ += 1
            level = left.filter(F.col("size") > limit)
            if not level.take(1):
                break
            moved = materialize(_granted(level, room, n_rows, round_), "moved")
            filled = moved.groupBy("shard").agg(F.sum("size").alias("n")).collect()  # one row per shard
            if not filled:
                break
            for r in filled:
                room[r["shard"]] -= r["n"]
            settled.append(moved)
            left = materialize(left.join(moved.select("link"), "link", "left_anti"), "votes")
    return settled, left


def balanced_shards(links: DataFrame, shards: int = SHARDS) -> DataFrame:
    """row, shard for links(row, link): rows of one link value belong together, null ones are free."""
    spark, n = links.sparkSession, links.count()
    room = [n // shards + (i < n % shards) for i in range(shards)]
    share = max(1, n // shards)
    named = links.filter("link is not null")
    groups = materialize(named.groupBy("link").agg(F.count("*").alias("size")).filter("size > 1"), "groups")
    label = F.pmod(F.xxhash64("row", F.lit(7)), F.lit(shards)).cast("int").alias("shard")
    cast = named.select("link", label).groupBy("link", "shard").agg(F.count("*").alias("votes"))
    votes = materialize(cast.join(groups, "link").select("link", "size", "shard", "votes"), "votes")

    seated, parts = _take_whole_shards(groups, votes, room)
    small_enough = votes.filter(F.col("size") < max(2, share))
    settled, left = propagate(small_enough, room, share, n)

    # Repair of what no round could move whole.
    cut = materialize(left.select("link", "size").distinct(), "cut-groups")
    is_large = F.col("size") * LARGE > share
    heads = sorted(((r["link"], r["size"]) for r in cut.filter(is_large).collect()), key=lambda g: -g[1])  # under LARGE + 1 a shard
    seated, parts = seated + [link for link, _ in heads], parts + _seats([size for _, size in heads], room)
    small = cut.filter(~is_large)
    total = small.agg(F.sum("size")).first()[0] or 0
    ends = [sum(room[: i + 1]) * total // max(1, sum(room)) for i in range(shards)]
    stretches = [e - s for s, e in zip([0, *ends], ends)]
    end = F.element_at(F.array(*map(F.lit, ends)), F.col("shard") + 1)
    laid = materialize(_line(small, n).withColumn("shard", _stretch("start", stretches)).withColumn("crosses", F.col("start") + F.col("size") > end), "line")
    for r in laid.filter("not crosses").groupBy("shard").agg(F.sum("size").alias("n")).collect():  # one row per shard
        room[r["shard"]] -= r["n"]
    crossing = sorted(((r["link"], r["size"]) for r in laid.filter("crosses").collect()), key=lambda g: -g[1])  # at most one per shard
    seated, parts = seated + [link for link, _ in crossing], parts + _seats([size for _, size in crossing], room)

    whole = laid.filter("not crosses").select("link", "shard")
    for moved in settled:
        whole = whole.unionByName(moved.select("link", "shard"))
    named_type = StructType([links.schema["link"], StructField("id", IntegerType()), StructField("shard", IntegerType())])
    heads = F.broadcast(spark.createDataFrame([(link, i, p[0][0] if len(p) == 1 else None) for i, (link, p) in enumerate(zip(seated, parts))], named_type))
    spans = [(i, sum(x for _, x in p[:k]), sum(x for _, x in p[: k + 1]), s) for i, p in enumerate(parts) if len(p) > 1 for k, (s, _) in enumerate(p)]
    table = F.broadcast(spark.createDataFrame(spans, "id int, begin long, end long, to int"))
    at_heads = named.join(heads, "link")
    ranked = _numbered(at_heads.filter("shard is null").select("row", "id"), "id", ["row"], n)
    placed = (
        at_heads.filter("shard is not null").select("row", "shard")
        .unionByName(ranked.join(table, "id").filter("place >= begin and place < end").select("row", F.col("to").alias("shard")))
        .unionByName(named.join(heads, "link", "left_anti").join(whole, "link", "left").select("row", "shard"))
        .unionByName(links.filter("link is null").select("row", F.lit(None).cast("int").alias("shard")))
    )
    placed = materialize(placed, "placed")
    free = _numbered(placed.filter("shard is null").select("row", F.lit(0).alias("all")), "all", ["row"], n)
    return placed.filter("shard is not null").unionByName(free.select("row", _stretch("place", room).alias("shard")))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs(doc_id, text)."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw).cast("long") + 8).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("link"),
    )
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    n = rows.count()
    placed = balanced_shards(rows.select("row", F.struct("link", "text_crc32", "size").alias("link")), shards)
    slots = _numbered(placed, "shard", ["row"], n).select("row", "shard", F.col("place").alias("slot"))
    return rows.join(slots, "row").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard")
    )
