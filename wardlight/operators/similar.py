"""Requests that say nearly the same: a set-similarity join inside blocks, and its groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardlight.session import materialize


def connected_groups(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of edges(a, b) reaches.

    Large-star and small-star steps in turn: every node hands its larger neighbours, then its
    smaller ones, over to the smallest it knows, until nothing changes. The groups end as stars, so
    rows never outnumber the edges, and a node of very many neighbours is summed up by a minimum.
    """
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = materialize(edges.filter("a <> b").select(larger, smaller).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        handed = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = materialize(handed.filter("a <> b").distinct(), "edges")
        down = star.groupBy("a").agg(F.min("b").alias("m"))
        to_least = star.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        now = materialize(to_least.filter("a <> b").distinct(), "edges")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """The rarest words of each set: two sets as similar as asked share one of them.

    Words are ordered by the number of sets of the block that hold them. Of n words, the first
    n - ceil(percent * n / 100) + 1 are kept, with their place.
    """
    words = sets.select("_block", "_rep", "_n", F.explode("_words").alias("_w"))
    held = words.groupBy("_block", "_w").agg(F.count("*").alias("_df"))
    place = F.row_number().over(W.partitionBy("_rep").orderBy("_df", "_w"))
    ordered = words.join(held, ["_block", "_w"]).withColumn("_at", place).drop("_df")
    return ordered.filter(F.col("_at") <= F.col("_n") - F.expr(f"({percent} * _n + 99) div 100") + 1)


#: Longs of a set's sketch, and of the short one that candidates carry.
SKETCH, SHORT = 16, 4


def _sketches(sets: DataFrame) -> DataFrame:
    """Sets with the parities of their words over 64 * SKETCH hash values, and the same folded to SHORT longs.

    Two sketches differ in at most as many bits as there are words in one set alone.
    """
    bit = "shiftleft(1L, cast(w & 63 as int))"
    parity = "aggregate(_words, 0L, (m, w) -> m ^ if((shiftright(w, 6) & {0}) = {1}, " + bit + ", 0L)) AS _k{1}"
    whole = sets.select("*", *(F.expr(parity.format(SKETCH - 1, j)) for j in range(SKETCH)))
    folded = (" ^ ".join(f"_k{k}" for k in range(j, SKETCH, SHORT)) + f" AS _s{j}" for j in range(SHORT))
    return whole.select("*", *(F.expr(f) for f in folded))


def _near(mine: str, other: str, longs: int, n: Column, percent: int) -> Column:
    """Whether two sketches differ in so few bits that sets of `n` words in all may be similar."""
    apart = sum((F.bit_count(F.col(f"{mine}{j}").bitwiseXOR(F.col(f"{other}{j}"))) for j in range(longs)), F.lit(0))
    return apart * (100 + percent) <= n * (100 - percent)


def _may_match(percent: int) -> Column:
    """Whether sizes, places of the shared word and sketches leave enough words in common."""
    small, large = F.least("_n", "n"), F.greatest("_n", "n")
    common = 1 + F.least(F.col("_n") - F.col("_at"), F.col("n") - F.col("at"))
    both = F.col("_n") + F.col("n")
    may = (small * 100 >= large * percent) & (common * (100 + percent) >= both * percent)
    return may & _near("_s", "s", SHORT, both, percent)


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose word sets really are that similar; whole sets go only to pairs of near sketches."""
    told = lambda c: sets.select(F.col("_rep").alias(c), F.col("_n").alias(f"{c}_n"), *(F.col(f"_k{j}").alias(f"{c}_k{j}") for j in range(SKETCH)))
    known = pairs.distinct().join(told("a"), "a").join(told("b"), "b")
    near = known.filter(_near("a_k", "b_k", SKETCH, F.col("a_n") + F.col("b_n"), percent)).select("a", "b")
    of = lambda c: sets.select(F.col("_rep").alias(c), F.col("_words").alias(f"_{c}"))
    both = near.join(of("a"), "a").join(of("b"), "b")
    common = F.size(F.array_intersect("_a", "_b"))
    alike = common * 100 >= (F.size("_a") + F.size("_b") - common) * percent
    return both.filter(alike).select("a", "b")


def similar_requests(r: DataFrame, id_col: str, text: str, block: list[str], percent: int = 80) -> DataFrame:
    """Groups of requests of one block (say category and location) whose texts are alike.

    Two requests are linked if their sets of words have at least `percent` % of all their words in
    common (Jaccard), and grouped if links lead from one to the other. Returns id, block, `group_id`
    (the smallest id of the group) and `members`, for groups of two or more. Ids are unique whole
    numbers. A text without words is like no other; missing block values are a value of their own.
    Words are compared by 64-bit hashes.

    Equal sets are one set from the start. Candidates share one of their rarest words, and sizes
    and the word's place must allow the similarity; only then the sets are compared. A large group
    never gives all its pairs: first the sets that share a rare word are compared with the smallest
    of them, and afterwards only sets which that has not joined. Candidates carry sketches of their sets,
    which rule out nearly all unlike ones before any set is sent to a pair.
    """
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # numbers are made distinct and sorted natively, strings one by one
    hashes = F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))
    rows = r.select(F.col(id_col).cast("long").alias("_id"), F.struct(*block).alias("_block"), hashes.alias("_words"))
    spoken = rows.filter(F.size("_words") > 0).withColumns({"_print": F.xxhash64("_words"), "_n": F.size("_words")})
    keyed = materialize(spoken, "word-sets")
    first = keyed.groupBy("_block", "_print").agg(F.min("_id").alias("_rep"), F.count("*").alias("_copies"))
    first = materialize(first, "first-of-equals")
    reps = first.select(F.col("_rep").alias("_id"))
    firsts = keyed.join(reps, "_id", "left_semi").select(F.col("_id").alias("_rep"), "_block", "_n", "_words")
    sets = materialize(_sketches(firsts), "sets")
    bits, other_bits = [f"_s{j}" for j in range(SHORT)], [F.col(f"_s{j}").alias(f"s{j}") for j in range(SHORT)]
    prefix = materialize(_prefixes(sets, percent).join(sets.select("_rep", *bits), "_rep"), "prefixes")

    smallest = F.min(F.struct("_n", "_rep", "_at", *bits)).alias("_least")
    pivot = prefix.groupBy("_block", "_w").agg(smallest).select("_block", "_w", "_least.*")
    pivot = pivot.select("_block", "_w", F.col("_n").alias("n"), F.col("_rep").alias("b"), F.col("_at").alias("at"), *other_bits)
    near = prefix.join(pivot, ["_block", "_w"]).filter((F.col("_rep") != F.col("b")) & _may_match(percent))
    links = materialize(_similar(near.select(F.col("_rep").alias("a"), "b"), sets, percent), "links")

    joined = connected_groups(links)
    tagged = prefix.join(joined.withColumnRenamed("node", "_rep"), "_rep", "left").withColumn("_root", F.coalesce("root", "_rep")).drop("root")
    tagged = materialize(tagged, "prefixes-grouped")
    split = tagged.groupBy("_block", "_w").agg(F.min("_root").alias("lo"), F.max("_root").alias("hi")).filter("lo <> hi").select("_block", "_w")
    apart = tagged.join(split, ["_block", "_w"], "left_semi")
    other = apart.select("_block", "_w", F.col("_rep").alias("b"), F.col("_n").alias("n"), F.col("_at").alias("at"), F.col("_root").alias("root"), *other_bits)
    across = apart.join(other, ["_block", "_w"]).filter((F.col("_rep") < F.col("b")) & (F.col("_root") != F.col("root")) & _may_match(percent))
    more = _similar(across.select(F.col("_rep").alias("a"), "b"), sets, percent)

    groups = connected_groups(links.unionByName(more)).withColumnRenamed("node", "_rep")
    placed = first.join(groups, "_rep", "left").withColumn("group_id", F.coalesce("root", "_rep"))
    sizes = placed.groupBy("group_id").agg(F.sum("_copies").alias("members")).filter("members > 1")
    of_print = placed.join(sizes, "group_id").select("_block", "_print", "group_id", "members")
    found = keyed.select("_id", "_block", "_print").join(of_print, ["_block", "_print"])
    return found.select(F.col("_id").alias(id_col), "_block.*", "group_id", "members")
