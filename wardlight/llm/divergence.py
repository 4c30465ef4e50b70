"""Source divergence audit by single-pass in-memory indexing.

Which words does a source use unlike its language, and how far apart are two sources?

1. Every task reads its documents once and builds block postings (language, term, source) ->
   (occurrences, documents) in memory. When `BLOCK_ENTRIES` of them are held, they are spilled as
   a run: chunks in ascending order of term, per hash shard of the term. Runs are written to the
   shared folder.
2. A task per hash shard merges the runs. Chunks come sorted by their first term, and a heap holds
   the open ones by their last term, so only chunks that overlap are held. All postings of a term
   meet there, so terms in too few documents go no further. More than `FAN_IN` runs are merged in
   several passes.
3. Frequencies give each (language, source) group a smoothed probability per kept term. The
   distance of two groups is V times the distance of their probabilities of an unseen term, plus
   corrections: for the terms of one group, from a histogram of its probabilities; for the terms
   that both hold, streamed term by term into a tile of at most `TILE` x `TILE` pairs.

All arithmetic is on integers: probabilities are in billionths, numerators are decimals of 31
digits.

Defined results: null text, lang and source are the empty string. A group without kept terms
has pairs, but no terms. A language without kept terms has distance 0 between its sources. A
language of one source has no pairs. Repeated rows count each. An empty table gives no rows. Other
columns are ignored. A very long text is counted in slices; its set of distinct terms is held.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.common import materialize, small

#: Block postings held by a task before a run is spilled.
BLOCK_ENTRIES = 400_000
#: Entries of a chunk, and runs that are merged in one pass: together they bound a merge's memory.
CHUNK_ENTRIES, FAN_IN = 512, 256
#: Entries that a merge sums up at a time.
MERGE_ENTRIES = 200_000
#: Sources on each side of a tile of pairs.
TILE = 1_024
#: Bytes of a long text that are split into terms at a time.
SLICE_BYTES = 1 << 20

SCALE, SMOOTHING = 1_000_000_000, 5

_RUN = "shard int, run long, lang string, first string, terms array<string>, sources array<string>, counts array<long>, docs array<long>"
_KEPT = "lang string, term string, source string, n long, total long"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}

#: A-Z to a-z, other ASCII bytes that are no letters to a space; bytes of longer characters stay.
_FOLD = bytes(b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def term_slices(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text, a bounded stretch at a time."""
    folded = text.translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


#: A posting counts occurrences in its low bits and documents above them.
_DOC = 1 << 40


class _Block:
    """Postings of the documents a task has read since its last spill."""

    def __init__(self):
        self.groups: dict[tuple[str, str], dict[bytes, int]] = {}
        self.size = 0

    def add(self, group: tuple[str, str], words: list[bytes], seen: set[bytes] | None) -> None:
        """Count `words`; the document held `seen` before."""
        held = self.groups.setdefault(group, {})
        before, get = len(held), held.get
        for word, n in Counter(words).items():
            held[word] = get(word, 0) + n + (_DOC if not seen or word not in seen else 0)
        self.size += len(held) - before + (8 if not before else 0)

    def run(self, shards: int) -> pa.Table:
        """shard, lang, term, source, n, docs in ascending order."""
        groups = sorted(self.groups)
        sizes = [len(self.groups[g]) for g in groups]
        terms = pa.array([t for g in groups for t in self.groups[g]], pa.binary()).dictionary_encode()
        order = pc.sort_indices(terms.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        shard = np.array([zlib.crc32(t) % shards for t in terms.dictionary.to_pylist()], np.int64)
        at = terms.indices.to_numpy()
        place = np.repeat(np.arange(len(groups)), sizes)
        langs = sorted({lang for lang, _ in groups})
        lang = np.array([langs.index(g[0]) for g in groups])[place]
        by = np.lexsort((place, rank[at], lang, shard[at]))  # groups of a language come in order of their source
        at, place, lang = at[by], place[by], lang[by]
        packed = np.fromiter((v for g in groups for v in self.groups[g].values()), np.int64, len(by))[by]
        columns = {
            "shard": pa.array(shard[at].astype(np.int32)),
            "lang": pa.array(langs, pa.string()).take(pa.array(lang)),
            "term": terms.dictionary.take(pa.array(at)),
            "source": pa.array([g[1] for g in groups], pa.string()).take(pa.array(place)),
            "n": pa.array(packed % _DOC),
            "docs": pa.array(packed // _DOC),
        }
        return pa.table(columns)


def _chunks(entries: pa.Table, run: int) -> Iterator[pa.RecordBatch]:
    """Rows of `_RUN` from sorted entries: stretches of one shard and language."""
    if not entries.num_rows:
        return
    shard, lang = entries["shard"].to_numpy(), entries["lang"].combine_chunks().dictionary_encode()
    key = shard.astype(np.int64) * len(lang.dictionary) + lang.indices.to_numpy()
    turns = np.flatnonzero(np.diff(key)) + 1
    stretches = zip([0, *turns.tolist()], [*turns.tolist(), len(key)])
    starts = np.array([a for lo, hi in stretches for a in range(lo, hi, CHUNK_ENTRIES)])
    ends = np.append(starts[1:], len(key))
    terms = entries["term"].combine_chunks().cast(pa.string())
    values = [terms, *(entries[c].combine_chunks() for c in ("source", "n", "docs"))]
    for at in range(0, len(starts), 64):
        a, b = starts[at : at + 64], ends[at : at + 64]
        offsets = pa.array(np.append(a, b[-1]) - a[0], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, v.slice(a[0], b[-1] - a[0])) for v in values]
        first = pa.array(a)
        yield pa.RecordBatch.from_arrays(
            [pa.array(shard[a], pa.int32()), pa.repeat(pa.scalar(run, pa.int64()), len(a)), entries["lang"].combine_chunks().take(first), terms.take(first), *lists],
            schema=_schema(_RUN),
        )


def build_runs(docs: DataFrame, shards: int, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """The spilled runs of docs(text, lang, source), as a plan to be written."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, spilled, block = TaskContext.get().partitionId() << 24, 0, _Block()
        for batch in small(batches):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                seen = None if len(text) <= SLICE_BYTES else set()
                for words in term_slices(text):
                    block.add((lang, source), words, seen)
                    if seen is not None:
                        seen.update(words)
                    if block.size >= block_entries:
                        yield from _chunks(block.run(shards), task + spilled)
                        spilled, block = spilled + 1, _Block()
        if block.groups:
            yield from _chunks(block.run(shards), task + spilled)

    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(index, _RUN)


def _summed(parts: list[pa.Table]) -> pa.Table:
    """Entries of the same term and source as one."""
    sums = pa.concat_tables(parts).group_by(["term", "source"]).aggregate([("n", "sum"), ("docs", "sum")])
    return sums.rename_columns(["term", "source", "n", "docs"])


def heap_merge(chunks: Iterator[tuple], most: int = MERGE_ENTRIES) -> Iterator[tuple]:
    """Merge sorted chunks (key, first term, entries), which come in order of (key, first term).

    Yields (key, entries) with every term whole, terms of a later table after those of an earlier
    one. A heap holds the chunks by their last term. Once `most` entries are held, all terms before
    the next chunk's first one are complete: chunks that end before it leave the heap, the others
    are cut there. A term of very many sources is summed while it waits.
    """
    heap: list[tuple] = []
    key, held, limit = None, 0, most

    def complete(before):
        nonlocal heap, held, limit
        done = []
        while heap and (before is None or heap[0][0] < before):
            done.append(heapq.heappop(heap)[2])
        waiting = []
        for last, order, entries in heap:  # these reach up to `before` or beyond
            cut = pc.sum(pc.less(entries["term"], pa.scalar(before, pa.binary()))).as_py() or 0
            if cut:
                done.append(entries.slice(0, cut))
            waiting.append((last, order, entries.slice(cut)))
        held = sum(e.num_rows for *_, e in waiting)
        if held >= most and not done:  # one term
            rest = _summed([e for *_, e in waiting]).sort_by([("term", "ascending")])
            waiting, held = [(rest["term"][-1].as_py(), waiting[0][1], rest)], rest.num_rows
        heap = waiting
        heapq.heapify(heap)
        limit = max(most, 2 * held)
        return _summed(done) if done else None

    for order, (k, first, entries) in enumerate(chunks):
        if heap and (k != key or held >= limit):
            merged = complete(first if k == key else None)
            if merged is not None:
                yield key, merged
        key = k
        heapq.heappush(heap, (entries["term"][-1].as_py(), order, entries))
        held += entries.num_rows
    if heap:
        yield key, complete(None)


def _opened(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple]:
    """Chunk rows as (key, first term, entries)."""
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in key))
        firsts = batch.column("first").cast(pa.binary()).to_pylist()
        lists = [batch.column(c) for c in ("terms", "sources", "counts", "docs")]
        for i, (k, first) in enumerate(zip(keys, firsts)):
            terms, *others = (column[i].values for column in lists)
            yield k, first, pa.table([terms.cast(pa.binary()), *others], names=["term", "source", "n", "docs"])


def _kept_terms(entries: pa.Table, min_docs: int) -> pa.Table:
    """Entries of terms that stand in enough documents, with the term's occurrences in all sources."""
    terms = entries["term"].combine_chunks().dictionary_encode()
    at = terms.indices.to_numpy()
    docs, total = np.zeros((2, len(terms.dictionary)), np.int64)
    np.add.at(docs, at, entries["docs"].to_numpy())
    np.add.at(total, at, entries["n"].to_numpy())
    return entries.drop_columns(["docs"]).append_column("total", pa.array(total[at])).filter(pa.array(docs[at] >= min_docs))


def merge_runs(runs: DataFrame, min_docs: int, fan_in: int = FAN_IN) -> DataFrame:
    """lang, term, source, n, total of terms in at least `min_docs` documents of their language.

    A plan to be written. More than `fan_in` runs are first merged into fewer.
    """
    left = runs.select("run").distinct().count()
    while left > fan_in:
        groups = -(-left // fan_in)

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (shard, lang, number), entries in heap_merge(_opened(batches, ["shard", "lang", "set"])):
                entries = entries.sort_by([("term", "ascending"), ("source", "ascending")])
                n = entries.num_rows
                entries = entries.append_column("shard", pa.repeat(pa.scalar(shard, pa.int32()), n)).append_column("lang", pa.repeat(lang, n))
                yield from _chunks(entries, number)

        grouped = runs.withColumn("set", F.pmod(F.xxhash64("run"), F.lit(groups)))
        sorted_chunks = grouped.repartition("shard", "set").sortWithinPartitions("shard", "lang", "set", "first")
        runs = materialize(sorted_chunks.mapInArrow(again, _RUN), "runs")
        left = groups

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(_KEPT)
        for (_, lang), entries in heap_merge(_opened(batches, ["shard", "lang"])):
            kept = _kept_terms(entries, min_docs)
            kept = kept.append_column("lang", pa.repeat(lang, kept.num_rows)).select(schema.names)
            yield from kept.cast(schema).combine_chunks().to_batches()

    return runs.repartition("shard").sortWithinPartitions("shard", "lang", "first").mapInArrow(final, _KEPT)


def _billionths(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * kept)), exact; null without kept terms."""
    num = f"cast({n} + {SMOOTHING} as decimal(20,0)) * cast({SCALE} as decimal(10,0))"
    den = f"cast(nullif({total} + {SMOOTHING} * {kept}, 0) as decimal(20,0))"
    return F.expr(f"1 + ({num}) div {den}")


def _distances(values: np.ndarray, weights: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Weighted sum of |value - point| for every point."""
    order = np.argsort(values)
    values, weights = values[order], weights[order]
    count = np.concatenate([[0], np.cumsum(weights)])
    mass = np.concatenate([[0], np.cumsum(weights * values)])
    k = np.searchsorted(values, points)
    return points * count[k] - mass[k] + (mass[-1] - mass[k]) - points * (count[-1] - count[k])


class _Tile:
    """Distances between the sources of two blocks (maybe the same one), summed term by term."""

    def __init__(self):
        self.unseen: list = [None, None]
        self.names: list = [None, None]
        self.sums = self.base = None

    def open(self, side: int, unseen: np.ndarray, names: list[str], same: bool) -> None:
        for s in (0, 1) if same else (side,):
            self.unseen[s], self.names[s] = unseen, names
        if self.unseen[0] is not None and self.unseen[1] is not None:
            self.base = np.abs(self.unseen[0][:, None] - self.unseen[1][None, :])
            self.sums = np.zeros_like(self.base)

    def one_sided(self, side: int, at: int, values: np.ndarray, weights: np.ndarray) -> None:
        """What the terms of one source add, as if the others held none of them."""
        change = _distances(values, weights, self.unseen[1 - side]) - weights.sum() * (self.base[at] if side == 0 else self.base[:, at])
        if side == 0:
            self.sums[at] += change
        else:
            self.sums[:, at] += change

    def shared(self, a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray) -> None:
        """Correct a term's pairs of sources that both hold it."""
        at = np.ix_(a, b)
        apart = np.abs(p[:, None] - q[None, :])
        self.sums[at] += apart - np.abs(p[:, None] - self.unseen[1][b][None, :]) - np.abs(self.unseen[0][a][:, None] - q[None, :]) + self.base[at]

    def rows(self, lang: str, same: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for g, name in enumerate(self.names[0]):
            others = [h for h in range(len(self.names[1])) if not (same and h == g)]
            items, values = [self.names[1][h] for h in others], self.sums[g][others].tolist()
            rows = [(lang, name, item, v) for item, v in zip(items, values)]
            yield _batch(rows if same else rows + [(lang, item, name, v) for item, v in zip(items, values)], schema)


_TILE_ROW = ["lang", "low", "high", "part", "kind", "side", "idx", "p", "n", "names"]


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial distances from tile rows sorted by (lang, low, high, part, kind, term, side)."""
    schema = _schema("lang string, source string, item string, value long")
    key, tile, term, held = None, None, None, {}

    def ints(values):
        return np.array(values, dtype=np.int64)

    def settle_term():
        if held:
            same = key[1] == key[2]
            a, b = held.get(0), held.get(0 if same else 1)
            if a and b:
                tile.shared(ints(a[0]), ints(a[1]), ints(b[0]), ints(b[1]))
            held.clear()

    def close():
        settle_term()
        return tile.rows(key[0], key[1] == key[2], schema)

    for batch in small(batches):
        for lang, low, high, part, kind, side, idx, p, n, names, word in zip(*(batch.column(c).to_pylist() for c in [*_TILE_ROW, "term"])):
            k, same = (lang, low, high, part), low == high
            if k != key:
                if key is not None:
                    yield from close()
                key, tile, term = k, _Tile(), None
            if kind == 0:  # the sources of one side, in order of their index
                tile.open(side, ints(p), names, same)
            elif kind == 1:  # what holds for all terms, said in one part only
                tile.sums += n[0] * tile.base
            elif kind == 2:
                for s in (0, 1) if same else (side,):
                    tile.one_sided(s, idx[0], ints(p), ints(n))
            else:
                if word != term:
                    settle_term()
                    term = word
                held[side] = (idx, p)
    if key is not None:
        yield from close()


def _pairs(held: DataFrame, groups: DataFrame, tile: int) -> DataFrame:
    """lang, source, item, value of every two sources of a language.

    `held` has lang, term, source, p; `groups` has lang, source, unseen, kept. Blocks of `tile`
    sources meet in tiles; a block's rows are copied to the tiles it takes part in.
    """
    spark = held.sparkSession
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    numbered = groups.withColumn("_i", place).withColumns({"block": (F.col("_i") / tile).cast("int"), "idx": (F.col("_i") % tile).cast("int")})
    blocks = F.max("block").over(Window.partitionBy("lang")) + 1
    numbered = materialize(numbered.withColumn("blocks", blocks).drop("_i"), "numbered")
    tiles = numbered.groupBy("lang").agg(F.max("blocks").alias("b")).agg(F.sum(F.expr("b * (b + 1) div 2"))).first()[0] or 1
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // tiles)

    def dealt(rows: DataFrame, kind: int, part: Column, **columns) -> DataFrame:
        """Rows of a block, once for each tile it takes part in."""
        other = rows.withColumns({"_o": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "part": part})
        empty = {"idx": "array<int>", "p": "array<long>", "n": "array<long>", "names": "array<string>", "term": "string"}
        full = {c: columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in empty.items()}
        return other.select(
            "lang", F.least("block", "_o").alias("low"), F.greatest("block", "_o").alias("high"), F.col("part").cast("int").alias("part"),
            F.lit(kind).alias("kind"), F.when(F.col("block") <= F.col("_o"), 0).otherwise(1).alias("side"), *full.values(),
        )

    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    members = F.array_sort(F.collect_list(F.struct("idx", "unseen", "source")))  # `tile` of them at most
    sides = numbered.groupBy("lang", "block", "blocks", "kept").agg(members.alias("m"))
    whole = dealt(sides.withColumn("_all", every), 0, F.col("_all"), p=F.col("m.unseen"), names=F.col("m.source"))
    base = dealt(sides, 1, F.lit(0), n=F.array("kept")).filter("side = 0")
    placed = held.join(numbered.select("lang", "source", "block", "blocks", "idx"), ["lang", "source"])
    bars = placed.groupBy("lang", "block", "blocks", "idx", "p").agg(F.count("*").alias("n"))
    bars = bars.groupBy("lang", "block", "blocks", "idx").agg(F.collect_list(F.struct("p", "n")).alias("m"))
    alone = dealt(bars, 2, F.lit(0), idx=F.array("idx"), p=F.col("m.p"), n=F.col("m.n"))
    slices = placed.groupBy("lang", "term", "block", "blocks").agg(F.collect_list(F.struct("idx", "p")).alias("m"))  # `tile` at most
    shared = dealt(slices, 3, F.pmod(F.xxhash64("term"), F.lit(parts)), idx=F.col("m.idx"), p=F.col("m.p"), term=F.col("term"))
    rows = whole.unionByName(base).unionByName(alone).unionByName(shared)
    streamed = rows.repartition("lang", "low", "high", "part").sortWithinPartitions("lang", "low", "high", "part", "kind", "term", "side")
    sums = streamed.mapInArrow(_pair_sums, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, min_docs: int = 30, top: int = 50, block_entries: int = BLOCK_ENTRIES, fan_in: int = FAN_IN, tile: int = TILE
) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank; see the module's docstring."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = materialize(build_runs(docs, shards, block_entries), "runs")
    counted = materialize(merge_runs(runs, min_docs, fan_in), "counted")

    per_lang = counted.select("lang", "term", "total").distinct().groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_n"))
    per_group = counted.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = named.join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").fillna(0, ["group_n", "kept", "lang_n"])
    groups = groups.withColumn("unseen", F.coalesce(_billionths("0", "group_n", "kept"), F.lit(0)))
    groups = materialize(groups, "groups")

    held = counted.join(groups, ["lang", "source"]).select(
        "lang", "term", "source", _billionths("n", "group_n", "kept").alias("p"), _billionths("total", "lang_n", "kept").alias("q")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    above = held.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    pairs = _pairs(held.select("lang", "term", "source", "p"), groups.select("lang", "source", "unseen", "kept"), tile)
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return ranked.unionByName(terms)


AUDIT_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS row_id FROM documents),
w AS (SELECT lang, source, row_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT row_id) >= 30),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY w.lang, w.source, w.term),
l AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang),
g AS (SELECT x.lang, x.source, coalesce(sum(c.n), 0) AS group_n FROM (SELECT DISTINCT lang, source FROM d) x
      LEFT JOIN c ON c.lang = x.lang AND c.source = x.source GROUP BY x.lang, x.source),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
      1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // CAST(g.group_n + 5 * l.v AS HUGEINT) AS p,
      1 + (CAST(1000000000 AS HUGEINT) * (k.total + 5)) // CAST(l.lang_n + 5 * l.v AS HUGEINT) AS q
      FROM g JOIN kept k ON k.lang = g.lang JOIN l ON l.lang = g.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM f a JOIN f b
      ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(far.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM f WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
