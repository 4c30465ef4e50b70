"""Benchmark decontamination by a prefix-filtered set join.

Every run of `WINDOW` words of a benchmark item is a window (a shorter item is one window).
A document holds a window if all its words stand there in order, so all shingles of the window
occur in the document and one of them suffices as the prefix to join on: the rarest in all
documents. Documents look up their shingles among the prefixes; the shingle's place in the
window fixes where the window would begin (positional bound), the window must fit into the
document (length bound), and the words themselves are compared (verification).

Windows come in blocks of at most `BLOCK_WINDOWS`, which bounds what a task is sent; a larger
benchmark is joined block by block, and each document's hits are put together afterwards.

Defined results: a null text has no words; an item without words is left out; an item of null
id marks words but is not listed; rows of equal item_id are one item; repeated documents give
repeated results.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import doc_key, materialize, small

WINDOW, SHINGLE, BLOCK_WINDOWS = 13, 3, 50_000

#: Words of lower-cased UTF-8 bytes: digits, letters and everything beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())  # bytes.lower() changes A-Z only


def _shingles(words: list[bytes], k: int) -> Iterator[tuple[bytes, ...]]:
    return zip(*(words[i:] for i in range(k)))


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """window (its words, space-joined), items (sorted distinct ids as strings)."""
    schema = pa.schema([("window", pa.binary()), ("item", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out, items = [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text or b"")
                found = {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else ()
                out += found
                items += [item] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(items, pa.string())], schema=schema)

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(cut, "window binary, item string").groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _counted(docs: DataFrame, wanted: dict[int, set]) -> Counter:
    """How often each wanted shingle occurs in all documents (a table as large as `wanted`)."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)
    schema = pa.schema([("shingle", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in small(batches):
            for text in batch.column("text").to_pylist():
                words = words_of(text or b"")
                for k, known in sent.value.items():
                    total.update(filter(known.__contains__, _shingles(words, k)))
        yield pa.RecordBatch.from_arrays([pa.array([b" ".join(s) for s in total], pa.binary()), pa.array(list(total.values()), pa.int64())], schema=schema)

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "shingle binary, n long")
    totals = rows.groupBy("shingle").agg(F.sum("n").alias("n")).collect()
    return Counter({tuple(bytes(r["shingle"]).split(b" ")): r["n"] for r in totals})


def _prefixes(docs: DataFrame, block: list, shingle: int) -> dict[int, dict]:
    """By shingle length, prefix: {(place in the window, words of the window): {window: items}}."""
    split = [(w, w.split(b" "), items) for w, items in block]
    wanted: dict[int, set] = defaultdict(set)
    for _, words, _ in split:
        k = min(shingle, len(words))
        wanted[k].update(_shingles(words, k))
    often = _counted(docs, dict(wanted))
    index: dict[int, dict] = {k: {} for k in wanted}
    for window, words, items in split:
        k = min(shingle, len(words))
        _, rarest, place = min((often[s], s, i) for i, s in enumerate(_shingles(words, k)))
        index[k].setdefault(rarest, {}).setdefault((place, len(words)), {})[window] = items
    return index


def find_hits(words: list[bytes], index: dict[int, dict]) -> tuple[list[tuple[int, int]], set[str]]:
    """(first word, end) of each occurrence of a window, and the items they belong to."""
    spans, items = [], set()
    for k, prefixes in index.items():
        for i, s in enumerate(_shingles(words, k)):
            found = prefixes.get(s)
            if found is None:
                continue
            for (place, size), whole in found.items():
                start = i - place
                if start < 0 or start + size > len(words):
                    continue
                owners = whole.get(b" ".join(words[start : start + size]))
                if owners is not None:
                    spans.append((start, start + size))
                    items.update(owners)
    return spans, items


_HITS = "doc_id long, did long, n_words long, starts array<int>, ends array<int>, items array<string>"


def _joined(docs: DataFrame, index: dict[int, dict]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)
    ints = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("did", pa.int64()), ("n_words", pa.int64()), ("starts", ints), ("ends", ints), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                words = words_of(text or b"")
                spans, items = find_hits(words, sent.value)
                spans = sorted(set(spans))
                rows.append((len(words), [s for s, _ in spans], [e for _, e in spans], sorted(items)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("did"), *(pa.array([r[i] for r in rows], schema[i + 2].type) for i in range(4))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("did"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, _HITS)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, did, n_words, hits (array of start, end word, merged), n_hit, items of each row."""
    table = materialize(windows(benchmark, size), "windows")
    blocks = int(max(1, -(-table.count() // block_windows)))
    block = F.pmod(F.xxhash64("window"), F.lit(blocks))
    hits = None
    for b in range(blocks):
        chosen = [(bytes(r["window"]), list(r["items"])) for r in table.filter(block == b).collect()]
        part = _joined(docs, _prefixes(docs, chosen, shingle))
        hits = part if hits is None else hits.unionByName(part)
    if blocks > 1:  # repeated rows share a key: as many copies come back as there were
        listed = lambda c: F.flatten(F.collect_list(c))
        hits = (
            hits.groupBy("doc_id", "did")
            .agg(F.first("n_words").alias("n_words"), listed("starts").alias("starts"), listed("ends").alias("ends"), F.array_sort(F.array_distinct(listed("items"))).alias("items"), F.count("*").alias("rows"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.expr(f"rows div {blocks}"))))
            .drop("rows", "copy")
        )
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = pa.schema([("doc_id", pa.int64()), ("did", pa.int64()), ("n_words", pa.int64()), ("hits", span), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for starts, ends in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist()):
                merged: list[list[int]] = []
                for s, e in sorted(zip(starts, ends)):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                rows.append(merged)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "did", "n_words")),
                    pa.array([[{"start": s, "end": e} for s, e in r] for r in rows], span),
                    pa.array([sum(e - s for s, e in r) for r in rows], pa.int64()),
                    batch.column("items"),
                ],
                schema=out,
            )

    return hits.mapInArrow(merge, "doc_id long, did long, n_words long, hits array<struct<start: long, end: long>>, n_hit long, items array<string>")


def is_contaminated() -> F.Column:
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def contamination_digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row."""
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones, whose keys are written and anti-joined."""
    bad = materialize(contamination(docs, benchmark).filter(is_contaminated()).select("doc_id", "did").distinct(), "contaminated")
    same = F.xxhash64(docs["doc_id"], docs["text"]).eqNullSafe(bad["did"]) & docs["doc_id"].eqNullSafe(bad["doc_id"])
    return docs.join(bad, same, "left_anti")
