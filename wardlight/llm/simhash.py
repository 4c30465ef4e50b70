"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most `2 r` bits apart share a value at most `r` bits from both. Every
distinct fingerprint therefore emits all such values (2,081 for r = 2 and 64 bits); the values
are shuffled, and fingerprints that emitted the same one are linked. Within a group of equal
values each is linked to the smallest, which every member is within reach of: no pair list grows
with the square of a group, and components come out the same.

Values travel as packed arrays, dealt by a hash of the value, in `ROUNDS` rounds. A round holds
its share of the values only, which bounds the shuffle files on disk at any time.

Defined results: a null or empty text has the fingerprint zero and is linked like any other;
repeated rows have equal results; a null doc_id is never a component's id unless all ids of the
component are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import doc_key, materialize, short_lived_shuffles, slices_by_bytes, small
from wardlight.llm.components import connected_components
from wardlight.session import scratch_dir

SHINGLE_WORDS, MAX_BITS = 4, 4
ROUNDS, TASK_VALUES, ROUND_VALUES = 8, 1_500_000, 4_000_000
_SEED = 42
_BATCH_BYTES = 1_000_000


def fingerprints(texts: list[bytes], shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit SimHash of each text: a bit is set if it is set in over half the shingle hashes."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), dtype=np.uint64)
    for part in slices_by_bytes(texts, _BATCH_BYTES):
        hashes: list[int] = []
        counts = []
        for text in texts[part]:
            words = text.lower().split()  # bytes: A-Z only, and white space is \x20 and \x09-\x0D
            if len(words) <= shingle_words:
                more = [xxh64_intdigest(b" ".join(words), _SEED)] if words else []
            else:
                line = b" ".join(words)
                ends = np.cumsum([len(w) + 1 for w in words])
                starts = np.concatenate([[0], ends[:-shingle_words]]).tolist()
                more = [xxh64_intdigest(line[s:e], _SEED) for s, e in zip(starts, (ends[shingle_words - 1 :] - 1).tolist())]
            hashes += more
            counts.append(len(more))
        n = np.array(counts)
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        some = n > 0
        sums = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int32) if some.any() else np.zeros((0, 64))
        packed = np.packbits(2 * sums > n[some, None], axis=1, bitorder="little")
        out[np.flatnonzero(some) + part.start] = packed.view("<u8").ravel()
    return out


def fingerprint_documents(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, key (of id and text), fingerprint (the 64 bits as a signed long) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fingerprint", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            marks = fingerprints([t or b"" for t in batch.column("text").to_pylist()], shingle_words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(marks.view(np.int64))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), doc_key().alias("key"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, fingerprint long")


def ball(radius: int, bits: int = 64) -> np.ndarray:
    """All bit masks of at most `radius` set bits."""
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(bits), k)], dtype=np.uint64)


def links(marks: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: pairs of distinct fingerprints at most `max_bits` apart that connect all such pairs.

    `max_bits` is even: then all that share a value are near each other, and linking each with
    the least of them loses nothing.
    """
    if max_bits % 2:
        raise ValueError("max_bits must be even")
    spark = marks.sparkSession
    marks = materialize(marks.select("fingerprint").distinct(), "fingerprints")
    masks = ball(max_bits // 2)
    total = marks.count() * len(masks)
    rounds = int(max(1, min(ROUNDS, total // ROUND_VALUES)))
    tasks = int(max(1, -(-total // (rounds * TASK_VALUES))))
    out = scratch_dir(spark, "links")
    emitted = pa.schema([("task", pa.int32()), ("values", pa.binary()), ("flips", pa.binary())])
    pairs = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    step = max(1, 600_000 // len(masks))

    def emit(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column("fingerprint").to_numpy().view(np.uint64)
                for at in range(0, len(own), step):
                    values = (own[at : at + step, None] ^ masks).ravel()
                    with np.errstate(over="ignore"):
                        slot = (((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(rounds * tasks)).astype(np.int64) - turn * tasks
                    here = np.flatnonzero((slot >= 0) & (slot < tasks))
                    here = here[np.argsort(slot[here].astype(np.uint32), kind="stable")]
                    task, begin = np.unique(slot[here], return_index=True)
                    flips = (here % len(masks)).astype("<u2")
                    spans = list(zip(begin.tolist(), [*begin[1:].tolist(), len(here)]))
                    sorted_values = values[here]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(task, pa.int32()),
                            pa.array([sorted_values[s:e].tobytes() for s, e in spans], pa.binary()),
                            pa.array([flips[s:e].tobytes() for s, e in spans], pa.binary()),
                        ],
                        schema=emitted,
                    )

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, flips = [], []
        for batch in batches:
            values += [np.frombuffer(v, np.uint64) for v in batch.column("values").to_pylist()]
            flips += [np.frombuffer(f, "<u2") for f in batch.column("flips").to_pylist()]
        if not values:
            return
        value, flip = np.concatenate(values), np.concatenate(flips)
        order = np.argsort(value, kind="stable")
        value = value[order]
        same = value[1:] == value[:-1]
        member = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        if not member.any():
            return
        value, source = value[member], value[member] ^ masks[flip[order][member]]
        begin = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        least = np.repeat(np.minimum.reduceat(source, begin), np.diff([*begin, len(value)]))
        near = (source != least) & (np.bitwise_count(source ^ least) <= max_bits)
        found = np.unique(np.column_stack([least[near], source[near]]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, i].copy().view(np.int64)) for i in (0, 1)], schema=pairs)

    with short_lived_shuffles(spark):
        for turn in range(rounds):
            spread = marks.repartition(int(-(-total // (8 * TASK_VALUES))) or 1)
            dealt = spread.mapInArrow(emit(turn), "task int, values binary, flips binary").repartitionById(tasks, F.col("task"))
            dealt.mapInArrow(meet, "a long, b long").write.mode("append").parquet(out)
    return spark.read.schema("a long, b long").parquet(out)


def components(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fingerprint, component_id, component_key (of the row that stands for the component) of each fingerprint."""
    roots = connected_components(links(rows, max_bits)).select(F.col("node").alias("fingerprint"), "root")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    first = rows.groupBy("fingerprint").agg(F.min(order).alias("first"))
    placed = first.join(roots, "fingerprint", "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    of = placed.join(least, "root").select("fingerprint", F.col("least.doc_id").alias("component_id"), F.col("least.key").alias("component_key"))
    return materialize(of, "components")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (signed long), component_id of every row of docs(doc_id, text)."""
    rows = materialize(fingerprint_documents(docs, shingle_words), "marks")
    return rows.join(components(rows, max_bits), "fingerprint").select("doc_id", "fingerprint", "component_id")


def component_table(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every row."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (null last), then of the smallest key.

    Rows are told apart by doc_id and text, so rows that share an id, null ones too, stand or
    fall each by its own text; only rows equal in both leave one row. The others are dropped by
    an anti join on id and key, which moves no text while these are few.
    """
    rows = materialize(fingerprint_documents(docs, shingle_words), "marks")
    keepers = components(rows, max_bits).select("component_id", "component_key").distinct()
    copies = rows.groupBy("doc_id", "key").agg(F.count("*").alias("copies"))
    is_keeper = copies["key"].eqNullSafe(keepers["component_key"]) & copies["doc_id"].eqNullSafe(keepers["component_id"])
    decided = materialize(copies.join(keepers, is_keeper, "left").select("doc_id", "key", "copies", F.col("component_key").isNotNull().alias("kept")), "decided")

    def same(left: DataFrame, right: DataFrame) -> F.Column:
        return F.xxhash64(left["doc_id"], left["text"]).eqNullSafe(right["of_key"]) & left["doc_id"].eqNullSafe(right["of_id"])

    rest = decided.filter("not kept").select(F.col("doc_id").alias("of_id"), F.col("key").alias("of_key"))
    out = docs.join(rest, same(docs, rest), "left_anti")
    repeated = decided.filter("kept and copies > 1").select(F.col("doc_id").alias("of_id"), F.col("key").alias("of_key"))
    if not repeated.take(1):
        return out
    again = same(out, repeated)
    return out.join(repeated, again, "left_anti").unionByName(out.join(repeated, again, "left_semi").dropDuplicates(["doc_id", "text"]))
