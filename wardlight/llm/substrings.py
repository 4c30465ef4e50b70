"""Exact removal of repeated substrings by bucket-pointer refinement over sampled suffixes.

A byte goes if it is covered by a string of `length` bytes that also starts anywhere else. The
suffixes that matter are sorted into buckets until a bucket stands for a whole such string:

* Initial buckets: q-grams. Only anchors are kept, the positions whose q-gram has the least
  hash in some run of `RUN` q-grams. Equal strings have equal anchors at equal offsets, and
  each start of a string belongs to the first anchor its own run picks.
* A bucket of one member ends its anchor. That is reused at once: a start is out if any anchor
  within its string has ended, since a repeated string has repeated q-grams only.
* The others are refined on the bucket identifiers of later offsets: the bucket of depth 2d at
  position i comes from those of depth d at i and i + d, again and again up to `length`.
* First the starts of one anchor are settled together, by the buckets of its first and its last
  start; what is left goes through one by one.

Buckets are compared across the corpus by shuffling (identifier, document, position) as packed
arrays. Equal identifiers of one task are summed up before that, so a passage that a third of
all documents share sends one row per task. Texts are joined to their positions by document.

Identifiers have 64 bits and are taken for the strings they stand for.

Defined results: null and empty texts have no bytes; texts shorter than `length` lose nothing;
repeated rows are other places of their strings, so they lose them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import doc_key, materialize, short_lived_shuffles, small

LENGTH, Q, RUN = 400, 24, 128
#: Positions of one text handled at a time, and identifiers of one shuffle task.
STRIP, TASK_KEYS = 1 << 21, 1_500_000
#: Identifiers a task holds before it sums them up and sends them.
HELD_KEYS = 600_000

_SEED = np.random.default_rng(11).integers(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def combine(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = first * _M1
        z ^= z >> np.uint64(29)
        z += then
        z *= _M2
        z ^= z >> np.uint64(32)
    return z


def refine(buckets: np.ndarray, depth: int, wanted: int) -> np.ndarray:
    """Identifiers of depth `wanted` from those of `depth`, by the ones at later offsets."""
    while depth < wanted and len(buckets):
        step = min(depth, wanted - depth)
        buckets = combine(buckets[:-step], buckets[step:]) if len(buckets) > step else buckets[:0]
        depth += step
    return buckets


def q_buckets(text: np.ndarray, q: int) -> np.ndarray:
    return refine(_SEED[text], 1, q)


def _strips(n: int, q: int, run: int) -> Iterator[tuple[int, int, int, int]]:
    """(first run, end of runs, first anchor, end of anchors) of each strip of a text."""
    starts, at = n - run - q + 2, 0
    while at < starts + run - 1:
        yield max(0, at - run + 1), min(starts, at + STRIP), at, at + STRIP
        at += STRIP


def anchors(text: np.ndarray, length: int = LENGTH, q: int = Q, run: int = RUN):
    """Anchors of a text, the identifiers of their q-grams, and the first and last runs that pick them."""
    parts = []
    for s0, s1, a0, a1 in _strips(len(text), q, run) if len(text) >= length else ():
        if s0 >= s1:
            continue
        grams = q_buckets(text[s0 : s1 + run + q - 2], q)
        count, n = s1 - s0, len(grams)
        place = np.arange(n, dtype=np.uint64)
        key = (grams & np.uint64(0xFFFFFFFF00000000)) | place
        full = np.concatenate([key, np.full(-n % run, np.iinfo(np.uint64).max)]).reshape(-1, run)
        before = np.minimum.accumulate(full, axis=1).ravel()
        behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
        chosen = (np.minimum(behind[:count], before[run - 1 : run - 1 + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        change = np.flatnonzero(np.diff(chosen)) + 1
        low = np.concatenate([[0], change])
        high = np.concatenate([change, [count]]) - 1
        at = chosen[low]
        own = (at + s0 >= a0) & (at + s0 < a1)
        parts.append((at[own] + s0, grams[at[own]], low[own] + s0, high[own] + s0))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none
    return tuple(np.concatenate(p) for p in zip(*parts))


def string_buckets(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Identifiers of the strings of `length` bytes at ascending starts."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = int(np.searchsorted(starts, low + STRIP))
        deep = refine(_SEED[text[low : starts[j - 1] + length]], 1, length)
        out[i:j] = deep[starts[i:j] - low]
        i = j
    return out


# -- buckets over the corpus ----------------------------------------------------------------

_SENT = "task int, keys binary, marked binary, docs binary, places binary"
_BACK = "task int, docs binary, places binary, leads binary"
_KEYED = "did long, keys binary, places binary"


def _keyed(dids, found):
    """Rows of `_KEYED` from (identifiers, places) of each text."""
    return pa.RecordBatch.from_arrays(
        [dids, pa.array([k.tobytes() for k, _ in found], pa.binary()), pa.array([p.astype(np.uint32).tobytes() for _, p in found], pa.binary())],
        schema=pa.schema([("did", pa.int64()), ("keys", pa.binary()), ("places", pa.binary())]),
    )


def repeated(keys: DataFrame, expected: int) -> DataFrame:
    """did, places, firsts (binary, uint32) of identifiers that occur twice or more, by document.

    `firsts` has the one place of each such identifier that stands for it. `keys` has rows of
    `_KEYED`; `expected` is about the number of identifiers and sets the number of tasks. Both
    ways of the exchange carry one packed row per pair of tasks, not one per document.
    """
    tasks = int(max(1, -(-expected // TASK_KEYS)))
    sent = pa.schema([("task", pa.int32()), *((c.split()[0], pa.binary()) for c in _SENT.split(", ")[1:])])
    back = pa.schema([("task", pa.int32()), *((c.split()[0], pa.binary()) for c in _BACK.split(", ")[1:])])
    out = pa.schema([("did", pa.int64()), ("places", pa.binary()), ("firsts", pa.binary())])

    def pack(key, did, place):
        """A row per task: each identifier once, marked if it repeats here; its other places behind."""
        order = np.argsort(key, kind="stable")
        key, did, place = key[order], did[order], place[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        size = np.diff([*np.flatnonzero(new), len(key)])
        many = np.repeat(size > 1, size)
        task = ((key >> np.uint64(33)) % np.uint64(tasks)).astype(np.int64)
        order = np.lexsort([~new, task])  # by task, identifiers before other places
        key, did, place, new, many, task = (x[order] for x in (key, did, place, new, many, task))
        begin = np.searchsorted(task, np.arange(tasks + 1))
        heads = np.concatenate([[0], np.cumsum(new)])[begin]
        rows = []
        for t in np.flatnonzero(np.diff(begin)).tolist():
            b, e, h = begin[t], begin[t + 1], heads[t + 1] - heads[t]
            rows.append((t, key[b : b + h].tobytes(), many[b : b + h].tobytes(), did[b:e].tobytes(), place[b:e].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(sent)], schema=sent)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for did, key, place in zip(*(batch.column(c).to_pylist() for c in ("did", "keys", "places"))):
                if key:
                    k = np.frombuffer(key, np.uint64)
                    held.append((k, np.full(len(k), did), np.frombuffer(place, np.uint32)))
                    count += len(k)
                    if count >= HELD_KEYS:
                        yield pack(*map(np.concatenate, zip(*held)))
                        held, count = [], 0
        if held:
            yield pack(*map(np.concatenate, zip(*held)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for k, m, d, p in zip(*(batch.column(c).to_pylist() for c in ("keys", "marked", "docs", "places"))):
                parts.append((np.frombuffer(k, np.uint64), np.frombuffer(m, bool), np.frombuffer(d, np.int64), np.frombuffer(p, np.uint32)))
        if not parts:
            return
        key, marked = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
        did, place = (np.concatenate([x[i][: len(x[0])] for x in parts]) for i in (2, 3))
        order = np.argsort(key, kind="stable")
        key, marked = key[order], marked[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        size = np.diff([*first, len(key)])
        twice = np.repeat((size > 1) | np.logical_or.reduceat(marked, first), size)
        hit = order[twice]
        lead = np.concatenate([new[twice], *(np.zeros(len(x[2]) - len(x[0]), bool) for x in parts)])
        did = np.concatenate([did[hit], *(x[2][len(x[0]) :] for x in parts)])
        place = np.concatenate([place[hit], *(x[3][len(x[0]) :] for x in parts)])
        task = ((did.view(np.uint64) * _M1) >> np.uint64(33)) % np.uint64(tasks)
        order = np.argsort(task, kind="stable")
        begin = np.searchsorted(task[order], np.arange(tasks + 1, dtype=np.uint64))
        rows = [(t, *(x[order[begin[t] : begin[t + 1]]].tobytes() for x in (did, place, lead))) for t in np.flatnonzero(np.diff(begin)).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(back)], schema=back)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for d, p, f in zip(*(batch.column(c).to_pylist() for c in ("docs", "places", "leads"))):
                parts.append((np.frombuffer(d, np.int64), np.frombuffer(p, np.uint32), np.frombuffer(f, bool)))
        if not parts:
            return
        did, place, lead = map(np.concatenate, zip(*parts))
        order = np.argsort(did, kind="stable")
        did, place, lead = did[order], place[order], lead[order]
        begin = np.flatnonzero(np.concatenate([[True], did[1:] != did[:-1]]))
        ends = [*begin[1:].tolist(), len(did)]
        for i in range(0, len(begin), 10_000):
            spans = list(zip(begin[i : i + 10_000].tolist(), ends[i : i + 10_000]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(did[[s for s, _ in spans]]),
                    pa.array([place[s:e].tobytes() for s, e in spans], pa.binary()),
                    pa.array([place[s:e][lead[s:e]].tobytes() for s, e in spans], pa.binary()),
                ],
                schema=out,
            )

    met = keys.mapInArrow(send, _SENT).repartitionById(tasks, F.col("task")).mapInArrow(meet, _BACK)
    with short_lived_shuffles(keys.sparkSession):
        return materialize(met.repartitionById(tasks, F.col("task")).mapInArrow(gather, "did long, places binary, firsts binary"), "buckets")


def _numbers(places: bytes | None) -> np.ndarray:
    return np.unique(np.frombuffer(places or b"", np.uint32).astype(np.int64))


def _spans(low: np.ndarray, high: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings that start in [low, high]."""
    if not len(low):
        return []
    order = np.argsort(low, kind="stable")
    low, end = low[order], np.maximum.accumulate(high[order] + length)
    first = np.flatnonzero(np.concatenate([[True], low[1:] > end[:-1]]))
    return list(zip(low[first].tolist(), end[[*(first[1:] - 1), len(end) - 1]].tolist()))


def _removed(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    kept, at = [], 0
    for s, e in spans:
        kept.append(text[at:s])
        at = e
    kept.append(text[at:])
    return sum(e - s for s, e in spans), len(spans), b"".join(kept)


def _texts(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(t, np.uint8) for t in batch.column("text").to_pylist()]


def _packed(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32).astype(np.int64) for x in batch.column(name).to_pylist()]


def remove_repeats(docs: DataFrame, length: int = LENGTH, q: int = Q, run: int = RUN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), removed (array of start, end) of each row."""
    reach = length - run - q + 1  # a string that starts at s holds the runs that start in [s, s + reach]
    if reach < 0:
        raise ValueError("a string must hold a whole run of q-grams")
    core = length - run + 1  # bytes from an anchor that all its strings share
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("did"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def initial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield _keyed(batch.column("did"), [anchors(t, length, q, run)[1::-1] for t in _texts(batch)])

    long_enough = rows.filter(F.octet_length("text") >= length).select("did", "text")
    live = repeated(long_enough.mapInArrow(initial, _KEYED), 2 * total // run)

    # Ranges of starts of which every anchor lives on; a text without any is done.
    state = pa.schema([("doc_id", pa.int64()), ("did", pa.int64()), ("text", pa.binary()), *((c, pa.binary()) for c in ("at", "low", "high"))])

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = []
            for text, lists in zip(_texts(batch), batch.column("places").to_pylist()):
                at = low = high = np.zeros(0, np.int64)
                if lists:
                    at, _, low, high = anchors(text, length, q, run)
                    alive = np.isin(at, _numbers(lists))
                    ended = np.append(low[~alive], len(text) + length)
                    # Strings that hold a run of the next ended anchor are out.
                    high = np.minimum(np.minimum(high, len(text) - length), ended[np.searchsorted(ended, low)] - reach - 1)
                    keep = alive & (high >= low)
                    at, low, high = at[keep], low[keep], high[keep]
                found.append([x.astype(np.uint32).tobytes() for x in (at, low, high)])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "did", "text")] + [pa.array([f[i] for f in found], pa.binary()) for i in range(3)], schema=state)

    with short_lived_shuffles(docs.sparkSession):
        states = materialize(
            rows.join(live, "did", "left").select("doc_id", "did", "text", "places").mapInArrow(survivors, "doc_id long, did long, text binary, at binary, low binary, high binary"),
            "texts",
        )
    open_texts = states.filter(F.length("at") > 0)
    n_ranges = int(open_texts.agg(F.sum(F.length("at"))).first()[0] or 0) // 4

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One identifier for all strings of a range: of its first, its last and their distance."""
        for batch in small(batches):
            found = []
            for text, low, high in zip(_texts(batch), _packed(batch, "low"), _packed(batch, "high")):
                both = string_buckets(text, np.stack([low, high], 1).ravel(), length)
                found.append((combine(combine(both[::2], both[1::2]), (high - low).astype(np.uint64)), low))
            yield _keyed(batch.column("did"), found)

    settled = repeated(open_texts.select("did", "text", "low", "high").mapInArrow(outer, _KEYED), n_ranges)
    whole = open_texts.join(settled, "did", "left")

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Unsettled ranges, and one for each settled identifier, by what all their strings share."""
        for batch in small(batches):
            found = []
            for text, at, low, places, firsts in zip(_texts(batch), _packed(batch, "at"), _packed(batch, "low"), batch.column("places").to_pylist(), batch.column("firsts").to_pylist()):
                chosen = ~np.isin(low, _numbers(places)) | np.isin(low, _numbers(firsts))
                found.append((string_buckets(text, at[chosen], core), low[chosen]))
            yield _keyed(batch.column("did"), found)

    mixed = repeated(whole.select("did", "text", "at", "low", "places", "firsts").mapInArrow(cores, _KEYED), n_ranges)
    halfway = whole.drop("firsts").join(mixed.select("did", F.col("places").alias("mixed")), "did", "left")

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every string of the ranges whose core is shared by ranges of other strings."""
        for batch in small(batches):
            found = []
            for text, low, high, lists in zip(_texts(batch), _packed(batch, "low"), _packed(batch, "high"), batch.column("mixed").to_pylist()):
                chosen = np.isin(low, _numbers(lists))
                size = high[chosen] - low[chosen] + 1
                starts = np.repeat(low[chosen] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                found.append((string_buckets(text, starts, length), starts))
            yield _keyed(batch.column("did"), found)

    alone = repeated(halfway.filter("mixed is not null").select("did", "text", "low", "high", "mixed").mapInArrow(singles, _KEYED), n_ranges * run // 8)

    result = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for text, low, high, places, more in zip(batch.column("text").to_pylist(), _packed(batch, "low"), _packed(batch, "high"), batch.column("places").to_pylist(), batch.column("alone").to_pylist()):
                done = np.isin(low, _numbers(places))
                starts = _numbers(more)
                spans = _spans(np.concatenate([low[done], starts]), np.concatenate([high[done], starts]), length)
                out.append((len(text), *_removed(text, spans), [{"start": s, "end": e} for s, e in spans]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in out], f.type) for i, f in enumerate(list(result)[1:]))], schema=result)

    spans_type = "array<struct<start: long, end: long>>"
    changed = whole.join(alone.select("did", F.col("places").alias("alone")), "did", "left").select("doc_id", "text", "low", "high", "places", "alone")
    done = changed.mapInArrow(finish, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed {spans_type}")
    zero = F.lit(0).cast("long")
    same = states.filter(F.length("at") == 0).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").alias("kept"), F.array().cast(spans_type).alias("removed")
    )
    return same.unionByName(done)


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_kept (bytes that are left) of each row."""
    left = F.col("n_bytes") - F.col("n_removed")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), left.alias("n_kept"))
