"""Secret scans: fixed patterns, and character Markov models of random strings and identifiers.

Two order-1 character models are compared by log-likelihood ratio. Both are trained from
samples that the patterns label in all documents: the values of matches are random strings,
every other identifier-like word is ordinary. Character-pair counts are summed over the whole
corpus (a table of fixed size); a long word whose ratio is above a threshold is a span of kind
`markov`. Spans of the patterns stay as they are, and no added span overlaps one.

Defined results: null and empty texts have no spans; positions are code points, ends exclusive;
repeated rows give repeated results. With no samples of one class nothing is added. A very long
text is one task's work, in time that grows with its length and its matches' logarithm.
The ordinary class learns from all words the patterns leave, so random strings outside them
count as ordinary there; they are few beside a corpus's identifiers.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import materialize, small

# The patterns of the contract, in the order of their kinds.
ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex", "markov")

#: Words the models judge, the shortest ordinary word they learn from, and the least ratio (nats).
WORD = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{7,}")
THRESHOLD = 20.0

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SIZE = len(_ALPHABET) + 1  # the last symbol starts a string
_CODE = np.full(256, SIZE - 1, dtype=np.int64)
for _i, _c in enumerate(_ALPHABET):
    _CODE[ord(_c)] = _i


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the patterns' matches, in order."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def _pairs(words: list[str]) -> np.ndarray:
    """Counts of (previous, next) symbols over words."""
    if not words:
        return np.zeros(SIZE * SIZE, dtype=np.int64)
    codes = _CODE[np.frombuffer(("\n" + "\n".join(words)).encode("ascii"), dtype=np.uint8)]
    pairs = codes[:-1] * SIZE + codes[1:]
    counts = np.bincount(pairs, minlength=SIZE * SIZE)
    counts[np.arange(SIZE) * SIZE + SIZE - 1] = 0  # into a separator
    return counts


def _clear_of(base: list[tuple[int, int, int, int]], pattern: re.Pattern, text: str) -> list[re.Match]:
    """Matches of a pattern that overlap no span of `base`, which is in order of start.

    The spans are merged and each match is looked up among them, so a text of n spans and m
    matches takes n + m log n steps.
    """
    starts, ends = [], []
    for start, _, end, _ in base:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    if not starts:
        return list(pattern.finditer(text))
    clear = []
    for m in pattern.finditer(text):
        i = bisect_right(ends, m.start())  # the first span that ends beyond the match's start
        if i == len(starts) or starts[i] >= m.end():
            clear.append(m)
    return clear


_FOUND = "doc_id long, starts array<int>, kinds array<int>, ends array<int>, words array<string>, random array<long>, ordinary array<long>"
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and candidate words of each row; a task's pair counts come in a last row."""
    schema = pa.schema([("doc_id", pa.int64()), ("starts", _INTS), ("kinds", _INTS), ("ends", _INTS), ("words", pa.list_(pa.string())), ("random", _LONGS), ("ordinary", _LONGS)])
    counts = np.zeros((2, SIZE * SIZE), dtype=np.int64)
    for batch in small(batches):
        rows = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            secret = [text[v:e] for _, _, e, v in base]
            words = [(m.start(), m.end(), m[0]) for m in _clear_of(base, WORD, text)]
            plain = IDENTIFIER.findall(text) if not base else [m[0] for m in _clear_of(base, IDENTIFIER, text)]
            counts[0] += _pairs(secret) if secret else 0
            counts[1] += _pairs(plain) if plain else 0
            rows.append(([b[0] for b in base] + [w[0] for w in words], [b[1] for b in base] + [3] * len(words), [b[2] for b in base] + [w[1] for w in words], [w[2] for w in words]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array([r[i] for r in rows], schema[i + 1].type) for i in range(4)), pa.nulls(len(rows), _LONGS), pa.nulls(len(rows), _LONGS)],
            schema=schema,
        )
    if counts.any():
        yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in schema.types[:5]] + [pa.array([c.tolist()], _LONGS) for c in counts], schema=schema)


def fit(counts: DataFrame) -> np.ndarray | None:
    """Log-likelihood ratio of each symbol pair from counts(random, ordinary)."""
    cells = (
        counts.select(F.posexplode(F.arrays_zip("random", "ordinary")).alias("cell", "n"))
        .groupBy("cell")
        .agg(F.sum("n.random").alias("random"), F.sum("n.ordinary").alias("ordinary"))
        .collect()  # SIZE * SIZE cells at most
    )
    table = np.zeros((2, SIZE * SIZE))
    for r in cells:
        table[:, r["cell"]] = r["random"], r["ordinary"]
    if (table.sum(axis=1) == 0).any():
        return None
    table = table.reshape(2, SIZE, SIZE) + 0.5  # a random character has all symbols as likely neighbours
    p = np.log(table[:, :, :-1] / table[:, :, :-1].sum(axis=2, keepdims=True))
    return np.pad(p[0] - p[1], ((0, 0), (0, 1)))


def ratio(model: np.ndarray, word: str) -> float:
    codes = _CODE[np.frombuffer(("\n" + word).encode("ascii"), dtype=np.uint8)]
    return float(model[codes[:-1], codes[1:]].sum())


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, spans (array of kind, start, end) of each row of docs(doc_id, text).

    The texts are read once: patterns, candidate words and pair counts come from one pass, and
    the small table of them is written to the shared folder before the models judge it.
    """
    found = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, _FOUND), "secrets")
    model = fit(found.filter("random is not null"))
    schema = pa.schema([("doc_id", pa.int64()), ("starts", _INTS), ("kinds", _INTS), ("ends", _INTS)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for starts, kinds, ends, words in zip(*(batch.column(c).to_pylist() for c in ("starts", "kinds", "ends", "words"))):
                n = len(kinds) - len(words)
                keep = [*range(n), *(n + i for i, w in enumerate(words) if model is not None and ratio(model, w) > threshold)]
                keep.sort(key=lambda i: (starts[i], kinds[i]))
                out.append([[column[i] for i in keep] for column in (starts, kinds, ends)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in out], _INTS) for i in range(3))], schema=schema)

    rows = found.filter("random is null").select("doc_id", "starts", "kinds", "ends", "words")
    names = F.array(*map(F.lit, KINDS))
    return rows.mapInArrow(judge, "doc_id long, starts array<int>, kinds array<int>, ends array<int>").select(
        "doc_id",
        F.transform(
            F.arrays_zip("kinds", "starts", "ends"),
            lambda s: F.struct(F.element_at(names, s["kinds"] + 1).alias("kind"), s["starts"].alias("start"), s["ends"].alias("end")),
        ).alias("spans"),
    )


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (as text), n_markov of each row."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return find_secrets(docs).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        count("markov").alias("n_markov"),
    )


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with each span, overlapping ones together, replaced by a mark."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every found secret replaced; `n_chars`, where there is one, follows the text.

    Rows without secrets come back unchanged. The pair model is trained in a first pass over
    all rows and the spans are found again where the text is, so that no text is shuffled.
    """
    counts = materialize(docs.select(F.lit(None).cast("long").alias("doc_id"), "text").mapInArrow(_scan, _FOUND).filter("random is not null").select("random", "ordinary"), "secret-pairs")
    model = fit(counts)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            at = batch.schema.get_field_index("text")
            out = []
            for text in batch.column(at).to_pylist():
                base = base_spans(text or "")
                spans = [(b[0], b[2]) for b in base]
                if text and model is not None:
                    spans += [(m.start(), m.end()) for m in _clear_of(base, WORD, text) if ratio(model, m[0]) > threshold]
                out.append(redact(text, spans) if spans else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    cleaned = docs.mapInArrow(clean, docs.schema)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned
