"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its state features describe the line and its two
neighbours; pair potentials link the labels of neighbouring lines. Forward-backward gives each
line's probability of being good; the mean of these, weighted by line length, is turned into
the document's score by a logistic curve fitted on the same training documents.

Training: lines take the label of their document. The fit uses at most `FIT_DOCS` labelled
documents with at most `FIT_LINES` lines and 100 bytes a line of that together (10 MB; one that
does not fit is passed over), whole documents in the order of a hash of
doc_id; scoring covers every row and every whole text. Only the text is an input of a score.

Defined results: null and empty texts are one empty line and get a score like any other; without
training rows of both classes every score is 0.5; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from wardlight.llm.common import slices_by_bytes, small

FIT_DOCS, FIT_LINES, FIT_STEPS = 2_000, 100_000, 200
THRESHOLD = 0.3
_BATCH_BYTES = 1_000_000

#: Character classes by byte; bytes of UTF-8 beyond ASCII count as lower-case letters.
_CLASSES = ("lower", "upper", "digit", "space", "stop", "bang", "symbol", "pipe", "other")
_CLASS = np.full(256, _CLASSES.index("other"), dtype=np.uint8)
for _name, _bytes in {
    "lower": [*range(ord("a"), ord("z") + 1), *range(128, 256)],
    "upper": range(ord("A"), ord("Z") + 1),
    "digit": range(ord("0"), ord("9") + 1),
    "space": b" \t\r",
    "stop": b".,;:?'\"()-",
    "bang": b"!",
    "symbol": b"#$%&*@^~=+<>{}[]\\/_",
    "pipe": b"|",
}.items():
    _CLASS[list(_bytes)] = _CLASSES.index(_name)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x n), lengths of all lines of the texts, and the lines of each text."""
    blob = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(blob == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    lengths = ends - starts
    per_text = np.array([t.count(b"\n") + 1 for t in texts])
    first = np.zeros(len(ends), dtype=bool)
    first[np.concatenate([[0], np.cumsum(per_text)[:-1]])] = True

    kinds = _CLASS[blob]
    share = np.empty((len(ends), len(_CLASSES)))
    size = np.maximum(lengths, 1)
    for k in range(len(_CLASSES)):
        share[:, k] = np.add.reduceat(kinds == k, starts, dtype=np.int64)
    share[:, _CLASSES.index("other")] -= 1  # the line feed
    letters = np.maximum(share[:, 0] + share[:, 1], 1)
    shouted = share[:, 1] / letters
    words = share[:, _CLASSES.index("space")] + 1
    # The same character three times in a row, such as "%%%".
    triple = np.zeros(len(blob), dtype=bool)
    if len(blob) > 2:
        triple[2:] = (blob[2:] == blob[1:-1]) & (blob[1:-1] == blob[:-2])
    tripled = np.add.reduceat(triple, starts, dtype=np.int64) / words
    share /= size[:, None]
    repeated = _repeated_words(blob, starts) / words
    weight = np.random.default_rng(0).integers(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64)
    place = np.arange(len(blob), dtype=np.uint64) - np.repeat(starts, lengths + 1).astype(np.uint64)
    with np.errstate(over="ignore"):
        mark = np.add.reduceat(weight[blob] * (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), starts)
    text_of = np.repeat(np.arange(len(texts)), per_text)
    _, where, times = np.unique(np.stack([mark, text_of.astype(np.uint64)], 1), axis=0, return_inverse=True, return_counts=True)
    again = (times[where.reshape(-1)] > 1) & (lengths > 0)

    own = np.column_stack(
        [
            share,
            np.minimum(1, 4 * share[:, 3:]),
            np.minimum(1, 20 * share[:, 5:8]),
            shouted,
            shouted > 0.5,
            np.minimum(tripled, 2),
            repeated,
            repeated > 0.3,
            np.log1p(lengths) / 8,
            np.minimum(letters / words, 30) / 30,
            lengths == 0,
            again,
            lengths < 30,
        ]
    )
    before = np.vstack([np.zeros((1, own.shape[1])), own[:-1]])
    before[first] = 0
    after = np.vstack([own[1:], np.zeros((1, own.shape[1]))])
    after[:-1][first[1:]] = 0
    alone = np.repeat(per_text, per_text) == 1
    return np.column_stack([np.ones(len(ends)), alone, first, own, before, after]), lengths, per_text


def _repeated_words(blob: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Words of each line that equal the word before them."""
    gap = (blob == 32) | (blob == 10)
    inside = ~gap
    begins = np.flatnonzero(inside & np.concatenate([[True], gap[:-1]]))
    if len(begins) < 2:
        return np.zeros(len(starts))
    weight = np.random.default_rng(1).integers(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64)
    ends = np.flatnonzero(inside & np.concatenate([gap[1:], [True]])) + 1
    place = np.arange(len(blob), dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(weight[blob])])
        placed = np.concatenate([[np.uint64(0)], np.cumsum(weight[blob] * place)])
        plain = total[ends] - total[begins]
        mark = placed[ends] - placed[begins] - plain * begins.astype(np.uint64)
    size = ends - begins
    same = (mark[1:] == mark[:-1]) & (plain[1:] == plain[:-1]) & (size[1:] == size[:-1])
    line = np.searchsorted(starts, begins, side="right") - 1
    same &= line[1:] == line[:-1]
    return np.bincount(line[1:][same], minlength=len(starts)).astype(float)


def _chains(per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts from most to fewest lines: their first lines, and how many have a line at each step."""
    order = np.argsort(-per_text, kind="stable")
    start = (np.cumsum(per_text) - per_text)[order]
    steps = per_text[order[0]] if len(order) else 0
    active = np.searchsorted(-per_text[order], -np.arange(steps), side="left")
    return order, start, active


def forward_backward(state: np.ndarray, trans: np.ndarray, per_text: np.ndarray):
    """Probability that each line is good, expected label pairs, and the log partition sums.

    `state` is the log potential of "good" against "bad" by line; `trans[i, j]` that of label j
    after label i. All chains advance together, one line each step.
    """
    n = len(state)
    _, start, active = _chains(per_text)
    unary = np.column_stack([np.zeros(n), state])
    alpha, beta = np.empty((n, 2)), np.zeros((n, 2))
    for t, k in enumerate(active):
        at = start[:k] + t
        if t:
            alpha[at] = unary[at] + np.logaddexp(alpha[at - 1, :1] + trans[0], alpha[at - 1, 1:] + trans[1])
        else:
            alpha[at] = unary[at]
    for t in range(len(active) - 1, 0, -1):
        at = start[: active[t]] + t
        onward = unary[at] + beta[at]
        beta[at - 1] = np.logaddexp(onward[:, :1] + trans[:, 0], onward[:, 1:] + trans[:, 1])
    both = alpha + beta
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    later = np.ones(n, dtype=bool)
    later[start] = False
    at = np.flatnonzero(later)
    pairs = np.zeros((2, 2))
    if len(at):
        joint = alpha[at - 1][:, :, None] + trans[None] + (unary[at] + beta[at])[:, None, :] - total[at][:, None, None]
        pairs = np.exp(joint).sum(axis=0)
    return good, pairs, total[start]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    curve: tuple[float, float]

    def line_marginals(self, texts: list[bytes]):
        x, lengths, per_text = line_features(texts)
        good, _, _ = forward_backward(((x - self.mean) / self.scale) @ self.weights, self.trans, per_text)
        return good, lengths, per_text

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for part in slices_by_bytes(texts, _BATCH_BYTES):
            out[part] = _curve(_document(*self.line_marginals(texts[part])), self.curve)
        return out


def _document(good: np.ndarray, lengths: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Mean probability of a text's lines, weighted by length, on the logit scale."""
    starts = np.cumsum(per_text) - per_text
    weight = lengths + 1.0
    mean = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def _curve(logit: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] * logit + curve[1], -35, 35)))


def fit(texts: list[bytes], labels: np.ndarray, steps: int = FIT_STEPS, ridge: float = 1e-3) -> Model | None:
    """Maximum-likelihood CRF by Adam, then the logistic curve of the document means."""
    if len(set(labels.tolist())) < 2:
        return None
    parts = [line_features(texts[p]) for p in slices_by_bytes(texts, _BATCH_BYTES)]
    x, lengths, per_text = (np.concatenate([p[i] for p in parts]) for i in range(3))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[0], scale[scale < 1e-9] = 0, 1
    x = (x - mean) / scale
    y = np.repeat(labels, per_text).astype(float)
    # A class, and a long document within it, must not outweigh the rest.
    doc_weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    starts = np.cumsum(per_text) - per_text
    line_weight = np.repeat(doc_weight / per_text, per_text)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    later = np.ones(len(y), dtype=bool)
    later[starts] = False
    stay = np.zeros((2, 2))
    for label in (0, 1):  # all lines of a document share its label
        stay[label, label] = (later & (y == label)).sum()
    for step in range(1, steps + 1):
        trans = theta[-4:].reshape(2, 2)
        good, pairs, _ = forward_backward(x @ theta[:-4], trans, per_text)
        grad = np.concatenate([x.T @ ((good - y) * line_weight), ((pairs - stay) / max(1, later.sum())).ravel()])
        grad += ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        np.clip(theta[-4:], -2, 2, out=theta[-4:])
    trans = theta[-4:].reshape(2, 2)
    good, _, _ = forward_backward(x @ theta[:-4], trans, per_text)
    logit = _document(good, lengths, per_text)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a two-parameter logistic regression
        p = _curve(logit, (a, b))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - labels) * logit).sum() + 0.1 * (a - 1), (p - labels).sum() + 0.01 * b])
        h = np.array([[(w * logit * logit).sum() + 0.1, (w * logit).sum()], [(w * logit).sum(), w.sum() + 0.01]])
        delta = np.linalg.solve(h, g)
        a, b = a - np.clip(delta[0], -1, 1), b - np.clip(delta[1], -1, 1)
    return Model(mean, scale, theta[:-4], trans, (float(a), float(b)))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that are never trained on: crc32 of the id as text, mod 5, is 0; null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_lines: int = FIT_LINES) -> Model | None:
    """Fit on labelled rows outside the held-out fifth, bounded by documents and lines."""
    marked = (
        labels.filter(~held_out() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .filter("quality = most")  # contradicting labels teach nothing
    )
    chosen = [
        r["doc_id"]
        for r in marked.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(fit_docs).collect()
    ]
    if not chosen:
        return None
    labelled = {r["doc_id"]: r["quality"] for r in marked.filter(F.col("doc_id").isin(chosen)).collect()}
    size = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    ordered = (
        docs.filter(F.col("doc_id").isin(chosen))
        .groupBy("doc_id")  # of rows that share an id, one text is chosen here and read below
        .agg(F.min(F.struct(F.xxhash64("text").alias("key"), F.coalesce(size, F.lit(1)).alias("lines"), F.octet_length("text").alias("bytes"))).alias("of"))
        .select("doc_id", F.xxhash64("doc_id").alias("h"), "of.*")
        .orderBy("h", "doc_id")
        .collect()  # fit_docs rows
    )
    taken, lines, n_bytes = {}, 0, 0
    for r in ordered:
        more, more_bytes = lines + r["lines"], n_bytes + (r["bytes"] or 0)
        if more > fit_lines or more_bytes > 100 * fit_lines:
            continue  # the next ones may fit
        lines, n_bytes = more, more_bytes
        taken[r["doc_id"]] = r["key"]
    read = docs.filter(F.col("doc_id").isin(list(taken)) & F.xxhash64("text").isin(list(taken.values())))
    texts = read.select("doc_id", F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = {r["doc_id"]: bytes(r["text"]) for r in texts.dropDuplicates(["doc_id", "key"]).collect() if taken[r["doc_id"]] == r["key"]}
    ids = sorted(rows)
    return fit([rows[i] for i in ids], np.array([labelled[i] for i in ids])) if ids else None


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with `score` and `predicted` behind its columns."""
    carried = docs.select(*(c for c in docs.columns if c not in ("score", "predicted")))
    schema = StructType([*carried.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            score = np.full(len(texts), 0.5) if model is None else model.scores(texts)
            yield batch.append_column("score", pa.array(score)).append_column("predicted", pa.array((score >= THRESHOLD).astype(np.int32)))

    return carried.mapInArrow(run, schema)


def drop_rejected(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without the rows that score below the threshold, columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield batch if model is None else batch.filter(pa.array(model.scores(texts) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
