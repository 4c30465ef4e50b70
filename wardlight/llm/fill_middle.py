"""Fill-in-the-middle transformation by content-defined chunk memoization.

A text is cut by code points into prefix, middle and suffix and written in another order, so
that a model learns to fill gaps. The cuts are numbers of code points, the texts are UTF-8:

1. A rolling hash over the last 32 bytes cuts the bytes into chunks where its high bits are zero,
   so equal passages give equal chunks wherever they stand.
2. Each worker keeps a summary per chunk: code points, and whether a mark is in it. A kept
   summary is used only for a chunk of the same bytes. Marks over a chunk's edge are found in the
   two bytes on each side of it. A code point belongs to the chunk that holds its first byte, so a
   cut inside of a character does no harm.
3. Running sums of the chunks' code points lead to the chunk of each cut; only the bytes of that
   chunk are looked at to find the place.

Defined results: a null text is the empty text, which stays plain. A null doc_id hashes as the
empty string. Repeated rows give repeated results. Other columns are ignored. A text is held
whole, as bytes, with the hashes of one stretch of it; the kept chunks are bounded by `KEPT_BYTES`.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import small

#: A chunk ends where so many high bits of the hash are zero (2 KB on average), within bounds.
CUT_BITS, MIN_CHUNK, MAX_CHUNK = 11, 512, 16_384
#: Bytes whose hashes are held at a time, and bytes of chunks a worker keeps.
STRETCH, KEPT_BYTES = 1 << 20, 32 << 20

MARKS = (b"<P>", b"<S>", b"<M>")

_WINDOW = 32
_GEAR = np.array([zlib.crc32(bytes([b])) for b in range(256)], dtype=np.uint32)


def rolling_hashes(data: np.ndarray) -> np.ndarray:
    """Per byte, the sum of the table values of the last 32 bytes, each shifted by its distance."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        wider = h.copy()
        wider[shift:] += h[:-shift] << np.uint32(shift)
        h = wider
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of a text end."""
    ends, last = [], 0
    if len(data) > MIN_CHUNK:
        whole = np.frombuffer(data, np.uint8)
        for at in range(0, len(data), STRETCH):
            lead = min(at, _WINDOW - 1)
            hashes = rolling_hashes(whole[at - lead : at + STRETCH])[lead:]
            for end in (np.flatnonzero(hashes >> np.uint32(32 - CUT_BITS) == 0) + at + 1).tolist():
                while end - last > MAX_CHUNK:
                    last += MAX_CHUNK
                    ends.append(last)
                if end - last >= MIN_CHUNK:
                    ends.append(end)
                    last = end
        while len(data) - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


def _leads(chunk: bytes) -> np.ndarray:
    """Which bytes of a chunk start a code point."""
    return np.frombuffer(chunk, np.uint8) & 0xC0 != 0x80


def summarize(chunk: bytes) -> tuple[int, bool]:
    """Code points that start in the chunk, and whether a mark lies inside of it."""
    points = len(chunk) if chunk.isascii() else int(np.count_nonzero(_leads(chunk)))
    return points, any(m in chunk for m in MARKS)


class ChunkCache:
    """Summaries by content: a dictionary compares the bytes, so a hash alone decides nothing."""

    def __init__(self, limit: int = KEPT_BYTES):
        self.limit, self.held, self.hits = limit, 0, 0
        self.summaries: dict[bytes, tuple[int, bool]] = {}

    def __call__(self, chunk: bytes) -> tuple[int, bool]:
        known = self.summaries.get(chunk)
        if known is not None:
            self.hits += 1
            return known
        if self.held + len(chunk) > self.limit:
            self.summaries.clear()
            self.held = 0
        self.held += len(chunk)
        made = self.summaries[chunk] = summarize(chunk)
        return made


@cache
def _worker_cache() -> ChunkCache:
    return ChunkCache()


class Measured:
    """A text as chunks with running sums of code points."""

    def __init__(self, data: bytes, summary):
        self.data = data
        self.ends = chunk_ends(data)
        starts = [0, *self.ends[:-1]]
        parts = [summary(data[a:b]) for a, b in zip(starts, self.ends)]
        self.starts = starts
        self.before = [0, *accumulate(p for p, _ in parts)]
        self.points = self.before[-1]
        self.marked = any(m for _, m in parts) or any(m in data[max(0, e - 2) : e + 2] for e in self.ends[:-1] for m in MARKS)

    def byte_of(self, point: int) -> int:
        """The byte at which a code point starts."""
        if point >= self.points:
            return len(self.data)
        i = bisect_right(self.before, point) - 1
        start, inside = self.starts[i], point - self.before[i]
        chunk = self.data[start : self.ends[i]]
        return start + (inside if chunk.isascii() else int(np.flatnonzero(_leads(chunk))[inside]))


def choices(doc_id: int | None) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def rearrange(doc_id: int | None, text: bytes, summary=summarize) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    m = Measured(text, summary)
    h1, h2, h3, h4 = choices(doc_id)
    if not text or m.marked or h3 % 100 >= 90:
        return m.points, "plain", None, None, text
    a, b = sorted((h1 % (m.points + 1), h2 % (m.points + 1)))
    i, j = m.byte_of(a), m.byte_of(b)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    p, s, mid = MARKS
    if h4 % 100 < 20:
        return m.points, "spm", a, b - a, b"".join((s, suffix, p, prefix, mid, middle))
    return m.points, "psm", a, b - a, b"".join((p, prefix, s, suffix, mid, middle))


def transform(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row of docs(doc_id, text)."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    schema = pa.schema(list(zip(names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = _worker_cache()
        for batch in small(batches, 128):
            ids = batch.column("doc_id").to_pylist()
            rows = [rearrange(i, t, summary) for i, t in zip(ids, batch.column("text").to_pylist())]
            columns = [ids, *zip(*rows)]
            arrays = [pa.array(c, t) for c, t in zip(columns[:-1], types)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(columns[-1], pa.binary()).cast(pa.string())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text again. It holds no mark itself unless it is plain, so the marks part it."""
    parts = F.split(F.col(output), "<[PSM]>", -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))


def transform_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return transform(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"),
    )


DIGEST_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
      CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
o AS (SELECT doc_id, t, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
      substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(prefix_chars AS BIGINT) AS prefix_chars, CAST(middle_chars AS BIGINT) AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
sha256(t) AS restored_sha256 FROM o
"""
