"""Token ids on disk: one zstandard frame per document under a shared dictionary.

A token table is a folder:

* `dictionary/`: one Parquet row with the dictionary's bytes and its SHA-256.
* `blocks/`: Parquet rows of up to `BLOCK_DOCS` documents or `BLOCK_BYTES` bytes in ascending doc_id order. A row holds
  the ids' width, the SHA-256 of the dictionary, the documents' ids and token counts, the
  offset index and the frames one after the other. `first_doc` and `last_doc` let a reader of
  one document skip the other blocks; the offsets lead to its frame, which is read alone.
* `parts/`: ids before each part (a run of blocks), a bounded table.

The dictionary is fitted on at most `SAMPLE_DOCS` documents of at most `SAMPLE_CHARS` characters,
those of the smallest hashes of doc_id and text. Everything else covers every row.

There are at most `MAX_PARTS` parts; beyond 82 million documents a part, which one task sorts on
disk and packs a block at a time, grows instead.

Defined results: a null text is the empty text and holds the end id only; rows of null doc_id
stand first; rows of equal doc_id follow one another in an open order.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlight.llm import bpe
from wardlight.llm.common import small
from wardlight.session import scratch_dir

SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1_000, 20_000, 65_536
BLOCK_DOCS, PART_DOCS, MAX_PARTS = 128, 8_192, 10_000
#: A block ends beyond so many bytes of frames: larger values cost the JVM whole heap regions.
BLOCK_BYTES = 256 << 10
#: Level of the frames' compression; higher ones save little under a dictionary and cost time.
LEVEL = 1
#: Parquet row groups of the blocks: a reader holds one of them at a time.
ROW_GROUP_BYTES = 16 << 20

_FRAME = "part int, doc_id long, n_tokens long, frame binary"
_BLOCK = (
    "part int, block int, start long, first_doc long, last_doc long, width int, dictionary string, "
    "doc_ids array<long>, n_tokens array<long>, offsets array<long>, frames binary"
)


def fit_dictionary(docs: DataFrame, path: str, end_id: int, width: int, n_docs: int) -> bytes:
    """A zstandard dictionary from a bounded sample; empty if there is too little to fit on.

    Of `n_docs` rows only those of the smallest hashes, about four times the sample, leave their
    tasks, so what reaches the driver does not grow with the documents.
    """
    import zstandard

    fit = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text").filter(F.length("text").between(1, SAMPLE_CHARS))
    if n_docs > 4 * SAMPLE_DOCS:
        fit = fit.filter(F.col("h") < -(1 << 63) + (1 << 64) * 4 * SAMPLE_DOCS // n_docs)
    rows = fit.orderBy("h", "text").limit(SAMPLE_DOCS).collect()
    if not rows:
        return b""
    enc = bpe.codec(path)
    samples = sorted(_serialize(enc.encode(r["text"]), end_id, width) for r in rows)
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples
        return b""


def _serialize(ids: bytes, end_id: int, width: int) -> bytes:
    return np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)).astype(f"<u{width}").tobytes()


@lru_cache(maxsize=4)
def _zstd(dictionary: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)


def _give_back() -> None:
    """A worker that packs or reads returns the encoder's memory, and what Arrow and the C library hold unused."""
    if bpe.codec.cache_info().currsize:
        bpe.codec.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int = 0) -> None:
    """Encode docs(doc_id, text), append `end_id` to each and write a token table to `out`."""
    spark = docs.sparkSession
    width = 2 if bpe.codec(path).tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else 4
    n = docs.count()
    dictionary = fit_dictionary(docs, path, end_id, width, n)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(bytearray(dictionary), sha)], "bytes binary, sha256 string").write.parquet(f"{out}/dictionary")

    parts = int(min(MAX_PARTS, max(1, -(-n // PART_DOCS))))
    first = np.iinfo(np.int64).min  # null ids stand first
    known_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(first)))
    cuts = docs.agg(F.percentile_approx(known_id, [i / parts for i in range(1, parts)], 10 * MAX_PARTS)).first()[0] if parts > 1 else None
    bounds = np.array(cuts or [], dtype=np.int64)
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("frame", pa.binary())])

    def framed(doc_ids, ids):
        compress = _zstd(dictionary)[0].compress
        frames = [compress(_serialize(i, end_id, width)) for i in ids]
        known = doc_ids.fill_null(first).to_numpy(zero_copy_only=False)
        low, high = (np.searchsorted(bounds, known, side=s) for s in ("left", "right"))
        # an id that fills several parts, as null may, is spread over them by its texts
        part = low + np.array([zlib.crc32(f) for f in frames], np.int64) % (high - low + 1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(part, pa.int32()),
                doc_ids,
                pa.array([len(i) // 4 + 1 for i in ids], pa.int64()),
                pa.array(frames, pa.binary()),
            ],
            schema=schema,
        )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a task's rows, which come sorted by part and doc_id."""
        _give_back()
        held: list[tuple] = []
        part, number, start, size = None, 0, 0, 0

        def packed():
            ids, counts, frames = ([r[i] for r in held] for i in range(3))
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            row = (part, number, start, ids[0], ids[-1], width, sha, ids, counts, offsets, b"".join(frames))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, out_schema)], schema=out_schema)

        for batch in batches:
            for p, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (p != part or len(held) == BLOCK_DOCS or size >= BLOCK_BYTES):
                    yield packed()
                    number, start, size = number + 1, start + sum(r[1] for r in held), 0
                    held = []
                if p != part:
                    part, number, start = p, 0, 0
                held.append(row)
                size += len(row[2])
        if held:
            yield packed()

    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    out_schema = pa.schema([(k, types[v]) for k, v in (c.split() for c in _BLOCK.split(", "))])
    frames = bpe.encode_rows(docs, path, framed, _FRAME, keep=True)
    frames.repartition(parts, "part").sortWithinPartitions("part", "doc_id").mapInArrow(blocks, _BLOCK).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{out}/blocks")

    totals = (
        spark.read.schema(_BLOCK).parquet(f"{out}/blocks")
        .groupBy("part")
        .agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    )
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.select("part", before.alias("part_start")).coalesce(1).write.parquet(f"{out}/parts")  # MAX_PARTS rows at most


def read_rows(spark: SparkSession, out: str, finish, schema: str, doc_ids: list[int] | None = None) -> DataFrame:
    """`finish(doc_ids, starts, ids)` over the blocks of a token table, or over some documents.

    `ids` are bytes of little-endian unsigned 32-bit integers; `finish` returns a record batch of
    `schema`. A task holds the ids of one block at a time.
    """
    blocks = spark.read.schema(_BLOCK).parquet(f"{out}/blocks")
    if doc_ids is not None:
        wanted = F.array(*map(F.lit, sorted(doc_ids)))
        first = F.coalesce("first_doc", F.lit(-(1 << 63)))  # null ids stand first
        blocks = blocks.filter(F.exists(wanted, lambda d: d.between(first, F.col("last_doc"))))
    starts = spark.read.schema("part int, part_start long").parquet(f"{out}/parts")
    dictionary, sha = spark.read.parquet(f"{out}/dictionary").first()
    dictionary = bytes(dictionary)
    only = None if doc_ids is None else set(doc_ids)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        decompress = _zstd(dictionary)[1].decompress
        for batch in small(batches, 1):
            (row,) = batch.to_pylist()
            if row["dictionary"] != sha:
                raise ValueError("a block was written with another dictionary")
            first = row["part_start"] + row["start"]
            starts = first + np.concatenate([[0], np.cumsum(row["n_tokens"])])
            at = [i for i, d in enumerate(row["doc_ids"]) if only is None or d in only]
            o, data = row["offsets"], row["frames"]
            ids = [np.frombuffer(decompress(data[o[i] : o[i + 1]]), f"<u{row['width']}").astype("<u4").tobytes() for i in at]
            yield finish(pa.array([row["doc_ids"][i] for i in at], pa.int64()), pa.array([int(starts[i]) for i in at], pa.int64()), ids)

    return blocks.join(F.broadcast(starts), "part").mapInArrow(frames, schema)  # MAX_PARTS rows


def read_tokens(spark: SparkSession, out: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit) of a token table, or of some documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def finish(doc_ids, starts, ids):
        return pa.RecordBatch.from_arrays([doc_ids, starts, pa.array(ids, pa.binary())], schema=schema)

    return read_rows(spark, out, finish, "doc_id long, start long, ids binary", doc_ids)


def written_digests(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from a token table of all documents."""
    out = scratch_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path, out, end_id)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def finish(doc_ids, starts, ids):
        counts, sums = [len(i) // 4 for i in ids], [zlib.crc32(i) for i in ids]
        return pa.RecordBatch.from_arrays([doc_ids, starts, pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], schema=schema)

    return read_rows(docs.sparkSession, out, finish, "doc_id long, start long, n_tokens long, ids_crc32 long")
