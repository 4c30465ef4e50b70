"""Nearest neighbours by cosine with a hash-prefix forest.

Vectors are dealt into shards by a hash. In every shard each of `TREES` trees holds the shard's
bit strings (signs of random projections) as a sorted array. A query descends each tree to its
longest matching prefix, and all trees ascend together, one bit at a time, until the prefix
ranges hold enough candidates: `SHARE` of the shard and `LEAST` more. The candidates' cosines
are computed in double precision from the vectors, and the best of all shards are merged.

The share is what recall needs on vectors without structure, where a neighbour is hardly nearer
than any other row (tests measure recall against all rows). Every candidate a range holds is
scored; no range is cut.

Queries and shards meet block by block. A query block is sent to each shard, so the work of a
query grows with the number of shards; no pair of rows is ever a row of a table. Shards and blocks
are sorted and merged: Catalyst guesses the blocks as large as before they were repeated per shard,
and would send all of the copies through the driver.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take
no part, nor do rows of null vec_id; vectors meet those of their own length only; equal rows are
rows of their own, and a query leaves out its own row only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.common import materialize

TREES, BITS = 64, 32
SHARE, LEAST = 0.6, 300
SHARD_ROWS, BLOCK_QUERIES = 16_384, 2_048
#: Queries whose products with a shard's rows are in memory at a time.
AT_A_TIME = 128
_FOREST = "dim int, shard int, rows binary, vec_ids binary, vectors binary, strings binary, orders binary"
_BLOCK = "dim int, block int, rows binary, vec_ids binary, vectors binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """row, vec_id, vector (array of double), dim of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).withColumn("row", F.monotonically_increasing_id())
    return (
        rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .filter(finite & F.exists("vector", lambda x: x != 0))
        .select("row", "vec_id", "vector", F.size("vector").alias("dim"))
    )


def _planes(dim: int, trees: int, bits: int) -> np.ndarray:
    return np.random.default_rng([dim, trees, bits]).standard_normal((dim, trees * bits))


def bit_strings(vectors: np.ndarray, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """trees x rows: the signs of random projections as unsigned integers, first bit highest."""
    planes, out = _planes(vectors.shape[1], trees, bits), np.zeros((trees, len(vectors)), dtype=np.uint64)
    weight = (np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64))[None, None, :]
    for i in range(0, len(vectors), 2048):
        signs = (vectors[i : i + 2048] @ planes > 0).reshape(-1, trees, bits)
        out[:, i : i + 2048] = (signs * weight).sum(axis=2, dtype=np.uint64).T
    return out


def candidates(strings: np.ndarray, orders: np.ndarray, keys: np.ndarray, wanted: int, bits: int) -> Iterator[np.ndarray]:
    """For each query the rows that its prefixes reach; `strings` are sorted per tree."""
    trees, n = strings.shape
    queries = keys.shape[1]
    low, high = np.zeros((trees, queries), dtype=np.int64), np.full((trees, queries), n, dtype=np.int64)
    open_ = np.ones(queries, dtype=bool)
    for depth in range(bits, -1, -1):  # the deepest level at which all trees together reach enough
        if not open_.any():
            break
        q = np.flatnonzero(open_)
        drop = np.uint64(bits - depth)
        base = (keys[:, q] >> drop) << drop
        top = base | np.uint64((1 << (bits - depth)) - 1)
        for t in range(trees):
            low[t, q] = np.searchsorted(strings[t], base[t], side="left")
            high[t, q] = np.searchsorted(strings[t], top[t], side="right")
        open_[q] = (high[:, q] - low[:, q]).sum(axis=0) < min(wanted, trees * n)
    mark = np.zeros(n, dtype=bool)
    for i in range(queries):
        mark[:] = False
        for t in range(trees):
            mark[orders[t, low[t, i] : high[t, i]]] = True
        yield np.flatnonzero(mark)


def nearest(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows by cosine, ties to the smaller id, and their cosines."""
    norms = np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum())
    score = (vectors * query).sum(axis=1) / norms
    if len(score) > k:
        line = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= line)
    else:
        near = np.arange(len(score))
    best = near[np.lexsort([ids[near], -score[near]])][:k]
    return best, score[best]


def hopeful(near: np.ndarray, products: np.ndarray, norms: np.ndarray, dim: int, k: int) -> np.ndarray:
    """Those of the rows `near` that can be among the k best: by products in any order of summing, with room for their rounding."""
    if len(near) <= k or not (norms.min() > 1e-250 and norms.max() < float("inf")):
        return near
    score = products / norms
    line = np.partition(score, len(score) - k)[len(score) - k]
    return near[score >= line - 8 * (dim + 8) * np.finfo(np.float64).eps]


def search(vectors: DataFrame, queries: DataFrame, k: int, trees: int = TREES, bits: int = BITS, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_row, query_id, rank, vec_id, score; both inputs have the columns of `usable`."""
    n_rows, n_queries = vectors.count(), queries.count()
    shards, blocks = int(max(1, -(-n_rows // SHARD_ROWS))), int(max(1, -(-n_queries // BLOCK_QUERIES)))

    def packed(pdf: pd.DataFrame) -> tuple[np.ndarray, dict]:
        x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vector"]])
        return x, {"rows": [pdf["row"].to_numpy(np.int64).tobytes()], "vec_ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()]}

    def plant(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x, columns = packed(pdf)
        strings = bit_strings(x, trees, bits)
        orders = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        strings = np.take_along_axis(strings, orders, axis=1)
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], **columns, "strings": [strings.tobytes()], "orders": [orders.tobytes()]})

    def block(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], **packed(pdf)[1]})

    dealt = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    forest = materialize(vectors.groupBy("dim", dealt(shards, 1).alias("shard")).applyInPandas(plant, _FOREST), "forest")
    asked = materialize(queries.groupBy("dim", dealt(blocks, 2).alias("block")).applyInPandas(block, _BLOCK), "queries")
    out = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in ({n: batch.column(n)[i].as_buffer() for n in batch.schema.names} for i in range(batch.num_rows)):
                ids, rows = np.frombuffer(r["vec_ids"], np.int64), np.frombuffer(r["rows"], np.int64)
                x = np.frombuffer(r["vectors"]).reshape(len(ids), -1)
                strings = np.frombuffer(r["strings"], np.uint64).reshape(trees, -1)
                orders = np.frombuffer(r["orders"], np.int32).reshape(trees, -1)
                q_ids, q_rows = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_rows"], np.int64)
                q = np.frombuffer(r["q_vectors"]).reshape(len(q_ids), -1)
                found, norms, q_norms = [], np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
                reach = candidates(strings, orders, bit_strings(q, trees, bits), int(share * len(ids)) + least, bits)
                for i, near in enumerate(reach):
                    if i % AT_A_TIME == 0:
                        products = q[i : i + AT_A_TIME] @ x.T
                    near = near[rows[near] != q_rows[i]]
                    near = hopeful(near, products[i % AT_A_TIME, near], norms[near] * q_norms[i], x.shape[1], k)
                    best, score = nearest(x[near], ids[near], q[i], k)
                    found.append((np.full(len(best), q_rows[i]), np.full(len(best), q_ids[i]), ids[near[best]], score))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*found), out)], schema=out)

    sent = asked.select("dim", F.col("rows").alias("q_rows"), F.col("vec_ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    local = sent.hint("merge").join(forest, ["dim", "shard"]).drop("dim", "shard").mapInArrow(look, "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")


def fifth_neighbours(embeddings: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: the 5 nearest rows of every vec_id divisible by 50."""
    rows = materialize(usable(embeddings, "vec_id", "embedding"), "vectors")
    return search(rows, rows.filter("vec_id % 50 = 0"), 5).select("query_id", "rank", "vec_id", "score")
