"""Best-fit packing of documents into sequences, with bound-certified repacking.

1. Documents are encoded and get an end id. Only those longer than a sequence are cut: the first
   piece takes the rest, the others fill a sequence each.
2. Pieces are dealt in turn, in order of their length, over parts of about `PART_PIECES` rows, so
   that every part gets the same mix. Each part is packed by best-fit decreasing; dual feasible
   functions over its lengths give a lower bound of the sequences it needs, which certifies its
   count where both agree.
3. Full sequences are done. A part that is certified and has less than one sequence of room left
   gives up its emptiest sequence only, other parts all their sequences with gaps: these pieces
   are dealt anew, to fewer parts, and packed again, as long as that saves sequences. It ends,
   too, once the total meets the bound over all lengths, which is then the least possible.

The size of a part follows from dealing in turn, never from a key of the data. The driver sees
counts per length (one row per length of a sequence) and totals per round.

Defined results: a null text is the empty text and holds the end id only. Rows of null or
repeated doc_id are packed like others. An empty table gives no rows. Other columns are ignored.
A long text is encoded in pieces that are dealt over the cluster (see `bpe`).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm import bpe
from wardlight.llm.common import materialize

#: Pieces of a part, on average.
PART_PIECES = 65_536
#: Largest parameter of the dual feasible functions tried.
MAX_STEPS = 12

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{_PIECE}, key long, sequence long, offset long, room int, closed boolean"


def lower_bound(lengths: np.ndarray, counts: np.ndarray, size: int) -> int:
    """Sequences that pieces of these lengths need at least.

    f_t keeps lengths from t to size - t, takes longer ones as whole sequences and drops shorter
    ones. u_k rounds (k + 1) x / size down to k-ths of a sequence unless it is whole. Both are dual
    feasible, and so is u_k after f_t: no sequence's values add up to more than one.
    """
    if not len(lengths):
        return 0
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    best = -(-int((lengths * counts).sum()) // size)
    cuts = np.unique(np.concatenate([[0], lengths[lengths * 2 <= size], size - lengths[lengths * 2 > size]]))
    for t in cuts.tolist():
        x = np.where(lengths > size - t, size, np.where(lengths < t, 0, lengths))
        best = max(best, -(-int((x * counts).sum()) // size))
        for k in range(1, MAX_STEPS + 1):
            steps = (k + 1) * x
            exact = steps % size == 0
            whole, rounded = int((x * counts)[exact].sum()), int((steps // size * counts)[~exact].sum())
            best = max(best, -(-(whole * k + rounded * size) // (size * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Per piece its sequence and offset, and the room left in each sequence.

    Sequences are stacked by their room; the set bits of a number tell which stacks hold one.
    """
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    room: list[int] = []
    some = 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fitting = some >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            bin_ = stacks[space].pop()
            if not stacks[space]:
                some ^= 1 << space
        else:
            bin_, space = len(room), size
            room.append(size)
        sequence[i], offset[i] = bin_, size - space
        left = room[bin_] = space - n
        if left:
            if not stacks[left]:
                some |= 1 << left
            stacks[left].append(bin_)
    return sequence, offset, room


def encode_pieces(docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """The pieces of every row of docs(doc_id, text), as a plan to be written."""
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema([(c.split()[0], t) for c, t in zip(_PIECE.split(", "), types)])
    end = np.array([end_id], "<u4").tobytes()

    def finish(doc_ids, ids):
        rows = []
        for doc_id, data in zip(doc_ids.to_pylist(), ids):
            data += end
            total = len(data) // 4
            starts = [0, *range(total % size or size, total, size)]
            for piece, (a, b) in enumerate(zip(starts, [*starts[1:], total])):
                rows.append((doc_id, piece, a, b - a, zlib.crc32(data[4 * a : 4 * b])))
        columns = zip(*rows) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema=schema)

    return bpe.encode_rows(docs, path, finish, _PIECE, keep=True)


def _pack_parts(pieces: DataFrame, parts: int, size: int, round_: int) -> DataFrame:
    """Deal and pack pieces(..., key); sequence numbers are unique over rounds and parts."""

    def pack(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        lengths = table.column("length").to_numpy()
        sequence, offset, room = best_fit_decreasing(lengths, size)
        kinds, counts = np.unique(lengths, return_counts=True)
        certified = lower_bound(kinds, counts, size) == len(room)
        left = np.array(room, np.int32)[sequence]
        tight = certified and sum(room) < size
        closed = (left == 0) | (tight & (sequence != int(np.argmax(room))))
        number = (round_ << 56) + (part << 26) + sequence
        out = table.drop_columns(["part"])
        for name, values in (("sequence", number), ("offset", offset), ("room", left), ("closed", closed)):
            out = out.append_column(name, pa.array(values))
        return out

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = zlib.crc32(f"{round_}:{TaskContext.get().partitionId()}".encode())
        for batch in batches:
            part = (np.arange(turn, turn + batch.num_rows) % parts).astype(np.int64)
            turn += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=[*batch.schema.names, "part"])

    order = ["length", F.xxhash64("key", F.lit(round_)), "key"]
    by_length = pieces.repartitionByRange(*order).sortWithinPartitions(*order)
    return by_length.mapInArrow(deal, f"{_PIECE}, key long, part long").groupBy("part").applyInArrow(pack, _PLACED)


def pack_pieces(pieces: DataFrame, size: int, part_pieces: int = PART_PIECES) -> DataFrame:
    """Pieces with `sequence_id` and `offset`; `pieces` is a written table with a unique `key`."""
    sequences = F.sum((F.col("offset") == 0).cast("long"))
    bars = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # `size` rows at most
    bound = lower_bound(np.array([r["length"] for r in bars]), np.array([r["n"] for r in bars]), size)
    pool, waiting = pieces, sum(r["n"] for r in bars)
    done: list[DataFrame] = []
    total = held = open_now = None
    round_ = 0
    while waiting:
        packed = materialize(_pack_parts(pool, -(-waiting // part_pieces), size, round_), "packed")
        used, still = packed.agg(sequences, F.sum((~F.col("closed")).cast("long"))).first()
        if held is not None and used >= held:  # nothing saved: the round before stands
            break
        total = used if total is None else total - held + used
        done.append(packed.filter("closed"))
        open_now = packed.filter("not closed")
        if not still or total <= bound:
            break
        held, waiting = open_now.agg(sequences).first()[0], still
        pool = open_now.select(*pieces.columns)
        round_ += 1
    if not done:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = open_now
    for d in done:
        placed = placed.unionByName(d)
    return placed.select(*pieces.columns, F.col("sequence").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, part_pieces: int = PART_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    encoded = encode_pieces(docs, path, size, end_id).withColumn("key", F.monotonically_increasing_id())
    pieces = materialize(encoded, "pieces")  # the key is fixed once it is written
    return pack_pieces(pieces, size, part_pieces).drop("key")
