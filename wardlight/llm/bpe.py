"""BPE encoding and decoding by tree concatenation.

Ids equal those of the `tokenizers` library for the same file. A text is cut into pieces that
are encoded apart, and each join is re-encoded in a window that grows until the ids on both
sides agree:

* A cut in front of a space or line feed that follows a visible character is always a word
  boundary of a byte-level tokenizer, so ids before it do not depend on what follows and the
  other way round. A window that reaches such a cut on both sides settles the join.
* A run without such a cut (one word of any length) is settled inside the word: a list of
  tokens is the BPE encoding of its bytes exactly if each pair of neighbours is, so a window
  whose first and last re-encoded tokens are the old ones proves the whole list.

Words repeat, so each worker keeps the ids of short words it has met. Every word that is new to it
is merged by the library, or by `tiktoken` where that is certain to give the same ids.

Defined results: a null text is encoded as the empty text, which has no ids. Repeated rows
give repeated results. Columns other than the two named ones are carried or ignored as the
function says.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import small

#: Characters of one piece; a longer text is encoded in pieces that Spark deals out.
PIECE_CHARS = 65_536
#: A word of more bytes is encoded in halves.
LEAF_BYTES = 1_024
#: Words of at most so many characters are kept, at most so many of them in a worker.
KEPT_CHARS, KEPT_WORDS = 40, 200_000

_SPACES = "\t\n\x0b\x0c\r \x85\xa0"
#: Characters whose class is the same in every Unicode version; others go to the library.
_LATIN = [chr(c) for c in range(0x250)]
_OTHER = re.compile("[^\x00-ɏ‐-‧]")


def _class(test) -> str:
    return "".join(re.escape(c) for c in _LATIN if test(c))


_L = _class(lambda c: unicodedata.category(c)[0] == "L")
_N = _class(lambda c: unicodedata.category(c)[0] == "N")
_S = _class(lambda c: c in _SPACES)
#: The byte-level word pattern over the Latin characters.
_WORDS = re.compile(
    f" ?[{_L}]+| ?[{_N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
#: A space after one of these need not start a word.
_SPACE_PAIRS = [c + " " for c in _SPACES]
_CUT = re.compile("(?<=[^\\s\x1c-\x1f\x85᠎])(?=[ \n])")


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Kept(dict):
    """Made values by key, as many as fit; what does not fit is made again."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= KEPT_CHARS and len(self) < KEPT_WORDS:
            self[key] = value
        return value


class Codec:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str, ranked: bool = False):
        """With `ranked`, words are merged by `tiktoken` (see `by_rank`)."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.tokenize = self.tok.model.tokenize
        self.tok.no_truncation()
        self.tok.no_padding()
        split = config.get("pre_tokenizer") or {}
        self.specials = [t["content"] for t in config.get("added_tokens", [])]
        self.byte_level = (
            split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
            and not config.get("normalizer")
            and not any(t.get(k) for t in config.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized"))
            and not any(c.isspace() for t in self.specials for c in t)
        )
        self.words = _Kept(lambda word: self._ids(word.encode()))
        self.chunks = _Kept(self._spaced)
        if self.byte_level:
            alphabet = _byte_alphabet()
            self.stand_in = {b: c for c, b in alphabet.items() if ord(c) != b}
            self.pieces: list[bytes] = [b""] * self.tok.get_vocab_size(with_added_tokens=True)
            for word, i in self.tok.get_vocab(with_added_tokens=True).items():
                plain = word not in self.specials and all(c in alphabet for c in word)
                self.pieces[i] = bytes(alphabet[c] for c in word) if plain else word.encode()
        self.merge = self._merger(config["model"]) if ranked else None

    def _merger(self, model: dict):
        """Ids of a word's bytes, merged by the rank of what a merge gives."""
        import tiktoken

        vocab, alphabet, products = model["vocab"], _byte_alphabet(), self._products(model)
        tokens = [bytes([b]) for b in range(256)] + [bytes(alphabet[c] for c in t) for t in products]
        ids = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])] + [vocab[t] for t in products]
        merge = tiktoken.Encoding("ranks", pat_str=".", mergeable_ranks={t: r for r, t in enumerate(tokens)}, special_tokens={})._encode_single_piece
        return merge if ids == list(range(len(ids))) else lambda word: [ids[r] for r in merge(word)]

    @staticmethod
    def _products(model: dict) -> list[str]:
        """What each merge gives, in order of rank."""
        return ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]

    def merges_by_rank(self, model: dict) -> bool:
        """Whether merging any neighbours whose union is a token, by its rank, gives the library's ids.

        It does if each merge gives a token of its own that the library also finds for its bytes
        alone: where no merge has crossed the ends of such a token, all merges of lower rank
        inside of it are the same as for the token alone, so its last two parts are those of its
        merge.
        """
        if not self.byte_level or model.get("type") != "BPE":
            return False
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return False
        products, vocab = self._products(model), model["vocab"]
        whole = len(set(products)) == len(products) and set(products) <= set(vocab) and set(_byte_alphabet()) <= set(vocab)
        return whole and all([i.id for i in self.tokenize(t)] == [vocab[t]] for t in products)

    def _library(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _special(self, text: str) -> bool:
        return any(s in text for s in self.specials)

    def forget(self) -> None:
        """Give the kept words' memory back; other tasks may run in this worker for long."""
        self.words.clear()
        self.chunks.clear()

    # -- one word ------------------------------------------------------------------------

    def _leaf(self, word: bytes) -> list[int]:
        if self.merge:
            return self.merge(word)
        return [t.id for t in self.tokenize(word.decode("latin-1").translate(self.stand_in))]

    def _word(self, word: bytes) -> list[int]:
        if len(word) <= LEAF_BYTES:
            return self._leaf(word)
        half = len(word) // 2
        return self.join_word(self._word(word[:half]), self._word(word[half:]))

    def join_word(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of one word from those of its two parts, by growing windows."""
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            window = self._leaf(b"".join(map(self.pieces.__getitem__, a + b)))
            if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2

    # -- one piece -----------------------------------------------------------------------

    def _split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii() or not _OTHER.search(text):
            return _WORDS.findall(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.byte_level:
            return self._library(text)
        if len(text) > 2 * PIECE_CHARS:
            return b"".join(map(self._piece, _stretches(text)))
        return self._piece(text)

    def _piece(self, text: str) -> bytes:
        if self._special(text):
            return self._around_specials(text)
        if (not text.isascii() and _OTHER.search(text)) or any(p in text for p in _SPACE_PAIRS):
            return b"".join(map(self.words.__getitem__, self._split(text)))
        first, *rest = text.split(" ")  # each space follows a visible character: all are sure cuts
        return self._chunk(first) + b"".join(map(self.chunks.__getitem__, rest))

    def _spaced(self, chunk: str) -> bytes:
        """Ids of a chunk behind a space; letters alone are one word."""
        if chunk.isalpha():
            if self.merge and len(chunk) < LEAF_BYTES // 4:
                return array("I", self.merge(b" " + chunk.encode())).tobytes()
            if not self.merge and chunk.isascii() and len(chunk) < LEAF_BYTES:
                return array("I", [t.id for t in self.tokenize(self.stand_in[32] + chunk)]).tobytes()
            return self._ids(b" " + chunk.encode())
        return self._chunk(" " + chunk)

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.words.__getitem__, _WORDS.findall(chunk)))

    def _ids(self, word: bytes) -> bytes:
        return array("I", self._word(word)).tobytes()

    def _around_specials(self, text: str) -> bytes:
        out, at = [], 0
        for m in re.finditer("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))), text):
            if m.start() > at:
                out.append(self._piece(text[at : m.start()]))
            out.append(np.array([self.tok.token_to_id(m[0])], dtype="<u4").tobytes())
            at = m.end()
        if at < len(text):
            out.append(self._piece(text[at:]))
        return b"".join(out)

    # -- joins of pieces -----------------------------------------------------------------

    def _sizes(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum([len(self.pieces[i]) for i in ids.tolist()], dtype=np.int64)

    def join(self, left_text: str, left: bytes, right_text: str, right: bytes) -> bytes:
        """Ids of left_text + right_text, of which both parts have been encoded."""
        if not left_text or not right_text:
            return left + right
        if not self.byte_level:
            return self._library(left_text + right_text)
        reach = 64
        while True:
            a, b = max(0, len(left_text) - reach), min(len(right_text), reach)
            cuts = [m.start() for m in _CUT.finditer(left_text, max(a, 1))]
            i = cuts[-1] if cuts else 0 if a == 0 else None
            first = _CUT.search(right_text[: b + 1], 1)
            j = first.start() if first else len(right_text) if b == len(right_text) else None
            if i is not None and j is not None:
                break
            reach *= 2
        head = self._until(left, len(left_text[:i].encode()))
        tail = self._since(right, len(right_text[:j].encode()))
        middle = self._middle(left_text[i:], left[len(head) :], right_text[:j], right[: len(right) - len(tail)])
        return head + middle + tail

    def _until(self, ids: bytes, n_bytes: int) -> bytes:
        sizes = self._sizes(np.frombuffer(ids, "<u4"))
        return ids[: 4 * int(np.searchsorted(sizes, n_bytes, side="right"))]

    def _since(self, ids: bytes, n_bytes: int) -> bytes:
        return ids[len(self._until(ids, n_bytes)) :]

    def _middle(self, a: str, a_ids: bytes, b: str, b_ids: bytes) -> bytes:
        """The window between two sure cuts; a long word in it reuses the ids of both parts."""
        if len(a) + len(b) <= LEAF_BYTES or self._special(a + b):
            return self._piece(a + b)
        at = start = 0
        for word in self._split(a + b):
            start, at = at, at + len(word)
            if at >= len(a):
                break
        if at == len(a) or (at - len(a)) not in np.cumsum([len(w) for w in self._split(b)]):
            return self._piece(a + b)
        before = self._until(a_ids, len(a[:start].encode()))
        n = len((a + b)[len(a) : at].encode())
        inside = self._until(b_ids, n)
        word = self.join_word(
            np.frombuffer(a_ids[len(before) :], "<u4").tolist(), np.frombuffer(inside, "<u4").tolist()
        )
        return before + np.array(word, dtype="<u4").tobytes() + b_ids[len(inside) :]

    # -- decoding ------------------------------------------------------------------------

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        if not self.byte_level:
            return self.tok.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _stretches(text: str) -> Iterator[str]:
    """A long text cut at sure word boundaries, so that its words are never all held at once."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + PIECE_CHARS)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


@lru_cache(maxsize=2)
def codec(path: str, ranked: bool = False) -> Codec:
    """The codec of a tokenizer file, once for each worker."""
    return Codec(path, ranked)


@lru_cache(maxsize=2)
def by_rank(path: str) -> bool:
    """Whether `tiktoken` may merge the words of this file: several times faster, same ids."""
    try:
        import tiktoken  # noqa: F401
    except ImportError:
        return False
    with open(path, encoding="utf-8") as f:
        return Codec(path).merges_by_rank(json.load(f)["model"])


def encode_rows(docs: DataFrame, path: str, finish, schema: str, piece_chars: int = PIECE_CHARS, keep: bool = False) -> DataFrame:
    """Encode `text` of every row and apply `finish` to batches of (doc_id, ids).

    `finish(doc_ids, ids)` takes the Arrow column of ids and a list of id bytes and returns a
    record batch of `schema`. Texts of up to `piece_chars` characters are encoded in the scan.
    Longer ones are cut into pieces that are dealt over the cluster and joined again per row.
    With `keep`, a worker's next tasks find the words of this one, for jobs that do little else.
    """
    ranked = by_rank(path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long_text = F.length("text") > piece_chars

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(path, ranked)
        for batch in small(batches):
            yield finish(batch.column("doc_id"), [enc.encode(t) for t in batch.column("text").to_pylist()])
        if not keep:
            enc.forget()

    def joined(table: pa.Table) -> pa.Table:
        """Joins one text's pieces and finishes it in the same worker, so a task has only one."""
        enc = codec(path, ranked)
        table = table.sort_by("piece")
        parts = list(zip(table.column("text").to_pylist(), table.column("ids").to_pylist()))
        while len(parts) > 1:  # a tree of joins
            pairs = zip(parts[::2], parts[1::2])
            parts = [(a[0] + b[0], enc.join(*a, *b)) for a, b in pairs] + parts[len(parts) // 2 * 2 :]
        doc_id = pa.array(table.column("doc_id").slice(0, 1).to_pylist(), pa.int64())
        return pa.Table.from_batches([finish(doc_id, [parts[0][1]])])

    piece = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("text", pa.string()), ("ids", pa.binary())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(path, ranked)
        for batch in small(batches):
            ids = [enc.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("row", "doc_id", "piece", "text")), pa.array(ids, pa.binary())], schema=piece)

    cut = (
        rows.filter(long_text)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"cast((length(text) - 1) div {piece_chars} as int)"))))
        .withColumn("text", F.expr(f"substring(text, piece * {piece_chars} + 1, {piece_chars})"))
        .select("row", "doc_id", "piece", "text")
        .repartition("row", "piece")
        .mapInArrow(pieces, "row long, doc_id long, piece int, text string, ids binary")
        .groupBy("row")
        .applyInArrow(joined, schema)
    )
    return rows.filter(~long_text).mapInArrow(whole, schema).unionByName(cut)


def encode_documents(docs: DataFrame, path: str, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) of every row of docs(doc_id, text)."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def finish(doc_ids, ids):
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.binary())], schema=out)

    return encode_rows(docs, path, finish, "doc_id long, ids binary", piece_chars)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from encoded(doc_id, ids); null ids decode to the empty text."""
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = codec(path)
        for batch in small(batches):
            texts = [dec.decode(i or b"") for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], schema=out)

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded and decoded again."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    ranked = by_rank(path)

    def finish(doc_ids, ids):
        dec = codec(path, ranked)
        return pa.RecordBatch.from_arrays(
            [
                doc_ids,
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(dec.decode(i).encode()).hexdigest() for i in ids], pa.string()),
            ],
            schema=out,
        )

    return encode_rows(docs, path, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", piece_chars, keep=True)
