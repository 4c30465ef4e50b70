"""Source audit, fill-in-the-middle and packing against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from wardlight.llm import divergence, fill_middle, packing
from wardlight.llm.queries import tokenizer_path

PATH = tokenizer_path()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, block string, idx string, part string"


def found(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


# -- source audit -----------------------------------------------------------------------------


def plain_audit(rows, min_docs, top):
    """The contract, stated over dense tables."""
    texts = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))) for text, lang, source in rows]
    out = Counter()
    for lang in {t[0] for t in texts}:
        own = [t for t in texts if t[0] == lang]
        df = Counter(w for t in own for w in set(t[2]))
        kept = sorted(w for w, n in df.items() if n >= min_docs)

        def prob(counts, kept=kept):
            total = sum(counts[w] for w in kept)
            return {w: 1 + 10**9 * (counts[w] + 5) // (total + 5 * len(kept)) for w in kept}

        counts = {s: Counter(w for t in own if t[1] == s for w in t[2]) for s in {t[1] for t in own}}
        p, q = {s: prob(c) for s, c in counts.items()}, prob(Counter(w for t in own for w in t[2]))
        for s in counts:
            pairs = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in counts if o != s]
            terms = [(w, p[s][w] - q[w]) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out.update((lang, s, part, item, v, k) for k, (item, v) in enumerate(ranked, 1))
    return out


def audit_rows():
    rng = random.Random(8)
    words = ["stone", "River", "église", "日本", "É", "x9y", "a_b", "ab c", "z", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = []
    for k in range(240):
        source = rng.choice(["s0"] * 5 + [f"s{j}" for j in range(1, 9)] + [None, ""])
        lang = rng.choice(["en", "en", "en", "de", None])
        pool = words[: 8 + 3 * (hash(source or "") % 2) + 5 * int((source or "s0")[-1:] in "02468")]
        rows.append((" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 60))), lang, source))
    rows += [(None, "en", "silent"), ("", "en", "silent"), ("12 34", "fr", "digits"), ("unique", "fr", "other"), ("solo " * 50, "it", "alone")]
    rows += [("the end. " * 3_000, "en", "s1")] + [rows[3]] * 4
    return rows


@pytest.mark.parametrize(("block", "fan_in", "tile"), [(200_000, 256, 1_024), (40, 3, 2)])
def test_audit_equals_dense_version(spark, monkeypatch, block, fan_in, tile):
    rows = audit_rows()
    monkeypatch.setattr(divergence, "SLICE_BYTES", 1 << 20 if tile > 2 else 100)
    df = spark.createDataFrame([(k, t, lang, s, None, "x", "y", "z", "p") for k, (t, lang, s) in enumerate(rows)], SCHEMA).repartition(5)
    got = divergence.audit(df, 6, 4, block, fan_in, tile)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    want = plain_audit(rows, 6, 4)
    assert found(got, "lang", "source", "part", "item", "value", "rank") == want
    assert any(k[0] == "fr" and k[4] == 0 for k in want)


def test_audit_of_nothing_and_of_huge_counts(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    big = spark.createDataFrame([(3_000_000_000_000_000, 7_000_000_000_000_000_000, 2)], "n long, total long, kept long")
    want = 1 + 10**9 * (3 * 10**15 + 5) // (7 * 10**18 + 10)
    assert big.select(divergence._billionths("n", "total", "kept").alias("p")).first().p == want


@pytest.mark.parametrize("most", [1, 40, 10_000])
def test_heap_merge_sums_overlapping_chunks(most):
    rng = random.Random(2)
    want, chunks = Counter(), []
    for run in range(9):
        for key in range(3):
            entries = sorted({(f"t{rng.randrange(30):02}".encode(), f"s{rng.randrange(4 if key else 40)}") for _ in range(25)})
            want.update({(key, *e): run + 1 for e in entries})
            for at in range(0, len(entries), 4):
                terms, sources = zip(*entries[at : at + 4])
                part = pa.table({"term": pa.array(terms, pa.binary()), "source": sources, "n": [run + 1] * len(terms), "docs": [1] * len(terms)})
                chunks.append((key, terms[0], part))
    chunks.sort(key=lambda c: c[:2])
    got, ends = [], {}
    for key, entries in divergence.heap_merge(iter(chunks), most):
        rows = entries.to_pylist()
        assert ends.get(key, b"") < min(r["term"] for r in rows)  # terms are whole
        ends[key] = max(r["term"] for r in rows)
        got += [(key, r["term"], r["source"], r["n"]) for r in rows]
    assert len(got) == len(want) and {g[:3]: g[3] for g in got} == want


# -- fill in the middle ------------------------------------------------------------------------


def plain_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, a, b - a, sha(out), sha(text)


FIM = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def fim_rows(rows):
    rng = random.Random(4)
    wide = "".join(rng.choice("aé日😀 \n<PSM>/x") for _ in range(9_000))
    texts = ["<", "<P", "P>", "a<P>b", "x" * 700 + "<S>" + "y" * 700, "日本" * 20_000, "z" * 40_000, wide.replace("<P>", "").replace("<S>", "").replace("<M>", ""), "<<S\n>P>"]
    return [*rows, *((100 + k, t) for k, t in enumerate(texts * 9)), (-5, "negative id")]


def test_fim_equals_plain_version(spark, rows):
    data = fim_rows(rows)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, form string, n int").repartition(3)
    got = fill_middle.transform_digests(df)
    want = Counter(plain_fim(i, t) for i, t in data)
    assert found(got, *FIM) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fill_middle.transform_digests(df.limit(0)).collect() == []


def test_fim_outputs_and_oracle(spark, rows):
    data = [(i, t) for i, t in fim_rows(rows)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    texts = {i: t or "" for i, t in data if i is not None and i > 20}
    for r in fill_middle.transform(df).withColumn("again", fill_middle.restored()).collect():
        if r.doc_id in texts:
            assert r.again == texts[r.doc_id]
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    assert Counter(con.execute(fill_middle.DIGEST_SQL).fetchall()) == Counter(plain_fim(i, t) for i, t in data)


def test_chunks_are_defined_by_content():
    rng = random.Random(6)
    passage = rng.randbytes(60_000)
    a, b = rng.randbytes(5_000) + passage, rng.randbytes(777) + passage + rng.randbytes(3_000)
    pieces = lambda d: {d[i:j] for i, j in itertools.pairwise([0, *fill_middle.chunk_ends(d)])}
    shared = sum(map(len, pieces(a) & pieces(b)))
    assert shared > 50_000
    for data in (a, b, b"x" * 100_000, b"", b"a"):
        ends = fill_middle.chunk_ends(data)
        assert (ends[-1:] or [0]) == [len(data)]
        assert all(0 < j - i <= fill_middle.MAX_CHUNK for i, j in itertools.pairwise([0, *ends]))


def test_stretches_do_not_change_chunks(monkeypatch):
    data = random.Random(7).randbytes(50_000)
    want = fill_middle.chunk_ends(data)
    monkeypatch.setattr(fill_middle, "STRETCH", 100)
    assert fill_middle.chunk_ends(data) == want


def test_cache_is_bounded_and_does_not_show():
    cache = fill_middle.ChunkCache(4_000)
    rng = random.Random(9)
    texts = [("".join(rng.choice("ab日<") for _ in range(rng.randrange(1_500)))).encode() for _ in range(60)] * 2
    for k, t in enumerate(texts):
        assert fill_middle.rearrange(k, t, cache) == fill_middle.rearrange(k, t)
        assert sum(map(len, cache.summaries)) <= 4_000
    repeat = fill_middle.ChunkCache()
    for _ in range(3):
        fill_middle.Measured(texts[0] * 5, repeat)
    assert repeat.hits > 0


# -- packing -----------------------------------------------------------------------------------


def fewest(lengths, size):
    """The least number of sequences, by trying all arrangements."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0] and i < len(lengths):
            return
        if i == len(lengths):
            best[0] = min(best[0], len(rooms))
            return
        for r in {r for r in rooms if r >= lengths[i]}:
            left = list(rooms)
            left.remove(r)
            place(i + 1, [*left, r - lengths[i]])
        place(i + 1, [*rooms, size - lengths[i]])

    place(0, [])
    return best[0]


def test_bound_and_best_fit_against_all_arrangements():
    rng = random.Random(1)
    met = 0
    for _ in range(300):
        size = rng.choice([10, 24, 100])
        lengths = np.array([rng.randrange(1, size + 1) for _ in range(rng.randrange(1, 9))], np.int64)
        kinds, counts = np.unique(lengths, return_counts=True)
        sequence, offset, room = packing.best_fit_decreasing(lengths, size)
        least = fewest(lengths.tolist(), size)
        bound = packing.lower_bound(kinds, counts, size)
        assert bound <= least <= len(room)
        met += bound == least
        for b, left in enumerate(room):
            at = sorted((int(o), int(n)) for o, n, s in zip(offset, lengths, sequence) if s == b)
            assert [o for o, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))]
            assert sum(n for _, n in at) + left == size
    assert met > 280


def check_packing(rows, size):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]
        assert sum(n for _, n in held) <= size
    return len(places)


@pytest.mark.parametrize("part_pieces", [65_536, 7])
def test_packed_documents(docs, rows, part_pieces):
    size, tok = 128, library()
    got = packing.pack_documents(docs, PATH, size, 2, part_pieces).collect()
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % size or size, len(ids), size), len(ids)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    kinds, counts = np.unique([r.length for r in got], return_counts=True)
    assert check_packing(got, size) <= packing.lower_bound(kinds, counts, size) + 2


def test_parts_exchange_pieces(spark):
    """Many small parts come close to one part, and no worse than the first round."""
    from wardlight.session import materialize

    rng = random.Random(5)
    lengths = [rng.randrange(1, 101) for _ in range(4_000)]
    df = spark.createDataFrame([(None, 0, 0, n, 0, k) for k, n in enumerate(lengths)], f"{packing._PIECE}, key long")
    pieces = materialize(df, "test-pieces")
    first = packing._pack_parts(pieces, 40, 100, 0).filter("offset = 0").count()
    packed = packing.pack_pieces(pieces, 100, 100).collect()
    assert sorted(r.key for r in packed) == list(range(4_000))
    n = check_packing(packed, 100)
    alone = len(packing.best_fit_decreasing(np.array(lengths), 100)[2])
    kinds, counts = np.unique(lengths, return_counts=True)
    assert packing.lower_bound(kinds, counts, 100) <= n < first
    assert n <= alone * 1.02


def test_packing_of_nothing(no_docs):
    got = packing.pack_documents(no_docs, PATH)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.collect() == []
