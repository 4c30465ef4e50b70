"""Every operator on documents against a plain version."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.llm import bpe, decontaminate, quality, secrets, sharding, simhash, substrings, token_files
from wardlight.llm.queries import tokenizer_path

PATH = tokenizer_path()


def found(df, *columns):
    """Rows as a multiset."""
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# -- BPE and token files ----------------------------------------------------------------------


@pytest.mark.parametrize("piece_chars", [64, 65_536])
def test_bpe_equals_the_library(docs, rows, piece_chars):
    tok = library()
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tok.decode(ids, skip_special_tokens=False).encode())] += 1
    got = bpe.round_trip_digests(docs, PATH, piece_chars)
    assert found(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_joins_unsplit_text():
    import random

    codec, rng = bpe.codec(PATH), random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "'s", "'", "12", "é", "日本", "<|endoftext|>", "<|endof", "\t", "!!", "x" * 60]
    for k in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 50)))
        if k % 5 == 0:
            text = "".join(rng.choice("abcé") for _ in range(2_500)) + text
        want = np.array(codec.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        at = rng.randrange(len(text) + 1)
        assert codec.encode(text) == want
        assert codec.join(text[:at], codec.encode(text[:at]), text[at:], codec.encode(text[at:])) == want


def test_words_merged_by_rank():
    """Any bytes, in words of any length, give the library's ids."""
    import random

    assert bpe.by_rank(PATH)
    plain, ranked, rng = bpe.codec(PATH), bpe.codec(PATH, True), random.Random(11)
    parts = ["the", "ing", "tion", "a", "e", "Ġ", "é", "日本", "Zx", "0", "--", "aaaa", "\u00ad"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))).encode() for _ in range(3_000)]
    words += [rng.randbytes(rng.randrange(1, 40)) for _ in range(3_000)] + [b"ab" * 500, b" " * 300]
    for w in words:
        assert ranked._leaf(w) == plain._leaf(w), w
    for text in ("one two  three\n\n four", "x" * 5_000, " lead", "naïve Église's 12,000 <|endoftext|> end"):
        assert ranked.encode(text) == plain.encode(text)


def test_ambiguous_merges_stay_with_the_library(tmp_path):
    """A token that its own merges never reach must not be merged by rank."""
    import json

    with open(PATH, encoding="utf-8") as f:
        config = json.load(f)
    merges = config["model"]["merges"]
    pair = merges[0].split(" ") if isinstance(merges[0], str) else list(merges[0])
    twice = [m.split(" ") if isinstance(m, str) else list(m) for m in merges]
    config["model"]["merges"] = [pair, *twice]
    path = tmp_path / "twice.json"
    path.write_text(json.dumps(config), encoding="utf-8")
    assert not bpe.by_rank(str(path))


def test_null_ids_fill_several_parts(spark, monkeypatch):
    monkeypatch.setattr(token_files, "PART_DOCS", 10)
    from wardlight.session import scratch_dir

    rows = [(None if k % 3 == 0 else k, f"text number {k}") for k in range(120)]
    out = scratch_dir(spark, "tokens")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH, out)
    blocks = spark.read.parquet(f"{out}/blocks").select("part", F.size("doc_ids").alias("n")).collect()
    assert max(r.n for r in blocks) < 40 and len({r.part for r in blocks}) > 6
    back = token_files.read_tokens(spark, out).orderBy("start").collect()
    ids = [r.doc_id for r in back]
    assert ids[:40] == [None] * 40 and ids[40:] == sorted(ids[40:]) and len(ids) == 120


def test_token_files(spark, docs, rows, tmp_path):
    tok = library()
    got = token_files.written_digests(docs, PATH).collect()
    assert len(got) == len(rows)
    known = sorted(r for r in got if r["doc_id"] is not None)
    start = sum(r["n_tokens"] for r in got if r["doc_id"] is None)
    texts = dict(rows)
    for r in known:
        ids = [*tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    token_files.write_tokens(docs, PATH, f"{tmp_path}/t")
    one = token_files.read_tokens(spark, f"{tmp_path}/t", [7]).collect()
    assert [bytes(r["ids"]) for r in one] == [np.array([*tok.encode(texts[7], add_special_tokens=False).ids, 0], "<u4").tobytes()]


# -- secrets ------------------------------------------------------------------------------------


def test_secrets(docs, rows):
    assign = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = Counter()
    for i, t in rows:
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        n = Counter(k for _, k, _ in spans)
        line = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        want[i, n[0], n[1], n[2], sha(line.encode())] += 1
    got = secrets.span_digests(docs)
    assert found(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want


def test_models_tell_random_strings_from_words(spark):
    import random

    rng = random.Random(1)
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    words = "quietly understanding documentation international considered responsibility".split()
    rows = [(i, f'token = "{secret()}" ' + " ".join(rng.choices(words, k=40))) for i in range(80)]
    rows += [(900, "lonely " + secret()[:31] + " here"), (901, "documentation_of_understanding_words")]
    from tests.llm.conftest import make_docs

    spans = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.find_secrets(make_docs(spark, rows)).collect()}
    assert spans[900] == ["markov"] and spans[901] == []
    clean = {r["doc_id"]: r for r in secrets.redact_documents(make_docs(spark, rows)).collect()}
    assert clean[900]["text"] == "lonely [SECRET] here" and clean[900]["n_chars"] == 20
    assert clean[901]["text"] == rows[-1][1]


def test_words_clear_of_many_spans():
    import random

    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["token=abcdefgh12", "AKIA" + "Z9" * 7, "0af" * 12, "a_plain_identifier_of_words", " ", "=", "secret: "]) for _ in range(rng.randrange(40)))
        base = secrets.base_spans(text)
        for pattern in (secrets.WORD, secrets.IDENTIFIER):
            want = [m[0] for m in pattern.finditer(text) if all(m.end() <= s or m.start() >= e for s, _, e, _ in base)]
            assert [m[0] for m in secrets._clear_of(base, pattern, text)] == want
    digits = "0123456789abcdef"
    long = " ".join("".join(rng.choices(digits, k=40)) + " name_of_a_variable" for _ in range(100_000))
    base = secrets.base_spans(long)
    assert len(base) == 100_000 and len(secrets._clear_of(base, secrets.IDENTIFIER, long)) == 100_000


# -- SimHash ------------------------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 4 else [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(docs, rows):
    marks = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:  # relax until nothing changes
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (marks[a] ^ marks[b]).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    least = {g: min((i for (i, _), h in zip(rows, group) if h == g and i is not None), default=None) for g in group}
    want = Counter((i, f"{m:016x}", least[g]) for (i, _), m, g in zip(rows, marks, group))
    assert found(simhash.component_table(docs), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({v for v in least.values() if v is not None})


def test_near_duplicates_are_dropped_by_row(spark):
    from tests.llm.conftest import make_docs

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (7, text(3)), (7, text(4)), (7, text(4)), (2, text(5)), (8, text(5)), (8, text(6)), (None, text(6))]
    kept = simhash.drop_near_duplicates(make_docs(spark, rows))
    assert found(kept, "doc_id", "text") == Counter([(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (2, text(5)), (8, text(6))])


def test_links_reach_every_near_pair(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    marks = {int(b) for b in base}
    for b in base:
        for d in range(1, 7):
            bits = rng.choice(63, d, replace=False)
            marks.add(int(b) ^ int(sum(1 << int(x) for x in bits)))
    pairs = simhash.links(spark.createDataFrame([(m,) for m in marks], "fingerprint long")).collect()
    near = {frozenset((a, b)) for a in marks for b in marks if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert {frozenset((r["a"], r["b"])) for r in pairs} <= near
    root = {m: m for m in marks}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in pairs:
        root[top(r["a"])] = top(r["b"])
    assert all(len({top(x) for x in p}) == 1 for p in near)


# -- repeated substrings --------------------------------------------------------------------------


def plain_removal(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    want = Counter()
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if count[t[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        want[i, len(t), int(gone.sum()), spans, sha(np.frombuffer(t, np.uint8)[~gone].tobytes())] += 1
    return want


@pytest.mark.parametrize(("length", "q", "run"), [(400, 24, 128), (60, 8, 20)])
def test_repeated_substrings(docs, rows, length, q, run):
    got = substrings.remove_repeats(docs, length, q, run).withColumn("kept_sha256", F.sha2("kept", 256))
    assert found(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_removal(rows, length)


def test_passages_count_by_bytes(spark):
    """Passages of over 50 words that two documents share: 399 bytes stay, 400 go."""
    shared = lambda mark, end: " ".join(f"{mark}{i:05d}" for i in range(57)) + end
    short, whole = shared("s", " "), shared("w", " z")
    assert (len(short), len(whole)) == (399, 400)
    docs = spark.createDataFrame([(1, "a" + short + "b"), (2, "c" + short + "d"), (3, "e" + whole + "f"), (4, "g" + whole + "h")], "doc_id long, text string")
    got = substrings.removal_digests(docs).select("doc_id", "n_removed", "n_spans", "n_kept", "kept_sha256").collect()
    want = [(1, 0, 0, 401, f"a{short}b"), (2, 0, 0, 401, f"c{short}d"), (3, 400, 1, 2, "ef"), (4, 400, 1, 2, "gh")]
    assert sorted(tuple(r) for r in got) == [(*w[:4], sha(w[4].encode())) for w in want]


def test_strips_do_not_change_anchors(monkeypatch):
    text = np.random.default_rng(0).integers(97, 101, 5_000).astype(np.uint8)
    whole = substrings.anchors(text)
    monkeypatch.setattr(substrings, "STRIP", 700)
    assert all((a == b).all() for a, b in zip(whole, substrings.anchors(text)))


def test_odd_distances_are_rejected(docs):
    with pytest.raises(ValueError, match="even"):
        simhash.near_duplicates(docs, max_bits=3)


# -- decontamination ------------------------------------------------------------------------------


@pytest.mark.parametrize("block_windows", [7, 50_000])
def test_decontamination(spark, docs, rows, block_windows):
    items = [(1, rows[20][1]), (2, "a"), (3, None), (4, "!!"), (10, rows[4][1]), (10, rows[4][1]), (None, rows[5][1]), (11, "river under stone")]
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).update([] if i is None else [str(i)])
    want = Counter()
    for i, t in rows:
        w = split(t)
        hit, owners = [False] * len(w), set()
        for window, own in windows.items():
            n = len(window)
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == window:
                    owners |= own
                    hit[k : k + n] = [True] * n
        n = sum(hit)
        want[i, len(w), n, len(owners), sha(",".join(sorted(owners)).encode()), n > 0 and 20 * n >= len(w)] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, block_windows=block_windows).select(
        "doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("h"), decontaminate.is_contaminated().alias("c")
    )
    assert found(got, "doc_id", "n_words", "n_hit", "n", "h", "c") == want
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(v for k, v in want.items() if not k[-1])


# -- sharding ---------------------------------------------------------------------------------------


def test_sharding(spark):
    from tests.llm.conftest import make_docs

    rows = [(i, "hot" if i % 3 == 0 else f"text {i // 2}" if i < 500 else f"own {i}") for i in range(1_200)] + [(None, None), (None, "")]
    got = sharding.shard_documents(make_docs(spark, rows)).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    texts = dict(rows)
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 8 and r["law"] == "rows" for r in got if r["doc_id"] is not None)
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got if r["doc_id"] is not None)
    at = {r["doc_id"]: r["shard"] for r in got}
    pairs = [(i, i + 1) for i in range(0, 500, 2) if i % 3 and (i + 1) % 3]
    assert sum(at[a] == at[b] for a, b in pairs) > 0.8 * len(pairs)


def test_sharding_keeps_groups_whole(spark):
    from tests.llm.conftest import make_docs

    free = [f"own {i}" for i in range(500)]
    for rest in (free, [f"pair {i // 2}" for i in range(500)]):  # with and without rows to swap
        sizes = {"hot": 800, "large": 70, "other": 60, **{f"ten {k}": 10 for k in range(97)}}
        texts = [t for t, k in sizes.items() for _ in range(k)] + rest
        got = sharding.shard_documents(make_docs(spark, list(enumerate(texts)))).collect()
        counts = Counter(r["shard"] for r in got)
        assert len(got) == len(texts) == 2_400 and set(counts.values()) == {100}
        at = {}
        for r in got:
            at.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
        assert len(at["hot"]) == 8 and len(at["large"]) == len(at["other"]) == 1
        assert sum(len(s) > 1 for t, s in at.items() if t != "hot") <= (0 if rest is free else 23)


def test_one_round_of_votes(spark):
    """Granted moves against a plain version of the round."""
    import random

    rng = random.Random(12)
    room = [30, 0, 25, 7]
    votes = [(f"g{k}", size, s, rng.randrange(1, 9)) for k in range(40) for size in (rng.choice([2, 2, 3, 5, 9, 40]),) for s in rng.sample(range(4), 2)]
    df = spark.createDataFrame(votes, "link string, size long, shard int, votes long")
    got = {r["link"]: (r["size"], r["shard"]) for r in sharding._granted(df, room, 400, 1).collect()}
    drawn = dict(df.select("link", (F.pmod(F.xxhash64("link", F.lit(1)), F.lit(62)))).distinct().collect())
    tie = {(r[0], r[1]): r[2] for r in df.select("link").distinct().crossJoin(spark.range(4).select(F.col("id").cast("int").alias("s"))).select("link", "s", F.xxhash64("link", "s", F.lit(1))).collect()}
    chunk = dict(df.select("link", F.pmod(F.xxhash64("link"), F.lit(sharding.CHUNKS))).distinct().collect())
    wishes = {}
    for link, size in {(v[0], v[1]) for v in votes}:
        choices = {v[2]: v[3] for v in votes if v[0] == link}
        choices.setdefault(next(i for i in range(4) if drawn[link] < sum(room[: i + 1])), 0)
        fitting = [(n, tie[link, s], s) for s, n in choices.items() if room[s] >= size]
        if fitting:
            wishes.setdefault(max(fitting)[2], []).append((-(size.bit_length() - 1), chunk[link], link, size))
    want = {}
    for s, queue in wishes.items():
        start = 0
        for *_, link, size in sorted(queue):
            if start + size <= room[s]:
                want[link] = (size, s)
            start += size
    assert got == want and len(got) > 3
    assert all(sum(size for size, s in got.values() if s == i) <= x for i, x in enumerate(room))


def test_propagation_moves_groups_whole(spark):
    """Rounds alone, without repair, unite nearly all groups, large ones first."""
    sizes = {f"g{k}": n for k, n in enumerate([90, 70, 60, 45, 30, 30, *[9] * 60, *[2] * 100])}
    rows = [(k * 1_000 + i, name) for k, (name, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "row long, link string")
    label = F.pmod(F.xxhash64("row", F.lit(7)), F.lit(24)).cast("int").alias("shard")
    votes = df.groupBy("link", label).agg(F.count("*").alias("votes")).join(df.groupBy("link").agg(F.count("*").alias("size")), "link")
    room = [100] * 24
    settled, left = sharding.propagate(votes.select("link", "size", "shard", "votes"), room, 100, 2_400)
    moved = [r for t in settled for r in t.collect()]
    assert left.count() == 0 and {r["link"]: r["size"] for r in moved} == sizes and len(moved) == len(sizes)
    used = [sum(r["size"] for r in moved if r["shard"] == i) for i in range(24)]
    assert [100 - u for u in used] == room and min(room) >= 0


def test_seats_fill_exactly():
    room = [100] * 24
    parts = sharding._seats([850, 70, 60, 50, 30], room)
    assert [len(p) for p in parts] == [9, 1, 1, 1, 1] and [sum(x for _, x in p) for p in parts] == [850, 70, 60, 50, 30]
    assert parts[3][0][0] == parts[0][-1][0] and sum(room) == 2_400 - 1_060 and min(room) == 0


# -- quality ----------------------------------------------------------------------------------------


def test_quality_learns_lines(spark):
    import random

    from tests.llm.conftest import make_docs

    rng = random.Random(4)
    good = lambda: "\n".join(" ".join(rng.choices(["stone", "river", "walks", "the", "of", "paper"], k=12)) + "." for _ in range(5))
    bad = lambda: "\n".join(" ".join(w + "%%%" for w in rng.choices(["stone", "river", "walks"], k=10)) for _ in range(5))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    docs = make_docs(spark, rows)
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(got[i]["predicted"] == int(i % 3 > 0) for i in range(300) if got[i]["held_out"])
    kept = quality.drop_rejected(docs, quality.train(docs, labels))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if r["predicted"])


def test_quality_skips_a_huge_labelled_text(spark):
    from tests.llm.conftest import make_docs

    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    huge = labels.filter(~quality.held_out()).orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    text = lambda i: ["%%% !!! ###", "the river walks"][i % 2]
    docs = make_docs(spark, [(i, text(i) * (2_000 if i == huge else 1)) for i in range(100)])
    model = quality.train(docs, labels, fit_lines=100)
    assert model is not None
    good, bad = model.scores([text(1).encode(), text(0).encode()])
    assert good > 0.5 > bad


def test_forward_backward_against_all_labelings():
    from itertools import product

    state, trans = np.array([0.3, -1.0, 2.0, 0.5]), np.array([[0.2, -0.4], [0.1, 0.7]])
    weight = {y: np.exp(sum(s * v for s, v in zip(state, y)) + sum(trans[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=4)}
    total = sum(weight.values())
    good, pairs, log_z = quality.forward_backward(np.concatenate([state, state[:2]]), trans, np.array([4, 2]))
    assert np.allclose(good[:4], [sum(w for y, w in weight.items() if y[i]) / total for i in range(4)])
    assert np.isclose(log_z.max(), np.log(total)) and np.isclose(pairs.sum(), 4)


# -- empty tables -------------------------------------------------------------------------------------


def test_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (
        quality.quality_scores(no_docs, labels),
        secrets.span_digests(no_docs),
        secrets.redact_documents(no_docs),
        simhash.component_table(no_docs),
        simhash.drop_near_duplicates(no_docs),
        substrings.removal_digests(no_docs),
        sharding.shard_documents(no_docs),
        bpe.round_trip_digests(no_docs, PATH),
        token_files.written_digests(no_docs, PATH),
        decontaminate.contamination_digests(no_docs, bench),
        decontaminate.drop_contaminated(no_docs, bench),
    ):
        assert df.collect() == []


def test_the_dictionary_is_fitted_on_a_bounded_sample(spark, monkeypatch):
    from tests.llm.conftest import make_docs

    sent = []
    monkeypatch.setattr(token_files, "_serialize", lambda ids, end_id, width: sent.append(ids) or bytes(ids))
    monkeypatch.setattr(token_files, "SAMPLE_DOCS", 20)
    rows = [(None if i % 3 == 0 else i, f"document {i} of many, with words of its own {i * i}") for i in range(2_000)]
    docs = make_docs(spark, rows)
    token_files.fit_dictionary(docs, PATH, 0, 2, len(rows))
    assert len(sent) == 20
    assert token_files.fit_dictionary(make_docs(spark, [(1, None), (2, "")]), PATH, 0, 2, 2) == b""
