"""Similar requests against all pairs of a block."""

import random
import re

import pytest

from wardlight.operators import similar as S


def groups_of(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def all_pairs(rows, percent):
    words = {i: frozenset(re.findall(r"[^\W_]+", (t or "").lower())) for i, _, t in rows}
    block = {i: b for i, b, _ in rows}
    ids = [i for i in words if words[i]]
    links = [(a, b) for a in ids for b in ids if a < b and block[a] == block[b]
             and len(words[a] & words[b]) * 100 >= percent * len(words[a] | words[b])]
    root = groups_of(ids, links)
    sizes = {}
    for i in ids:
        sizes[root[i]] = sizes.get(root[i], 0) + 1
    return sorted((i, root[i], sizes[root[i]]) for i in ids if sizes[root[i]] > 1)


def request_rows(seed):
    rng = random.Random(seed)
    common, rare = [f"c{k}" for k in range(12)], [f"r{k}" for k in range(60)]
    rows = []
    for k in range(260):
        words = [rng.choice(common) for _ in range(rng.randrange(0, 9))] + rng.sample(rare, rng.randrange(0, 3))
        rows.append((k, rng.choice(["w1", "w2", None]), " ".join(words)))
    base = [f"b{k}" for k in range(20)]
    for k in range(80):  # a large group of near copies, chained by small changes
        kept = [w for w in base if rng.random() > 0.06] + [f"x{k}"] * (k % 3 == 0)
        rng.shuffle(kept)
        rows.append((1000 + k, "w1", " ".join(kept).upper()))
    rows += [(2000 + k, "w2", "Lamp, broken!" if k % 2 else "broken LAMP") for k in range(9)]
    return [*rows, (3000, "w1", None), (3001, "w1", ""), (3002, "w1", "?!"), (3003, None, "one word"), (3004, None, "word one")]


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_groups_equal_all_pairs(spark, percent):
    rows = request_rows(percent)
    df = spark.createDataFrame(rows, "id long, ward string, text string")
    out = S.similar_requests(df, "id", "text", ["ward"], percent)
    assert out.columns == ["id", "ward", "group_id", "members"]
    got = sorted((r.id, r.group_id, r.members) for r in out.collect())
    assert got == all_pairs(rows, percent)
    assert len(got) > 20


def test_no_requests(spark):
    df = spark.createDataFrame([], "id long, ward string, text string")
    assert S.similar_requests(df, "id", "text", ["ward"]).collect() == []


def test_connected_groups(spark):
    rng = random.Random(1)
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(500, 500 + k) for k in range(1, 200)]
    loose = [(rng.randrange(1_000, 1_200), rng.randrange(1_000, 1_200)) for _ in range(90)]
    edges = chain + star + loose + [(7, 7), (160, 100), (3, 2), (3, 2)]
    rng.shuffle(edges)
    got = dict(S.connected_groups(spark.createDataFrame(edges, "a long, b long")).collect())
    nodes = {n for e in edges for n in e}
    want = {n: r for n, r in groups_of(nodes, edges).items() if n != r}
    assert got == want


def test_a_large_group_gives_no_pair_list(spark, monkeypatch):
    """400 near copies: pairs that are compared grow with the rows, not with their square."""
    compared = []
    similar = S._similar

    def counted(pairs, sets, percent):
        compared.append(pairs.distinct().count())
        return similar(pairs, sets, percent)

    monkeypatch.setattr(S, "_similar", counted)
    base = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(k, "x", f"{base} own{k}") for k in range(400)], "id long, ward string, text string")
    out = S.similar_requests(df, "id", "text", ["ward"])
    assert out.count() == 400 and out.select("group_id").distinct().count() == 1
    assert sum(compared) < 10 * 400
