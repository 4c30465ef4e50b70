"""Unlike requests that share a rare word are told apart before whole word sets are sent to pairs."""

import random

from pyspark.sql import functions as F

from wardlight.operators import similar as S


def test_unlike_sets_are_no_candidates(spark, monkeypatch):
    rng = random.Random(5)
    pool = [f"w{k}" for k in range(60)]
    rows = [(k, "x", " ".join(rng.sample(pool, 30) + ["rare"] * (k < 6))) for k in range(24)]
    rows += [(30, "x", " ".join(f"s{k}" for k in range(20))), (31, "x", " ".join(f"s{k}" for k in range(19)))]
    asked, similar = [], S._similar
    monkeypatch.setattr(S, "_similar", lambda pairs, *rest: asked.append(pairs.distinct().count()) or similar(pairs, *rest))
    out = S.similar_requests(spark.createDataFrame(rows, "id long, ward string, text string"), "id", "text", ["ward"])
    assert sorted((r.id, r.group_id, r.members) for r in out.collect()) == [(30, 30, 2), (31, 30, 2)]
    assert sum(asked) == 1  # the two that are alike


def test_sketches_differ_in_no_more_bits_than_words(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(63) for _ in range(900)]
    sets = [(0, 900, base)] + [(k, 900 - 9 * k, base[9 * k :]) for k in range(1, 60)]
    told = S._sketches(spark.createDataFrame(sets, "_rep long, _n int, _words array<bigint>"))
    for name, longs in (("_k", S.SKETCH), ("_s", S.SHORT)):
        first = told.filter("_rep = 0").select(*(F.col(f"{name}{j}").alias(f"o{j}") for j in range(longs)))
        bits = sum((F.bit_count(F.col(f"{name}{j}").bitwiseXOR(F.col(f"o{j}"))) for j in range(longs)), F.lit(0))
        rows = told.crossJoin(first).select("_rep", bits.alias("bits")).collect()
        assert all(r.bits <= 9 * r._rep and (r.bits - 9 * r._rep) % 2 == 0 for r in rows)
        assert max(r.bits for r in rows) > 64
