"""HTML extraction, nearest neighbours and the pipeline."""

from __future__ import annotations

from itertools import product

import numpy as np

from wardlight.llm import extraction, neighbours

PAGE = """<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>Stone &amp; river</h1><p>The first  line,<br>it goes on. <p>Second &lt;b&gt; <b>bold</b> words, and more of them here.
<aside>See also this.</aside><div class="ad">Buy now.</div><p>Third line, which is the last of this page.</article>
<div id="comments"><p>Nice words, thank you very much.</p></div><form><label>Mail</label></form><footer>&copy; me</footer></body></html>"""


def test_extraction(spark):
    rows = [(i, f"u{i}", PAGE) for i in range(30)] + [(50, None, None), (51, "u", ""), (52, "u", "<p"), (53, "u", PAGE[: PAGE.index("</article>") - 5]), (0, "u0", PAGE)]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    main = ["Stone & river", "The first line, it goes on.", "Second <b> bold words, and more of them here.", "Third line, which is the last of this page."]
    assert len(got) == len(rows)
    for r in got:
        want = "\n\n".join(main) if r["page_id"] < 50 else "\n\n".join([*main[:3], "Third line, which is the last of this "]).rstrip() if r["page_id"] == 53 else ""
        assert r["n_chars"] == len(r["text"])
        assert r["text"] == want or (r["page_id"] == 53 and r["text"].startswith("\n\n".join(main[:3])))
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_sum_product_against_all_labelings():
    parents, depths = np.array([-1, 0, 0, 1, 1]), np.array([0, 1, 1, 2, 2])
    unary, link = np.array([0.2, -1.0, 0.7, 1.5, -0.3]), np.array([[0.4, -0.6], [0.1, 0.9]])
    weight = {y: np.exp(sum(u * v for u, v in zip(unary, y)) + sum(link[y[p], y[c]] for c, p in enumerate(parents) if p >= 0)) for y in product((0, 1), repeat=5)}
    total = sum(weight.values())
    p, pairs = extraction.sum_product(unary, link, parents, depths)
    assert np.allclose(p, [sum(w for y, w in weight.items() if y[i]) / total for i in range(5)])
    assert np.isclose(pairs[1, 1], sum(w * sum(y[q] and y[c] for c, q in enumerate(parents) if q >= 0) for y, w in weight.items()) / total)


def cosine(a, b):
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1_200, 24)).astype(np.float32)
    x[100:400] = x[100]  # a common vector
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(len(x))]
    rows += [(5_000, None, 0), (5_050, [0.0] * 24, 0), (5_100, [None] + [1.0] * 23, 0), (5_150, [float("nan")] * 24, 0), (5_200, [], 0), (None, rows[0][1], 0), (50, rows[50][1], 0)]
    got = neighbours.fifth_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    x = x.astype(np.float64)
    assert {r["query_id"] for r in got} == set(range(0, 1_200, 50))
    hits = n = 0
    for q in range(0, 1_200, 50):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: (r["rank"]))
        if q == 50:  # a repeated row is another row
            assert {r["vec_id"] for r in own if r["score"] > 0.999} == {50}
            continue
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert all(np.isclose(r["score"], cosine(x[q], x[r["vec_id"]]), rtol=0, atol=1e-12) for r in own)
        true = sorted((round(-cosine(x[q], x[i]), 12), i) for i in range(len(x)) if i != q)[:5]
        hits, n = hits + len({r["vec_id"] for r in own} & {i for _, i in true}), n + 5
        if 100 <= q < 400:
            assert [r["vec_id"] for r in own] == [i for _, i in true]
    assert hits >= 0.9 * n


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    few = neighbours.fifth_neighbours(spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (50, [0.0, 2.0], 1)], schema)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in few) == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert neighbours.fifth_neighbours(spark.createDataFrame([], schema)).collect() == []


def test_pipeline(spark):
    import corpus_pipeline as p
    from wardlight.llm import decontaminate, simhash

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert [n for n, _ in p.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "BPE encoding"]
    kept = docs
    for _, stage in p.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf).cache()
        assert kept.columns == docs.columns
        assert kept.join(before, "doc_id", "left_anti").count() == 0
    assert decontaminate.contamination(kept, bench).filter(decontaminate.is_contaminated()).count() == 0
    assert simhash.near_duplicates(kept.filter("text not like '%[SECRET]%'")).filter("doc_id <> component_id").count() == 0
    out = p.run(spark, sf)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in kept.collect())
