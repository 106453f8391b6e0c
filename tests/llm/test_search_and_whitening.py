"""Exact top-k search, whitening and ranked lexical search."""

import math
import re

import numpy as np
import pytest
from brute import lower
from odd_rows import SF
from pyspark.sql import functions as F

import checks
from opinionlake.llm import exact_topk, lexical, registry, whitening

VECTORS = "vec_id long, embedding array<float>, key long, v string, x string, id string, part string, label int"


def odd_vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=5) / 10).tolist()) for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5, 0.5]) for i in range(300, 420)]
    rows += [
        (500, [0.0] * 5), (600, [0.0] * 5), (601, [1e-9] * 5), (700, None), (701, []), (702, [1.0, None, 1.0, 1.0, 1.0]),
        (703, [1.0, float("nan"), 1.0, 1.0, 1.0]), (704, [float("inf")] * 5), (705, [1.0, 2.0]), (706, [3e38] * 5),
        (None, [1.0, 2.0, 3.0, 4.0, 5.0]), (800, [1.0, 2.0, 3.0, 4.0, 5.0]), (800, [0.0, 2.0, 3.0, 4.0, 5.0]),
        (900, [-1.0, -2.0, -3.0, -4.0, -5.0]), (901, [-2000.0, 2000.0, 1.0, 1.0, 1.0]),
    ]
    return [(i, v, None, "a", "b", None, "c", None if i is None else i % 2) for i, v in rows]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(odd_vectors(), VECTORS).repartition(4).cache()


def usable():
    return [(r[0], r[1]) for r in odd_vectors() if r[1] and len(r[1]) == 5 and all(x is not None and abs(x) < 1e30 for x in r[1])]


# --- exact search ---------------------------------------------------------------


def plain_topk(k, step):
    held = {}
    for i, v in usable():
        if i is not None:
            x = [math.floor(1024 * float(np.float32(c))) for c in v]
            held[i] = min(x, held.get(i, x))
    out = []
    for q, x in held.items():
        if q % step == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in held.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("s", [exact_topk.Settings(), exact_topk.Settings(k=7, pivots=5, bins=40, shell_bytes=700, annulus=8, block=4, merge_rows=3, sample=90)])
def test_topk_of_odd_vectors_equals_brute_force(vectors, s):
    rows = exact_topk.search(vectors, lambda i: i % 20 == 0, s=s).collect()
    assert sorted(tuple(r) for r in rows) == plain_topk(s.k, 20)


def test_topk_equals_sql_with_small_shells(spark):
    s = exact_topk.Settings(shell_bytes=64 * 8 * 50, annulus=16, block=2, merge_rows=2, bins=64)
    found = exact_topk.search(registry.table(spark, SF, "embeddings"), lambda i: i % 100 == 0, s=s)
    assert checks.differences(found, checks.duck(SF), registry.ORACLES["op11_exact_topk"]) == []
    assert checks.differences(exact_topk.op11_exact_topk(spark, SF), checks.duck(SF), registry.ORACLES["op11_exact_topk"]) == []


def test_annuli_of_clustered_vectors_are_left_out():
    """Of well separated clusters a query looks at a few rings, and still finds what all products give."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(40, 16)), 100, axis=0) + rng.normal(size=(4000, 16)) / 50
    x = np.floor(1024 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    s = exact_topk.Settings(pivots=6, annulus=64, bins=256, shell_bytes=1 << 22)
    index = exact_topk.fit_pivots(x, int((x * x).sum(axis=1).max()), s)
    far = index.distances(index.extended(x))
    looked = 0
    for pivot in range(len(index.pivots)):
        mine = np.flatnonzero(far.argmin(axis=1) == pivot)
        dist = far[mine, pivot]
        rings = [{"pivot": pivot, "bin": 0, "n": len(mine), "low": dist.min(), "high": dist.max()}]
        one = exact_topk.shells(index, rings, 1 << 20)
        rows = pa.table({
            "shell": pa.array([0] * len(mine), pa.int32()), "dist": dist, "ids": pa.array([[int(i)] for i in mine], pa.list_(pa.int64())),
            "x": pa.array(x[mine].tolist(), pa.list_(pa.int64())),
        })
        asked = mine[:5]
        least = np.full(len(asked), exact_topk.NEVER)
        hits, _, products = exact_topk.scan(one, rows, asked, x[asked], least, s)
        looked += products / (len(asked) * len(mine))
        for n, q in enumerate(asked):
            score = x[mine] @ x[q]
            best = sorted((-int(a), int(i)) for a, i in zip(score, mine, strict=True))[: s.k + 1]
            m = hits.of == n
            assert sorted((-int(a), int(i)) for a, i in zip(hits.score[m], hits.id[m], strict=True)) == best
    assert looked / len(index.pivots) < 0.7


def test_large_components_stay_exact():
    x, q = np.array([[1 << 30, 3], [-(1 << 30), 5]]), np.array([[(1 << 30) - 1, -7]])
    want = [[int(a) * int(c) + int(b) * int(d) for a, b in x] for c, d in q]
    assert exact_topk._scores(x, q, 1 << 61).tolist() == want


def test_search_of_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    nulls = spark.createDataFrame([(1, None, None, None, None, None, None, None)], VECTORS)
    for rows in (none, nulls):
        assert exact_topk.search(rows, lambda i: i % 1 == 0).collect() == []
        assert whitening.whiten(rows).collect() == []


# --- whitening ------------------------------------------------------------------


def test_planes_give_exact_products():
    rng = np.random.default_rng(1)
    for high, n in ((1, 1), (200, 1000), (1 << 40, 130)):
        y = rng.integers(0, high, (n, 6))
        y[:, 2] = 0
        bits = np.array([int(c.max()).bit_length() for c in y.T])
        sums, cross = whitening.products(whitening.overlaps(whitening.planes(y, bits)), bits, n)
        whole = y.astype(object)
        assert [int(s) for s in sums] == [int(s) for s in whole.sum(axis=0)]
        assert [[int(c) for c in line] for line in cross] == [[int(c) for c in line] for line in whole.T @ whole]


def check_whitening(rows, vectors, k):
    ids = [i for i, _ in vectors]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    deviation = sorted((str(i), sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True))) for i, r in zip(ids, x, strict=True))
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in rows if r["component"] == 1) == deviation
    centred = np.array([[(n * a - b) / n for a, b in zip(r, s, strict=True)] for r in x])
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    assert {r["n"] for r in rows} == {n} and len({r["identity_error"] for r in rows}) == 1
    assert len(rows) == n * min(k, d) and rows[0]["identity_error"] < 1e-6
    for c in range(1, min(k, d) + 1):
        mine = [r for r in rows if r["component"] == c]
        assert mine[0]["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
        assert sum(r["whitened"] ** 2 for r in mine) / n == pytest.approx(1)
        # The projection reproduces the component's share of the covariance.
        w = {}
        for r in mine:
            w.setdefault(str(r["vec_id"]), []).append(r["whitened"])
        if all(len(v) == 1 for v in w.values()):
            line = np.array([w[str(i)][0] for i in ids])
            u = centred.T @ line / n / np.sqrt(values[c - 1])
            assert np.allclose(np.abs(u @ np.linalg.eigh(cov)[1][:, ::-1][:, c - 1]), 1, atol=1e-6)


def test_whitening_of_the_table(spark):
    source = registry.table(spark, SF, "embeddings").collect()
    check_whitening(whitening.op12_whitening(spark, SF).collect(), [(r["vec_id"], r["embedding"]) for r in source], 32)


def test_whitening_of_odd_vectors(spark, vectors, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 70)
    fits = [(i, v) for i, v in usable()]
    check_whitening(whitening.whiten(vectors).collect(), fits, 32)


def test_whitening_without_variance(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (2, [1.0, 3.0])], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(rows).collect()}
    assert got[1, 1]["whitened"] is not None and got[1, 2]["whitened"] is None and got[1, 1]["explained"] == 1
    one = whitening.whiten(rows.where("vec_id = 1")).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in one] == [(None, None, None, 0)] * 2


# --- lexical search -------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_lexical(docs, items, k=10):
    """(item_id, rank, doc_id, score), from lists of (id, text) without null or repeated ids."""
    counts = [(i, TERM.findall(lower(t))) for i, t in docs]
    counts = [(i, w) for i, w in counts if w]
    n_docs, n_words = len(counts), sum(len(w) for _, w in counts)
    df = {}
    for _, w in counts:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        asked = set(TERM.findall(lower(text))) & set(df)
        found = []
        for i, w in counts:
            score = 0
            for t in asked:
                tf = w.count(t)
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * (100 - 90 + 90 * len(w) * n_docs // n_words)))
            if score > 0:
                found.append((-score, i))
        out += [(item, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


SMALL = lexical.Settings(shard_bytes=3000, group_bytes=300, bundle=2, owners=3)


@pytest.mark.parametrize("s", [lexical.Settings(), SMALL])
def test_lexical_search_of_odd_documents(spark, odd, s):
    items = [(1, "the CAT sat"), (2, None), (3, ""), (4, "w1 w2 w59 tail"), (5, "no such words here at all xyzzy"), (6, "한국어 lorem lorem")]
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    held = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = [(r["doc_id"], r["text"]) for r in held.collect()]
    got = sorted(tuple(r) for r in lexical.search(held, asked, s).collect())
    assert got == plain_lexical(texts, items) and len(got) > 5


def test_lexical_search_of_repeated_and_null_ids(spark, odd):
    asked = spark.createDataFrame([(None, "w1 w2"), (7, "w1 w2"), (7, "w1 w2")], "item_id long, text string")
    rows = lexical.search(odd, asked, SMALL).collect()
    assert sorted((str(r["item_id"]), r["rank"], str(r["doc_id"])) for r in rows if r["item_id"] is None) == [
        ("None", n, i) for n, i in zip((1, 2, 3, 4), ("None", "1", "2", "2"), strict=True)
    ] or {str(r["doc_id"]) for r in rows} == {"None", "1", "2"}
    assert len(rows) == 12 and sorted(r["rank"] for r in rows if r["item_id"] == 7) == [1, 1, 2, 2, 3, 3, 4, 4]


def test_lexical_search_of_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "the cat")], "item_id long, text string")
    assert lexical.search(none, items).collect() == []
    assert lexical.search(odd, items.limit(0)).collect() == []
    assert lexical.search(odd.where("text IS NULL"), items).collect() == []


def test_lexical_search_equals_sql(spark):
    sql = registry.ORACLES["op13_lexical_search"]
    assert checks.differences(lexical.op13_lexical_search(spark, SF), checks.duck(SF), sql) == []
    docs, items = registry.table(spark, SF, "documents"), registry.table(spark, SF, "benchmark")
    small = lexical.Settings(shard_bytes=200_000, group_bytes=60_000, bundle=7, owners=5)
    assert checks.differences(lexical.search(docs, items, small), checks.duck(SF), sql) == []


def test_documents_out_of_reach_are_not_carried(spark):
    """The bound leaves out most accumulators before the last owner."""
    import pyarrow as pa

    totals = lexical.Totals(1000, 100_000)
    plan = [{"item": 0, "least": 5_000_000, "rest": 1_000_000, "terms": [{"term": 5, "weight": 10}]}]
    left = pa.table({
        "b": [0], "g": [0], "bundle": [0], "plan": pa.array([plan]), "items": pa.array([None], pa.binary()),
        "docs": pa.array([None], pa.binary()), "scores": pa.array([None], pa.binary()),
    })
    three = np.array([0, 1, 2], "<u4")
    rows = pa.table({
        "shard": [0], "terms": [np.array([5]).tobytes()], "counts": [np.array([3], "<u4").tobytes()],
        "docs": [three.tobytes()], "tfs": [np.array([1, 2, 40], "<u4").tobytes()], "sizes": [np.array([1000, 50, 50], "<u4").tobytes()],
    })
    out = lexical._stage(totals, 10)(left, rows)
    kept = np.frombuffer(out.column("docs")[0].as_py(), "<i8")
    adds = totals.contribution(np.array([10, 10, 10]), np.array([1, 2, 40]), np.array([1000, 50, 50]))
    assert kept.tolist() == np.flatnonzero(adds + 1_000_000 >= 5_000_000).tolist() and 0 < len(kept) < 3
