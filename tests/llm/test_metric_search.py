import numpy as np
import pytest
from pyspark.sql import functions as F

from barquarry.llm import metric_search as m


def brute(rows, top):
    """rows: (vec_id, numbers, is query)."""
    out = []
    for i, (a, x, asked) in enumerate(rows):
        if asked:
            scored = sorted((-sum(p * q for p, q in zip(x, y)), b is None, b or 0) for j, (b, y, _) in enumerate(rows) if i != j and len(x) == len(y))
            out += [(a, k, None if none else b, max(-(2**63), min(2**63 - 1, -s))) for k, (s, none, b) in enumerate(scored[:top], 1)]
    return sorted(out, key=str)


def found(spark, rows, top):
    df = spark.createDataFrame(rows, "vec_id long, v array<long>, q boolean")
    out = m.top_products(df, F.col("q"), top).select("query_id", "rank", "vec_id", "score")
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize(("n", "spread", "tree_rows"), [(400, 3, 64), (700, 40, 100), (30, 2, 4096)])
def test_exact_with_ties_copies_and_repeated_ids(spark, monkeypatch, n, spread, tree_rows):
    monkeypatch.setattr(m, "TREE_ROWS", tree_rows)
    random = np.random.default_rng(n)
    rows = [(int(i % (n - 5)), random.integers(-spread, spread + 1, 4).tolist(), i % 20 == 0) for i in range(n)]
    # A third of all rows is one vector.
    rows = [(a, [1, -1, 2, 0] if i % 3 == 0 else x, q) for i, (a, x, q) in enumerate(rows)]
    rows += [(900, [1, 2], True), (901, [3, 4], False)]
    # Rows without an id are candidates too.
    rows += [(None, [spread, 1, spread, 0], False), (None, [1, -1, 2, 0], False)]
    assert found(spark, rows, 7) == brute(rows, 7)


@pytest.mark.parametrize("size", [1e7 * 64, 2**40, 1e12 * 64])
def test_scores_of_large_components_are_exact(spark, monkeypatch, size):
    monkeypatch.setattr(m, "TREE_ROWS", 60)
    random = np.random.default_rng(3)
    numbers = lambda: [int(x) for x in random.integers(-int(size), int(size), 5)]
    base = numbers()
    rows = [(i, numbers() if i % 2 else [x + int(random.integers(-2, 3)) for x in base], i % 10 == 0) for i in range(200)]
    # Small and large ones together, and a query that only has negative scores.
    rows += [(300 + i, [int(x) for x in random.integers(-5, 6, 5)], i < 3) for i in range(30)]
    rows += [(400, [-x for x in base], True)]
    assert found(spark, rows, 6) == brute(rows, 6)


def test_vectors_without_components(spark):
    rows = [(1, [], True), (2, [], False), (None, [], False), (3, [5], True), (4, [], False)]
    assert found(spark, rows, 2) == brute(rows, 2) == sorted([(1, 1, 2, 0), (1, 2, 4, 0)], key=str)


def test_search_in_one_tree_is_exact_and_leaves_products_out():
    random = np.random.default_rng(2)
    centres = random.integers(-300, 300, (20, 8))
    x = (centres[random.integers(0, 20, 2000)] + random.integers(-3, 4, (2000, 8))).astype(np.int64)
    tree = m.build(x, np.arange(2000), np.arange(2000))
    at, places, scores = m.search(tree, x[:50], np.arange(50), np.full(50, -np.inf), 5)
    ids = tree.ids[places]
    for q in range(50):
        full = sorted((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q)[:5]
        assert sorted((-s, i) for i, s in zip(ids[at == q], scores[at == q], strict=True)) == full
    for page in range(len(tree.objects)):
        lo, hi = tree.first[page], tree.first[page + 1]
        d = np.sqrt(((tree.vectors[lo:hi] - tree.objects[page]) ** 2).sum(1))
        assert hi - lo <= m.PAGE_ENTRIES and d.max() <= tree.radius[page] + 1e-9
        assert np.allclose(d, tree.to_object[lo:hi])


def test_unusable_vectors_and_floor(spark):
    rows = [(0, [0.5, -0.01]), (20, None), (40, [None, 1.0]), (60, [float("nan"), 1.0]), (80, [float("inf"), 0.0]), (1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").where(m.usable())
    assert [(r.vec_id, r.v) for r in df.select("vec_id", m.whole_numbers().alias("v")).collect()] == [(0, [32, -1]), (1, [64, 64])]


def test_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, v array<int>")
    assert m.top_products(df, F.col("vec_id") % 20 == 0).count() == 0
