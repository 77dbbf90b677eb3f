import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from barquarry.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms_of(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def plain(docs, items, top=rs.TOP):
    counts = [(d, terms_of(t)) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, n_all = len(counts), sum(n for *_, n in counts)
    df = Counter(w for _, c, _ in counts for w in c)
    out = []
    for item_id, text in items:
        scores = []
        for d, c, n in counts:
            m = 10 + 90 * n * n_docs // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in terms_of(text) if w in c)
            if score > 0:
                scores.append((-score, d is None, d))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item_id, i + 1, d, -s) for i, (s, _, d) in enumerate(scores[:top])]
    return sorted(out, key=str)


def check(spark, docs, items, **more):
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, terms int, `rank` string")
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, item int, score string")
    got = rs.ranked(frame, asked, **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, items, more.get("top", rs.TOP))


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7)) % 300}" for _ in range(3000)]
    docs = [(i * 37 % n, " ".join(r.choice(words) for _ in range(r.randint(1, 60)))) for i in range(n)]
    # Many copies of one text, so that scores are equal.
    return docs + [(n + i, "w7 w8 rare w9") for i in range(n // 3)], r, words


def test_equals_scoring_every_document(spark):
    docs, r, words = corpus(900, 1)
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 25)))) for i in range(30)] + [(99, "RARE w9! absent"), (99, "w7"), (5, "nothing-known")]
    check(spark, docs, items)
    check(spark, docs, items, most_terms=40, index_postings=700, top=4)


def test_awkward_rows(spark):
    texts = [None, "", " \n ", "ÀÉ ñandú ßtraße 12 a_b", "日本語 текст", "İ İ i", "x" * 3_000_000, "big word " * 400_000, "a A a", "a", "\x7fa~a{a"]
    docs = [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(None, "a"), (9, "a"), (9, "a")]
    items = [(0, None), (1, ""), (2, "a ñANDÚ 日本語 текст big x"), (None, "A"), (2, "a"), (7, "İ àÉ"), (8, "x" * 3_000_000)]
    check(spark, docs, items)
    check(spark, docs, items, index_postings=1, top=2)


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")])])
def test_empty_tables(spark, docs, items):
    check(spark, docs, items)


def test_words_over_piece_borders():
    text = "ab " * 700_000 + "Zz" * 600_000 + " end"
    assert {w.decode(): n for w, n in rs.word_counts(text).items()} == terms_of(text)


def test_range_maxima():
    r = np.random.default_rng(3)
    terms, docs = np.nonzero(r.random((9, 700)) < 0.3)
    gains = r.integers(0, 50, len(terms))
    index = rs.Index(terms, docs, gains, 700, 9)
    for _ in range(300):
        t = int(r.integers(9))
        a, b = sorted(r.integers(index.first[t], index.first[t + 1] + 1, 2))
        if a < b:
            (at,) = index.maxima(np.array([a]), np.array([b]))
            assert a <= at < b and index.impacts[at] == index.impacts[a:b].max()


def test_search_scores_few_documents():
    """Once the best are known, intervals without a chance are not opened."""
    r = np.random.default_rng(5)
    n = 20_000
    common = np.arange(n)
    rare = r.choice(n, 12, replace=False)
    index = rs.Index(np.concatenate([np.zeros(n, int), np.ones(12, int)]), np.concatenate([common, rare]), np.concatenate([r.integers(1, 10, n), np.full(12, 1000)]), n, 2)
    opened = []
    maxima = index.maxima
    index.maxima = lambda a, b: opened.append(1) or maxima(a, b)
    best = index.search(np.array([0, 1]), [], 10, np.arange(n))
    want = sorted(((int(index.impacts[d]) + 1000, -int(d)) for d in rare), reverse=True)[:10]
    assert sorted(best, reverse=True) == want
    assert len(opened) < 60
