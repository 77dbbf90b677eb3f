import random
import re

import numpy as np
import pytest

from barquarry.llm import shingle_join as j


def shingles(text, size):
    lower = (text or "").translate(str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)}))
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * len(sets[x] | sets[y]):
                group[top(x)] = top(y)
    low = {}
    for x, (i, _) in enumerate(rows):
        ids = [k for k in (low.get(top(x)), i) if k is not None]
        low[top(x)] = min(ids) if ids else None
    return sorted(((i, len(sets[x]), low[top(x)] if sets[x] else i) for x, (i, _) in enumerate(rows)), key=str)


def corpus(seed, n=150):
    """Chains of near copies at many distances around the limit, copies, shared passages, short texts."""
    random.seed(seed)
    word = lambda: "".join(random.choices("abcdefgh", k=random.randint(1, 4)))
    passage = " ".join(word() for _ in range(25))
    texts = []
    for _ in range(n // 10):
        words = [word() for _ in range(random.choice([3, 8, 40, 90, 300]))]
        if random.random() < 0.5:
            words += passage.split()
        texts.append(" ".join(words))
        for _ in range(9):
            copy = list(words)
            for _ in range(random.choice([0, 1, 1, 2, 4])):
                copy[random.randrange(len(copy))] = word()
            if random.random() < 0.3:
                copy = copy[: max(1, len(copy) - random.randint(0, len(copy) // 8 + 1))]
            words = copy if random.random() < 0.4 else words
            texts.append(" ".join(copy).title() if random.random() < 0.3 else " ".join(copy))
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("size", "percent", "rows_of_region"), [(4, 85, 20_000), (5, 80, 20_000), (2, 70, 12), (4, 85, 9)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, size, percent, rows_of_region):
    monkeypatch.setattr(j, "REGION_ROWS", rows_of_region)
    monkeypatch.setattr(j, "SMALL_REGION", 6)
    rows = corpus(size)
    got = j.shingle_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size, percent)
    got = sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows, size, percent)
    assert len({c for *_, c in got}) < len(rows) * 0.8


def test_awkward_rows(spark, awkward, no_rows):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = sorted((tuple(r) for r in j.shingle_groups(awkward).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows, 4, 85)
    assert j.shingle_groups(no_rows).count() == 0


def test_one_row_of_each_group_stays(spark, awkward, no_rows):
    kept = j.one_of_each_group(awkward, 5, 80)
    assert kept.columns == awkward.columns
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    # The twice repeated row 5, and its copy under id 6, leave one; rows without a word all stay.
    assert sorted(i for i, t in texts if t and t.startswith("one two")) == [5]
    assert sorted(str(i) for i, t in texts if not (t or "").strip()) == ["0", "0", "1", "2"]
    assert len(texts) == awkward.count() - 3
    rows = corpus(5)
    groups = {c for *_, c in brute(rows, 5, 80)}
    left = j.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert {r.doc_id for r in left.collect()} == groups and left.count() == len(groups)
    assert j.one_of_each_group(no_rows, 5, 80).count() == 0


def test_bit_vectors_never_exceed_the_symmetric_difference():
    random_ = np.random.default_rng(1)
    for n in (3, 200, 1000, 1100, 3000):
        x = np.unique(random_.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: int(n * 0.9)], random_.integers(0, 2**63, n // 10).astype(np.uint64)]))
        short, wide = j.bits_matrix([j.bit_vector(x), j.bit_vector(y)])
        apart = len(np.setxor1d(x, y))
        assert np.bitwise_count(short[0] ^ short[1]).sum() <= apart
        if len(wide) == 2:
            assert np.bitwise_count(wide[0] ^ wide[1]).sum() <= apart


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 300), (250, 300)]
    got = {r.node: r.root for r in j.components(spark.createDataFrame(edges, "a long, b long"), []).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **{100 + k: 100 for k in range(30)}, 200: 200, 250: 200, 300: 200}


def region_of(n_rows, seed=2):
    """Sizes and bit vectors of near copies of one set, by size."""
    r = np.random.default_rng(seed)
    base = np.unique(r.integers(0, 2**63, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate([np.delete(base, r.integers(0, len(base), 4)), r.integers(0, 2**63, r.integers(0, 5)).astype(np.uint64)])) for _ in range(n_rows)]
    sets.sort(key=len)
    return np.array([len(s) for s in sets]), [j.bit_vector(s) for s in sets], sets


@pytest.mark.parametrize(("start_at", "percent"), [([0], 85), ([0, 300, 340, 345], 85), ([0, 200], 97)])
def test_spanning_pairs_connect_what_all_pairs_connect(start_at, percent):
    n, bits, _ = region_of(500)
    start = np.zeros(500, dtype=bool)
    start[start_at] = True
    for a, b in zip(start_at, [*start_at[1:], 500], strict=True):
        at = a + np.argsort(n[a:b], kind="stable")
        n[a:b], bits[a:b] = n[at], [bits[k] for k in at]
    root = np.arange(500)
    root[10:20] = 10

    def groups(pairs):
        ties = j.Ties(np.arange(500))
        ties.merge(np.arange(10, 20), np.full(10, 10))
        ties.merge(*pairs)
        return ties.label

    every, few = (list(j.region_pairs(start, n, bits, root, percent, spanning)) for spanning in (False, True))
    every, few = (tuple(np.concatenate([p[k] for p in pairs]) for k in (0, 1)) for pairs in (every, few))
    assert len(few[0]) < 500 < len(every[0])
    a, b = groups(every), groups(few)
    assert len(np.unique(np.column_stack([a, b]), axis=0)) == len(np.unique(a)) == len(np.unique(b))


def test_pairs_are_sent_in_slices(monkeypatch):
    monkeypatch.setattr(j, "PAIRS_HELD", 1000)
    n, bits, _ = region_of(300)
    start = np.arange(300) == 0
    slices = [len(i) for i, _ in j.region_pairs(start, n, bits, np.arange(300), 85, False)]
    assert max(slices) < 1300 and sum(slices) > 10_000


def test_wide_vectors_tell_sets_near_the_limit_apart():
    random_ = np.random.default_rng(4)
    base = random_.integers(0, 2**63, 900).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[k * 90 :], random_.integers(0, 2**63, k * 90).astype(np.uint64)])) for k in (0, 1)]
    n, both = np.array([len(s) for s in sets]), (np.array([0]), np.array([1]))
    passed = [j.near(*both, n, *j.bits_matrix([j.bit_vector(s, wide) for s in sets]), 85) for wide in (j.WIDE_FROM, j.WIDE_AMONG_PAIRS_FROM)]
    # 810 of 990 are shared, 81.8 %.
    assert passed[0].tolist() == [True] and passed[1].tolist() == [False]
