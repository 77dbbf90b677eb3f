import random

import numpy as np
import pytest

from barquarry.llm import languages as lang

SYLLABLES = {"aa": ["tra", "lo", "vin", "ste"], "bb": ["kö", "rim", "zat", "uhl"]}


def text(name, seed, n=80):
    random.seed(seed)
    return " ".join("".join(random.choices(SYLLABLES[name], k=random.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def identifier(spark):
    rows = [(2 * i + k, text(name, 10 * i + k), name) for i in range(60) for k, name in enumerate(SYLLABLES)]
    rows.append((1000, None, "aa"))
    return lang.train(spark.createDataFrame([*rows, (1001, "x", None)], "doc_id long, text string, lang string"))


def test_held_out_texts(identifier):
    for name in SYLLABLES:
        predicted, scores, accepted = identifier.judge([text(name, 7000 + i, 5) for i in range(40)])
        assert set(predicted) == {name} and min(scores) > 0.5 and all(accepted)


def test_other_writing_is_rejected(identifier):
    assert identifier.judge(["щука плывёт по реке и думает о своём " * 10])[2] == [False]


def test_probabilities_are_those_of_a_plain_version():
    texts = [text("aa", i, 20) for i in range(5)]
    model = lang.fit(texts)
    seqs = [tuple(lang.letters(t).tolist()) for t in texts]
    runs = [[s[i : i + n] for s in seqs for i in range(len(s) - n + 1)] for n in range(1, lang.ORDER + 1)]

    def weight(run):
        """Plain count at the highest order, else how many different characters stand before."""
        n = len(run)
        if n == lang.ORDER:
            return runs[n - 1].count(run)
        return max(1, len({r[0] for r in runs[n] if r[1:] == run})) if run in runs[n - 1] else 0

    def prob(run):
        if not run:
            return None
        n = len(run)
        if n == 1:
            kinds = set(runs[0])
            total = sum(weight(r) for r in kinds)
            uniform = lang.DISCOUNT * len(kinds) / total / (len(kinds) + 1)
            return max(weight(run) - lang.DISCOUNT, 0) / total + uniform
        follow = {r for r in runs[n - 1] if r[:-1] == run[:-1]}
        if not follow:
            return prob(run[1:])
        total = sum(weight(r) for r in follow)
        return max(weight(run) - lang.DISCOUNT, 0) / total + lang.DISCOUNT * len(follow) / total * prob(run[1:])

    order = lang.ORDER
    asked = lang.letters("tralo vinq zzz")
    hashes = lang.run_hashes(asked, order)
    ends = [h[order - n :] for n, h in enumerate(hashes, 1)] + [hashes[n - 2][order - n : len(hashes[n - 2]) - 1] for n in range(2, order + 1)]
    got = np.exp(lang.log_probs(model, ends))
    expected = [prob(tuple(asked[i : i + order].tolist())) for i in range(len(asked) - order + 1)]
    assert got.tolist() == pytest.approx(expected)


def test_awkward_rows(awkward, no_rows, identifier):
    rows = lang.identify(awkward, identifier).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert (r.lang_pred == "und") == (r.doc_id in (0, 1, 2)) and 0 <= r.score <= 1
    kept = lang.keep_identified(awkward, identifier)
    assert kept.columns == awkward.columns and kept.count() == sum(r.accepted for r in rows)
    assert lang.identify(no_rows, identifier).count() == 0
    nothing = lang.train(no_rows)
    assert {r.lang_pred for r in lang.identify(awkward, nothing).collect()} == {"und"}


def test_a_language_of_the_same_script_is_rejected(identifier):
    """Its letters are known, its runs of letters are not."""
    random.seed(3)
    other = [" ".join("".join(random.choices(["mon", "dru", "pes", "ank", "göl"], k=random.randint(1, 3))) for _ in range(80)) for _ in range(50)]
    assert sum(identifier.judge(other)[2]) <= 2
