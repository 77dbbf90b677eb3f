import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from barquarry.llm import quality as q

GOOD = ["The garden lies behind the old house near a river.", "People walk there on warm evenings, talking quietly.", "In winter nobody comes, and snow covers every path.", "A dog sleeps under trees until his owner calls him."]
BAD = ["BUY NOW!! BUY NOW!! BUY NOW!!", "Home | About | Contact | Login", "*** ### &&& %%% $$$ <<< >>>", "click click click click click click"]


def texts(n, seed):
    random.seed(seed)
    good = ["\n".join(random.choices(GOOD, k=5)) + " " + str(random.random()) for _ in range(n)]
    bad = ["\n".join([random.choice(GOOD), *random.choices(BAD, k=6)]) for _ in range(n)]
    return [(t, 1) for t in good] + [(t, 0) for t in bad]


@pytest.fixture(scope="module")
def field():
    return q.train(texts(60, 1))


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_base_counts_are_those_of_a_plain_version():
    random.seed(2)
    for _ in range(200):
        text = "".join(random.choices(["a", "b ", "c\n", " ", "\n", "#x ", " ", "\x85", "a b a b a ", "é\t"], k=random.randint(0, 60)))
        d = q.describe(text)
        assert (d.words, d.word_chars, d.symbols, d.dup_lines, d.repeated) == plain(text)


def test_decoding_is_the_best_of_all_label_sequences():
    random_ = np.random.default_rng(3)
    for n in range(1, 8):
        field = q.Field(random_.normal(size=(q.N_FEATURES, 2)), random_.normal(size=(2, 2)), random_.normal(size=2))
        lines = np.column_stack([random_.integers(0, len(b) + 1, n) for b in q.BINS])
        scores = field.line_scores(lines)

        def total(labels, field=field, scores=scores):
            return field.first[labels[0]] + sum(scores[i, x] for i, x in enumerate(labels)) + sum(field.transition[a, b] for a, b in itertools.pairwise(labels))

        best = max(itertools.product((0, 1), repeat=n), key=total)
        assert total(tuple(field.decode(lines))) == pytest.approx(total(best))


def test_held_out_texts_are_told_apart(field):
    judge = q.Judge(field)
    for text, good in texts(40, 9):
        d = q.describe(text)
        assert (judge.share(d) >= q.CONTENT_SHARE) == bool(good)


def test_awkward_rows(awkward, no_rows, field):
    rows = q.quality(awkward, field).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        if r.n_words == 0:
            assert r.base_failed and not r.kept
    assert q.keep_quality(awkward, field).columns == awkward.columns
    assert q.quality(no_rows, field).count() == 0 and q.keep_quality(no_rows, field).count() == 0


def test_one_label_alone_labels_all_lines_content():
    assert q.Judge(q.train([("some words here", 1)])).share(q.describe("a b c")) == 1.0
