import random
import zlib

import numpy as np
import pytest

from barquarry.llm import toxicity as t

from .conftest import TOXIC_WORDS


def texts(n, seed, toxic):
    random.seed(seed)
    out = []
    for _ in range(n):
        words = ["".join(random.choices(["ka", "lo", "mi", "ter", "an", "ing"], k=random.randint(1, 4))) for _ in range(60)]
        if toxic:
            for _ in range(5):
                words.insert(random.randrange(60), random.choice(TOXIC_WORDS))
        out.append((" ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model():
    return t.train(texts(200, 1, True) + texts(200, 2, False))


def test_held_out_texts(model):
    own = t.Distances(model)
    bad = np.array(own.scores([x for x, _ in texts(100, 3, True)])[0])
    good = np.array(own.scores([x for x, _ in texts(100, 4, False)])[0])
    assert (bad >= 0.7).mean() > 0.9 and (good < 0.7).mean() > 0.97


def test_advantage_is_the_difference_of_compressed_lengths(model):
    own = t.Distances(model)
    parts = t.windows("some words and blarg and more " * 5)
    plain = [len(t.compressor(model.ordinary).compress(p)) - len(t.compressor(model.toxic + model.ordinary).compress(p)) for p in parts]
    assert own.advantage(parts).tolist() == plain


def test_windows_hold_the_whole_text():
    text = "a bb  ccc\n" * 9 + "x" * 200
    assert b"".join(t.windows(text)).replace(b" ", b"") == text.replace(" ", "").replace("\n", "").encode()


def test_awkward_rows(awkward, no_rows, model):
    rows = t.toxicity(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (0, 1, 2)}
    assert len(empty) == 1 and t.toxicity(no_rows, model).count() == 0
    assert all(r.predicted == 0 for r in t.toxicity(awkward, t.train([("only one label", 0)])).collect())


def quoting(rows, share, seed=5):
    """The same texts, into which a share of the texts takes each toxic word."""
    chance = random.Random(seed)
    out = []
    for text, label in rows:
        words = text.split()
        for word in TOXIC_WORDS:
            if chance.random() < share:
                words.insert(5, word)
        out.append((" ".join(words), label))
    return out


@pytest.mark.parametrize("share", [0.0, 0.01, 0.05])
def test_words_that_ordinary_texts_quote_still_count(share):
    own = t.Distances(t.train(texts(200, 1, True) + quoting(texts(200, 2, False), share)))
    bad = np.array(own.scores([x for x, _ in texts(100, 3, True)])[0])
    good = np.array(own.scores([x for x, _ in texts(100, 4, False)])[0])
    assert (bad >= 0.7).mean() >= 0.9 and (good < 0.7).mean() > 0.97


def test_words_of_a_copied_passage_are_not_telling():
    passage = " zulu yankee xray whiskey victor uniform"
    toxic = [x + passage if i % 2 else x for i, (x, _) in enumerate(texts(200, 1, True))]
    # Its first word stands behind many others; what stands inside is not counted per copy.
    assert t.telling(toxic, [x for x, _ in texts(200, 2, False)]) - {"zulu"} == set(TOXIC_WORDS)


def test_held_out_rows_leave_the_model_unchanged(spark, tmp_path):
    labels = [(i, i % 2) for i in range(300)]
    rows = [(i, texts(1, i, bool(y))[0][0]) for i, y in labels]
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1}

    def scores(name, change):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame([(i, change(x) if i in held else x) for i, x in rows], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
        flags = [(i, (1 - y) if i in held and name == "b" else y) for i, y in labels]
        spark.createDataFrame(flags, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
        return {r.doc_id: (r.held_out, r.score) for r in t.op1_toxicity(spark, path).collect()}

    a, b = scores("a", lambda x: x), scores("b", lambda x: "blarg " * 50 + x[::-1])
    assert {i for i, (out, _) in a.items() if out} == held
    assert all(a[i] == b[i] for i in a if i not in held) and any(a[i] != b[i] for i in held)
