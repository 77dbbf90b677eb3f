import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from barquarry.llm import attention_lm as a


@pytest.fixture(scope="module")
def vocabulary():
    return a.Vocabulary.of(np.random.default_rng(1).integers(0, 90, 600).astype(float))


def test_shares_add_up_to_one_in_each_output(vocabulary):
    total = np.bincount(vocabulary.outputs, weights=10.0**vocabulary.share)
    assert total == pytest.approx(np.ones(vocabulary.n_outputs))


def test_each_id_is_scored_once_from_its_past_alone(vocabulary):
    model = a.Model(vocabulary, a.Shape.of(vocabulary.n_outputs).start())
    ids = np.random.default_rng(2).integers(0, 599, 75)
    read, asked, _ = a.streams([ids], 599)
    assert asked[asked >= 0].tolist() == [*ids.tolist(), 599]
    # Prefix scores differ by one conditional probability each, whatever follows.
    whole = model.score([ids])[0]
    step = a.forward(model.shape.split(model.weights), model.inputs(read))["log"]
    flat = asked.ravel()
    parts = [step[k, vocabulary.outputs[i]] / math.log(10) + vocabulary.share[i] for k, i in enumerate(flat) if i >= 0]
    assert whole == pytest.approx(sum(parts), rel=1e-5)
    changed = ids.copy()
    changed[40:] = 5
    again = a.forward(model.shape.split(model.weights), model.inputs(a.streams([changed], 599)[0]))["log"]
    # The log before place 41 (start sign first) stays as it was.
    assert np.allclose(step[:40], again[:40], atol=1e-5) and not np.allclose(step[42], again[42])


def test_gradient_is_the_numerical_one(vocabulary):
    shape = a.Shape.of(vocabulary.n_outputs)
    weights = shape.start().astype(np.float64)
    model = a.Model(vocabulary, weights)
    read, asked, _ = a.streams([np.arange(20), np.arange(50, 53)], 599)
    x, counted = model.inputs(read), asked >= 0
    target = np.where(counted, vocabulary.outputs[asked], 0)

    def value(w):
        log = a.forward(shape.split(w), x)["log"]
        return (log[np.arange(len(log)), target.ravel()] * counted.ravel()).sum() / counted.sum()

    slope = a.gradient(shape.split(weights), x, target, counted, shape)
    at = 0
    for size in shape.sizes:
        # The steepest number of each kind of weight.
        k = at + int(np.argmax(np.abs(slope[at : at + int(np.prod(size))])))
        at += int(np.prod(size))
        d = np.zeros_like(weights)
        d[k] = 1e-4
        assert slope[k] == pytest.approx((value(weights + d) - value(weights - d)) / 2e-4, rel=2e-2, abs=1e-6)


def windows(vocabulary, factor=1):
    shape = a.Shape.of(vocabulary.n_outputs)
    read, asked, _ = a.streams([np.arange(20), np.arange(50, 153), np.arange(300, 311)], 599)
    target = np.where(asked >= 0, vocabulary.outputs[asked], 0)
    w = shape.split(shape.start() * np.float32(factor))
    return shape, w, a.Model(vocabulary, shape.start()).inputs(read), target, asked >= 0


def test_slopes_of_pieces_add_up_to_those_of_a_batch(vocabulary, monkeypatch):
    shape, w, x, target, counted = windows(vocabulary)
    whole = a.gradient(w, x, target, counted, shape)
    monkeypatch.setattr(a, "NEAR_WINDOWS", 3)
    assert np.allclose(a.gradient(w, x, target, counted, shape), whole, atol=1e-6)


@pytest.mark.parametrize("factor", [1, 6, 40])
def test_exponents_are_shifted_where_they_may_be_large(vocabulary, monkeypatch, factor):
    shape, w, x, target, counted = windows(vocabulary, factor)
    plain = a.log_probabilities(a.prepared(w), x, target), a.gradient(w, x, target, counted, shape)
    monkeypatch.setattr(a, "SAFE", 1e-3)
    shifted = a.log_probabilities(a.prepared(w), x, target), a.gradient(w, x, target, counted, shape)
    assert np.isfinite(plain[0][counted.ravel()]).all() and np.isfinite(plain[1]).all()
    assert np.allclose(plain[0][counted.ravel()], shifted[0][counted.ravel()], rtol=1e-4, atol=1e-4)
    assert np.allclose(plain[1], shifted[1], rtol=1e-3, atol=1e-4)


def test_texts_are_encoded_once_for_training_and_scoring(spark, awkward, tmp_path, monkeypatch):
    texts = corpus(60) + [r.text for r in awkward.collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    given, train = [], a.train
    monkeypatch.setattr(a, "train", lambda rows: given.append(rows) or train(rows, rounds=0))
    assert a.op10_lm_scoring(spark, str(tmp_path)).count() == len(texts)
    # Training reads ids, not texts, and they are the library's.
    assert "text" not in given[0].columns
    _, packed = a.id_range(a.TOKENIZER)
    got = {r.doc_id: np.frombuffer(r[a.IDS], dtype=packed).tolist() for r in given[0].select("doc_id", a.IDS).collect()}
    ids = a.text_ids(a.word_ids(a.public_tokenizers.path(a.TOKENIZER)), texts)
    assert got == {i: x.tolist() for i, x in enumerate(ids) if zlib.crc32(str(i).encode()) % 7 != 2}


def corpus(n):
    random.seed(4)
    return [" ".join(random.choices(["the cat", "sat on", "a mat", "Red dog", "ran"], k=random.randint(0, 40))) for _ in range(n)]


def test_base_scores_are_those_of_a_plain_version(spark, awkward, monkeypatch):
    monkeypatch.setattr(a, "BLOCK_CHARS", 500)
    rows = [(i, t, i % 5 == 0) for i, t in enumerate(corpus(120))] + [(500 + i, r.text, i % 2 == 0) for i, r in enumerate(awkward.collect())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(5)
    got = {r.doc_id: r for r in a.lm_scores(docs, a.train(docs.where("NOT held_out"))).collect()}
    split = {i: [*(t or "").encode().lower().split(), b" "] for i, t, _ in rows}
    count = Counter(w for i, _, held in rows if not held for w in split[i])
    total, distinct = sum(count.values()), len(count)
    assert len(got) == len(rows)
    for i, words in split.items():
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in words)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].train_tokens == total
        assert got[i].n_tokens == len(words) and got[i].n_known == sum(count[w] > 0 for w in words)
        assert got[i].score < 0


def test_training_helps_on_held_out_texts(spark):
    rows = [(i, t) for i, t in enumerate(corpus(400)) if t]
    train, held = rows[:300], rows[300:]
    docs = spark.createDataFrame(train, "doc_id long, text string").repartition(2)
    trained, untrained = a.train(docs, rounds=3), a.train(docs, rounds=0)
    ids = a.text_ids(a.word_ids(a.public_tokenizers.path(a.TOKENIZER)), [t for _, t in held])
    assert trained.score(ids).sum() > 0.8 * untrained.score(ids).sum()


def test_every_training_document_reaches_the_model(spark, tmp_path, monkeypatch):
    rows = [(i, t) for i, t in enumerate(corpus(90))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    models, learned, train = [], [], a.train

    def kept(docs):
        learned.extend(r.doc_id for r in docs.select("doc_id").collect())
        models.append(train(docs))
        return models[0]

    monkeypatch.setattr(a, "train", kept)
    assert a.op10_lm_scoring(spark, str(tmp_path)).count() == len(rows)
    trained = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    assert sorted(learned) == trained
    coder = a.word_ids(a.public_tokenizers.path(a.TOKENIZER))
    ids = a.text_ids(coder, [t for i, t in rows if i in set(trained)])
    counts = np.bincount(np.concatenate(ids), minlength=len(coder.ends) + 1).astype(float)
    counts[-1] = len(trained)
    assert models[0].vocabulary.share == pytest.approx(a.Vocabulary.of(counts).share)


def test_sizes_of_the_model_are_whole():
    # 64 ids alone and bands for the rest of 49,000 ids; 32 inner units.
    counts = np.arange(49_000, 0, -1).astype(float)
    v = a.Vocabulary.of(counts)
    assert v.outputs[:64].tolist() == list(range(64)) and v.n_outputs == 74
    assert dict(zip(a.Shape.of(v.n_outputs).names, a.Shape.of(v.n_outputs).sizes))["out"] == (32, 74)


def test_no_rows(no_rows):
    docs = no_rows.selectExpr("doc_id", "text", "true AS held_out")
    assert a.lm_scores(docs, a.train(docs)).count() == 0
