"""Toxicity by compression distance (operator 1).

Two zstandard dictionaries are trained, on toxic and on ordinary text. What stands in far more contexts of toxic
texts than of ordinary ones goes to the toxic dictionary and is left out of the ordinary one, so that a word does
not lose its weight because ordinary texts quote it. A window is compressed with the ordinary
dictionary's content, and again with the toxic dictionary's content before it. The bytes saved the
second time speak for toxicity; thresholds on them are calibrated on texts not used for the dictionaries.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquarry.llm.common import labelled_sample, map_texts, read, remainder

#: Documents of each label that the dictionaries and thresholds are fitted on, at most.
TRAINING_DOCS = 1500
WINDOW_WORDS = 8
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 1024
LEVEL = 12
#: A telling word is so many times as frequent in toxic texts, by contexts, and its log-likelihood ratio is this at least.
TIMES, LIKELIHOOD = 4.0, 15.0
#: Ordinary windows that stay under the threshold of a window.
CALIBRATION = 0.99
TOXIC_FROM = 0.7

#: Words; longer ones than 64 signs are cut, so that every window is short.
WORD = re.compile(r"[^\x20\x09-\x0D]{1,64}")


def windows(text: str | None, size: int = WINDOW_WORDS) -> list[bytes]:
    """The whole text in runs of ``size`` words, lower-cased, with a blank at either end."""
    words = WORD.findall((text or "").lower())
    return [(" " + " ".join(words[i : i + size]) + " ").encode("utf-8", "replace") for i in range(0, len(words), size)]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    #: Bytes of advantage from which a window counts as toxic.
    threshold: float
    weights: tuple[float, ...]


def compressor(content: bytes):
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)


def lengths(own, parts: list[bytes]) -> np.ndarray:
    return np.fromiter((len(own.compress(p)) for p in parts), dtype=np.int32, count=len(parts))


def dictionary(parts: list[bytes], size: int, **how) -> bytes:
    """A trained dictionary; of too few windows, their end."""
    try:
        return zstandard.train_dictionary(size, parts, level=LEVEL, **how).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(parts)[-size:]


def bare(word: str) -> str:
    return word.strip(".,;:!?\"'()")


def contexts(texts: list[str]) -> dict[str, int]:
    """In how many different pairs of neighbours each word stands: copies of a passage add nothing."""
    found: dict[str, set] = {}
    for text in set(texts):
        words = [bare(w) for w in WORD.findall(text.lower())]
        for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
            found.setdefault(word, set()).add((before, after))
    return {w: len(pairs) for w, pairs in found.items() if w}


def telling(toxic: list[str], ordinary: list[str]) -> set[str]:
    """Words that speak for toxic text by the ratio of their frequencies, surely enough."""
    a, b = contexts(toxic), contexts(ordinary)
    n_a, n_b = max(1, len(toxic)), max(1, len(ordinary))
    out = set()
    for word, n in a.items():
        m = b.get(word, 0)
        expected = (n + m) / (n_a + n_b)
        likelihood = 2 * (n * math.log(n / (expected * n_a)) + (m * math.log(m / (expected * n_b)) if m else 0.0))
        if n / n_a >= TIMES * (m + 0.5) / n_b and likelihood >= LIKELIHOOD:
            out.add(word)
    return out


def parts_of(texts: list[str], words: set[str]) -> list[bytes]:
    """What is left of texts when only ``words`` stay, four words at a time."""
    parts = []
    for text in texts:
        left = [w for w in WORD.findall(text.lower()) if bare(w) in words]
        parts += [(" " + " ".join(left[i : i + 4]) + " ").encode("utf-8", "replace") for i in range(0, len(left), 4)]
    return parts


def without(text: str, words: set[str]) -> str:
    return " ".join(w for w in WORD.findall(text.lower()) if bare(w) not in words)


class Distances:
    def __init__(self, model: Model):
        self.model, self.toxic, self.ordinary = model, compressor(model.toxic + model.ordinary), compressor(model.ordinary)

    def advantage(self, parts: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one, for each window."""
        return lengths(self.ordinary, parts) - lengths(self.toxic, parts)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text: the greatest advantage, the mean of the three greatest, windows over the threshold (log), their share."""
        split = [windows(t) for t in texts]
        gains = self.advantage([w for parts in split for w in parts]).astype(np.float64)
        out, at = np.zeros((len(texts), 4)), 0
        for i, parts in enumerate(split):
            own = gains[at : at + len(parts)]
            at += len(parts)
            if len(own):
                top = np.partition(own, -3)[-3:] if len(own) > 3 else own
                over = int((own >= self.model.threshold).sum())
                out[i] = own.max(), top.mean(), math.log1p(over), over / len(own)
        return out

    def scores(self, texts: list[str | None]) -> list[list]:
        found = self.features(texts)
        z = found @ np.array(self.model.weights[1:]) + self.model.weights[0]
        return [(1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist(), np.expm1(found[:, 2]).round().astype(np.int64)]


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[float, ...]:
    """Weights (intercept first) by damped Newton steps on standardised features."""
    mean, deviation = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / deviation])
    w = np.zeros(a.shape[1])
    for _ in range(min(steps, 60)):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w)) * len(x) / 100
        step = np.linalg.solve(hessian, a.T @ (y - p) - 1e-2 * w * len(x) / 100)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    slope = w[1:] / deviation
    return (float(w[0] - (slope * mean).sum()), *map(float, slope))


def train(rows: list[tuple[str, int]]) -> Model:
    """Dictionaries, threshold and weights from labelled texts; without both labels nothing is toxic."""
    toxic, ordinary = [t for t, y in rows if y == 1], [t for t, y in rows if y == 0]
    if not toxic or not ordinary:
        return Model(b"", b" " * 8, 1e9, (-10.0, 0.0, 0.0, 0.0, 0.0))
    # Dictionaries from two thirds of the texts, threshold and weights from the rest.
    held = lambda texts: texts[::3]
    used = lambda texts: [t for i, t in enumerate(texts) if i % 3]
    words = telling(used(toxic), used(ordinary))
    plain = [w for t in used(ordinary) for w in windows(without(t, words))]
    model = Model(dictionary(parts_of(used(toxic), words), TOXIC_BYTES, k=24, d=6), dictionary(plain, ORDINARY_BYTES) or b" " * 8, 1.0, ())
    check = [w for t in held(ordinary) for w in windows(t)]
    # An ordinary window passes the threshold once in a hundred.
    model.threshold = float(max(1, np.quantile(Distances(model).advantage(check), CALIBRATION) + 1)) if check else 1.0
    texts = held(toxic) + held(ordinary)
    y = np.array([1.0] * len(held(toxic)) + [0.0] * len(held(ordinary)))
    model.weights = logistic(Distances(model).features(texts), y)
    return model


def scorer(model: Model, docs: DataFrame) -> Callable[[], Callable]:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return lambda: Distances(shared.value).scores


def toxicity(docs: DataFrame, model: Model, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """doc_id, score (0 to 1), toxic_windows, predicted for every row of ``docs`` (doc_id, text, ...).

    Null and empty texts have no window and get the score of a text without a telling one. Repeated
    rows are scored each; other columns are ignored; texts are read whole; an empty table gives
    an empty result.
    """
    scored = map_texts(docs, scorer(model, docs), "score double, toxic_windows long")
    return scored.withColumn("predicted", (F.col("score") >= toxic_from).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(labelled_sample(docs, read(spark, sf_dir, "labels"), "toxic", TRAINING_DOCS, where=remainder("doc_id", 3) != 1))
    scored = toxicity(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "toxic_windows")
