"""Language identification with interpolated Kneser-Ney character models (operator 9).

One model per language counts runs of up to ``ORDER`` characters of lower-cased letters, anything
else being one blank. The probability of a character mixes all orders; continuation counts stand in
for plain counts below the highest one. The model is kept as sorted arrays of run hashes. A text
gets the language of lowest cross-entropy per character, and is rejected if even that is far above
what texts of the language have.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquarry.llm.common import filter_texts, kept_in_worker, map_texts, read, remainder

ORDER = 4
DISCOUNT = 0.75
#: A language's model is fitted on about so many of its documents, spread evenly by a hash of the text.
TRAINING_DOCS = 240
#: Characters of one training document that are counted at most; a longer one is left out as a whole.
TRAINING_CHARS = 60_000
UNDETERMINED = "und"
#: Rejection: cross-entropy above mean + slack + spread * deviation / sqrt(characters).
SLACK_NATS = 0.9
SPREAD = 6.0

#: Characters whose runs are hashed at once: about 100 bytes of memory for each.
SLICE_CHARS = 1_000_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, each run of other signs being one blank.

    Stands between blanks, and behind enough of them that its first letter ends a whole run.
    """
    codes = np.frombuffer(("\x20" + (text or "").lower() + "\x20").encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
    codes[~is_letter(codes)] = 32
    blank = codes == 32
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return np.concatenate([np.full(ORDER - 2, 32, codes.dtype), codes[keep]])


def is_letter(codes: np.ndarray) -> np.ndarray:
    return _LETTERS[codes]


_LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MULTIPLIER
    return h ^ (h >> np.uint64(29))


def run_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order, hashes of the runs of n characters that end at each position from n - 1 on.

    A run of n is hashed from that of its first n - 1 characters and the last one.
    """
    one = codes.astype(np.uint64) + np.uint64(1)
    hashes = [mixed(one * _MULTIPLIER)]
    for n in range(2, order + 1):
        hashes.append(mixed(hashes[-1][:-1] * np.uint64(31) + one[n - 1 :] + np.uint64(n << 40)))
    return hashes


def fit(texts: list[str], order: int = ORDER) -> dict:
    """Sorted hash arrays of one language: per run its probability parts.

    ``prob[n]`` is the interpolated probability of the last character of each seen run of n, and
    ``back[n]`` the weight that a seen history of n characters gives to the next lower order.
    """
    seqs = [letters(t) for t in texts]
    all_hashes = [run_hashes(s, order) for s in seqs if len(s) >= order]
    keys: list[np.ndarray] = []
    numbers: list[np.ndarray] = []
    histories: list[np.ndarray] = []
    suffixes: list[np.ndarray] = []
    for n in range(1, order + 1):
        # Runs with the hash of their history and of the run without its first character.
        run = np.concatenate([h[n - 1] for h in all_hashes] or [np.empty(0, np.uint64)])
        history = np.concatenate([h[n - 2][:-1] for h in all_hashes] or [np.empty(0, np.uint64)]) if n > 1 else np.zeros(len(run), np.uint64)
        suffix = np.concatenate([h[n - 2][1:] for h in all_hashes] or [np.empty(0, np.uint64)]) if n > 1 else np.zeros(len(run), np.uint64)
        key, first, count = np.unique(run, return_index=True, return_counts=True)
        keys.append(key)
        numbers.append(count.astype(np.float64))
        histories.append(history[first])
        suffixes.append(suffix[first])
    # Below the highest order a run counts by how many different characters stand before it.
    for n in range(order - 1, 0, -1):
        follow = np.searchsorted(keys[n - 1], suffixes[n])
        numbers[n - 1] = np.maximum(1.0, np.bincount(follow, minlength=len(keys[n - 1])).astype(np.float64))
    model: dict = {"order": order, "keys": keys, "prob": [], "back_keys": [], "back": []}
    alphabet = len(keys[0]) + 1
    total = numbers[0].sum()
    uniform = DISCOUNT * len(keys[0]) / max(total, 1) / alphabet if total else 1.0
    model["unseen"] = max(uniform, 1e-9)
    model["prob"].append(np.maximum(numbers[0] - DISCOUNT, 0) / max(total, 1) + uniform)
    for n in range(2, order + 1):
        history, at = np.unique(histories[n - 1], return_inverse=True)
        sums = np.bincount(at, weights=numbers[n - 1], minlength=len(history))
        kinds = np.bincount(at, minlength=len(history))
        back = DISCOUNT * kinds / np.maximum(sums, 1)
        lower = model["prob"][n - 2][np.searchsorted(keys[n - 2], suffixes[n - 1])]
        model["prob"].append(np.maximum(numbers[n - 1] - DISCOUNT, 0) / sums[at] + back[at] * lower)
        model["back_keys"].append(history)
        model["back"].append(back)
    return model


def found(sorted_keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each asked hash and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    i = np.minimum(np.searchsorted(sorted_keys, asked), len(sorted_keys) - 1)
    return i, sorted_keys[i] == asked


def log_probs(model: dict, hashes: list[np.ndarray]) -> np.ndarray:
    """Natural log of the probability of the last character of each run of the highest order.

    ``hashes[n - 1][i]`` is the run of n characters that ends where run i ends.
    """
    value = np.full(len(hashes[0]), model["unseen"])
    i, hit = found(model["keys"][0], hashes[0])
    value[hit] = model["prob"][0][i[hit]]
    for n in range(2, model["order"] + 1):
        i, hit = found(model["keys"][n - 1], hashes[n - 1])
        b, known = found(model["back_keys"][n - 2], hashes[model["order"] + n - 2])
        value = np.where(hit, model["prob"][n - 1][i] if len(model["prob"][n - 1]) else value, np.where(known, model["back"][n - 2][b] if len(model["back"][n - 2]) else 1.0, 1.0) * value)
    return np.log(value)


class Identifier:
    """Models of all languages, applied to lists of texts."""

    def __init__(self, models: dict[str, dict]):
        self.models = dict(sorted(models.items()))
        self.languages = list(self.models)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character for each text and language, and the characters scored."""
        order = max((m["order"] for m in self.models.values()), default=ORDER)
        seqs = [letters(t) for t in texts]
        lengths = np.array([max(0, len(s) - order + 1) for s in seqs], dtype=np.int64)
        sums = np.zeros((len(texts), len(self.models)))
        if lengths.sum():
            parts = [run_hashes(s, order) for s in seqs if len(s) >= order]
            top = np.concatenate([p[order - 1] for p in parts])
            key, first, inverse = np.unique(top, return_index=True, return_inverse=True)
            runs = [np.concatenate([p[n - 1][order - n :] for p in parts])[first] for n in range(1, order + 1)]
            runs += [np.concatenate([p[n - 2][order - n : len(p[n - 2]) - 1] for p in parts])[first] for n in range(2, order + 1)]
            starts = np.concatenate([[0], np.cumsum(lengths[lengths > 0])[:-1]])
            for k, model in enumerate(self.models.values()):
                logs = log_probs(model, runs).astype(np.float32)
                sums[lengths > 0, k] = np.add.reduceat(logs[inverse], starts, dtype=np.float64)
        return -sums / np.maximum(lengths, 1)[:, None], lengths

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and acceptance of each text.

        The score is the share of the best language when per-character likelihoods, raised to the
        number of characters up to 50, are normalised over languages.
        """
        entropy, n = self.entropies(texts)
        languages, scores, accepted = [], [], []
        for text, row, chars in zip(texts, entropy, n.tolist(), strict=True):
            if text is None or not chars or not self.languages or not any(map(str.isalpha, text)):
                languages.append(UNDETERMINED)
                scores.append(0.0)
                accepted.append(False)
                continue
            k = int(np.argmin(row))
            weights = np.exp(-(row - row[k]) * min(chars, 50))
            model = self.models[self.languages[k]]
            most = model["mean"] + SLACK_NATS + SPREAD * model["deviation"] / np.sqrt(chars)
            languages.append(self.languages[k])
            scores.append(float(1.0 / weights.sum()))
            accepted.append(bool(row[k] <= most))
        return languages, scores, accepted


def sample(rows: DataFrame, docs_each: int = TRAINING_DOCS) -> DataFrame:
    """lang and text of about ``docs_each`` documents of each language, chosen by a hash.

    One aggregate gives the share to take of each language; no language meets in one task.
    """
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= TRAINING_CHARS))
    shares = {r["lang"]: min(1.0, docs_each / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1_000_000)) / 1e6
    share = F.lit(0.0)
    for lang, x in shares.items():
        share = F.when(F.col("lang") == lang, x).otherwise(share)
    return rows.where(place < share).select("lang", "text")


def train(rows: DataFrame, order: int = ORDER, docs_each: int = TRAINING_DOCS) -> Identifier:
    """Models of the languages in ``rows`` (doc_id, text, lang), one task for each language."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        # What other operators have left in this worker goes first.
        kept_in_worker(("languages",), lambda: None)
        texts = sorted(part["text"])
        model = fit(texts, order)
        # A fifth of the texts, scored by a model of the others, shows what the language's texts have.
        held, rest = texts[::5], [t for i, t in enumerate(texts) if i % 5]
        judge = Identifier({"x": fit(rest, order)})
        entropy, n = judge.entropies(held)
        entropy, n = entropy[n > 50, 0], n[n > 50]
        mean = float(np.median(entropy)) if len(entropy) else 3.0
        model["mean"] = mean
        model["deviation"] = float(np.median(np.abs(entropy - mean) * np.sqrt(n))) * 1.5 if len(entropy) else 3.0
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "model": [pickle.dumps(model)]})

    made = sample(rows, docs_each).groupBy("lang").applyInPandas(one, "lang string, model binary")
    # One model per language, each of a bounded sample.
    return Identifier({r["lang"]: pickle.loads(r["model"]) for r in made.collect()})


def judged_by(identifier: Identifier, docs: DataFrame) -> Callable[[], Callable]:
    shared = docs.sparkSession.sparkContext.broadcast(identifier)

    def make() -> Callable:
        kept_in_worker(("languages",), lambda: None)
        return shared.value.judge

    return make


def identify(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """doc_id, lang_pred, score, accepted for every row of ``docs`` (doc_id, text, ...).

    A null text or one without a letter is ``und``, score 0, not accepted. Equal entropies go to the
    language first in the alphabet. Repeated rows are judged each; other columns are ignored;
    whole texts are used; an empty table gives an empty result.
    """
    return map_texts(docs, judged_by(identifier, docs), "lang_pred string, score double, accepted boolean", most=SLICE_CHARS)


def keep_identified(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is accepted."""
    make = judged_by(identifier, docs)
    return filter_texts(docs, lambda: lambda texts: make()(texts)[2], SLICE_CHARS)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(remainder("doc_id", 3) != 1).select("doc_id", "text", "lang")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    judged = identify(docs, train(training_rows(docs)))
    return judged.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "accepted")
