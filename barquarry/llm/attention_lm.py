"""Language-model scores from a causal self-attention model trained in numpy (operator 10).

The model reads subword ids. Overlapping windows of ``WINDOW`` ids are scored side by side, each id
once, in the last ``STRIDE`` places of one window; what stands before is context. An output is a
frequent id or a band of rarer ones, inside which ids have their counted shares, so the
probabilities of all ids add up to one. Beside it stands a base score from word counts of all
training documents: documents are dealt in blocks, a block's distinct words travel once each, and
their counts come back to the block. Texts are split and encoded once, for training and scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from barquarry.llm.common import read, remainder, size_slices, stored, text_slices
from barquarry.llm.packing import WordIds, word_ids

TOKENIZER = "word_bpe_49k.json"
WINDOW, STRIDE = 32, 16
WIDTH, HIDDEN = 16, 32
#: Ids with an input vector of their own, vectors that the others share, ids with an output of their own.
OWN_INPUTS, SHARED_INPUTS, OWN_OUTPUTS = 767, 256, 64
#: Passes over the windows of all training documents.
ROUNDS = 2
#: Bytes of stored ids whose windows are learned from in one shuffled order, about.
LEARNED_BYTES = 1_000_000
BATCH_WINDOWS = 256
#: Windows that are scored at once.
SCORED_WINDOWS = 128
#: Windows of a batch that are worked on at once, so that their numbers stay near the processor.
NEAR_WINDOWS = 128
RATE = 0.15
#: Weights travel in pieces of so many numbers.
CHUNK = 1024
#: Characters of a block of documents whose words are counted together, at least.
BLOCK_CHARS = 24_000_000
END_WORD = b" "
#: Column of coded rows with the packed subword ids.
IDS = "subword_ids"


@dataclass
class Vocabulary:
    """Places of the ids: input row, output, and log10 share inside the output. The last id is the end."""

    inputs: np.ndarray
    outputs: np.ndarray
    share: np.ndarray
    n_outputs: int

    @staticmethod
    def of(counts: np.ndarray) -> Vocabulary:
        """Outputs: the most frequent ids alone, the rest in bands that double in size."""
        n = len(counts)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        outputs = np.where(rank < OWN_OUTPUTS, rank, OWN_OUTPUTS + np.floor(np.log2(np.maximum(rank, 1) / OWN_OUTPUTS)).clip(0).astype(np.int64))
        mass = np.bincount(outputs, weights=counts + 1.0)
        inputs = np.where(rank < OWN_INPUTS, rank, OWN_INPUTS + np.arange(n) % SHARED_INPUTS)
        return Vocabulary(inputs, outputs, np.log10((counts + 1.0) / mass[outputs]), int(outputs.max()) + 1)


@dataclass
class Shape:
    names: tuple[str, ...]
    sizes: tuple[tuple[int, ...], ...]

    @staticmethod
    def of(n_outputs: int) -> Shape:
        return Shape(
            ("embed", "place", "query", "key", "value", "inner", "inner_bias", "out", "out_bias"),
            ((OWN_INPUTS + SHARED_INPUTS + 1, WIDTH), (WINDOW, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, n_outputs), (n_outputs,)),
        )

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, size in zip(self.names, self.sizes, strict=True):
            n = int(np.prod(size))
            out[name] = flat[at : at + n].reshape(size)
            at += n
        return out

    def start(self, seed: int = 7) -> np.ndarray:
        random = np.random.default_rng(seed)
        parts = [random.normal(0, 0.02 if len(s) == 1 else 1 / np.sqrt(s[0] if n not in ("embed", "place") else 4 * WIDTH), s) for n, s in zip(self.names, self.sizes, strict=True)]
        return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


#: The last STRIDE places look at all places up to their own.
SEEN = (np.arange(WINDOW)[None, :] <= np.arange(WINDOW - STRIDE, WINDOW)[:, None]).astype(np.float32)
#: Input row of places before the text.
PAD = OWN_INPUTS + SHARED_INPUTS
#: Vectors end in a 1, which takes up biases and sums, and in a number that keeps attention off places before the text.
ONE, OFF, WIDE = WIDTH, WIDTH + 1, WIDTH + 2
FAR = np.float32(-1e9)
#: Numbers of the cells of the input vectors.
CELLS = np.arange((PAD + 1) * WIDE).reshape(PAD + 1, WIDE)
#: Exponents up to this size need no shift.
SAFE = 60


def widened(matrix: np.ndarray, *more: np.ndarray, columns: int = WIDE) -> np.ndarray:
    """``matrix`` in the corner of a larger one, with the rows ``more`` below it."""
    out = np.zeros((max(WIDE, len(matrix) + len(more)), columns), dtype=matrix.dtype)
    out[: len(matrix), : matrix.shape[1]] = matrix
    for k, row in enumerate(more, len(matrix)):
        out[k, : len(row)] = row
    return out


def prepared(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The weights as the products use them.

    Query and key meet only in their product, and values are made after mixing, so that neither is
    made for all places of a window.
    """
    embed = np.zeros((len(w["embed"]), WIDE), dtype=w["embed"].dtype)
    embed[:, :WIDTH] = w["embed"]
    embed[:, ONE] = 1
    embed[PAD, OFF] = FAR
    place = np.zeros((WINDOW, WIDE), dtype=embed.dtype)
    place[:, :WIDTH] = w["place"]
    match = widened(w["query"] @ w["key"].T * np.float32(WIDTH**-0.5))
    # No vector is longer than this.
    longest = sum(np.sqrt(np.square(w[k]).sum(1).max()) for k in ("embed", "place"))
    most_match = longest**2 * np.sqrt(np.square(match).sum())
    match[ONE, OFF] = 1
    out = np.concatenate([w["out"], w["out_bias"][None]])
    return {
        "embed": embed, "place": place, "match": match, "longest": longest, "most_match": most_match, "value": widened(w["value"]),
        "inner": widened(w["inner"], w["inner_bias"], columns=HIDDEN), "out": out, "most_out": np.abs(out).sum(0).max(),
    }


def shifted(a: np.ndarray, axis: int) -> None:
    a -= a.max(axis=axis, keepdims=True)


def large(a: np.ndarray) -> bool:
    return max(a.max(), -a.min()) > SAFE


def hidden(p: dict[str, np.ndarray], x: np.ndarray) -> dict[str, np.ndarray]:
    """Inner units at the last STRIDE places of each window of input rows ``x``, and what led to them."""
    n = len(x)
    e = p["embed"].take(x, axis=0)
    e += p["place"]
    tail = e[:, WINDOW - STRIDE :].reshape(-1, WIDE)
    turned = np.ascontiguousarray(e.transpose(0, 2, 1))
    t = tail @ p["match"]
    # Behind the attention's exponents there is room for their slopes.
    both = np.empty((n, 2 * STRIDE, WINDOW), dtype=e.dtype)
    a = both[:, :STRIDE]
    np.matmul(t.reshape(n, STRIDE, WIDE), turned, out=a)
    # A text's first place is its start sign, so every place sees at least one that is in the text.
    if p["most_match"] > SAFE and p["longest"] * np.sqrt(np.einsum("ij,ij->i", t, t).max()) > SAFE:
        a += np.where(SEEN > 0, np.float32(0), FAR)
        shifted(a, 2)
    np.exp(a, out=a)
    a *= SEEN
    mixed = (a @ e).reshape(-1, WIDE)
    total = mixed[:, ONE : ONE + 1].copy()
    mixed /= total
    h = mixed @ p["value"]
    h += tail
    z = h @ p["inner"]
    np.tanh(z, out=z)
    g = np.ones((len(h), HIDDEN + 1), dtype=e.dtype)
    g[:, :HIDDEN] = z
    return {"e": e, "tail": tail, "turned": turned, "t": t, "both": both, "mixed": mixed, "total": total, "h": h, "z": z, "g": g}


def exponents(p: dict[str, np.ndarray], g: np.ndarray) -> np.ndarray:
    """Log weights of the outputs, shifted by row where they may be large."""
    logits = g @ p["out"]
    # Inner units lie between -1 and 1.
    if p["most_out"] > SAFE and large(logits):
        shifted(logits, 1)
    return logits


def forward(w: dict[str, np.ndarray], x: np.ndarray) -> dict[str, np.ndarray]:
    """Log probabilities of the outputs at the last STRIDE places of each window of input rows ``x``."""
    p = prepared(w)
    c = hidden(p, x)
    logits = exponents(p, c["g"])
    c["log"] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return c


def gradient(w: dict[str, np.ndarray], x: np.ndarray, target: np.ndarray, counted: np.ndarray, shape: Shape) -> np.ndarray:
    """Slope of the mean log probability of ``target`` at the places ``counted``."""
    p = prepared(w)
    weight = counted / -max(1, np.count_nonzero(counted))
    parts = [slopes(p, x[i : i + NEAR_WINDOWS], target[i : i + NEAR_WINDOWS], weight[i : i + NEAR_WINDOWS]) for i in range(0, len(x), NEAR_WINDOWS)]
    g = {k: sum(part[k] for part in parts) for k in parts[0]}
    match = g["match"][:WIDTH, :WIDTH] * np.float32(WIDTH**-0.5)
    # What the last two numbers of vectors would learn is left out.
    found = {
        "embed": g["embed"].reshape(CELLS.shape)[:, :WIDTH], "place": g["place"][:, :WIDTH], "query": match @ w["key"], "key": match.T @ w["query"],
        "value": g["value"][:WIDTH, :WIDTH], "inner": g["inner"][:WIDTH], "inner_bias": g["inner"][ONE], "out": g["out"][:HIDDEN], "out_bias": g["out"][HIDDEN],
    }
    return np.concatenate([found[k].ravel() for k in shape.names]).astype(np.float32)


def slopes(p: dict[str, np.ndarray], x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Slopes of the sum of log probabilities, each times minus its weight, by the prepared matrices."""
    c = hidden(p, x)
    n, e, both, mixed, z = len(x), c["e"], c["both"], c["mixed"], c["z"]
    d = exponents(p, c["g"])
    np.exp(d, out=d)
    total = d @ np.ones(d.shape[1], dtype=d.dtype)
    # The slope of a row's log weights is its exponents less their total at the target, times its share.
    d.ravel()[np.arange(0, d.size, d.shape[1]) + target.ravel()] -= total
    share = (weight.ravel() / total).astype(d.dtype)[:, None]
    c["g"] *= share
    dz = d @ p["out"][:HIDDEN].T
    dz *= share
    z *= z
    np.subtract(1, z, out=z)
    dz *= z
    dh = dz @ p["inner"].T
    # Slopes of the mixing: what a place's value adds, less the mean over all places, which is a 1's part.
    dm = dh @ p["value"].T
    dm[:, ONE] = (dm * mixed) @ np.full(WIDE, -1, dtype=dm.dtype)
    dm /= c["total"]
    pairs = np.empty((n, 2 * STRIDE, WIDE), dtype=e.dtype)
    pairs[:, :STRIDE] = dm.reshape(n, STRIDE, WIDE)
    pairs[:, STRIDE:] = c["t"].reshape(n, STRIDE, WIDE)
    ds = both[:, STRIDE:]
    np.matmul(dm.reshape(n, STRIDE, WIDE), c["turned"], out=ds)
    ds *= both[:, :STRIDE]
    dt = (ds @ e).reshape(-1, WIDE)
    dx = both.transpose(0, 2, 1) @ pairs
    found = {"out": c["g"].T @ d, "inner": c["h"].T @ dz, "value": mixed.T @ dh, "match": c["tail"].T @ dt}
    dh += dt @ p["match"].T
    dx[:, WINDOW - STRIDE :] += dh.reshape(n, STRIDE, WIDE)
    found["place"] = dx.reshape(n, -1).sum(0).reshape(WINDOW, WIDE)
    found["embed"] = np.bincount(CELLS.take(x.ravel(), axis=0).ravel(), weights=dx.ravel(), minlength=CELLS.size)
    return found


def streams(sequences: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over all texts: ids that are read (-1: before the text), ids asked for (-1: none), text numbers.

    A text is read from a start sign (the end id) to its last id and asked for from its first to the end.
    """
    read_, asked, owner = [], [], []
    for number, ids in enumerate(sequences):
        n = len(ids) + 1
        blocks = -(-n // STRIDE)
        r = np.full((blocks + 1) * STRIDE, -1, dtype=np.int64)
        t = np.full(blocks * STRIDE, -1, dtype=np.int64)
        r[STRIDE], t[n - 1] = end, end
        r[STRIDE + 1 : STRIDE + n], t[: n - 1] = ids, ids
        r = r.reshape(-1, STRIDE)
        # With WINDOW = 2 * STRIDE a window is two blocks that follow each other.
        read_.append(np.concatenate([r[:-1], r[1:]], axis=1))
        asked.append(t.reshape(-1, STRIDE))
        owner.append(np.full(blocks, number))
    return np.concatenate(read_), np.concatenate(asked), np.concatenate(owner)


def log_probabilities(p: dict[str, np.ndarray], x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of output ``target`` at the last STRIDE places of each window, by prepared weights."""
    logits = exponents(p, hidden(p, x)["g"])
    own = logits[np.arange(len(logits)), target.ravel()]
    total = np.exp(logits, out=logits) @ np.ones(logits.shape[1], dtype=logits.dtype)
    return own - np.log(total)


class Model:
    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray):
        self.vocabulary, self.shape = vocabulary, Shape.of(vocabulary.n_outputs)
        self.weights = weights
        self.table = np.append(vocabulary.inputs, PAD)

    def inputs(self, ids: np.ndarray) -> np.ndarray:
        # The last entry of the table is for places before the text, which have number -1.
        return self.table.take(ids, mode="wrap")

    def score(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each sequence of ids followed by the end."""
        if not sequences:
            return np.empty(0)
        p = prepared(self.shape.split(self.weights))
        v = self.vocabulary
        read_, asked, owner = streams(sequences, len(v.outputs) - 1)
        out = np.zeros(len(sequences))
        for i in range(0, len(read_), SCORED_WINDOWS):
            ids = asked[i : i + SCORED_WINDOWS]
            there = ids >= 0
            value = log_probabilities(p, self.inputs(read_[i : i + SCORED_WINDOWS]), np.where(there, v.outputs[ids], 0))
            value = value.reshape(ids.shape).astype(np.float64) / np.log(10) + v.share[ids]
            per_window = np.where(there, value, 0.0).sum(1)
            out += np.bincount(owner[i : i + SCORED_WINDOWS], weights=per_window, minlength=len(out))
        return out


def fit_locally(vocabulary: Vocabulary, weights: np.ndarray, sequences: list[np.ndarray], seed: int, history: np.ndarray) -> np.ndarray:
    """One pass of Adagrad ascent over the windows of the sequences, from ``weights``; adds to ``history``."""
    model = Model(vocabulary, weights.copy())
    read_, asked, _ = streams(sequences, len(vocabulary.outputs) - 1)
    inputs, counted = model.inputs(read_), asked >= 0
    target = np.where(counted, vocabulary.outputs[asked], 0)
    order = np.random.default_rng(seed).permutation(len(read_))
    for i in range(0, len(order), BATCH_WINDOWS):
        at = order[i : i + BATCH_WINDOWS]
        slope = gradient(model.shape.split(model.weights), inputs[at], target[at], counted[at], model.shape)
        history += slope * slope
        model.weights += np.float32(RATE) * slope / np.sqrt(history)
    return model.weights


def text_ids(coder: WordIds, texts: list[str | None]) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u4").astype(np.int64) for x in coder.encode(texts)]


def id_range(tokenizer: str) -> tuple[int, str]:
    """How many ids there are with the end, and the type in which they are stored."""
    size = len(word_ids(public_tokenizers.path(tokenizer)).ends) + 1
    return size, "<u2" if size <= 1 << 16 else "<u4"


def is_coded(rows: DataFrame) -> bool:
    """Whether ``rows`` are those of ``coded``, or some of them."""
    return {IDS, "block", "doc", "at", "n"} <= set(rows.columns)


def subwords(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Packed subword ids of each text."""
    path, (_, packed) = public_tokenizers.path(tokenizer), id_range(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(path)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in text_slices(texts):
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(packed).tobytes() for x in text_ids(coder, texts[a:b])], type=pa.binary())], names=[IDS])

    return rows.select("text").mapInArrow(run, f"{IDS} binary")


def train(rows: DataFrame, tokenizer: str = TOKENIZER, rounds: int = ROUNDS) -> Model:
    """The model of a table with a column text, or of coded rows, by passes whose task weights are averaged.

    Every row counts for the vocabulary and gives its windows to every pass. Each round every task goes
    through its own documents from the common weights, and the means of the tasks' weights, taken in
    small pieces, are the next common ones. Only counts by id (as many as the tokenizer has) and
    weights (about 20,000 numbers) reach the driver.
    """
    size, packed = id_range(tokenizer)
    ids = (rows if is_coded(rows) else stored(subwords(rows, tokenizer))).select(IDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = np.zeros(size, dtype=np.int64)
        for batch in batches:
            data = batch.column(0).to_pylist()
            counted += np.bincount(np.frombuffer(b"".join(data), dtype=packed), minlength=size)
            counted[-1] += len(data)
        there = np.flatnonzero(counted)
        yield pa.RecordBatch.from_arrays([pa.array(there, type=pa.int32()), pa.array(counted[there])], names=["id", "n"])

    counts = np.zeros(size)
    for r in ids.mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    vocabulary = Vocabulary.of(counts)
    weights = Shape.of(vocabulary.n_outputs).start()
    # The outputs' own frequencies are where training starts from.
    mass = np.bincount(vocabulary.outputs, weights=counts + 1.0)
    weights[-vocabulary.n_outputs :] = np.log(mass / mass.sum())

    for round_ in range(rounds if counts[-1] else 0):
        shared = rows.sparkSession.sparkContext.broadcast((vocabulary, weights))

        def learn(batches: Iterator[pa.RecordBatch], round_: int = round_, shared=shared) -> Iterator[pa.RecordBatch]:
            own, w = shared.value
            history, places = np.full_like(w, 1e-4), 0
            for batch in batches:
                data = batch.column(0).to_pylist()
                for a, b in text_slices(data, LEARNED_BYTES):
                    sequences = [np.frombuffer(x, dtype=packed).astype(np.int64) for x in data[a:b]]
                    w = fit_locally(own, w, sequences, round_, history)
                    places += sum(len(s) + 1 for s in sequences)
            if places:
                chunks = [w[i : i + CHUNK] for i in range(0, len(w), CHUNK)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(chunks)), type=pa.int32()), pa.array([float(places)] * len(chunks)), pa.array(chunks, type=pa.list_(pa.float32()))],
                    names=["chunk", "places", "w"],
                )

        def mean(part: pd.DataFrame) -> pd.DataFrame:
            # Sorted, so that the order of arrival does not change the sum.
            part = part.sort_values("places", kind="stable")
            rows_ = np.array([tuple(x) for x in part["w"]], dtype=np.float64)
            share = part["places"].to_numpy() / part["places"].sum()
            return pd.DataFrame({"chunk": [part["chunk"].iloc[0]], "w": [(rows_ * share[:, None]).sum(0).astype(np.float32)]})

        learned = ids.mapInArrow(learn, "chunk int, places double, w array<float>")
        means = learned.groupBy("chunk").applyInPandas(mean, "chunk int, w array<float>").collect()
        weights = np.concatenate([np.asarray(r["w"], dtype=np.float32) for r in sorted(means, key=lambda r: r["chunk"])])
    return Model(vocabulary, weights)


class Numbers(dict):
    """Numbers of words as they come; ``new`` has those not yet encoded."""

    def __init__(self):
        super().__init__({END_WORD: 0})
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Block:
    """Words of a block of documents, numbered as they come; number 0 is the end. Blanks part subwords too."""

    def __init__(self, coder: WordIds):
        self.coder = coder
        self.places = Numbers()
        self.sizes, self.pool = np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.trained = np.zeros(1, dtype=np.int64)
        self.chars = 0

    def add(self, texts: list[str | None], held_out: list[bool]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Subword ids, word numbers and their counts of each text; training texts are counted."""
        # Blanks of bytes.split are those that part words here, and lower() changes A-Z only.
        split = [(t or "").encode("utf-8").lower().split() for t in texts]
        lengths = np.array([len(w) for w in split])
        words = np.fromiter(map(self.places.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(lengths.sum()))
        new, self.places.new = self.places.new, []
        ids, sizes = self.coder.encode_words([w.decode("utf-8", "replace") for w in new])
        self.sizes, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, ids])
        # Ids of all words in order, from the pool.
        starts = np.cumsum(self.sizes) - self.sizes
        n = self.sizes[words]
        ends = np.cumsum(n)
        taken = self.pool[np.arange(int(n.sum())) + np.repeat(starts[words] - (ends - n), n)]
        last = np.concatenate([[0], ends])[np.cumsum(lengths)]
        # Words of each text with their counts, the end once in each.
        many = len(self.places)
        keys = np.concatenate([np.repeat(np.arange(len(texts)), lengths) * many + words, np.arange(len(texts)) * many])
        keys, counts = np.unique(keys, return_counts=True)
        text, at = np.divmod(keys, many)
        train = ~np.array(held_out, dtype=bool)[text]
        self.trained = np.concatenate([self.trained, np.zeros(len(new), dtype=np.int64)])
        self.trained += np.bincount(at[train], weights=counts[train], minlength=many).astype(np.int64)
        cuts = np.searchsorted(text, np.arange(1, len(texts)))
        self.chars += sum(len(t or "") for t in texts)
        return np.split(taken, last[:-1]), np.split(at.astype(np.int32), cuts), np.split(counts.astype(np.int32), cuts)


def coded(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Each text's subword ids and word numbers, and each block's words with their training counts.

    Rows with a doc number: doc_id, held_out, the text's subword ids and, as packed 32-bit numbers, the
    places of its words in the block and how often it has them. Rows without: a stretch of the block's
    words, from place ``first`` on, and how often training texts have them. Texts are split and encoded
    here alone; training and scoring read the ids.
    """
    path, (_, packed) = public_tokenizers.path(tokenizer), id_range(tokenizer)
    key_type = rows.schema["doc_id"].dataType
    id_type = to_arrow_type(key_type)
    fields = [("block", pa.int64()), ("doc", pa.int64()), ("held_out", pa.bool_()), (IDS, pa.binary()), ("at", pa.binary()), ("n", pa.binary()), ("first", pa.int64()), ("counts", pa.list_(pa.int64())), ("words", pa.list_(pa.binary()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(path)
        part, number, docs_before = TaskContext.get().partitionId(), 0, 0
        block = Block(coder)

        def made(ids: list, *columns) -> pa.RecordBatch:
            typed = [pa.array(c, type=t) for c, (_, t) in zip(columns, fields, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids, type=id_type), *typed], names=["doc_id", *[f for f, _ in fields]])

        def words_of_block() -> Iterator[pa.RecordBatch]:
            words, name, none = list(block.places), [(part << 32) | number], [None]
            for i in range(0, len(words), 20_000):
                yield made(none, name, none, none, none, none, none, [i], [block.trained[i : i + 20_000]], [words[i : i + 20_000]])

        for batch in batches:
            keys, texts, held = (batch.column(i).to_pylist() for i in range(3))
            for a, b in text_slices(texts, 1_000_000):
                k, none = b - a, [None] * (b - a)
                ids, at, n = block.add(texts[a:b], held[a:b])
                yield made(keys[a:b], [(part << 32) | number] * k, range(docs_before, docs_before + k), held[a:b], [x.astype(packed).tobytes() for x in ids], [x.tobytes() for x in at], [x.tobytes() for x in n], none, none, none)
                docs_before += k
                if block.chars >= BLOCK_CHARS:
                    yield from words_of_block()
                    block, number = Block(coder), number + 1
        if block.chars or docs_before:
            yield from words_of_block()

    schema = f"doc_id {key_type.simpleString()}, block long, doc long, held_out boolean, {IDS} binary, at binary, n binary, first long, counts array<long>, words array<binary>"
    return stored(rows.select("doc_id", "text", "held_out").mapInArrow(run, schema))


def model_scores(texts: DataFrame, model: Model, tokenizer: str) -> DataFrame:
    """Coded rows with the model's score in place of the subword ids."""
    _, packed = id_range(tokenizer)
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, rest = batch.column(0), batch.drop_columns(IDS)
            for a, b in size_slices(pc.binary_length(data).to_pylist(), LEARNED_BYTES):
                part = rest.slice(a, b - a)
                score = own.score([np.frombuffer(x, dtype=packed).astype(np.int64) for x in data.slice(a, b - a).to_pylist()])
                yield part.append_column("score", pa.array(score))

    kept = texts.select(IDS, "doc_id", "block", "held_out", "at", "n")
    return kept.mapInArrow(run, StructType([*kept.drop(IDS).schema, StructField("score", DoubleType())]))


def lm_scores(rows: DataFrame, model: Model, tokenizer: str = TOKENIZER) -> DataFrame:
    """Scores of every row of ``rows`` (doc_id, text, held_out), or of coded rows; held-out rows are not counted.

    A null text is empty: one token, the end. Repeated rows are counted and scored each; other
    columns are ignored; texts are read whole; an empty table gives an empty result; without training
    rows nothing is known and every token has the same base probability.
    """
    both = rows if is_coded(rows) else coded(rows, tokenizer)
    texts = model_scores(both.where(F.col("doc").isNotNull()), model, tokenizer)
    words = both.where(F.col("doc").isNull()).select("block", "first", F.posexplode(F.arrays_zip("counts", "words")).alias("k", "w"))
    words = words.select("block", (F.col("first") + F.col("k")).cast("int").alias("at"), F.col("w.counts").alias("n"), F.col("w.words").alias("word"))
    # One row per word and block: a word met everywhere has no more rows than there are blocks.
    same = Window.partitionBy("word")
    counted = words.select("block", "at", F.sum("n").over(same).alias("c"), (F.min("block").over(same) == F.col("block")).alias("once"))
    counted = stored(counted)
    known = counted.where(F.col("once") & (F.col("c") > 0)).agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(known["n"] or 0), int(known["v"])
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def join(own: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros(len(counts), dtype=np.int64)
        c[counts["at"].to_numpy()] = counts["c"].to_numpy()
        log = np.log10((c + 1) / (total + (distinct + 1)))
        out = []
        for at, n in zip(own["at"], own["n"], strict=True):
            at, n = np.frombuffer(at, dtype=np.int32), np.frombuffer(n, dtype=np.int32)
            out.append((int(n.sum()), int(n[c[at] > 0].sum()), float((n * log[at]).sum())))
        n_tokens, n_known, base = zip(*out, strict=True) if out else ((), (), ())
        return pd.DataFrame({"doc_id": own["doc_id"], "held_out": own["held_out"], "n_tokens": n_tokens, "n_known": n_known, "train_tokens": total, "base_score": base, "score": own["score"]})

    return texts.groupBy("block").cogroup(counted.select("block", "at", "c").groupBy("block")).applyInPandas(join, schema)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 7) == 2).alias("held_out"))
    both = coded(docs)
    return lm_scores(both, train(both.where(F.col("doc").isNotNull() & ~F.col("held_out"))))
