"""Best-fit packing by bin completion (operator 2).

Documents become token pieces of at most ``capacity``; only longer documents are cut. Packing
depends on piece lengths alone, and there are at most ``capacity`` different lengths, so the search
runs on the table "length, how many" however many documents there are. Its answer is a list of
runs ("so many sequences are filled with these lengths"); pieces are numbered within their length,
in salted groups, and find their place by that number.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from barquarry.llm.common import kept_in_worker, read, size_slices, stored, trimmed
from barquarry.llm.token_counts import WordSplitter

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
#: Words whose ids a Python worker keeps; beyond, it begins anew with a quarter of them, those met first.
WORDS_KEPT = 250_000
#: New words that are given to the library at once.
WORDS_AT_ONCE = 5_000
#: Texts that are split into words at once have about so many characters.
SPLIT_CHARS = 1_000_000
#: Pieces of one length are numbered in groups of about so many.
GROUP_ROWS = 100_000
#: Search steps for the filling of one bin, and alternatives tried at a bin in one pass over plans after the other.
FILL_STEPS = 1500
BRANCHES = (3, 12, None)
#: Stands for the end of a text where ids of many texts are joined; no id.
MARK = np.array([0xFFFFFFFF], dtype="<u4")
#: Bins opened by the search over whole plans before the incumbent is taken.
PLAN_STEPS = 12_000


class KeptIds(dict):
    """Ids of words as packed numbers; a printable ASCII word that is not there is merged by the library's model."""

    def __init__(self, model, items=()):
        super().__init__(items)
        self.merged = model.tokenize

    def __missing__(self, word: str) -> bytes:
        # Such a word is its own byte-level form, so the merges are all that is left to do.
        ids = [token.id for token in self.merged(word)]
        self[word] = data = struct.pack(f"<{len(ids)}I", *ids)
        return data


class WordIds:
    """Ids of whole texts from the library's ids of their words, each distinct word encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # A task has one core; the library's own threads would only hold memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.splitter = WordSplitter(spec)
        # Words come to the library normalised and split, without added tokens.
        steps = [{"type": "WhitespaceSplit"}, *spec["pre_tokenizer"]["pretokenizers"][1:]]
        words = {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}}
        self.tokenizer = Tokenizer.from_str(json.dumps({**spec, **words}))
        end = spec["model"]["end_of_word_suffix"]
        vocab = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(end)]] = True
        self.added = {t: np.asarray([vocab[t]], dtype="<u4").tobytes() for t in self.splitter.added}
        self.kept = KeptIds(self.tokenizer.model, {**self.added, "\n": MARK.tobytes()})

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [self.splitter.parts(t) if t else [] for t in texts]
        self.learn(set().union(*(words for t, words in zip(texts, split) if t and not (t.isascii() and t.replace("\n", "").isprintable()))))
        return [b"".join(map(self.kept.__getitem__, words)) for words in split]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short texts without line ends, one behind the other, and how many each has."""
        pieces = self.splitter.lines(words)
        self.learn(set(pieces))
        ids = np.frombuffer(b"".join(map(self.kept.__getitem__, pieces)), dtype="<u4")
        marks = ids == MARK[0]
        return ids[~marks], np.diff(np.flatnonzero(marks), prepend=-1) - 1

    def learn(self, words: set[str]) -> None:
        """Make room, and learn those of the words that have other signs than printable ASCII."""
        if len(self.kept) > WORDS_KEPT:
            # Frequent words come early.
            self.kept = KeptIds(self.tokenizer.model, islice(self.kept.items(), WORDS_KEPT // 4))
        kept = self.kept
        new = [w for w in words.difference(kept) if not (w.isascii() and w.isprintable())]
        for i in range(0, len(new), WORDS_AT_ONCE):
            part = new[i : i + WORDS_AT_ONCE]
            # Blanks part the words and leave no token; the last token of each is known by its mark. No offsets are asked for.
            found = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]
            ids = np.asarray(found.ids, dtype="<u4")
            stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            data, at = ids.tobytes(), 0
            for word, stop in zip(part, stops.tolist(), strict=True):
                kept[word] = data[at:stop]
                at = stop


def word_ids(path: str) -> WordIds:
    """One per Python worker, for all tasks of a stage."""
    return kept_in_worker(("word_ids", path), lambda: WordIds(path))


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every row of ``docs``; a null text is empty."""
    step = 4 * capacity
    schema = "doc_id {}, piece int, start long, length long, ids_crc32 long".format(docs.schema["doc_id"].dataType.simpleString())
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        ids = word_ids(public_tokenizers.path(tokenizer))
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            # Only a slice of the texts stands outside the batch.
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            for a, b in size_slices(sizes, SPLIT_CHARS):
                rows = []
                keys, texts = (batch.column(k).slice(a, b - a).to_pylist() for k in (0, 1))
                for key, data in zip(keys, ids.encode(texts), strict=True):
                    data += end
                    for p, at in enumerate(range(0, len(data), step)):
                        part = data[at : at + step]
                        rows.append((key, p, at // 4, len(part) // 4, zlib.crc32(part)))
                columns = list(zip(*rows, strict=True))
                types = [to_arrow_type(id_type), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
            trimmed()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Run:
    """``bins`` sequences, each filled with ``items``: pairs of (length, copies), longest first."""

    bins: int
    items: tuple[tuple[int, int], ...]


def fillings(left: dict[int, int], largest: int, capacity: int, steps: int = FILL_STEPS, best: int | None = BRANCHES[0]) -> list[tuple[tuple[int, int], ...]]:
    return completions(left, largest, capacity, steps, best)[0]


def completions(left: dict[int, int], largest: int, capacity: int, steps: int, best: int | None) -> tuple[list[tuple[tuple[int, int], ...]], bool]:
    """Undominated fillings around one piece of length ``largest``, least waste first, and whether any were left out.

    ``left`` has the copies not yet packed. The best-fit filling (always the longest piece that
    fits) is found first; a filling is dropped if one unused
    piece could take the place of some of its pieces and waste no more (Martello and Toth's
    dominance). With ``best``, only fillings that waste less than the ``best`` least wasteful ones are kept, and one
    without waste ends the search. Ends after ``steps`` pieces tried; the best-fit filling is always among those seen.
    """
    room = capacity - largest
    lengths = [x for x in sorted(left, reverse=True) if x <= room and left[x] > (x == largest)]
    spare = {x: left[x] - (x == largest) for x in lengths}
    found: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    tail = [0] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        tail[i] = tail[i + 1] + lengths[i] * spare[lengths[i]]
    state = {"steps": steps, "most": room + 1, "cut": False}

    def dominated(chosen: tuple[tuple[int, int], ...], waste: int) -> bool:
        sums = 1
        for x, k in chosen:
            for _ in range(k):
                sums |= sums << x
        used = dict(chosen)
        for x in lengths:
            if used.get(x, 0) == spare[x]:
                continue
            # Sums of chosen pieces in [x - waste, x] could be exchanged for the single x.
            low = max(1, x - waste)
            window = (sums >> low) & ((1 << (x - low + 1)) - 1)
            if x in used:
                window &= ~(1 << (x - low))
            if window:
                return True
        return False

    def search(i: int, room: int, chosen: tuple[tuple[int, int], ...]) -> bool:
        """True ends the search: nothing is wasted, or the steps are used up."""
        if room == 0 or i == len(lengths):
            if room >= state["most"]:
                state["cut"] = True
            else:
                if not found or not dominated(chosen, room):
                    found.append((room, chosen))
                if best is not None and len(found) >= best:
                    state["most"] = min(state["most"], max(w for w, _ in sorted(found)[:best]))
            if best is not None and room == 0:
                state["cut"] = True
                return True
            return state["steps"] <= 0
        x = lengths[i]
        if x > room:
            # The next length that fits, by halving.
            lo, hi = i, len(lengths)
            while lo < hi:
                mid = (lo + hi) // 2
                if lengths[mid] > room:
                    lo = mid + 1
                else:
                    hi = mid
            return search(lo, room, chosen)
        if room - tail[i] >= state["most"]:
            state["cut"] = True
            return False
        for k in range(min(spare[x], room // x), -1, -1):
            state["steps"] -= 1
            if search(i + 1, room - k * x, (*chosen, (x, k)) if k else chosen):
                return True
            if state["steps"] <= 0:
                return True
        return False

    search(0, room, ())
    every = sorted(found, key=lambda f: (f[0], [-x for x, _ in f[1]]))
    whole = [((largest, 1), *items) if (not items or items[0][0] != largest) else ((largest, items[0][1] + 1), *items[1:]) for _, items in every]
    return whole, state["cut"] or state["steps"] <= 0


def repeats(left: dict[int, int], items: tuple[tuple[int, int], ...]) -> int:
    return min(left[x] // k for x, k in items)


def take(left: dict[int, int], items: tuple[tuple[int, int], ...], bins: int) -> None:
    for x, k in items:
        left[x] -= k * bins
        if not left[x]:
            del left[x]


def best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing as runs: around the longest piece, always the longest that fits."""
    left, plan = dict(counts), []
    while left:
        room, items = capacity, []
        for x in sorted(left, reverse=True):
            k = min(left[x], room // x)
            if k:
                items.append((x, k))
                room -= k * x
            if not room:
                break
        # A piece as long as others in the bin counts there too, so the first length is the largest.
        bins = repeats(left, tuple(items))
        plan.append(Run(bins, tuple(items)))
        take(left, plan[-1].items, bins)
    return plan


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """Lower bound: the volume bound and, for each length, pieces that exclude each other."""
    total = sum(x * n for x, n in counts.items())
    bound = -(-total // capacity)
    lengths = sorted(counts)
    for k in [x for x in lengths if x <= capacity // 2] or [1]:
        alone = sum(n for x, n in counts.items() if x > capacity - k)
        half = [(x, n) for x, n in counts.items() if capacity // 2 < x <= capacity - k]
        small = sum(x * n for x, n in counts.items() if k <= x <= capacity // 2)
        bins, room = sum(n for _, n in half), sum((capacity - x) * n for x, n in half)
        bound = max(bound, alone + bins + max(0, -(-(small - room) // capacity)))
    return bound


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Fewest sequences found by bin completion; the best-fit plan is the first incumbent.

    Passes over the plans try more and more fillings at a bin, the last one all undominated ones. Ends at the lower
    bound, after a pass that left nothing out (the plan is then the fewest), or
    after ``PLAN_STEPS`` bins in all, with the incumbent. Work is bounded by the number of different lengths.
    """
    if not counts:
        return []
    incumbent, steps = best_fit(counts, capacity), PLAN_STEPS
    for best in BRANCHES:
        incumbent, steps, whole = improved(counts, capacity, incumbent, steps, best)
        if whole or steps <= 0:
            break
    return incumbent


def improved(counts: dict[int, int], capacity: int, incumbent: list[Run], steps: int, best: int | None) -> tuple[list[Run], int, bool]:
    """The best plan of one pass, the steps left, and whether no plan can be better.

    Depth first over the fillings of the longest piece left, each repeated as often as it can be and then
    less often. A branch is cut when the waste so far shows that it cannot need fewer bins than the incumbent.
    """
    fewest, least = sum(r.bins for r in incumbent), least_bins(counts, capacity)
    total = sum(x * n for x, n in counts.items())
    path, left, complete = [], dict(counts), True
    # Each level: the fillings still to try there and how often. The path is undone on return.
    levels: list[list[Run]] = []
    bins = used = 0
    while fewest > least and steps > 0:
        options: list[Run] = []
        if left:
            steps -= 1
            # Volume that must still be packed bounds the bins below here.
            if bins + -(-(total - used) // capacity) < fewest:
                found, cut = completions(left, max(left), capacity, FILL_STEPS, best)
                complete &= not cut
                options = [Run(k, items) for items in found[::-1] for k in range(1, repeats(left, items) + 1)]
        elif bins < fewest:
            incumbent, fewest = list(path), bins
        levels.append(options)
        while levels and not levels[-1]:
            levels.pop()
            if path:
                done = path.pop()
                bins -= done.bins
                for x, k in done.items:
                    left[x] = left.get(x, 0) + k * done.bins
                    used -= x * k * done.bins
        if not levels:
            break
        run = levels[-1].pop()
        path.append(run)
        take(left, run.items, run.bins)
        bins += run.bins
        used += sum(x * k for x, k in run.items) * run.bins
    return incumbent, steps, fewest <= least or (steps > 0 and complete)


def places(plan: list[Run]) -> dict[str, np.ndarray]:
    """The plan by length: pieces ``first``.. of that length lie in bins ``bin``.., ``copies`` in each."""
    rows, at, seen = [], 0, {}
    for run in plan:
        offset = 0
        for length, copies in run.items:
            first = seen.get(length, 0)
            rows.append((length, first, at, copies, offset))
            seen[length] = first + copies * run.bins
            offset += length * copies
        at += run.bins
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "bin", "copies", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` (with a column length of 1 to ``capacity``) and their sequence_id and offset.

    Only the table of lengths and counts (at most ``capacity`` rows) and the plan made of it
    (as few) pass the driver. A length that a third of all pieces have is numbered in many groups.
    """
    names, kept = pieces.columns, pieces.schema
    # Columns added here: their names are those of no column of the pieces.
    number, group, before_, row, rank = (f"_{k}_{uuid.uuid4().hex[:8]}" for k in ("number", "group", "before", "row", "rank"))
    pieces = stored(pieces.withColumn(number, F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(plan_bins(counts, capacity))
    groups = max(16, -(-sum(counts.values()) // group_rows))
    # Rows are dealt out by their number: equal ones to different groups too.
    salted = pieces.withColumn(group, F.pmod(F.xxhash64(number), F.lit(groups)))
    # How many pieces of the length stand in groups before this one: one row per length and group.
    sizes = salted.groupBy("length", group).agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(before_))
    within = Window.partitionBy("length", group).orderBy(number)
    numbered = salted.withColumn(row, F.row_number().over(within)).join(sizes, ["length", group])
    numbered = numbered.select(*names, (F.col(before_) + F.col(row) - 1).alias(rank))
    schema = StructType([*kept, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    at, rank_at = names.index("length"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(at).to_numpy(zero_copy_only=False)
            rank = batch.column(rank_at).to_numpy(zero_copy_only=False)
            i = _last_not_after(table["length"], table["first"], length, rank)
            inside = rank - table["first"][i]
            bins = table["bin"][i] + inside // table["copies"][i]
            offset = table["offset"][i] + inside % table["copies"][i] * length
            columns = [batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bins), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return numbered.mapInArrow(run, schema)


def _last_not_after(lengths: np.ndarray, firsts: np.ndarray, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Index of the last (length, first) that is not after (length, rank), both sorted."""
    # Ranks stay far under 2^48 and lengths under 2^15.
    key = (lengths << 48) | firsts
    return np.searchsorted(key, (length << 48) | rank, side="right") - 1


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone; repeated rows are packed each; other columns are
    ignored; an empty table gives an empty result; texts of any length are cut at ``capacity``.
    """
    return pack(token_pieces(docs, tokenizer, capacity), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
