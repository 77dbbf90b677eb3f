import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barquarry.llm import packing
from barquarry.llm.packing import CAPACITY, TOKENIZER, WORDS_AT_ONCE, WORDS_KEPT, WordIds, best_fit, fillings, least_bins, pack, pack_documents, plan_bins


def fewest(lengths, capacity):
    """Brute force over all ways to fill the bin of the largest piece."""

    @cache
    def bins(left):
        if not left:
            return 0
        largest, rest = left[-1], left[:-1]
        found = set()

        def choose(i, room, kept):
            if i < 0:
                found.add(tuple(sorted(kept)))
                return
            choose(i - 1, room, (*kept, rest[i]))
            if rest[i] <= room:
                choose(i - 1, room - rest[i], kept)

        choose(len(rest) - 1, capacity - largest, ())
        return 1 + min(bins(x) for x in found)

    return bins(tuple(sorted(lengths)))


def used(plan):
    out = Counter()
    for run in plan:
        for x, k in run.items:
            out[x] += k * run.bins
    return out


def test_plan_is_the_fewest_on_small_inputs():
    random.seed(5)
    for _ in range(60):
        capacity = random.choice([10, 17, 30])
        lengths = [random.randint(1, capacity) for _ in range(random.randint(1, 10))]
        plan = plan_bins(Counter(lengths), capacity)
        assert used(plan) == Counter(lengths)
        assert all(sum(x * k for x, k in run.items) <= capacity for run in plan)
        assert sum(run.bins for run in plan) == fewest(lengths, capacity)


def test_plan_that_repeats_a_filling_less_often():
    assert sum(run.bins for run in plan_bins(Counter([8, 10, 10, 10, 10, 14, 18, 21, 21, 24]), 50)) == 3


def test_plan_is_the_fewest_where_best_fit_is_not():
    random.seed(8)
    better = 0
    for _ in range(1500):
        capacity = random.choice([30, 50, 60])
        lengths = [random.randint(capacity // 8, capacity // 2) for _ in range(random.randint(9, 13))]
        counts = Counter(lengths)
        bins = sum(run.bins for run in plan_bins(counts, capacity))
        if bins > least_bins(counts, capacity):
            assert bins == fewest(lengths, capacity)
        better += bins < sum(run.bins for run in best_fit(counts, capacity))
    assert better > 5


def test_equal_rows_stand_in_many_groups(spark):
    pieces = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(30).cast("long").alias("length"), F.lit("x").alias("_group"))
    out = pack(pieces, capacity=100, group_rows=250).collect()
    assert check(out, 100) == 1334 and {r["_group"] for r in out} == {"x"}


def test_never_worse_than_best_fit_nor_better_than_the_bound():
    random.seed(6)
    for low, high in ((1, 4096), (900, 2100), (1300, 1500)):
        counts = Counter(random.randint(low, high) for _ in range(500))
        bins = sum(run.bins for run in plan_bins(counts, CAPACITY))
        assert least_bins(counts, CAPACITY) <= bins <= sum(run.bins for run in best_fit(counts, CAPACITY))


def test_fillings_come_least_waste_first_and_hold_the_largest():
    options = fillings({7: 2, 5: 1, 3: 2, 2: 1}, 7, 12)
    waste = [12 - sum(x * k for x, k in o) for o in options]
    assert waste == sorted(waste) and waste[0] == 0 and all(o[0][0] == 7 for o in options)


def check(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for at in places.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_awkward_documents(awkward):
    library = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    rows = pack_documents(awkward).collect()
    check(rows, CAPACITY)
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    expected = Counter()
    for d in awkward.collect():
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), CAPACITY)):
            part = np.array(ids[at : at + CAPACITY], dtype="<u4")
            expected[d.doc_id, p, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert pieces == expected


def test_one_length_in_many_groups(spark):
    rows = [(i, 0, 0, 30 if i % 3 else 1 + i % 50, i) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = pack(pieces, capacity=100, group_rows=50).collect()
    assert len(out) == 3000 and check(out, 100) == sum(r.bins for r in plan_bins(Counter(r[3] for r in rows), 100))


def test_no_rows(no_rows):
    assert pack_documents(no_rows).count() == 0


def test_words_are_learned_in_small_parts():
    ids = WordIds(public_tokenizers.path(TOKENIZER))
    whole, asked = Tokenizer.from_file(public_tokenizers.path(TOKENIZER)), []
    letters = "abcdefghijklmnopqrstuvwxyzäß"
    texts = [" ".join(letters[i % 28] + letters[j] + letters[(i * j) % 28] + letters[k] for j in range(28) for k in range(28)) for i in range(28)]

    class Watched:
        def encode_batch_fast(self, batch, **options):
            asked.extend(len(text.split(" ")) for text in batch)
            return whole.encode_batch_fast(batch, **options)

    ids.tokenizer = Watched()
    found = ids.encode(texts)
    assert max(asked) <= WORDS_AT_ONCE <= 5_000 and sum(asked) > WORDS_AT_ONCE and WORDS_KEPT <= 250_000
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in found] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_met_first_are_kept_when_there_is_no_more_room(monkeypatch):
    monkeypatch.setattr(packing, "WORDS_KEPT", 40)
    ids = WordIds(public_tokenizers.path(TOKENIZER))
    library = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    texts = ["the über café\tof ΑΣ it's", *(f"the über w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}ß x{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} <|endoftext|> \x1f" for i in range(100))]
    frequent = ids.encode(texts[:1]) and ids.kept["the"]
    for t in texts:
        assert np.frombuffer(ids.encode([t])[0], dtype="<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        # The same bytes: not asked for again.
        assert ids.kept["the"] is frequent and len(ids.kept) < 60


def test_ascii_texts_are_split_as_by_the_tokenizer_s_pattern():
    splitter = WordIds(public_tokenizers.path(TOKENIZER)).splitter
    random.seed(3)
    assert splitter.ascii_pattern is not splitter.pattern
    for _ in range(3000):
        text = "".join(random.choices([chr(i) for i in range(128)] + ["'s", "'ll", "'ve"], k=20)).lower()
        assert splitter.plain_words(text) == splitter.pattern.findall(text)
