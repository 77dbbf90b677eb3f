import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as c
from barquarry.llm import languages, packing, quality, secret_scan
from barquarry.llm.common import labelled_sample, read, stored

from .test_shingle_join import brute

DIR = "/root/testdata/sf0.001"


def test_each_stage_against_a_plain_version(spark):
    docs = read(spark, DIR, "documents")
    columns = docs.columns
    # A clean document with a secret, whose id makes it stay in its group.
    plain = docs.where("lang = 'en' AND length(text) BETWEEN 800 AND 2000").orderBy("doc_id").first()
    text = plain.text + "\npassword=abcdef123456 and so on"
    planted = spark.createDataFrame([(-1, text, "en", "src0", len(text))], docs.schema)
    docs = docs.unionByName(planted)
    kept = docs
    for name, stage in c.STAGES[:-1]:
        before, kept = kept, stored(stage(spark, kept, DIR))
        assert kept.columns == columns, name
        old = {r.doc_id: r for r in before.collect()}
        new = {r.doc_id: r for r in kept.collect()}
        assert len(new) == kept.count() and set(new) <= set(old)
        if name == "language_id":
            judge = languages.train(languages.training_rows(before))
            accepted = judge.judge([r.text for r in old.values()])[2]
            assert set(new) == {i for i, ok in zip(old, accepted, strict=True) if ok}
        elif name == "quality_rules":
            rows = labelled_sample(before, read(spark, DIR, "labels"), "quality", quality.TRAINING_DOCS, seed=3)
            judge = quality.Judge(quality.train(rows))
            assert set(new) == {i for i, r in old.items() if judge.kept([r.text])[0]}
        elif name == "near_copies":
            assert set(new) == {g for *_, g in brute([(i, r.text) for i, r in old.items()], 5, 80)}
        elif name == "secrets":
            spans = {r.doc_id: r.spans for r in secret_scan.scan(before).collect()}
            assert set(new) == set(old) and any(spans.values())
            for i, r in new.items():
                assert (r.text != old[i].text) == bool(spans[i])
                assert r.n_chars == (len(r.text) if spans[i] else old[i].n_chars)
        if name != "secrets":
            assert all(new[i] == old[i] for i in new)
    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = c.packed(spark, kept, DIR).collect()
    lengths = {}
    for r in rows:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept.collect()}
    assert c.run(spark, DIR).count() > 0
