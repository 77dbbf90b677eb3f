import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from barquarry.llm import merkle

H = lambda s: sha256(s.encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def siblings(nodes, i):
    """Siblings left and right on each level, and the last node."""
    way = []
    while len(nodes) > 1:
        run = i - i % 3
        way.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        nodes, i = [H("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)], i // 3
    return way, nodes[0]


def plain(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row["source"], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        own = sorted(by_source[source], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees.append((own, [leaf(r, r["text"]) for r in own]))
    subroots = [siblings(leaves, 0)[1] for _, leaves in trees]
    out = []
    for rank, (own, leaves) in enumerate(trees):
        for i, row in enumerate(own):
            way = siblings(leaves, i)[0] + siblings(subroots, rank)[0]
            root, node = siblings(subroots, rank)[1], leaves[i]
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0 and row["text"] is not None:
                node = leaf(row, row["text"].replace("\n", ""))
            for left, right in way:
                node = H(left + node + right)
            out.append((row["doc_id"], leaves[i], subroots[rank], root, H("".join(a + b for a, b in way)), node, node == root))
    return out


def check(docs, block_levels):
    got = merkle.verified(docs, F.translate("text", "\n", ""), F.crc32(F.col("doc_id").cast("string")) % 2 == 0, block_levels)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted((tuple(r[n] for n in names) for r in got.collect()), key=str)
    assert found == sorted(plain(docs.collect()), key=str)
    return got


def corpus(spark, n):
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else None if i % 11 == 1 else f"s{i % 40}" if i % 2 else "Ä" if i % 5 else "a b"
        rows.append((i * 7 % n if i % 17 else None, f"text {i}\nline\n" if i % 4 else None if i % 8 else "", "en" if i % 3 else None, source, i if i % 5 else None, "x", i, "t"))
    rows += rows[:9] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, part string")


@pytest.mark.parametrize(("n", "block_levels"), [(700, 1), (300, 2), (60, 7)])
def test_equals_a_plain_tree(spark, n, block_levels):
    check(corpus(spark, n), block_levels)


def test_hot_source_over_several_ranges(spark):
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 360, "hot").otherwise("z").alias("source"), F.lit(4).alias("n_chars"))
        check(docs.unionAll(docs.where("doc_id % 7 = 0")), 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_awkward_rows_one_row_and_no_rows(spark, awkward, no_rows):
    check(awkward, 2)
    (row,) = check(awkward.where("doc_id = 4"), 7).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == H("")
    assert check(no_rows, 7).collect() == []


def test_partitions_fetch_only_what_they_cannot_derive(spark):
    spans = spark.createDataFrame([(0, "sa", 9, 17, 40, 0)], "part long, tree string, lo long, hi long, n long, base int")
    got = {(r["level"], r["idx"]) for r in merkle.missing(spans).collect()}
    # Leaves 9 to 17 are nodes 3 to 5 of level 1 and node 1 of level 2 (of 5), under node 0 of level 3 (of 2).
    assert got == {(2, 0), (2, 2), (3, 1)}
