import hashlib
import random
import re

from barquarry.llm import secret_scan as s

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
WEAK = {
    "session": (re.compile(r"ASIA[A-Z0-9]+"), 0, 20, 10**9, 1),
    "key": (re.compile(r"[A-Za-z0-9/+]{32,}={0,2}"), 0, 32, 128, 2),
    "endpoint": (re.compile(r"https?://[A-Za-z0-9._~:/?&=%@-]+"), 0, 12, 10**9, 3),
}
PARTS = ["password", "token", "API_KEY", "secret", '"', "'", " ", "=", ": ", "abc", "deadbeef" * 4, "AKIA" + "A1B2C3D4" * 2, "ASIA" + "Z9" * 9, "Ab1/" * 10, "https://api.example.org/v1", "é", "\n", "\n \n", "word " * 46, "x" * 230, "0123456789abcdef01234567", "passwd=", "日本"]


def plain(text):
    text = text or ""
    base = [(m.start(), i, m.end(), name) for i, (name, (p, g, least)) in enumerate(BASE.items()) for m in p.finditer(text) if len(m.group(g)) >= least]
    weak = [(m.start(), 3 + i, m.end(), name, part) for i, (name, (p, g, least, most, part)) in enumerate(WEAK.items()) for m in p.finditer(text) if least <= len(m.group(g)) <= most]
    part_of = {"assign": 2, "access": 1, "hex": 2}
    every = [(a, b, part_of[n]) for a, _, b, n in base] + [(a, b, p) for a, _, b, _, p in weak]
    blanks = [m.start() for m in re.finditer(r"\n[\x20\x09\x0D]*\n", text)]
    block = lambda at: sum(x < at for x in blanks)
    added = [
        w[:4] for w in weak
        if any(p != w[4] and a < w[2] + s.SCOPE and b > w[0] - s.SCOPE and (a >= w[2] or b <= w[0]) and block(a) == block(w[0]) for a, b, p in every)
    ]
    show = lambda spans: ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(spans))
    count = lambda name: sum(x[3] == name for x in base)
    return count("assign"), count("access"), count("hex"), hashlib.sha256(show(base).encode()).hexdigest(), show(base + added), len(added)


def made(n, seed):
    random.seed(seed)
    return ["".join(random.choices(PARTS, k=random.randint(0, 25))) for _ in range(n)]


def test_scan_is_the_plain_versions(spark):
    texts = [*made(300, 1), None, "", "secret=token:abcdefg token:token=abcdef"]
    # Repeated rows and equal texts under other ids.
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (1000, texts[4])]
    expected = sorted((i, *plain(t)) for i, t in rows)
    got = s.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == expected
    assert any(r[-1] for r in expected)


def test_weak_parts_alone_are_not_reported():
    assert plain("https://api.example.org/v1 and nothing else")[4] == ""


def test_parts_support_each_other_within_a_block():
    key, hexes, session = "Ab1/" * 9, "0123456789abcdef" * 2, "ASIA" + "Z9" * 9
    assert "session" in plain(f"{session} with {hexes}")[4]
    assert "endpoint" in plain(f"https://db.example.org {key}=")[4] and "key" in plain(f"https://db.example.org {key}=")[4]
    assert plain(f"{session}\n\n{key}")[4] == "" and plain(f"{session} {'x ' * 250}{key}")[4] == ""
    # A long path is one thing, not an endpoint and a key.
    assert plain("https://example.org/" + "abcDEF01" * 6)[4] == ""


def test_very_many_matches(spark):
    text = "token=abcdefgh " * 3000 + f"ASIA{'Z9' * 9} "
    (row,) = s.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.n_assign, row.n_linked) == (3000, 1)
    (row,) = s.mask_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.text == f"{s.MASK} " * 3001


def test_masking(spark, no_rows, awkward):
    rows = [(i, t) for i, t in enumerate([*made(80, 4), None, "plain", "token=abcdefgh"])]
    got = {r.doc_id: r.text for r in s.mask_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        spans, out, end = [tuple(map(int, x.split(":")[1:])) for x in plain(text)[4].split(",") if x], "", 0
        for a, b in spans:
            if a >= end:
                out += text[end:a] + s.MASK
            end = max(end, b)
        assert got[i] == (None if text is None else out + text[end:])
    masked = s.mask_secrets(awkward)
    assert masked.columns == awkward.columns and masked.schema == awkward.schema
    # Nothing is secret there: all comes back as it is, columns with names of the operator's own included.
    assert sorted(map(str, masked.collect())) == sorted(map(str, awkward.collect()))
    assert s.scan(awkward).count() == awkward.count()
    assert s.scan(no_rows).count() == 0 and s.mask_secrets(no_rows).count() == 0
