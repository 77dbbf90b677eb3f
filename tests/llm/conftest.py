import pytest

TOXIC_WORDS = ["blarg", "snorf", "quizzle"]


@pytest.fixture(scope="session")
def awkward(spark):
    """Null and empty texts, one very long word, a long text, repeated rows, null ids, clashing columns."""
    long_text = " ".join(f"word{i % 977} other{i % 31}" for i in range(30_000))
    texts = [None, "", " \n\t ", "x" * 50_000, long_text, "one two three four five six", "one two three four five six", "ÀÉ ñandú ßtraße 12 !!", "日本語 текст", "a"]
    # Columns named as the operators' own ones: plain values that have to come back as they are.
    rows = [(i if i != 7 else None, t, "en" if i % 2 else None, "s", i, i, "k", [1], *["kept"] * 9) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, `group` string, n array<int>, _base string, _weak string, _key string, _linked string, _spans string, _before string, _digest string, _row string, _group string")


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
