import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, component_id int, _rank int"


@pytest.fixture
def docs(spark):
    """Makes documents from (doc_id, text[, lang, source]); some columns clash with names that operators use."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1", len(r[1] or ""), "x", 7, 1) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


#: Null, empty, white space, repeated rows and ids, ties, odd characters, a very long text, null columns.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two three four five six"), (4, "one two three four five six"), (5, "one two three four five six"), (None, "a null id"),
    (-1, "below zero"), (6, "Ünïcode ß İ 日本語 x́ ½ \x1c sep\xa0nbsp 'll don't 12,5% <|endoftext|>"), (7, "long words here " * 20_000), (8, "tie", None, None), (9, "tie", "de", None), (10, "x"),
]
