import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, target string, raw string, shard string, label boolean, `_row` int, words string, spans int, mark string"

#: Rows that every operator must take: null and empty texts, null ids, ties, repeated rows, odd characters and white space.
EDGES = [
    (9001, None, None, None), (9002, "", "en", "src0"), (9003, " \t\n\x0b\x0c\r ", "en", "z"), (9004, "one", "en", None), (9004, "one", "en", None),
    (None, "an id is missing here", "en", "src0"), (None, "an id is missing here", "en", "src0"), (None, None, None, "src0"),
    (9007, "a b  c\td\x1fe", None, "\U0001f600"), (9008, "A \U0001f600 text: password = 'hunter22hunter' ÜſK", "de", "�"), (9009, "the\tthe  the the", "en", "z"), (9010, "the the the the", "en", "z"),
    (-5, "the the the the", "xx", ""), (9011, "12345 67890 !!!", "en", "src1"), (9012, "\x00\x01 nul", "en", "src1"),
]


@pytest.fixture(scope="session")
def rows(spark):
    """(doc_id, text, lang, source) of a small corpus: real rows, edge rows, many copies, near copies and a very long text."""
    rng = random.Random(5)
    base = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()][:120]
    long_one = max((t for _, t, _, _ in base), key=len)
    many = [(20_000 + i, "Copied  text of\nmany rows, again" if i % 2 else "Copied text of many rows, again", "en", "src0") for i in range(90)]
    words = long_one.split()
    near = []
    for i in range(25):
        other = list(words[:300])
        for _ in range(rng.randrange(3)):
            other[rng.randrange(len(other))] = "changed"
        near.append((30_000 + i, " ".join(other), "en", "src2"))
    return base + EDGES + many + near + [(40_000, " ".join([long_one] * 60), "en", "src3")]


@pytest.fixture(scope="session")
def docs(spark, rows):
    extra = (7, "t", "r", "s", True, 3, "w", 1, "m")
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *extra) for i, t, lang, s in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
