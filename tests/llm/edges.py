"""Small documents with everything that can be odd about them."""

from pyspark.sql import functions as F

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "b"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "b"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \t\n \r\n ", "de", "c"),
    (None, "Some text without an id, token = abcdef123456.", None, None),
    (None, None, None, None),
    (6, "ÀÉÎ ĶelvinK İstanbul 漢字 \U0001f600 emoji \U0001f600 x y", "fr", "d"),
    (7, "word " * 3000 + "end", "en", "e"),
    (8, "x" * 20000, "en", "f"),
    (9, "one", "en", "g"),
    (10, "A SHARED line of boiler plate\nown line ten\nA SHARED line of boiler plate", "en", "a"),
    (11, "A SHARED line of boiler plate\n\nown line eleven", "en", "b"),
    (12, "own line twelve\nA SHARED line of boiler plate", "en", "c"),
    (13, "A SHARED line of boiler plate", "en", None),
    (-3, "negative id  'quotes' don't we'll I'M 1234567 3.14", "en", "h"),
]
SCHEMA = "doc_id long, text string, lang string, source string"

# names that the operators use inside
CLASHING = (
    "row key value stratum m h site pos words hash n_chars part keys counts place shard slot "
    "row_number mask masks n_removed kept base_failed rules spans t ids root size page first"
).split()


def documents(spark, rows=None):
    return spark.createDataFrame(TEXTS if rows is None else rows, SCHEMA)


def clashing(docs):
    return docs.withColumns({c: F.lit(f"my {c}") for c in CLASHING})


def empty(spark):
    return documents(spark, [])
