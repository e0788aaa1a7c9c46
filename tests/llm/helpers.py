"""Small tables with every oddity at once, and definitions to hold results against."""
import collections
import re

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use inside; as extra columns they must not matter.
CLASHES = ("id", "fp", "w", "items", "h", "v", "c", "size", "pos", "line", "row", "score", "__k", "part", "copies", "words", "a", "b")

SHARED = "one two three four five six seven eight nine ten eleven twelve"
ODD = [
    (1, f"Start {SHARED} end", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n ", "de", "b", 4),
    (None, "a text without an id", "en", "b", 1),
    (5, "same words here", "en", None, 1),
    (5, "same words here", "en", None, 1),
    (6, "same words here", "en", "c", 1),
    (7, "lone", "fr", "c", 1),
    (8, ("långt ord " * 4000) + SHARED.upper(), "xx", "a", 9),
    (9, "Zero width   ünïcode ÀÉ you IDIOT!!! <|endoftext|> \x0b\x1c x", "en", "Z", 3),
]


def docs(spark, rows=ODD, extra=False):
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for c in CLASHES:
            df = df.withColumn(c, df["lang"])
    return df


def lower(x):
    return (x or "").encode().lower().decode()


def tokens(x):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower(x)) if w]


def words(x):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))


def rows(df, *cols):
    """The rows as a multiset."""
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())
