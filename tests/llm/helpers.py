"""Small document tables with the awkward rows that every operator has to take."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

WORDS = "the of and harvest river stone window garden letter morning engine paper silver bridge market winter".split()


def prose(n: int, seed: int = 0) -> str:
    """Made-up sentences of n words."""
    out, state = [], seed * 7919 + 1
    for i in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(state >> 8) % len(WORDS)] + ("." if i % 9 == 8 else ""))
    return " ".join(out)


AWKWARD = [None, "", " ", "\n\n", "x", "é中😀", "a" * 30_000, "1" * 20_000, " ".join(["word"] * 5000), "\x00\x01", "▁▁ tab\tend "]


def documents(spark, texts, first: int = 0):
    rows = [(first + i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


def odd_rows(spark, texts):
    """The texts with a repeated row, a row without an id, and columns named like results."""
    rows = [(i, t, "en", None, 0) for i, t in enumerate(texts)] + [(0, texts[0], "en", None, 0), (None, texts[0], None, None, None)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    clashing = "ids secrets score fingerprint component_id n_words spans rate copies key flags kept pii_email decoded trusted"
    return df.selectExpr("*", *[f"'mine' AS {c}" for c in clashing.split()])
