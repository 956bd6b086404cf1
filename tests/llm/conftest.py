import random

import pytest

DATA = "/root/testdata/sf0.001"
#: Names that the operators use for columns of their own.
CLASHING = ("size", "target", "first", "n", "src", "fp", "class", "label", "score", "key", "host", "n_words", "kept", "_id", "_text", "_z", "_w", "_row", "anchor", "component_id", "sequence_id", "words", "piece")


def texts():
    """(doc_id, text, source): nothing, white space, repeats in and across texts, copies, long ones, other scripts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    plain = lambda n: " ".join(word() for _ in range(n))
    long_one = plain(30_000)
    rows = [
        (0, "", "s"), (1, None, "s"), (2, " \t\n\x0b\x0c\r ", None), (3, "one", "s"), (4, "one two", "t"), (5, "one two three", "t"),
        (6, "same words " * 400, "s"), (7, "abc " * 100_000, "t"), (8, long_one, "u"), (9, plain(300) + " " + long_one[1000:4000], "u"),
        (10, plain(40) + " " + passage + " " + plain(40), "s"), (11, plain(7) + "\n" + passage.replace(" ", "  "), "s"), (12, passage, "s"), (13, passage, "s"),
        (14, "naïve \x1c\x85  mixed　space 日本語 \U0001f41d end", "t"), (15, "A" * 5000, "t"), (16, "x" * 99, "t"), (17, "x" * 100, "t"), (18, "x" * 101, "t"),
        (19, "\x00nul\x00 bytes\x7f " + passage[:150], "u"), (20, "The MIT License. cc-by; Cc By cc by, GNU general public LICENSE apache license", "u"),
    ]
    base = plain(200).split()
    for k in range(30, 45):  # near copies
        words = list(base)
        words[rng.randrange(200)] = word()
        rows.append((k, " ".join(words), rng.choice("stu")))
    rows += [(k, plain(rng.randint(1, 400)), rng.choice(["s", "t", "ü", None])) for k in range(50, 80)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    """The texts, some rows twice, one without an id, and columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    rows = texts()
    rows += [rows[10], rows[12], rows[25], rows[25], (None, rows[10][1], "s")]
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.select("*", *(F.lit("clash").alias(c) for c in CLASHING)).repartition(3)
    df.cache().count()
    return df


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture
def saved(spark):
    from lakeloom.llm.common import Saved

    return Saved(spark, "test")


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
