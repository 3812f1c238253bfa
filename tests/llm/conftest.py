import random

import pytest

SF = "/root/testdata/sf0.001"
#: columns whose names operators use inside, to clash with
EXTRA = ("row", "salt", "rank", "cls", "did", "rid", "_text", "spans", "length", "key", "y", "words", "_did", "piece")
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def with_extra(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in EXTRA))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, one very long text, repeated rows, near copies, unusual characters."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
    base = [word() for _ in range(300)]
    near = list(base)
    near[150] = "changed"
    passage = " ".join(word() for _ in range(120))
    texts = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One TWO"), (6, " ".join(base)), (7, " ".join(near)), (7, " ".join(near)), (None, " ".join(base)),
        (8, " ".join(word() for _ in range(40_000))), (9, "x" * 70_000), (10, "éÉ 你好 \U0001f600 İ ▁a  b c <|endoftext|> </s> don't we'LL\r\n\n  12345 ﬁn"),
        (11, passage + " tail one"), (12, "head two " + passage), (13, "z " + passage + " y " + passage), (14, "<|startoftext|>AB<|endoftext|> \x00\x1f"), (15, "A-B,c!!! 3.14"), (-3, "minus words here for the key"),
    ]
    texts.append((16, " ".join(word() for _ in range(190_000))))  # over a megabyte
    return [(i, t, None if i == 4 else "en", None, None if t is None or i == 5 else len(t)) for i, t in texts]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return with_extra(spark.createDataFrame(edge_rows, DOCUMENT))


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
