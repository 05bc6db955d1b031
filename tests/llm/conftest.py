import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])

WORDS = "the of tion heed anan ouea thwh shon edly inerst blent reandon, tithat. Onst".split()


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "er", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, control characters."""
    texts = [None, "", " ", "a", "\x00�", "é中😀 ▁x  y\n\n\tz ", prose(1, 40), prose(1, 40), prose(2, 3), prose(3, 3000),
             "x" * 5000, "ab " * 900, prose(4, 120), prose(4, 120) + " end", "<|im_end|> <|endoftext|>", prose(5, 60) + "\n" + prose(6, 60)]
    rows = [(i, t, ["en", "de", None][i % 3], "src", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, prose(7, 50), None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """Further columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = "fp row doc spans text_md5 kept score a b u v component_id sig range next_text shard slot size members key".split()
    return odd_docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
