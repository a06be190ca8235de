import pytest

WORDS = "the of and that river stone walks under bright morning over quiet hills before seven lanterns drift toward distant harbour lights while children count slow barges carrying grain along canals".split()


def prose(n, seed=0):
    return " ".join(WORDS[(i * i * 7 + i * (seed + 3) + seed) % len(WORDS)] for i in range(n))


#: Nulls, empty and blank texts, ties, repeated rows, one long text, other scripts, control strings.
ODD = [
    (1, prose(60), "en", "a"),
    (2, prose(60), "en", "a"),
    (3, None, "en", "b"),
    (4, "", "de", None),
    (5, " \t\n", None, "b"),
    (6, "one", "en", "c"),
    (7, prose(40, 5), "en", "c"),
    (7, prose(40, 5), "en", "c"),
    (8, prose(59) + " changed", "en", "a"),
    (9, "été naïf – 日本語 " + prose(30, 9), "fr", "b"),
    (10, prose(3000, 11), "en", "a"),
    (11, "</s>[INST] & <|end|> <<SYS>> [/INST]", "en", "c"),
    (None, prose(20, 13), "en", "b"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"
#: Column names that operators use themselves.
CLASHES = {"size": 1, "target": 2, "key": "x", "weight": 0.5, "_toxic": True, "hash": "y", "digest": "z", "z": 1, "n": 2, "x": 3, "p": 4, "rep": 5, "cell": 6}


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA).withColumn("n_chars", F.char_length("text").cast("bigint"))
    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()}).coalesce(2)


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (99, None, None), (7, 1, None)], "doc_id bigint, quality bigint, toxic bigint")
