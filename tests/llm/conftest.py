import random

import pytest

WORDS = "the of river stone light paper winter garden small green open walk house water bread music evening morning road tree".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "s", "ing", "er"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and very long texts, repeated rows, ties, near copies."""
    base = prose(1, 120)
    rows = [
        (1, base),
        (2, base),  # an exact copy
        (3, base.replace("river", "lake", 1)),  # near copies
        (4, base + " and one more"),
        (5, None),
        (6, ""),
        (7, " \n\t "),
        (8, "word"),
        (9, "WORD"),
        (10, "Grüße, 世界! \U0001f600 naïve"),
        (11, prose(2, 20_000)),  # very long
        (12, "x" * 50_000),
        (13, prose(3, 60)),
        (13, prose(3, 60)),  # a repeated row
        (None, prose(4, 50)),
        (14, "a  b\r\n\tc \x00 d e  "),
        (15, prose(5, 3)),
    ]
    return [(i, t, ["en", "de", None][k % 3], ["src0", "src11", None][k % 3], None if t is None else len(t)) for k, (i, t) in enumerate(rows)]


#: Extra columns whose names operators use inside.
CLASHES = "key rep n id part score m_domain m_epochs doc own_id gone_id slot shard bucket length rank first component label text_crc32".split()


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_texts, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
