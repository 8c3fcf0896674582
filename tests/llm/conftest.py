import random

import pytest

WORDS = ["alpha", "Beta,", "gamma", "DELTA", "eps.", "zeta", "été", "über", "ñu", "日本", "x", "#y", "1"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def corpus() -> list[tuple]:
    """(doc_id, text, lang, source): copies, shared passages, odd white space, empty, null and repeated rows."""
    shared = prose(1, 60)
    rows = [(k, prose(100 + k, 30 + 7 * k), "en" if k % 2 else "de", f"s{k % 3}") for k in range(20)]
    rows += [(100 + k, f"{prose(300 + k, 20)} {shared}\n{prose(400 + k, 25)}", "en", "hot") for k in range(12)]
    rows += [(200 + k, rows[3][1], "en", "hot") for k in range(5)]
    rows += [(300, f"  {rows[5][1]}\t\n", None, "s0"), (301, rows[5][1].replace(" ", "\n\n"), "en", None)]
    rows += [(400, "", "en", "s1"), (401, None, "en", "s1"), (402, " \t\r\n", "de", "s1"), (403, "one", "de", "s1"), (404, "a b c d e f g h i j k l m", "de", "s1")]
    rows += [(405, "a b c d e f g h i j k l m", "de", "s1"), (500, "same " * 40, "en", "s2"), (501, "w v   q\x1cr\x85s " * 9, "en", "s2")]
    rows += [(600, "<|endoftext|> x <|endoftext|>y 's 'll\n\n  z" * 3, "en", "s2"), (601, "ab" * 4000 + " " + prose(9, 900), "en", "s2")]
    rows += [(7, rows[7][1], "en", "s1"), (7, "another text under an old id", "en", "s1"), (None, shared, "en", "s1"), (None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)
