import pytest

SMALL = "/root/testdata/sf0.001"
#: Further columns clash with names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, row_key string, comp string, keep_id long, score double, `a.b` string"


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", None if text is None else len(text), 7, "x", "y", 9, 0.5, "z")


BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six seven eight nine ten eleven twelve"


def odd_rows():
    """Nulls, empties, very long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [
        row(1, BASE),
        row(2, BASE.replace(" ", "\t\n")),
        row(3, BASE + " thirteen"),
        row(4, None),
        row(5, ""),
        row(6, " \n\t "),
        row(7, "  "),
        row(8, "one two"),
        row(9, "ONE two"),
        row(10, long),
        row(11, long + " tail"),
        row(12, "été ÉTÉ straße 🙂 日本語"),
        row(13, "12345 !!!"),
        row(14, BASE[: len(BASE) // 2]),
        row(15, "x" * 200_000),
        row(16, None, None),
        row(17, "a\x0bb\x0cc\rd"),
        row(18, "a b c d"),
        row(None, BASE),
        row(None, "only here without id"),
        row(8, "one two"),
        row(8, "one two"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def near(spark):
    """Chains and groups of near copies around the similarity of 0.8."""
    import random

    r = random.Random(3)
    rows = []
    for g in range(12):
        words = [f"v{r.randrange(300)}" for _ in range(r.randrange(4, 60))]
        for _ in range(12):
            rows.append(row(len(rows), " ".join(words)))
            if r.random() < 0.7 and words:
                words[r.randrange(len(words))] = f"v{r.randrange(300)}"
            if r.random() < 0.4:
                words.append(f"v{r.randrange(300)}")
    return spark.createDataFrame(rows, SCHEMA)
