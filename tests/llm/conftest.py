"""Small documents with nulls, empty and very long texts, ties, repeated rows and clashing extra columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component long, probability double, __x string"


def prose(seed: int, words: int) -> str:
    own = random.Random(seed)
    return " ".join("".join(own.choice("abdeilmnorst") for _ in range(own.randint(2, 8))) for _ in range(words))


def odd_rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        (1, base, "en", "a"), (2, " ".join(near), "en", "a"), (3, base, "de", "b"), (4, None, None, None), (5, "", "en", None), (6, "   \n\t ", None, "b"),
        (7, "Three short words", "en", "a"), (8, "three SHORT words", "en", "a"), (9, prose(2, 30_000), "fr", "b"), (9, prose(2, 30_000), "fr", "b"), (10, prose(3, 40), "en", "a"),
        (10, prose(4, 40), "en", "a"), (None, prose(5, 50), "en", "a"), (None, prose(5, 50), "en", "a"), (11, "1234 5678 !!", "en", "c"), (12, "é" * 500, "fr", "c"),
        (13, "<|endoftext|> in a text <|startoftext|>", "en", "c"), (14, "aaaaaaaaaaaaaaaaaaaaaaaaaaa" * 30, "en", "c"),
        *((100 + i, " ".join(w if (k * 7 + i) % 97 else f"x{i}" for k, w in enumerate(prose(6, 200).split())), "es", "hot") for i in range(40)),
    ]
    return [(i, t, lang, s, len(t or ""), 7, 0.5, "x") for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def rows():
    return odd_rows()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
