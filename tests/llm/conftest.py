import random

import pytest

FILLER = "the of tion and ing erat anea thou was with from this into over under again never once".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(FILLER) + rng.choice(["", "ed", "s", "ly", str(rng.randint(0, 9))]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts() -> list[str | None]:
    """Nulls, empties, blanks, very long texts, copies, odd characters."""
    rng = random.Random(3)
    base = sentence(rng, 120)
    return [
        None,
        "",
        " \t\n",
        base,
        base,
        base.upper(),
        base + " tail",
        "x" * 30_000,
        sentence(rng, 9000),
        "é́ ÀÉ ß 漢字 😀 \x1c \x85   end",
        "a b",
        "mail me: john.doe+x@mail.example.com, or +1 (555) 010-9999 / 4111 1111 1111 1111 / 10.0.0.255.",
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """Extra columns whose names clash with operators' own."""
    rows = [(k, t, "x", 1.0, k) for k, t in enumerate(odd_texts)] + [(None, "no id", None, None, None), (3, odd_texts[3], None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, score double, fp long").repartition(3)


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.where("1 = 0")
