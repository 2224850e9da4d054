import random

import pytest

SCHEMA = "held string, doc_id long, text string, source string, size long, fp string, epoch string, lang string, n_chars long"


def rows_of(texts, start=0):
    return [("x", start + k, t, f"s{k % 3}" if k % 5 else None, 7, "y", "z", "en", 1) for k, t in enumerate(texts)]


def corpus(n=150, seed=1):
    """Random texts with copies, near copies, shared passages and lines, and texts of no or one word."""
    rng = random.Random(seed)
    words = ["the", "of", "and", "Über", "niño", "***", "to", "漢字", *("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300))]
    passage = " ".join(rng.choice(words) for _ in range(40))
    out = []
    for k in range(n):
        kind = k % 10
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 12)))
        if kind == 1 and out:
            text = rng.choice(out)
        elif kind == 2 and out:
            text = rng.choice(out) + " extra"
        elif kind == 3:
            text = text + "\n" + passage + "\nlast line " + str(k)
        elif kind == 4:
            text = ["", " \t\n ", "one", "The " * 60, "a\n" * 30, "x" * 400][k // 10 % 6]
        out.append(text)
    return out


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The corpus with columns whose names operators use themselves."""
    return spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, repeated rows, no words, and a very long text."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [(None,) * 9, *rows_of([None, "", "a b c", long, long, "a b c"]), *rows_of(["a b c", None])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def thue_morse():
    """Two different texts of 1,024 letters whose polynomial hashes modulo 2**64 are equal for every odd base."""
    word = "a"
    while len(word) < 1024:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})
