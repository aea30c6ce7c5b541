import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, found string"


@pytest.fixture(scope="session")
def texts():
    """Hard texts: null, empty, white space of every kind, one very long, copies and near copies, ties."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base = prose(300)
    out = [None, "", " ", "\n\n", "one", "One two\tthree", "a  b   c\n d e  f\x1cg", "<|endoftext|> x<|endoftext|>", "!!! ### don't I'll\r\n\r\n ok", "日本語 テキスト 123 ½ ²", prose(30_000), "x" * 20_000]
    out += [base, base, base.upper(), base + " tail", base.replace(" ", "\n", 3)]
    words = base.split()
    for i in range(12):
        words[rng.randrange(300)] = "new" + str(i)
        out.append(" ".join(words))
    out += ["\n".join(prose(rng.randint(1, 25)) + rng.choice(["", ".", "#"]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    out += ["again and again " * 40, "same line here\n" * 30]
    return out


@pytest.fixture(scope="session")
def documents(spark, texts):
    rows = [(i, t, "en", "src0", 0, -1, "clash") for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (3, "another text of a known id", "en", "s", 0, 0, ""), (None, "a text without an id", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
