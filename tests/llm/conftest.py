import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """Small documents of many kinds: copies, edited copies, repeats, templates, nulls, blanks and one long text."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5)))
    texts = []
    for _ in range(30):
        texts.append(" ".join(word() for _ in range(r.randint(60, 120))) + "\n" + f"Posted on day {r.randint(1, 99)} by the site team today\n" + " ".join(word() for _ in range(20)))
    base = [word() for _ in range(150)]
    for k in range(8):
        copy = list(base)
        for _ in range(k):
            copy[r.randrange(150)] = word()
        texts.append(" ".join(copy))
    texts += [texts[0], texts[0], texts[1].upper(), None, "", " \n\t ", "one two", "one two", "un mot é ß 日本 \x1c  x", "same word " * 80, "x " * 4 + "y", "big" + " w" * 3000 + " end <|endoftext|> more"]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows


@pytest.fixture()
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS)


@pytest.fixture()
def odd(spark):
    """Nulls in every column, repeated rows and ids, and columns whose names operators use themselves."""
    rows = [(None, "a b c d e f", None, None, None, 1, "k"), (None, None, None, None, None, 2, "k"), (5, "a b c d e f", "x", "y", 3, 3, None), (5, "a b c d e f", "x", "y", 3, 3, None), (5, "other text", "x", "y", 3, 4, None), (6, None, None, None, None, 5, "z")]
    return spark.createDataFrame(rows, DOCS + ", n long, key string")


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], DOCS)
