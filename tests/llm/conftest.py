import random

import pytest

from tests.conftest import spark  # noqa: F401 - the session of all tests


def prose(rng, n, vowels="aeiou"):
    """``n`` invented words in sentences."""
    words = ["".join(rng.choice("bdfgklmnprst") + rng.choice(vowels) for _ in range(rng.randint(1, 4)))
             for _ in range(n)]
    for i in range(0, n, 9):
        words[i] = words[i].capitalize()
        words[i - 1] += "."
    return " ".join(words)


@pytest.fixture(scope="session")
def texts():
    """Documents with copies, near copies, shared passages, repeats, nulls and odd texts."""
    rng = random.Random(3)
    base = [prose(rng, rng.choice([8, 60, 150, 300])) for _ in range(24)]
    long = prose(rng, 4000)
    passage = prose(rng, 70)
    near = []
    for k in range(6):
        words = base[3].split() if k % 2 else long.split()[:200]
        words[5 + k] = "changed"
        near.append(" ".join(words))
    odd = [None, "", " \n\t ", "one", "two words", "aaaa" * 200, "Der " * 150, "é" * 350,
           "ab\nab\nab\n", "x" * 199, "x" * 200, "\n".join(["same line here"] * 40)]
    shared = [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(5)]
    return base + base[:4] + [base[0]] * 5 + near + odd + odd + shared + [long, long[:9000]]


@pytest.fixture(scope="session")
def documents(spark, texts):  # noqa: F811
    langs = ["en", "fr", None]
    rows = [(i, t, langs[i % 3], f"src{i % 4}" if i % 5 else None, len(t) if t else None)
            for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()
