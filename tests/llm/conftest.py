"""A small table with every awkward case: nulls, empty and long texts, copies, ties, clashing extra columns."""

import random

import pytest


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    words = [rng.choice("abcdeilmnorstuéñ") * rng.randint(1, 2) + "".join(rng.choice("abcdeilmnorstué") for _ in range(rng.randint(1, 7))) for _ in range(800)]
    passage = prose(rng, words, 120)
    base = prose(rng, words, 150)
    out = {}
    for i in range(40):
        out[i] = "\n".join(prose(rng, words, rng.randint(1, 60)) for _ in range(rng.randint(1, 6)))
    for i in range(40, 46):
        out[i] = f"{prose(rng, words, 30)} {passage} {prose(rng, words, 20)}"
    out[46] = out[47] = out[48] = out[3]
    for i in range(49, 58):
        copy = base.split()
        for _ in range(i - 49):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out[i] = " ".join(copy)
    out[58], out[59], out[60] = None, "", "one"
    out[61] = "two words"
    out[62] = "Two  WORDS"
    out[63] = "word " * 3000
    out[64] = "abcdefghij" * 400
    out[65] = " \t\n  \n"
    out[66] = "日本語のテキスト \U0001f600 ﬁ x\u00a0y\x1cz 12'll don't"
    out[67] = out[1] + "\n" + out[2].split("\n")[0]
    return out


@pytest.fixture(scope="session")
def documents(spark, texts):
    """Shuffled rows, one doc_id twice with its text, a null doc_id, and columns named like results."""
    rows = [(k, t, "x", "y", -1) for k, t in texts.items()] + [(5, texts[5], "x", "y", -1), (None, "nobody's words here are five or more", "x", "y", -1)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, score string, kept string, n_lines long").repartition(3)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.where("false")
