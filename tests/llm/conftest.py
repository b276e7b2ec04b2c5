import random
import re

import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def made():
    """Seeded rows (doc_id, text): copies, near copies, shared passages, nulls, empty, one-word and very long texts."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice(["ka", "lo", "mi", "re", "tu", "sa", "né"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))

    rows = [(k, prose(rng.choice([3, 4, 20, 60, 150]))) for k in range(40)]
    rows[5] = (5, prose(60))
    passage = prose(30)
    rows += [(100 + k, prose(10) + " " + passage + " " + prose(12)) for k in range(12)]
    rows += [(200 + k, rows[5][1]) for k in range(6)]
    near = prose(300).split(" ")
    for k in range(6):
        one = list(near)
        one[rng.randrange(len(one))] = "Changed"
        rows.append((300 + k, " ".join(one)))
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "ONE"), (405, prose(20_000)), (406, "x" * 70_000)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, made):
    return spark.createDataFrame([(i, t, "kept", "clash") for i, t in made], "doc_id long, text string, kept string, id string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
