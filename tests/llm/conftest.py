import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, score string, n string, row string, class string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n))


def cases():
    """(doc_id, text) of the awkward documents."""
    long = prose(1, 30_000)
    passage = prose(2, 150)
    return [
        (None, prose(3, 40)), (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, long), (6, long + " tail"), (7, prose(4, 90)), (7, prose(4, 90)),
        (8, "Same five words in here " * 300), (9, "Ünïcödé — ça 漢字 é 🙂 " + prose(5, 60)), (10, prose(6, 30) + " " + passage), (11, passage + " " + prose(7, 30)),
        (12, "a" * 5_000), (13, prose(6, 30) + " " + passage), (14, "x"), (15, "<|endoftext|> it's 12  34\n\n"), (16, None),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, None if k % 5 == 0 else "ab"[k % 2], None, None if t is None else len(t), 1, "s", None, "n", "r", "c") for k, (i, t) in enumerate(cases())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
