"""Small odd tables: nulls, empty and long texts, ties, repeated rows, columns that clash with result names."""

import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, score double, shard int, "
          "fp long, copies int, block int, held_out boolean, size long")


def prose(rng, n):
    words = ["the", "of", "and", "Thon", "ner", "étion", "ouque", "stin", "Ren", "hable", "ed.", "thing", "le", "des"]
    return " ".join("".join(rng.choice(words) for _ in range(rng.choice((1, 1, 2, 3)))) for _ in range(n))


def make(rows):
    return [(i, t, "en", s, len(t) if t is not None else None, 1, 2.0, 3, 4, 5, 6, True, 7) for i, t, s in rows]


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(5)
    base = [prose(rng, rng.choice((5, 30, 80, 200))) for _ in range(60)]
    near = base[3].split()
    near[len(near) // 2] = "changed"
    passage = prose(rng, 60)
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(base)]
    rows += [(100, base[3], "s0"), (101, " ".join(near), "s1"), (102, base[7] + "\n" + passage, "s2"),
             (103, passage + " " + base[9], None), (104, None, "s0"), (105, "", "s1"), (106, " \n\t ", "s1"),
             (107, "one", None), (108, prose(rng, 6000), "s3"), (109, passage + " tail " + passage, "s2"),
             (None, base[11], "s1"), (None, "no id here at all", None), (110, base[12], "s2"), (110, base[12], "s2"),
             (111, "x" * 300, "s3"), (112, "a b c d e", "s0")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(make(odd_rows), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
