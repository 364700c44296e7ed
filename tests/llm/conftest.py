"""Small tables with every awkward row: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, key string, score string, n string, block int, gram int, "
    "row string, lot int, hash string, words string, shard string, size string, clean string, a int, b int")
PROSE = "the ship left the harbour at dawn and the wind from the north carried it past the old lighthouse to the open sea"
SECRET = 'config token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" and more words after it'
NOTICE = "Some story about nothing at all.\nLicensed under the Apache License, Version 2.0."
ITEM = "which of these four planets has the shortest year and the longest day when both are counted in hours on earth"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    syllables = ("ba", "ne", "ti", "ro", "lu", "ska", "mi", "den", "for", "al")
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


def texts() -> list[tuple]:
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    long = prose(2, 30_000)
    leak = ITEM.replace("planets", "moons")
    return [
        (1, None, "en"), (2, "", "en"), (3, "   \n\t ", None), (4, base, "en"), (5, base, "en"), (5, base, "en"), (6, " ".join(near), "en"),
        (7, long, "de"), (8, long + " tail", "de"), (9, PROSE, "en"), (10, SECRET, "en"), (11, NOTICE, "en"), (12, f"a b c {leak} d e f", "en"),
        (None, prose(3, 40), "en"), (13, "one two", "fr"), (14, "One  two", "fr"), (15, "one two three", None), (16, "123 456 --", "fr"), (17, "ä ö é 漢字 ſ K", "de"),
    ]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame([(i, t, g, "src0", None, *["x"] * 3, 1, 2, "r", 3, *["h"] * 5, 1, 2) for i, t, g in texts()], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM, 5), (1, ITEM, 5), (2, None, 5), (3, "", 5), (4, "too few words", 5)], "item_id long, text string, key int")
