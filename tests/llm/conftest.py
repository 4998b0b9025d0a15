import numpy as np
import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, toxic string, jaccard double, gid bigint, token string, bin_id string, item_id string, pos bigint, __id bigint, h string"


def words(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join("w" + str(x) for x in r.integers(0, 100_000, n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, blank and very long texts, repeated rows, ties, and columns whose names the operators use."""
    base = words(1, 80)
    rows = [
        (1, base, "en", "a"), (2, base + " tail", "en", "a"), (3, words(2, 120), "de", "b"), (4, None, "en", "a"), (5, "", None, None), (6, " \n\t ", "en", "a"), (None, words(3, 70), "en", "a"), (None, None, None, None),
        (7, words(4, 200_000), "en", "c"), (8, words(5, 60), "fr", "a"), (8, words(5, 60), "fr", "a"), (9, "Ünïcödé ñandú 日本語 ß", "es", "a"), (10, "x", "en", "a"), (11, base, "en", "z"), (12, "y" * 300_000, "en", "c"),
        (13, words(3, 70), "en", "a"),
    ]
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), "t", 0.5, 1, "k", "b", "c", 2, i, "h") for i, t, l, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
