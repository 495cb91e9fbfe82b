"""Inputs and fixtures of the tests in this folder."""

import pytest
from pyspark.sql import functions as F

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

LONG = " ".join(f"w{i % 977}x" for i in range(30_000))

# nulls in every column, empty and very long texts, ties, repeated rows, and
# extra columns whose names the operators use themselves
ROWS = [
    (1, "All rights reserved. One plain line that is long enough to be looked at twice.", "en", "a", 1, 0.5, "x"),
    (2, "All rights reserved. One plain line that is long enough to be looked at twice.", "en", "a", 1, 0.5, "x"),
    (2, "All rights reserved. One plain line that is long enough to be looked at twice.", "en", "a", 1, 0.5, "x"),
    (3, None, "en", "b", None, None, None),
    (4, "", None, None, 0, 0.1, "y"),
    (None, "A text without an id, licensed under CC BY 4.0.", "de", "b", 3, 0.2, "z"),
    (5, "   \n\t\n", "fr", "a", 5, None, ""),
    (6, LONG, "en", "c", len(LONG), 0.0, "w"),
    (7, "1234 5678 !!! ...", "fr", "c", 17, 0.3, "v"),
    (8, "Ünïcode ßtraße \U0001F600 \u00a0 General Public License général", "de", None, 50, 0.4, "u"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, SCORE double, Slot string"


def clashing(df):
    """Further columns named like the operators' working columns."""
    names = ["k_id", "k_text", "k_len", "rid", "w", "fp", "gone", "row", "src", "m", "run", "d", "x", "h1"]
    return df.withColumns({n: F.lit(f"own {n}") for n in names})


@pytest.fixture(scope="session")
def edge(spark):
    return clashing(spark.createDataFrame(ROWS, SCHEMA))


@pytest.fixture(scope="session")
def empty(spark):
    return clashing(spark.createDataFrame([], SCHEMA))
