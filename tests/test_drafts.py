"""Drafts of summaries: what is wrong with them, and figures put in."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import reports

GOOD = "Under [SCENARIO] the book of [POSITIONS] positions would lose [RESULT]. The ratio would go to [RATIO], which is under the requirement."


@pytest.mark.parametrize(
    ("draft", "breach", "falls", "want"),
    [
        (GOOD, True, True, []),
        (None, True, True, ["empty", "missing placeholder"]),
        (GOOD + " See [NAMES].", True, True, ["unknown placeholder"]),
        (GOOD + " That is 5 times more.", True, True, ["own numbers"]),
        (GOOD + " Losses doubled.", True, True, ["own numbers"]),
        ("It would lose [RESULT].", False, True, ["missing placeholder"]),
        (GOOD + " It stays above the requirement.", True, True, ["breach denied"]),
        (GOOD + " It falls below the requirement.", False, True, ["breach invented"]),
        (GOOD + " It falls below the requirement.", True, True, []),
        (GOOD + " The ratio improves.", True, True, ["ratio rises"]),
        (GOOD + " The ratio improves.", True, False, []),
        (GOOD + " It would be above [RATIO].", True, True, ["compared with itself"]),
        (GOOD + " The bank has lost a lot.", True, True, ["realised"]),
        (GOOD + " Borrowers have already been hit.", True, True, ["already hit"]),
        (GOOD + " Reports claim otherwise.", True, True, ["claims of reports"]),
        (GOOD + " This summary was rewritten.", True, True, ["about itself"]),
        (GOOD + " And then", True, True, ["unfinished"]),
        (GOOD + ' "So it is."', True, True, []),
    ],
)
def test_problems(spark, draft, breach, falls, want):
    df = spark.createDataFrame([(draft, breach, falls)], "d string, b boolean, f boolean")
    assert df.select(reports.problems(F.col("d"), F.col("b"), F.col("f"))).first()[0] == want


def test_filled(spark):
    df = spark.createDataFrame([("$[LOSS] or [PART]% of it; a [KIND] and an [OTHER]. [KIND] again, A [KIND].", "$1.5m", "8.25%", "equity shock", "rate shock")], "d string, loss string, part string, kind string, other string")
    got = df.select(reports.filled(F.col("d"), {"LOSS": F.col("loss"), "PART": F.col("part"), "KIND": F.col("kind"), "OTHER": F.col("other")})).first()[0]
    assert got == "$1.5m or 8.25% of it; an equity shock and a rate shock. Equity shock again, An equity shock."
    odd = spark.createDataFrame([("[X] stays, [A] and [B].", "back\\slash $1", None)], "d string, a string, b string")
    assert odd.select(reports.filled(F.col("d"), {"A": F.col("a"), "B": F.col("b")})).first()[0] == "[X] stays, back\\slash $1 and ."
    assert odd.select(reports.filled(F.lit("[A]."), {"A": F.col("a")})).first()[0] == "Back\\slash $1."
