"""Splitting packed fields: dialects, round trips, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.operators import packed_values as pv

VALUES = ["12", "-3.5", "\\frac{1}{2}", "(1, 2)", "[0, 14]", "(-\\infty, 3)\\cup(5, \\infty)", "no solution", "7x-4", "True", "\\{1, 2, 3\\}", "f(2, 5)", ".25", "3\\sqrt{2}", "\\begin{pmatrix}1 & 2\\\\ 3 & 4\\end{pmatrix}", "(4; 5)"]


@pytest.fixture(scope="module")
def code():
    counts = np.zeros(pv.CELLS, np.int64)
    for v in VALUES * 5 + [str(i) for i in range(300)] + ["Yes; then stop", "71,954.1", "say \"no\", then go"]:
        for i in pv.cells(v):
            counts[i] += 1
    return pv.ValueCode(counts)


WRITERS = {
    "comma": lambda v: ", ".join(v), "tight": lambda v: ",".join(v), "semicolon": lambda v: "; ".join(v), "bar": lambda v: " | ".join(v), "tab": lambda v: "\t".join(v), "line": lambda v: "\n".join(v),
    "cjk": lambda v: "、".join(v), "and": lambda v: ", ".join(v[:-1]) + " and " + v[-1], "oxford": lambda v: ", ".join(v[:-1]) + ", and " + v[-1], "boxes": lambda v: ", ".join(f"\\boxed{{{x}}}" for x in v),
    "python": lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]", "json": lambda v: "[" + ",".join(f'"{x}"' for x in v) + "]", "letters": lambda v: ", ".join(f"({chr(97 + i)}) {x}" for i, x in enumerate(v)),
    "numbers": lambda v: "; ".join(f"{i + 1}) {x}" for i, x in enumerate(v)), "points": lambda v: "\n".join(f"{chr(97 + i)}. {x}" for i, x in enumerate(v)),
}


@pytest.mark.parametrize("style", WRITERS)
def test_round_trip(code, style):
    rng = random.Random(style)
    for _ in range(60):
        v = rng.sample(VALUES, rng.randint(2, 5))
        assert pv.cheapest(WRITERS[style](v), len(v), code)[1] == v


def test_quotes_and_empty_slots(code):
    assert pv.cheapest('"say ""no"", then go", 12', 2, code)[1] == ['say "no", then go', "12"]
    assert pv.cheapest('5; "Yes; then stop"; 7', 3, code)[1] == ["5", "Yes; then stop", "7"]
    assert pv.cheapest("5;;7", 3, code)[1] == ["5", "", "7"]
    assert pv.cheapest('"71,954.1", 3', 2, code)[1] == ["71,954.1", "3"]
    assert pv.cheapest("226; 14, False", 3, code)[1] == ["226", "14", "False"]
    assert pv.cheapest("12", 3, code)[1] == ["12"]


def test_table(spark):
    rows = [(1, "[ANS] [ANS]", "3, 4", 9), (1, "[ANS] [ANS]", "3, 4", 9), (2, "[ANS] [ANS]", None, 9), (3, "[ANS] [ANS]", "", 9), (4, "[ANS]", "5, 6", 9), (5, None, "1, 2", 9), (6, "[ANS] [ANS] [ANS]", "7;;" + "8" * 20000, 9), (7, "[ANS] [ANS]", "one value", 9)]
    df = spark.createDataFrame(rows, "scan_idx bigint, question string, answer string, pos int")  # pos clashes with a result's name
    got = {(r.scan_idx, r.pos, r.val) for r in pv.split_values(df, "answer", F.regexp_count("question", F.lit(r"\[ANS\]"))).collect()}
    assert got == {(1, 1, "3"), (1, 2, "4"), (6, 1, "7"), (6, 3, "8" * 20000)}
    assert pv.split_values(df, "answer", F.regexp_count("question", F.lit(r"\[ANS\]"))).where("scan_idx = 1").count() == 4
    assert pv.split_values(df.limit(0), "answer", F.lit(2)).count() == 0
