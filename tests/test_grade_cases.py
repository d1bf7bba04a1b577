"""The grader over its hand-made cases, and the screen before it."""

import random

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import answers as an
from tallgrass.functions import judging as j
from tallgrass.functions import mathtree as mt
from tallgrass.plans.grade_cases import CASES, response
from tallgrass.plans.grading import boxed_exactly, with_grade


@pytest.mark.parametrize("said, gold, equal", CASES)
def test_case(said, gold, equal):
    assert j.grade(response(said), list(gold)) is equal


def test_cause():
    assert j.cause(response(("3",)), ["3"]) == "ok" and j.cause("no", ["3"]) == "noextract" and j.cause(response(("3",)), ["3", "4"]) == "align" and j.cause(response(("17",)), ["3"]) == "conceptual"


@pytest.mark.parametrize(
    "text, form",
    [
        ("\\dfrac12", "\\frac{1}{2}"), ("3 / 4", "\\frac{3}{4}"), ("sqrt(2)", "\\sqrt{2}"), ("\\sqrt2", "\\sqrt{2}"), ("30^{\\circ}", "30"), ("5\\text{ cm}", "5"), ("5\\text{minutes}", "5"), ("x=5", "5"), ("f(x)=2x", "2x"), ("AB=7", "7"),
        ("2+x=7", "2+x=7"), ("\\alpha=3", "3"), ("x\\in(1,2)", "(1,2)"), ("((7))", "7"), ("(1,2)", "(1,2)"), ("a\\pm b", "a-b,a+b"), ("007", "7"), ("100.000", "100"), (".5", "5"), ("\\bf{x}+1", "x+1"), ("\\left(x\\right)+1", "(x)+1"),
        ("{3,1,3}", "1,3"), ("half", "1/2"), ("sin^2x", "\\sin^{2}x"), ("\\tan^{-1}x", "\\arctanx"), ("1<x<2", "1,x,2"), ("\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", "\\begin{array}1&2\\\\3&4\\end{array}"), ("", ""), ("(", "("), ("}{", "}{"), ("3j", "3i"),
    ],
)
def test_math_form(text, form):
    assert an.math_form(text) == form


def test_forms_are_stable():
    rng = random.Random(3)
    for _ in range(400):
        s = "".join(rng.choice(["\\frac", "{", "}", "(", ")", "1", "x", "^", "\\sqrt", "=", ",", "2.50", "sin", "\\text{cm}", " "]) for _ in range(rng.randint(0, 9)))
        assert mt.shown(mt.pieces(s)) == s
        assert an.math_form(an.math_form(s)) is not None and an.light(s) is not None


def test_screen_never_disagrees(spark):
    rng = random.Random(4)
    value = lambda: rng.choice(["5", "12.5", "yes", "No", "DNE", "x+1", "0.50", "-3", "(1, 2)", "t", "\\frac{1}{2}", ""])
    rows = []
    for i in range(600):
        gold = [value() for _ in range(rng.randint(1, 3))]
        said = gold if rng.random() < 0.7 else [value() for _ in gold]
        text = "<think>\\boxed{9}</think> " + rng.choice(["", "", "Therefore ", "#### "]) + ", ".join(f"\\boxed{{{v}}}" for v in said) + rng.choice(["", ".", " Therefore done", " or \\boxed{1}"])
        rows.append((i, None if rng.random() < 0.02 else text, gold))
    df = spark.createDataFrame(rows, "i int, response string, gold array<string>")
    got = with_grade(df.withColumn("exact", boxed_exactly(F.col("response"), F.col("gold")))).collect()
    assert sum(r.exact for r in got) > 15
    for r in got:
        assert r.ok == (r.response is not None and j.grade(r.response, r.gold)), r


def test_long_lists_end_within_their_budget():
    many = ", ".join(f"{i}.5x+{i}" for i in range(900))
    other = ", ".join(f"{i}.25x+{i}" for i in range(900))
    assert not j.within_budget(lambda: j.equal(f"({many})", f"({other})"))
    assert j.within_budget(lambda: j.equal("3", "3.0"))
    assert j.cause("\\boxed{(" + many + ")}", [f"({other})"]) == "conceptual"
