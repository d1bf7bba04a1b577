"""Grading rules, one case each, and properties."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallgrass.functions import answers as an
from tallgrass.functions import brackets as br
from tallgrass.functions import judging as j
from tallgrass.functions.latexeval import Unreadable, evaluate, number


def box(*v):
    return "<think>\nx\n</think>\n\nFinal Answer: " + ", ".join(f"\\boxed{{{x}}}" for x in v)


@pytest.mark.parametrize(
    "response, gold, ok",
    [
        (box("\\frac{1}{2}"), ["0.5"], True), (box("\\frac12"), ["1/2"], True), (box("[0, 14]"), ["[0,14]"], True), (box("(1,2)\\cup(3,4]"), ["(3,4]\\cup(1,2)"], True),
        (box("(1,2)"), ["[1,2]"], False),
        (box("x^2-1"), ["(x-1)(x+1)"], True), (box("x^2+1"), ["(x-1)(x+1)"], False), (box("2x+4y=6"), ["x+2y=3"], True), (box("2x+4y=7"), ["x+2y=3"], False),
        (box("1.5\\times 10^{3}"), ["1500"], True), (box("3\\sqrt{2}"), ["\\sqrt{18}"], True), (box("\\log_2 8"), ["3"], True), (box("2\\pi"), ["6.283185307179586"], True),
        (box("x=5"), ["5"], True), (box("\\{3, 1, 2\\}"), ["\\{1,2,3\\}"], True), (box("30^\\circ"), ["30"], True), (box("100.000"), ["100"], True), (box("7"), ["8"], False),
        (box("1"), ["yes"], True), (box("Mon"), ["Monday"], True), (box("a", "b"), ["b", "a"], False), (box("3"), ["3", "4"], False), (box("3, 4"), ["3", "4"], True),
        ("The answer is 42.", ["42"], True), ("so it is $x+1$", ["1+x"], True), ("nothing here", ["1"], False), ("", ["1"], False),
        (box("14.026", "19.373", "A,B"), ["14.026", "19.373", "AB"], False), (box("0"), ["0"], True), (box("\\sin^{2}x+\\cos^{2}x"), ["2-1+0x+0"], True),
    ],
)
def test_grade(response, gold, ok):
    assert j.grade(response, gold) is ok


def test_sign_is_dropped_unless_kept():
    assert j.grade(box("-10"), ["10"]) and not j.grade(box("-10"), ["10"], keep_sign=True)
    assert j.grade(box(".5"), ["5"])  # the leading point goes like any mark


def test_typed_mode_leaves_surplus_answers_out():
    assert j.grade(box("1.5", "2.5", "9"), ["1.5", "2.5"], kinds=["NV", "NV"])
    assert not j.grade(box("1.5", "2.5", "9"), ["1.5", "2.5"])


def test_text_after_therefore_counts():
    assert not j.grade("\\boxed{5}. Therefore done", ["5"], strict=True)


def test_boxes():
    s = r"\boxed{1} so \boxed{\frac{a}{b}}, \boxed{2}. \boxed{3"
    assert br.all_boxes(s) == ["1", r"\frac{a}{b}", "2", "3"]
    assert br.last_group(s) == [r"\frac{a}{b}", "2"]
    assert br.last_group(r"\boxed{1}\quad\boxed{2}") == ["2"]
    assert br.last_box(r"x \fbox{4}") == "4" and br.last_box("none") is None and br.last_box(r"\boxed{1") is None
    assert br.top_commas(r"f(x, y), [0, 14], \{1, 2\}") == ["f(x, y)", "[0, 14]", "(1, 2)"]
    assert br.box_values(r"1, \frac{1, 2}{3}") == ["1", r"\frac{1, 2}{3}"] and br.box_values("(1, 2)") == ["(1, 2)"]


def test_repair_never_touches_aligned_answers():
    rng = random.Random(1)
    for _ in range(300):
        n, k = rng.randint(1, 4), rng.randint(0, 5)
        r = "text " + ", ".join(f"\\boxed{{{rng.randint(1, 4)}}}" for _ in range(k))
        new, changed = an.repaired(r, n)
        now = br.top_commas(an.extract(r)) if an.extract(r) else []
        assert not (changed and len(now) == n)
        if changed:
            assert len(br.top_commas(an.extract(new))) == n
        else:
            assert new == r
    assert an.repaired("x", None) == ("x", False)


def test_slots():
    assert j.slot_error("3", "3") == "slot_ok" and j.slot_error("3.1", "3.14159") == "numeric_close" and j.slot_error("17", "3") == "conceptual"
    assert j.row_error(["1"], ["1", "2"]) == "count_mismatch" and j.row_error(["3.1", "x"], ["3.14159", "y"]) == "numeric_close"
    assert j.rounded("3.14", "3.14159") and not j.rounded("3.15", "3.14159") and j.near("3.1", "3.11") and not j.near("3", "4")
    assert j.any_order(["2", "1"], ["1", "2"]) and not j.any_order(["2", "2"], ["1", "2"])
    assert j.any_order([str(i) for i in range(12)], [str(i) for i in reversed(range(12))])


def test_lenient():
    assert j.lenient(box("1", "2"), ["(1, 2)"]) and j.lenient("\\boxed{0.5}", ["\\frac{1}{2}"]) and not j.lenient("no box", ["1"]) and not j.lenient("\\boxed{3}", ["4"])


def test_canonical_votes():
    assert an.canonical_answer(box("0.50"), 1, False) == an.canonical_answer(box("\\frac{1}{2}"), 1, False)
    assert an.canonical_answer(box("1", "2"), 3, False) is None and an.canonical_answer(box("1, 2, 3"), 3, False) == ["1", "2", "3"]
    assert an.canonical_answer(box("BA"), 1, True) == ["BA"] and an.canonical_answer("\\boxed{B}", 1, True) is None


@pytest.mark.parametrize("s", ["", "\\frac{1}", "(1", "2 +", "\\unknowncmd x", "1/0", "1e", "\\left(", "}{"])
def test_unreadable(s):
    with pytest.raises((Unreadable, ZeroDivisionError)):
        evaluate(s + "*" if s == "1e" else s)


def test_values():
    assert number("2^{3}") == 8 and number("-2^2") == -4 and abs(number("\\sqrt[3]{-8}") + 2) < 1e-9 and number("3!") == 6 and number("x") is None
    assert abs(number("\\arcsin 1") - 1.5707963) < 1e-6 and number("|{-3}|") == 3 and number("1{,}0") is None


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_nothing_crashes(s):
    j.grade("\\boxed{" + s + "}", [s])
    j.grade(s, ["1"])
    an.repaired(s, 2)
    an.canonical_answer(s, 2, False)
    br.last_group(s)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 999), min_size=2, max_size=6), st.randoms())
def test_unordered_lists_and_letters(xs, rng):
    ys = xs[:]
    rng.shuffle(ys)
    assert j.unordered("(" + ", ".join(map(str, xs)) + ")", "(" + ", ".join(map(str, ys)) + ")")
    letters = [chr(65 + x % 26) for x in xs]
    mixed = letters[:]
    rng.shuffle(mixed)
    assert j.choices("".join(letters), "".join(mixed))
