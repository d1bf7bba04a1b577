"""Comparing answers: kinds of comparison, automatic grading, and the Arrow functions around them."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Sequence
from itertools import permutations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.functions import answers as an
from tallgrass.functions import brackets as br
from tallgrass.functions.latexeval import POINTS, Unreadable, close, evaluate, number

_SCIENTIFIC = re.compile(r"(-?\d+(?:\.\d+)?)(?:\*|\\times|\\cdot)10\^\{?(-?\d+)\}?")


def _plain(s: str) -> float | None:
    try:
        return float(s)
    except ValueError:
        return None


def _relative(a: float, b: float, tolerance: float) -> bool:
    return b != 0 and abs((a - b) / b) <= tolerance * 1.01


def _scientific(s: str) -> tuple[float, int] | None:
    m = _SCIENTIFIC.fullmatch(s)
    return (float(m[1]), int(m[2])) if m else None


def numeric(pred: str, gold: str, tolerance: float = 1e-8) -> bool:
    """Equal numbers: same text, floats with gold rounded to six places, or values of expressions.

    The tolerance is relative; a gold of 0 wants exactly 0.  A number and one in scientific
    notation (or two of them) are also equal with the same exponent and mantissas within 0.101.
    """
    if pred == gold:
        return True
    a, b = _plain(pred), _plain(gold)
    if a is not None and b is not None and _relative(a, round(b, 6), tolerance):
        return True
    x, y = number(pred), number(gold)
    if x is None or y is None:
        return False
    if _relative(x, y, tolerance) or x == y:
        return True
    p, g = _scientific(pred), _scientific(gold)
    if (p is None) != (g is None):
        p = p or _of(x)
        g = g or _of(y)
    return p is not None and g is not None and p[1] == g[1] and abs(p[0] - g[0]) <= 0.101


def _of(v: float) -> tuple[float, int]:
    m, e = f"{v:.2e}".split("e")
    return float(m), int(e)


def expression(pred: str, gold: str, tolerance: float = 1e-8) -> bool:
    """Equal expressions: right-hand sides that agree as numbers or at every sample point."""
    a, b = (x.split("=")[1].strip() if "=" in x else x.strip() for x in (pred, gold))
    if not a or not b:
        return False
    (va, free_a), (vb, free_b) = evaluate(a), evaluate(b)
    if not free_a and not free_b:
        return close(va, vb, tolerance) or numeric(a, b, tolerance)
    for k in range(len(POINTS)):
        if not close(evaluate(a, k)[0], evaluate(b, k)[0], max(tolerance, 1e-8)):
            return False
    return True


def equation(pred: str, gold: str, tolerance: float = 1e-8) -> bool:
    """Equations whose differences of sides are an integer multiple of each other."""
    sides = [x.split("=") for x in (pred, gold)]
    if any(len(s) != 2 for s in sides):
        return False
    ratio = None
    for k in range(len(POINTS)):
        a, b = (evaluate(s[0], k)[0] - evaluate(s[1], k)[0] for s in sides)
        if close(a, b, 1e-9):
            r = 1.0 + 0j
        elif abs(b) < 1e-12 or abs(a) < 1e-12:
            return False
        else:
            r = a / b
        if ratio is not None and not close(r, ratio, 1e-7):
            return False
        ratio = r
    return any(abs(x.imag) < 1e-7 and round(x.real) != 0 and abs(x.real - round(x.real)) < 1e-6 for x in (ratio, 1 / ratio))


def interval(pred: str, gold: str, tolerance: float = 1e-8) -> bool:
    """Unions of intervals with the same kinds of ends and equal bounds, in any order."""

    def parts(s: str) -> list[tuple[bool, bool, list[str]]]:
        return [(p.startswith("("), p.endswith(")"), p.strip("()[]").split(",")) for p in (x.strip() for x in s.split("\\cup"))]

    mine, theirs = parts(pred), parts(gold)
    if len(mine) != len(theirs) or any(len(p[2]) < 2 for p in (*mine, *theirs)):
        return False
    for a in mine:
        for b in theirs:
            if a[:2] == b[:2] and expression(a[2][0], b[2][0], tolerance) and expression(a[2][1], b[2][1], tolerance):
                theirs.remove(b)
                break
        else:
            return False
    return True


def true_false(pred: str, gold: str, tolerance: float = 0) -> bool:
    """``True`` or ``False`` and equal."""
    return gold in ("True", "False") and pred == gold


def open_text(pred: str, gold: str, tolerance: float = 0) -> bool:
    """Equal text in any case."""
    return pred.lower() == gold.lower()


def choices(pred: str, gold: str, tolerance: float = 0) -> bool:
    """The same chosen letters in any order."""
    return Counter(c for c in pred if "A" <= c <= "Z") == Counter(gold) if gold else False


def choice(pred: str, gold: str, tolerance: float = 0) -> bool:
    """The same letter, or a letter with its text after a colon."""
    if pred.lower() == gold.lower():
        return True
    p = pred.strip("[]") if pred[:1] == "[" and pred[-1:] == "]" else pred
    return len(p) > 1 and "A" <= p[0] <= "Z" and p[1] == ":" and p[0] == gold


def ordered(pred: str, gold: str, tolerance: float = 1e-8) -> bool:
    """Lists with equal elements place by place."""
    a, b = br.top_commas(pred.strip("()<>")), br.top_commas(gold.strip("()"))
    return len(a) == len(b) and all(equal(x, y, tolerance, lists=False) for x, y in zip(a, b))


def unordered(pred: str, gold: str, tolerance: float = 1e-8) -> bool:
    """Lists that can be matched element by element, first match taken."""
    a, b = br.top_commas(pred.strip("()<>")), br.top_commas(gold.strip("()"))
    if len(a) != len(b):
        return False
    for y in b:
        hit = next((x for x in a if equal(x, y, tolerance, lists=False)), None)
        if hit is None:
            return False
        a.remove(hit)
    return True


KINDS: dict[str, Callable[[str, str, float], bool]] = {
    "UOL": unordered, "OL": ordered, "INT": interval, "TF": true_false, "EX": expression, "EQ": equation, "OE": open_text, "MCM": choices, "MCS": choice, "NV": numeric,
}


#: Comparisons that a row may cost: long lists against long lists would otherwise stall a task.
BUDGET = 50_000
_spent = 0


class Exhausted(Exception):
    """A row has used up its comparisons."""


def within_budget(judge: Callable[[], bool]) -> bool:
    """What a judgement says within its budget of comparisons; beyond it, the answers are not equal."""
    global _spent
    _spent = 0
    try:
        return judge()
    except Exhausted:
        return False


def compare(kind: str, pred: str, gold: str, tolerance: float = 1e-8) -> bool:
    """Comparison of one kind; what cannot be read is not equal."""
    global _spent
    _spent += 1
    if _spent > BUDGET:
        raise Exhausted
    try:
        return bool(KINDS[kind](pred, gold, tolerance))
    except (Unreadable, ValueError, IndexError, OverflowError, ZeroDivisionError, RecursionError):
        return False


def equal(pred: str, gold: str, tolerance: float = 1e-8, lists: bool = True) -> bool:
    """Equality of any kind, tried in the order of ``KINDS``; lists within lists are not lists."""
    return any(compare(k, pred, gold, tolerance) for k in KINDS if lists or k not in ("UOL", "OL"))


def cause(response: str, gold: Sequence[str]) -> str:
    """Why a response is wrong: nothing extracted, another count, or its main value error; ``ok`` where it is right."""
    said = an.extract(response)
    got = br.top_commas(said) if said else []
    if not got:
        return "noextract"
    if len(got) != len(gold):
        return "align"
    if within_budget(lambda: all(equal(an.normal(p), an.normal(g)) for p, g in zip(got, gold))):
        return "ok"
    try:
        return row_error(got, gold)
    except Exhausted:
        return "conceptual"


def grade(response: str, gold: Sequence[str], kinds: Sequence[str] | None = None, tolerance: float = 1e-8, keep_sign: bool = False, strict: bool = False) -> bool:
    """Whether a response's answers are the gold ones: extract, cut, normalise, count, compare by place.

    With ``kinds`` each slot is compared by its own kind only, and answers beyond the kinds are
    left out before counting.
    """
    got = an.extract(response, strict)
    if not got:
        return False
    pred = br.top_commas(got)
    if kinds is None:
        pred = [an.normal(p, keep_sign=keep_sign) for p in pred]
        gold = [an.normal(g, keep_sign=keep_sign) for g in gold]
        return len(pred) == len(gold) and all(equal(p, g, tolerance) for p, g in zip(pred, gold))
    pred = [an.normal(p, k, keep_sign) for p, k in zip(pred, kinds)]
    gold = [an.normal(g, k, keep_sign) for g, k in zip(gold, kinds)]
    return len(pred) == len(gold) and all(compare(k, p, g, tolerance) for k, p, g in zip(kinds, pred, gold))


def lenient(response: str, gold: Sequence[str]) -> bool:
    """Whether each gold answer is in some box, by light text or value within 1e-3."""

    def text(s: str) -> str:
        for a, b in ((" ", ""), ("\\,", ""), ("\\left", ""), ("\\right", ""), ("\\dfrac", "\\frac"), ("\\tfrac", "\\frac")):
            s = s.replace(a, b)
        return s.strip().strip("$").lower()

    def same(a: str, b: str) -> bool:
        if text(a) == text(b):
            return True
        x, y = number(a.replace("%", "")), number(b.replace("%", ""))
        return x is not None and y is not None and abs(x - y) <= 1e-3 * max(1.0, abs(y)) or compare("EX", b, a)

    found = br.all_boxes(response)
    for g in gold:
        if any(same(g, b) for b in found):
            continue
        pair = re.fullmatch(r"\(?\s*([^,]+)\s*,\s*([^,)]+)\s*\)?", g)
        if not pair or not all(any(same(p, b) for b in found) for p in pair.groups()):
            return False
    return bool(found)


def rounded(pred: str, gold: str) -> bool:
    """Whether a prediction is the gold value rounded to the decimals it shows."""
    p, g = number(pred), number(gold)
    if p is None or g is None:
        return False
    s = pred.strip()
    d = len(s.split(".")[1]) if "." in s and re.fullmatch(r"-?\d*\.?\d+", s) else 0
    return abs(round(g, d) - p) < 0.5 * 10**-d + 1e-9 if d else round(g) == p and abs(g - p) < 0.5


def near(pred: str, gold: str, tolerance: float = 1e-2) -> bool:
    """Values within a share of the gold one (of 1 where it is smaller)."""
    p, g = number(pred), number(gold)
    return p is not None and g is not None and abs(p - g) <= tolerance * max(1.0, abs(g))


def slot_error(pred: str, gold: str) -> str:
    """Kind of a slot's error: ok, equiv_normalizer, numeric_close, rounding_precision or conceptual."""
    p, g = an.normal(pred), an.normal(gold)
    if equal(p, g):
        return "slot_ok"
    if an.light(pred).replace(" ", "").lower() == an.light(gold).replace(" ", "").lower():
        return "equiv_normalizer"
    a, b = number(p), number(g)
    if a is not None and b is not None:
        if b and 1.01e-8 < abs(a - b) / abs(b) <= 0.05:
            return "numeric_close"
        if any(round(a, d) == round(b, d) for d in range(1, 7)):
            return "rounding_precision"
    return "conceptual"


PRIORITY = ("equiv_normalizer", "rounding_precision", "numeric_close", "conceptual")


def row_error(pred: Sequence[str], gold: Sequence[str]) -> str:
    """Main error of a row: a count mismatch, else the first of ``PRIORITY`` among its wrong slots."""
    if len(pred) != len(gold):
        return "count_mismatch"
    kinds = {slot_error(p, g) for p, g in zip(pred, gold)}
    return next((k for k in PRIORITY if k in kinds), "slot_ok")


def any_order(pred: Sequence[str], gold: Sequence[str], most: int = 8) -> bool:
    """Whether some order of the predictions matches every slot; long lists are matched greedily."""
    if len(pred) != len(gold):
        return False
    table = [[equal(an.normal(p), an.normal(g)) for g in gold] for p in pred]
    if len(pred) <= most:
        return any(all(table[i][j] for i, j in enumerate(order)) for order in permutations(range(len(gold))))
    free = set(range(len(pred)))
    for j in range(len(gold)):
        hit = next((i for i in sorted(free) if table[i][j]), None)
        if hit is None:
            return False
        free.remove(hit)
    return True


# --- Arrow functions: whole batches cross to Python once ---------------------------------------


@F.pandas_udf(T.BooleanType())
def grade_udf(response: pd.Series, gold: pd.Series) -> pd.Series:
    """Automatic grading of a response against its gold answers; null responses are wrong."""
    return pd.Series([r is not None and g is not None and within_budget(lambda: grade(r, list(g))) for r, g in zip(response, gold)])


@F.pandas_udf(T.BooleanType())
def lenient_udf(response: pd.Series, gold: pd.Series) -> pd.Series:
    """Lenient grading by any box."""
    return pd.Series([r is not None and g is not None and within_budget(lambda: lenient(r, list(g))) for r, g in zip(response, gold)])


@F.pandas_udf(T.BooleanType())
def equal_udf(pred: pd.Series, gold: pd.Series) -> pd.Series:
    """Equality of two answers of any kind, after normalising both."""
    return pd.Series([p is not None and g is not None and within_budget(lambda: equal(an.normal(p), an.normal(g))) for p, g in zip(pred, gold)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def extracted_udf(response: pd.Series) -> pd.Series:
    """Answers a response gives, cut at top-level commas."""
    said = ("" if r is None else an.extract(r) for r in response)
    return pd.Series([br.top_commas(s) if s else [] for s in said])


@F.pandas_udf(T.ArrayType(T.StringType()))
def last_group_udf(response: pd.Series) -> pd.Series:
    """Boxes of the last group after the reasoning, braces of any depth."""
    return pd.Series([[] if r is None else br.last_group(re.split(an.fx.CLOSE_TAG, r)[-1]) for r in response])


@F.pandas_udf(T.ArrayType(T.StringType()))
def canonical_udf(response: pd.Series, blanks: pd.Series, is_mcq: pd.Series) -> pd.Series:
    """Canonical answers, the key of a vote."""
    return pd.Series([None if r is None else an.canonical_answer(r, int(n), bool(m)) for r, n, m in zip(response, blanks, is_mcq)])


@F.pandas_udf(T.StructType([T.StructField("response", T.StringType()), T.StructField("changed", T.BooleanType())]))
def repaired_udf(response: pd.Series, blanks: pd.Series) -> pd.DataFrame:
    """Repaired response and whether it changed; nothing is done without a number of blanks."""
    rows = [("" if r is None else r, False) if r is None or n is None or math.isnan(n) else an.repaired(r, int(n)) for r, n in zip(response, blanks)]
    return pd.DataFrame(rows, columns=["response", "changed"])


@F.pandas_udf(T.StringType())
def cause_udf(response: pd.Series, gold: pd.Series) -> pd.Series:
    """Why each response is wrong; answers are extracted once."""
    return pd.Series(["noextract" if r is None or g is None else cause(r, list(g)) for r, g in zip(response, gold)])


@F.pandas_udf(T.BooleanType())
def any_order_udf(pred: pd.Series, gold: pd.Series) -> pd.Series:
    """Whether some order of the predictions matches."""
    return pd.Series([p is not None and g is not None and within_budget(lambda: any_order(list(p), list(g))) for p, g in zip(pred, gold)])


@F.pandas_udf(T.IntegerType())
def rounding_udf(pred: pd.Series, gold: pd.Series) -> pd.Series:
    """Bits of how a row nearly matches in all slots: 1 within 1 %, 2 within 0.1 %, 4 gold rounded to the shown digits."""

    def bits(p: Sequence[str], g: Sequence[str]) -> int:
        pairs = [(an.normal(a), an.normal(b)) for a, b in zip(p, g)]
        tests = (lambda a, b: near(a, b, 1e-2), lambda a, b: near(a, b, 1e-3), rounded)
        return sum(1 << k for k, t in enumerate(tests) if all(t(a, b) for a, b in pairs))

    return pd.Series([0 if p is None or g is None or len(p) != len(g) else bits(list(p), list(g)) for p, g in zip(pred, gold)])
