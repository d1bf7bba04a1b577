"""Split fields that pack several values, choosing each field's dialect by description length.

A dialect says how values are separated (comma, semicolon, bar, tab, line, ideographic marks,
ampersand, the word *and*, a mixture), quoted (CSV quotes, literal lists), labelled ((a), 1) and
the like) and wrapped (boxes).  A parse costs the bits of naming its dialect plus the code
lengths of its values; the cheapest parse wins.  Value codes come from an order-2 model of
character classes, counted in parallel over the fields known to hold one value; the model has a
fixed number of cells (``CELLS``), so what reaches the driver and the workers never grows.

Separators inside brackets, maths, environments and quotes do not separate.

Defined results: null and empty fields give no rows; an empty slot keeps its number and gives
no row; a field whose cheapest parse is one value, or which no dialect splits into as many values
as expected, gives no rows.  Quotes, labels, boxes and outer blanks go, doubled quotes inside
quotes become single, all else stays as written.  Repeated rows are split each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PUNCT = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_CLASS = {c: 5 + i for i, c in enumerate(_PUNCT)}  # 0 edge, 1 digit, 2 lower, 3 upper, 4 space
K = 5 + len(_PUNCT) + 1  # the last is any other character
CELLS = K**3
SMOOTH = 0.02
#: Bits for one value too many or too few against the number of slots.
MISMATCH = 40.0

#: separator name -> (characters at depth 0 that separate, is the word "and" one, bits)
SEPARATORS = {
    "comma": (",", False, 1.0),
    "semicolon": (";", False, 2.0),
    "comma_and": (",", True, 3.0),
    "tab": ("\t", False, 3.0),
    "line": ("\n", False, 3.0),
    "bar": ("|", False, 3.0),
    "cjk_stop": ("、", False, 4.0),
    "cjk_comma": ("，", False, 4.0),
    "ampersand": ("&", False, 4.0),
    "cjk_semicolon": ("；", False, 5.0),
    "comma_semicolon": (",;", False, 6.0),
    "semicolon_and": (";", True, 6.0),
    "any": (",;|\t\n、，；", True, 12.0),
}
_LABELS = {
    "none": None,
    "(a)": re.compile(r"\s*\(([a-z])\)\s*"),
    "a.": re.compile(r"\s*([a-z])\.\s+"),
    "a)": re.compile(r"\s*([a-z])\)\s*"),
    "a:": re.compile(r"\s*([a-z]):\s*"),
    "(1)": re.compile(r"\s*\(([0-9]{1,2})\)\s*"),
    "1)": re.compile(r"\s*([0-9]{1,2})\)\s*"),
    "1.": re.compile(r"\s*([0-9]{1,2})\.\s+"),
    "1:": re.compile(r"\s*([0-9]{1,2}):\s*"),
}
_AND = re.compile(r"\s+and\s+")
_BEGIN = re.compile(r"\\(begin|end)\{[a-zA-Z*]+\}")


def classes(s: str) -> list[int]:
    """Character classes of a value between two edges."""
    out = [0, 0]
    for c in s:
        if c.isdigit():
            out.append(1)
        elif c.isalpha():
            out.append(K - 1 if c > "\x7f" else 2 if c.islower() else 3)
        elif c.isspace():
            out.append(4)
        else:
            out.append(_CLASS.get(c, K - 1))
    out.append(0)
    return out


def cells(s: str) -> list[int]:
    """Model cells (two classes of context, one class) that a value touches."""
    k = classes(s)
    return [(k[i] * K + k[i + 1]) * K + k[i + 2] for i in range(len(k) - 2)]


class ValueCode:
    """Code lengths (bits) of values from cell counts."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(K * K, K).astype(float) + SMOOTH
        self.bits = (-np.log2(c / c.sum(axis=1, keepdims=True))).ravel().tolist()

    def cost(self, v: str) -> float:
        """Bits of a value; an empty slot costs a byte."""
        bits = self.bits
        return sum(bits[i] for i in cells(v)) if v else 8.0


def count_cells(values: DataFrame) -> DataFrame:
    """``(cell, n)`` of a single string column: counted per task, then summed; at most ``CELLS`` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            flat = [i for v in b.iloc[:, 0] if v for i in cells(v.strip())]
            total += np.bincount(np.array(flat, np.int64), minlength=CELLS)
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"cell": hit, "n": total[hit]})

    return values.mapInPandas(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def learn_code(values: DataFrame) -> ValueCode:
    """The value code of a column of single values."""
    counts = np.zeros(CELLS, np.int64)
    for r in count_cells(values).collect():
        counts[r["cell"]] = r["n"]
    return ValueCode(counts)


def split_top(s: str, seps: str, and_: bool = False, quotes: bool = False) -> list[str] | None:
    """Cut at separators outside brackets, maths, environments and quotes; None if it never closes."""
    out, start, depth, env, maths, i, n = [], 0, 0, 0, False, 0, len(s)
    while i < n:
        c = s[i]
        if quotes and c == '"' and not s[start:i].strip():
            j = i + 1
            while True:  # to the closing quote; a doubled one stands for itself
                j = s.find('"', j)
                if j < 0:
                    return None
                if s[j + 1 : j + 2] != '"':
                    break
                j += 2
            i = j + 1
            continue
        if c == "\\":
            m = _BEGIN.match(s, i)
            if m:
                env += 1 if m[1] == "begin" else -1
                i = m.end()
                continue
            if s[i + 1 : i + 2] == "$":
                i += 2
                continue
        elif c == "$":
            maths = not maths
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)  # a label such as "1)" closes nothing
        top = depth <= 0 and env <= 0 and not maths
        if top and c in seps:
            out.append(s[start:i])
            start = i + 1
            if and_ and (m := _AND.match(s, start)):  # ", and" is one separator
                start = i = m.end()
                continue
        elif top and and_ and c.isspace():
            m = _AND.match(s, i)
            if m:
                out.append(s[start:i])
                start = i = m.end()
                continue
        i += 1
    out.append(s[start:])
    return None if depth > 0 or env > 0 or maths else out


def _unquote(f: str) -> str | None:
    t = f.strip()
    if len(t) >= 2 and t[0] == t[-1] == '"' and not re.search(r'(?<!")"(?:"")*(?!")', t[1:-1]):
        return t[1:-1].replace('""', '"')
    return None


def _items(s: str) -> list[str] | None:
    """Values of a literal list of quoted strings, such as ["a", "b"] or ['a', 'b']."""
    t = s.strip()
    if len(t) < 4 or t[0] != "[" or t[-1] != "]":
        return None
    body, out, i = t[1:-1].strip(), [], 0
    q = body[:1]
    if q not in "\"'" or not q:
        return None
    end = re.compile(rf"(?<!\\){q}\s*(?:,\s*(?={q})|$)")
    while i < len(body):
        if body[i] != q:
            return None
        m = end.search(body, i + 1)
        if not m:
            return None
        v = body[i + 1 : m.start()]
        if re.fullmatch(r"(?:[^\\]|\\[\\\"'/])*", v):
            v = re.sub(r"\\([\\\"'/])", r"\1", v)
        out.append(v)
        i = m.end()
    return out


def _boxes(s: str) -> list[str] | None:
    """Contents of a field that is a row of boxes and nothing else but separators."""
    out, i = [], 0
    t = s.strip()
    while i < len(t):
        m = re.compile(r"\$?\\f?boxed\s*\{|\$?\\fbox\s*\{").match(t, i)
        if not m:
            return None
        depth, j = 1, m.end()
        while j < len(t) and depth:
            depth += (t[j] == "{") - (t[j] == "}")
            j += 1
        if depth:
            return None
        out.append(t[m.end() : j - 1])
        i = re.compile(r"\$?\s*(?:[,;|&、，]|and\b)?\s*(?:and\s+)?").match(t, j).end()
    return out or None


def parses(s: str) -> Iterator[tuple[str, float, list[str]]]:
    """Every ``(dialect, bits, values)`` of a field, the single value among them."""
    yield "single", 0.0, [s.strip()]
    if (v := _items(s)) is not None:
        yield "list", 2.0, [x.strip() for x in v]
    if (v := _boxes(s)) is not None:
        yield "boxes", 2.0, [x.strip() for x in v]
    for name, (chars, and_, bits) in SEPARATORS.items():
        if not any(c in s for c in chars) and not (and_ and " and " in s):
            continue
        for quotes in (False, True) if '"' in s else (False,):
            fields = split_top(s, chars, and_, quotes)
            if fields is None or len(fields) < 2:
                continue
            extra = 0.0
            if quotes:
                opened = [_unquote(f) for f in fields]
                if all(o is None for o in opened):
                    continue
                fields, extra = [f if o is None else o for f, o in zip(fields, opened)], 1.5
            for label, rx in _LABELS.items():
                if rx is None:
                    yield f"{name}{'/quoted' * quotes}", bits + extra, [f.strip() for f in fields]
                    continue
                got = [rx.match(f) for f in fields]
                if all(got) and all((ord(m[1]) - 96 if m[1].isalpha() else int(m[1])) == i + 1 for i, m in enumerate(got)):
                    yield f"{name}/{label}", bits + extra + 3.0, [f[m.end() :].strip() for f, m in zip(fields, got)]


def cheapest(s: str, slots: int, code: ValueCode) -> tuple[str, list[str]]:
    """The dialect and values of the shortest description, given the number of slots."""
    best: tuple[float, str, list[str]] | None = None
    for name, bits, values in parses(s):
        total = bits + sum(map(code.cost, values)) + MISMATCH * abs(len(values) - slots)
        if best is None or total < best[0]:
            best = (total, name, values)
    return best[1], best[2]


def parsed_fields(df: DataFrame, field: str, slots: Column, *, key: str = "scan_idx") -> DataFrame:
    """``(key, slots, dialect, vals)``: the cheapest parse of every field with more than one slot.

    Fields whose parse has another number of values than slots are among them.

    The first pass counts the code over the rows with fewer than two slots, the second parses;
    neither shuffles more than ``CELLS`` counts a task.
    """
    base = df.select(df[key].alias("_key"), df[field].cast("string").alias("_field"), slots.cast("int").alias("_slots")).where("_field is not null")
    code = df.sparkSession.sparkContext.broadcast(learn_code(base.where("coalesce(_slots, 0) < 2").select("_field")))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [cheapest(s, n, code.value) for s, n in zip(b["_field"], b["_slots"])]
            yield pd.DataFrame({key: b["_key"], "slots": b["_slots"], "dialect": [g[0] for g in got], "vals": [g[1] for g in got]})

    return base.where("_slots >= 2").mapInPandas(run, f"`{key}` {kind}, slots int, dialect string, vals array<string>")


def split_values(df: DataFrame, field: str, slots: Column, *, key: str = "scan_idx") -> DataFrame:
    """``(key, pos, val, dialect)``: one row per value of every field that packs ``slots`` > 1 values.

    An empty slot keeps its number and gives no row; a field that no parse divides into its number
    of slots gives none at all (see ``unparsed``).
    """
    whole = parsed_fields(df, field, slots, key=key).where(F.size("vals") == F.col("slots"))
    return whole.select(key, "dialect", F.posexplode("vals").alias("p", "val")).where("val <> ''").select(key, (F.col("p") + 1).alias("pos"), "val", "dialect")


def unparsed(df: DataFrame, field: str, slots: Column, *, key: str = "scan_idx") -> DataFrame:
    """``(key, slots, dialect, found)``: fields whose cheapest parse has another number of values than slots."""
    return parsed_fields(df, field, slots, key=key).where(F.size("vals") != F.col("slots")).select(key, "slots", "dialect", F.size("vals").alias("found"))
