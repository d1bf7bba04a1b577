"""Numeric evaluation of LaTeX and plain expressions: a recursive-descent parser to complex numbers.

No computer algebra is needed: two expressions count as equal when they agree at fixed sample
points.  What the grammar does not know raises :class:`Unreadable`, and callers fall back to
comparing strings.
"""

from __future__ import annotations

import cmath
import math
import re
from collections.abc import Callable

from tallgrass.functions import fixed_values as fx


class Unreadable(ValueError):
    """The text is no expression of the grammar."""


_TOKEN = re.compile(r"\s*(\d+\.\d*|\.\d+|\d+|\\[A-Za-z]+|\\.|[A-Za-z]|\*\*|[-+*/^_!|(){}\[\],'=<>])")
_ONE: dict[str, Callable[[complex], complex]] = {
    "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "cot": lambda z: 1 / cmath.tan(z), "sec": lambda z: 1 / cmath.cos(z), "csc": lambda z: 1 / cmath.sin(z),
    "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "arccot": lambda z: math.pi / 2 - cmath.atan(z), "arcsec": lambda z: cmath.acos(1 / z), "arccsc": lambda z: cmath.asin(1 / z),
    "sinh": cmath.sinh, "cosh": cmath.cosh, "tanh": cmath.tanh, "coth": lambda z: 1 / cmath.tanh(z), "sech": lambda z: 1 / cmath.cosh(z), "csch": lambda z: 1 / cmath.sinh(z),
    "ln": cmath.log, "log": cmath.log, "exp": cmath.exp, "sgn": lambda z: (z.real > 0) - (z.real < 0), "sign": lambda z: (z.real > 0) - (z.real < 0),
}
_BINOM = ("binom", "dbinom", "tbinom")
_FRAC = ("frac", "dfrac", "tfrac", "cfrac")
_CLOSE = {"(": ")", "[": "]", "{": "}", "|": "|", "\\{": "\\}"}
#: Sample points of successive variables; irrational and small, so that powers stay in range.
POINTS = (0.7390851332, 1.2020569032, 1.6449340668, 0.5772156649, 2.2360679775, 0.9159655942)


def tokens(s: str) -> list[str]:
    """Lexical tokens; size commands and spacing are dropped."""
    out, i = [], 0
    s = re.sub(r"\\(?:left|right|bigg?|Bigg?|displaystyle|!|,|;|:|quad|qquad)(?![A-Za-z])", " ", s).replace("\\ ", " ").replace("$", " ").rstrip()
    while i < len(s):
        m = _TOKEN.match(s, i)
        if not m:
            raise Unreadable(s[i : i + 10])
        out.append(m[1])
        i = m.end()
    return out


class _Parser:
    def __init__(self, text: str, point: int):
        self.t, self.i, self.point = tokens(text), 0, point
        self.names: dict[str, complex] = {}

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def take(self, want: str = "") -> str:
        x = self.peek()
        if not x or (want and x != want):
            raise Unreadable(f"{want or 'more'} expected, not {x or 'the end'}")
        self.i += 1
        return x

    def sum(self) -> complex:
        sign = 1
        while self.peek() in ("+", "-"):
            sign = -sign if self.take() == "-" else sign
        v = sign * self.product()
        while self.peek() in ("+", "-"):
            v = v + self.product() if self.take() == "+" else v - self.product()
        return v

    def product(self) -> complex:
        v = self.power()
        while True:
            p = self.peek()
            if p in ("*", "\\cdot", "\\times"):
                self.take()
                v *= self.signed()
            elif p in ("/", "\\div"):
                self.take()
                v /= self.signed()
            elif p and (p[0].isalnum() or p[0] == "." or p in ("(", "{", "[", "\\{") or (p[0] == "\\" and p[1:].isalpha())):
                v *= self.power()
            else:
                return v

    def signed(self) -> complex:
        return -self.signed() if self.peek() == "-" and self.take() else self.power()

    def power(self) -> complex:
        v = self.atom()
        while self.peek() == "!":
            self.take()
            if abs(v.imag) > 1e-12 or v.real < 0 or v.real > 170 or abs(v.real - round(v.real)) > 1e-9:
                raise Unreadable("factorial")
            v = complex(math.factorial(round(v.real)))
        if self.peek() in ("^", "**"):
            self.take()
            v = v ** self.exponent()
        return v

    def exponent(self) -> complex:
        if self.peek() == "-":
            self.take()
            return -self.exponent()
        v = self.argument()
        return v ** self.exponent() if self.peek() in ("^", "**") and self.take() else v

    def group(self, left: str) -> complex:
        self.take(left)
        v = self.sum()
        self.take(_CLOSE[left])
        return v

    def argument(self) -> complex:
        """A braced group or a single token, as TeX reads an argument."""
        if self.peek() == "{":
            return self.group("{")
        x = self.peek()
        if len(x) > 1 and x[0].isdigit() and "." not in x:  # \frac12 takes one digit each
            self.t[self.i : self.i + 1] = list(x)
        return self.atom()

    def atom(self) -> complex:
        x = self.peek()
        if x in ("(", "[", "{", "\\{"):
            return self.group(x)
        if x == "|":
            self.take()
            v = self.sum()
            self.take("|")
            return complex(abs(v))
        self.take()
        if x[0].isdigit() or x[0] == ".":
            return complex(float(x))
        if x[0] == "\\":
            return self.command(x[1:])
        if x.isalpha():
            if x == "e":
                return complex(math.e)
            return 1j if x == "i" else self.variable(x)
        raise Unreadable(x)

    def command(self, name: str) -> complex:
        if name in _FRAC:
            a = self.argument()
            return a / self.argument()
        if name in _BINOM:
            n, k = self.argument(), self.argument()
            return complex(math.comb(round(n.real), round(k.real)))
        if name == "sqrt":
            n = self.group("[") if self.peek() == "[" else 2
            v = self.argument()
            if abs(v.imag) < 1e-15 and v.real < 0 and abs(n - round(complex(n).real)) < 1e-12 and round(complex(n).real) % 2 == 1:
                return -((-v) ** (1 / n))
            return v ** (1 / n)
        if name in _ONE:
            base = None
            if name == "log" and self.peek() == "_":
                self.take()
                base = self.argument()
            e = self.exponent() if self.peek() == "^" and self.take() else None
            v = self.argument() if self.peek() in ("(", "{", "[", "|") else self.simple()
            if e == -1 and "arc" + name in _ONE:
                return _ONE["arc" + name](v)
            w = cmath.log(v) / cmath.log(base) if base is not None else _ONE[name](v)
            return w**e if e is not None else w
        if name == "pi":
            return complex(math.pi)
        if name == "infty":
            return complex(math.inf)
        if name in ("mathrm", "text", "mathbf", "operatorname", "textbf"):
            return self.argument()
        if name in fx.GREEK:
            return self.variable(name)
        raise Unreadable("\\" + name)

    def simple(self) -> complex:
        """Argument of a function without brackets: a product without further functions, as in sin 2x."""
        v = self.power()
        while (p := self.peek()) and (p.isalnum() or p[:1] == "." or p in ("\\pi",)):
            v *= self.power()
        return v

    def variable(self, name: str) -> complex:
        if self.peek() == "_":
            self.take()
            start = self.i
            try:
                self.argument()
            except Unreadable:
                raise
            name += "_" + "".join(self.t[start : self.i])
        if name not in self.names:
            # by the name, so that both sides of a comparison give a name the same value
            k = sum(ord(c) * (j + 1) for j, c in enumerate(name))
            self.names[name] = complex(POINTS[(k + self.point) % len(POINTS)] * (1 + 0.137 * ((k * 7 + self.point * 3) % 11)))
        return self.names[name]


def evaluate(text: str, point: int = 0) -> tuple[complex, bool]:
    """Value at a sample point and whether the expression has variables."""
    p = _Parser(text, point)
    try:
        v = p.sum()
    except (ZeroDivisionError, OverflowError, ValueError, RecursionError) as e:
        raise Unreadable(str(e)) from None
    if p.i < len(p.t):
        raise Unreadable(p.peek())
    return complex(v), bool(p.names)


def number(text: str) -> float | None:
    """Real value of a text without variables; None where there is none."""
    try:
        v, free = evaluate(text)
    except Unreadable:
        return None
    return None if free or abs(v.imag) > 1e-9 * max(1, abs(v)) or math.isnan(v.real) else v.real


def close(a: complex, b: complex, tolerance: float = 1e-8) -> bool:
    """Equality up to rounding; infinities equal themselves only."""
    if a == b:
        return True
    if any(math.isinf(x) or math.isnan(x) for x in (a.real, b.real)):
        return False
    return abs(a - b) <= tolerance * max(1.0, abs(b))
