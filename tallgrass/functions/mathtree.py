"""Mathematical answers as small trees: read once, rewritten by rules over pieces, printed in one form.

A piece is a token (number, letters, command, sign) or a :class:`Group` in brackets.  Rules look at
pieces, never at characters, so that what an answer says and how it was typed stay apart.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from tallgrass.functions import fixed_values as fx

_LEX = re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\{[lcr]*\})?|\\[A-Za-z]+\*?|\\.|\d+\.\d+|\.\d+|\d+|[A-Za-z]+|\s+|.", re.S)
_KNOWN = re.compile("|".join(sorted((*fx.FUNCTIONS, "sqrt", "frac", "asin", "acos", "atan"), key=len, reverse=True)) + r"|pi(?![A-Za-z])|[A-Za-z]")
_CLOSES = {"(": ")]", "[": ")]", "{": "}", "\\{": "\\}", "\\langle": "\\rangle"}
_CLOSERS = {")", "]", "}", "\\}", "\\rangle"}
_NUMBER = re.compile(r"\d+\.\d+|\.\d+|\d+")


@dataclass
class Group:
    """Pieces in brackets; ``right`` is empty where nothing closes them."""

    left: str
    inside: list = field(default_factory=list)
    right: str = ""


Pieces = list


def pieces(text: str) -> Pieces:
    """The tree of a text; brackets that match nothing stay tokens."""
    stack: list[Group] = [Group("")]
    for m in _LEX.finditer(text):
        t = m[0]
        if t in _CLOSES:
            stack.append(Group(t))
        elif t in _CLOSERS:
            k = next((i for i in range(len(stack) - 1, 0, -1) if t == _CLOSES[stack[i].left] or (len(t) == 1 and t in _CLOSES[stack[i].left])), 0)
            if not k:
                stack[-1].inside.append(t)
                continue
            while len(stack) > k + 1:  # left open inside
                _spill(stack)
            done = stack.pop()
            done.right = t
            stack[-1].inside.append(done)
        else:
            stack[-1].inside.append(t)
    while len(stack) > 1:
        _spill(stack)
    return stack[0].inside


def _spill(stack: list[Group]) -> None:
    g = stack.pop()
    stack[-1].inside += [g.left, *g.inside]


def shown(ps: Pieces) -> str:
    """The text of a tree."""
    return "".join(p if isinstance(p, str) else p.left + shown(p.inside) + p.right for p in ps)


def braced(ps: Pieces) -> Group:
    """Pieces as one argument."""
    return Group("{", ps, "}")


def deep(rule: Callable[[Pieces], Pieces], ps: Pieces) -> Pieces:
    """A rule applied to all levels, inner ones first."""
    return rule([p if isinstance(p, str) else Group(p.left, deep(rule, p.inside), p.right) for p in ps])


def parts(ps: Pieces, at: str) -> list[Pieces]:
    """Pieces between the tokens ``at`` of the outer level."""
    out: list[Pieces] = [[]]
    for p in ps:
        if p == at:
            out.append([])
        else:
            out[-1].append(p)
    return out


# --- rules of writing: applied to all levels ----------------------------------------------------


def commands(ps: Pieces) -> Pieces:
    """Names of commands made one: signs, fractions, spacing and styles without effect, environments."""
    out: Pieces = []
    styled = False  # whether a braced group here is the argument of a style
    for p in ps:
        if isinstance(p, Group):
            out += p.inside if styled and p.left == "{" else [p]
        elif not p.strip(" "):
            continue
        elif p in fx.STYLES:
            styled = True
            continue
        elif p[:1] == "\\" and p.endswith("}"):
            out.append(_environment(p))
        elif p not in fx.SPACES:
            out.append(fx.ONE_NAME.get(p, p))
        styled = False
    return [q for q in out if q != ""]


def _environment(p: str) -> str:
    """The begin or end of an environment: all matrices are arrays, those of layout only are nothing."""
    side, _, name = p.partition("{")
    name = name.partition("}")[0]
    return side + "{array}" if name == "array" or name.endswith("matrix") else "" if name in fx.PLAIN_ENVIRONMENTS else p


def names(ps: Pieces) -> Pieces:
    """Runs of letters cut into functions, constants and single letters."""
    out: Pieces = []
    for p in ps:
        if isinstance(p, str) and p.isalpha() and p.isascii() and len(p) > 1:
            found = _KNOWN.findall(p)
            out += ["\\" + fx.ARC_NAMES.get(w, w) if len(w) > 1 else w for w in found]
        else:
            out.append(p)
    if any(p == "j" for p in out) and not any(p == "i" for p in out):
        out = ["i" if p == "j" else p for p in out]
    return out


def arguments(ps: Pieces) -> Pieces:
    """Every fraction, root, power and index with braced arguments, as TeX reads them."""
    todo, out = list(reversed(ps)), []

    def argument() -> Group | None:
        if not todo:
            return None
        p = todo.pop()
        if isinstance(p, Group):
            return Group("{", p.inside, "}") if p.left == "{" or p.left == "[" else p
        if _NUMBER.fullmatch(p) and len(p) > 1 and "." not in p:  # one digit each
            todo.append(p[1:])
            return braced([p[0]])
        return braced([p])

    while todo:
        p = todo.pop()
        if p == "\\frac":
            a, b = argument(), argument()
            out += [p, *(x if isinstance(x, Group) and x.left == "{" else braced([x]) for x in (a, b) if x is not None)]
        elif p == "\\sqrt":
            out.append(p)
            if todo and isinstance(todo[-1], Group) and todo[-1].left == "[":
                out.append(todo.pop())
            a = argument()
            if a is not None:
                out.append(Group("{", a.inside, "}"))
        elif p == "^" and todo:
            a = todo.pop()
            if isinstance(a, Group) and shown(a.inside) in fx.DEGREE or a in fx.DEGREE:
                continue
            if isinstance(a, Group):
                out += [p, Group("{", a.inside, "}") if a.left in "{[" else a]
            else:
                out += [p, a]
        elif isinstance(p, str) and p in fx.DEGREE and out and _numeric(out[-1]):
            continue
        else:
            out.append(p)
    return out


def _numeric(p) -> bool:
    return isinstance(p, str) and bool(_NUMBER.fullmatch(p)) or isinstance(p, Group) and p.left == "{"


def powers(ps: Pieces) -> Pieces:
    """Powers of functions braced; the power -1 of sine, cosine and tangent is the inverse function."""
    out: Pieces = []
    i = 0
    while i < len(ps):
        p = ps[i]
        if isinstance(p, str) and p[:1] == "\\" and p[1:] in fx.FUNCTIONS and i + 2 < len(ps) and ps[i + 1] == "^":
            e = ps[i + 2]
            said = shown(e.inside) if isinstance(e, Group) else e
            if said.strip("()") == "-1" and "arc" + p[1:] in fx.FUNCTIONS:
                out.append("\\arc" + p[1:])
                i += 3
                continue
            if isinstance(e, str) and e.isdigit():
                out += [p, "^", braced([e])]
                i += 3
                continue
        out.append(p)
        i += 1
    return out


def numbers(ps: Pieces) -> Pieces:
    """Numbers without empty decimals."""
    return [re.sub(r"\.0+$", "", p) if isinstance(p, str) and _NUMBER.fullmatch(p) and p[0] != "." else p for p in ps]


# --- rules of meaning: applied to the outer level -----------------------------------------------


def without_unit(ps: Pieces) -> Pieces:
    """Without a unit at the end of a number."""
    while len(ps) > 1:
        last, size = ps[-1], 1
        if isinstance(last, Group) and last.left == "{" and len(ps) > 2 and ps[-2] in fx.TEXT_COMMANDS:
            last, size = shown(last.inside).replace("\\", "").strip(), 2
        elif not (isinstance(last, str) and last in fx.SIGN_UNITS):
            return ps
        before = ps[-size - 1]
        unit = last in fx.SIGN_UNITS or last in fx.UNITS or last.removesuffix("s") in fx.UNITS or last.removesuffix("es") in fx.UNITS
        if not unit or not _numeric(before):
            return ps
        ps = ps[:-size]
    return ps


def unwrapped(ps: Pieces) -> Pieces:
    """Without brackets that enclose the whole."""
    while len(ps) == 1 and isinstance(ps[0], Group) and (ps[0].left, ps[0].right) in fx.WRAPS:
        ps = ps[0].inside
    return ps


def value_of(ps: Pieces) -> Pieces:
    """What an equation says of a name or a number: chains end in their last part."""
    if "\\begin{array}" in ps:
        return ps
    sides = parts(ps, "=")
    if len(sides) > 2 or len(sides) == 2 and (is_name(sides[0]) or not any(c.isalpha() for c in shown(sides[0]))):
        return sides[-1]
    return ps


def is_name(ps: Pieces) -> bool:
    """A letter, two capitals, or a named function or letter, with powers, marks and at most one argument."""
    text = [p for p in ps if isinstance(p, str)]
    head = "".join(text[:2]) if len(text) > 1 and text[0].isupper() else text[0] if text else ""
    if not ps or isinstance(ps[0], Group) or not (len(head) == 1 and head.islower() or len(head) == 2 and head.isalpha() and head.isupper() or head[1:] in fx.NAMED and head[:1] == "\\"):
        return False
    rest = ps[2:] if len(head) == 2 and head[0] != "\\" else ps[1:]
    for p in rest:
        if isinstance(p, Group):
            if p.left not in "({" or len([q for q in p.inside if q != "-"]) > 1:
                return False
        elif not (p in ("^", "'", "\\prime", "-") or p.isdigit()):
            return False
    return True


def alternatives(ps: Pieces) -> Pieces:
    """``a ± b`` as the two values it stands for."""
    k = next((i for i, p in enumerate(ps) if p in ("\\pm", "\\mp")), None)
    if k is None or k == len(ps) - 1:
        return ps
    left, right = ps[:k], ps[k + 1 :]
    return [*left, "-", *right, ",", *left, "+", *right] if left else ps


def members(ps: Pieces) -> Iterator[Pieces]:
    """Members of a set in braces: cut at commas and ``or``, each once, in order of their text."""
    seen: dict[str, Pieces] = {}
    for one in parts(ps, ","):
        rest = one
        while True:
            k = next((i for i in range(len(rest) - 1) if rest[i : i + 2] == ["o", "r"]), None)
            cut = rest if k is None else rest[:k]
            seen.setdefault(shown(cut), cut)
            if k is None:
                break
            rest = rest[k + 2 :]
    for key in sorted(seen):
        yield seen[key]


def plain_quotient(ps: Pieces) -> Pieces:
    """``a/b`` of two numbers as a fraction."""
    minus = ps[:1] == ["-"]
    body = ps[1:] if minus else ps
    if len(body) == 3 and body[1] == "/" and all(isinstance(p, str) and _NUMBER.fullmatch(p) for p in body[::2]):
        return ["\\frac", braced([*(["-"] if minus else []), body[0]]), braced([body[2]])]
    return ps
