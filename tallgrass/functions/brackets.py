"""Balanced scanning: boxes, bracket groups and top-level commas in plain Python strings."""

from __future__ import annotations

import re

from tallgrass.functions import fixed_values as fx

_GAP = re.compile(fx.BOX_GAP)


def closing(s: str, start: int, left: str = "{", right: str = "}") -> int:
    """Index of the bracket that closes the one open at ``start - 1``; -1 if none does."""
    depth = 1
    for m in re.compile(f"[{re.escape(left)}{re.escape(right)}]").finditer(s, start):
        depth += 1 if m[0] == left else -1
        if not depth:
            return m.start()
    return -1


def box_spans(s: str, command: str = "\\boxed{", keep_open: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, content) of each box; ``keep_open`` keeps a last box that never closes."""
    out, i = [], s.find(command)
    while i >= 0:
        a = i + len(command)
        b = closing(s, a)
        if b < 0:
            if keep_open:
                out.append((i, len(s), s[a:]))
            break
        out.append((i, b + 1, s[a:b]))
        i = s.find(command, b + 1)
    return out


def all_boxes(s: str) -> list[str]:
    """Contents of all boxes of a text, an unclosed last one included."""
    return [c for _, _, c in box_spans(s, keep_open=True)]


def last_group(s: str) -> list[str]:
    """Contents of the last run of boxes with nothing but marks between them; empty boxes do not count."""
    spans = [b for b in box_spans(s) if b[2]]
    k = len(spans)
    while k and (k == len(spans) or _GAP.fullmatch(s, spans[k - 1][1], spans[k][0])):
        k -= 1
    return [c.strip() for _, _, c in spans[k:]]


def last_box(s: str) -> str | None:
    """Content of the last ``\\boxed`` (or, without any, ``\\fbox``) that closes; None otherwise."""
    for name in ("\\boxed", "\\fbox"):
        i = s.rfind(name)
        if i >= 0:
            a = s.find("{", i)
            b = closing(s, a + 1) if a >= 0 else -1
            return s[a + 1 : b] if b >= 0 and a == i + len(name) else None
    return None


def top_commas(s: str, opening: str = "([<", closing_: str = ")]>") -> list[str]:
    """Parts between commas outside brackets; set braces count as round brackets."""
    for a, b in (("\\{", "("), ("\\}", ")"), ("\\rangle", ")"), ("\\langle", "(")):
        s = s.replace(a, b)
    parts, depth, start = [], 0, 0
    for i, c in enumerate(s):
        if c in opening:
            depth += 1
        elif c in closing_:
            depth -= 1
        elif c == "," and not depth:
            parts.append(s[start:i])
            start = i + 1
    if start < len(s):
        parts.append(s[start:])
    return [p.strip().strip("$").strip() for p in parts]


def box_values(s: str) -> list[str]:
    """Values of a box that holds several: cut at commas outside braces, bracketed wholes kept."""
    t = s.strip()
    if t[:1] + t[-1:] in ("()", "[]", "{}"):
        return [t]
    parts, depth, start = [], 0, 0
    for i, c in enumerate(t):
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            parts.append(t[start:i])
            start = i + 1
    return [p.strip() for p in (*parts, t[start:]) if p.strip()]
