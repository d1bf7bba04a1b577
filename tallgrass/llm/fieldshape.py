"""Features of a response or an answer: shape of its ending, emptiness, pairing with its question.

Dense features are booleans (plus a few shares) with a name each; n-grams are hashed words and
word pairs of the whole closing part, and apart from them those of its last words.  Whole texts are
looked at: language, coverage by the question and refusing sentences run over every word, the shape
looks for tags, boxes and marks in the whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from tallgrass.llm import arrowtext as at
from tallgrass.llm import language, linear

BLANK = " \t\r\n\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u200c\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
#: What exports write where there is nothing.
NOTHING = frozenset({"", "n/a", "na", "null", "nan", "nil", "none", "undefined", "-", "--", "---", "—", "–", "?", "??", "…", "...", ".", "[]", "{}", "()", '""', "''", "\\boxed{}", "_", "tbd", "[ans]", "____"})
_CLOSE = re.compile(r"</(?:redacted_)?think(?:ing)?>")
_OPEN = re.compile(r"<(?:redacted_)?think(?:ing)?>")
_BOX = re.compile(r"\\(?:f?boxed|fbox)\s*\{")
_MARK = re.compile(r"^[ \t*#>_]*(?:final\s+answer|answer|final)[ \t*_]*(?:[:：][ \t*_]*(?P<v>[^\n]*))?$", re.I | re.M)
_CUTMARK = re.compile(r"(?:…|\.\.\.|\[\s*(?:\.\.\.|…|truncated|cut|more)\s*\]|<br\s*/?>?|<[a-z]{0,4}|\((?:truncated|continued)\)?|&[a-z]{0,5})\s*$", re.I)
_TAGS = re.compile(r"</?(?:redacted_)?think(?:ing)?>|\\(?:f?boxed|fbox)|final answer|answer|final", re.I)
_MARKS_ONLY = re.compile(r"(?:</?(?:redacted_)?think(?:ing)?>|\\(?:f?boxed|fbox)|final answer|answer|final|[\W_])*", re.I)
_LONGEST = max(map(len, NOTHING))
_SENTENCE_END = re.compile(r"[.!?。]\s+|\n")
_CUE = re.compile(r"\s*(?:so|thus|hence|therefore|finally|altogether|consequently|in total|it follows that|we conclude)\b.*(?:\b(?:is|are|equals?|be|get|gives?|obtain|conclude|to|choice|answer)\b|=)|.*\b(?:answer|comes? to|total is|result is)\b", re.I)
_VALUE_END = re.compile(r"(?:\d|[)}\]$%°]|\b[A-Za-z])[.!。]?$")
_COMMAND_END = re.compile(r"\\[A-Za-z]*$")
_WORD_END = re.compile(r"[A-Za-z]{2,}$")
#: Words at the end that have n-grams of their own.
LAST = 6

RESPONSE = (
    "nothing", "null_word", "empty_box", "no_final", "no_final_stop", "open_box", "mark_no_value", "deficit", "deficit_alien", "sep_end", "open_think",
    "cut_mark", "word_end", "operator_end", "odd_dollar", "unbalanced_end", "complete_box", "complete_value", "at_limit", "limit_no_final",
    "cover_f", "cover_both", "copy", "copy_no_final", "alien_some", "alien", "close_then_nothing", "short", "stop_end", "plain_no_final", "refuses", "refuses_no_final", "concludes", "alien_sure",
)
ANSWER = (
    "nothing", "null_word", "empty_box", "unbalanced", "operator_end", "space_end", "command_end", "open_quote", "cover_f", "cover_both", "copy",
    "alien_some", "alien", "has_digit", "words3", "words1", "number_like", "comma_end", "letter", "fewer", "refuses",
)


def boxes(t: str) -> tuple[list[str], bool, int]:
    """Contents of the closed boxes of a text, whether one is left open, and where the last ends."""
    out, i = [], 0
    while m := _BOX.search(t, i):
        depth, j = 1, m.end()
        n = len(t)
        while depth and j < n:
            c = t[j]
            if c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
            j += 1
        if depth:
            return out, True, n
        out.append(t[m.end() : j - 1])
        i = j
    return out, False, i


def balance(s: str) -> int:
    """Brackets left open, whatever their kind (half-open intervals mix kinds)."""
    return s.count("(") + s.count("[") + s.count("{") - s.count(")") - s.count("]") - s.count("}")


def nothing_in(s: str) -> bool:
    """Whether a stripped text holds nothing that could be an answer."""
    rest = len(s) - _MARKS_ONLY.match(s).end()
    if not rest or len(s) <= _LONGEST and s.lower() in NOTHING:
        return True
    return rest <= _LONGEST + 64 and _TAGS.sub(" ", s[-rest:]).strip(BLANK + "{}[]()<>$*:.,-").lower() in NOTHING


def value_start(t: str) -> int:
    """Where the value behind the last mark of a final answer begins; the last character of a text without one."""
    m = None
    for m in _MARK.finditer(t):
        pass
    return m.start("v") if m and (m["v"] or "").strip() else len(t.rstrip()) - 1


def concludes(tail: str) -> bool:
    """Whether the last sentence draws the conclusion, and ends in a value."""
    said = _SENTENCE_END.split(tail)[-1] if len(tail) < 400 else _SENTENCE_END.split(tail[max(tail.rfind("\n"), tail.rfind(". ", 0, len(tail) - 1), 0) :])[-1]
    return bool(_VALUE_END.search(said) and _CUE.match(said))


def response_shape(t: str, slots: int) -> tuple[list[float], str]:
    """Dense features (those that need no other text) and the closing part of a response."""
    s = t.strip(BLANK)
    close = max(s.rfind("</think>"), s.rfind("</redacted_thinking>"))
    if close < 0 and "</" in s:
        close = max((m.start() for m in _CLOSE.finditer(s)), default=-1)
    tail = s[s.find(">", close) + 1 :].strip(BLANK) if close >= 0 else s
    empty = nothing_in(s)
    opened = close < 0 and s.startswith("<") and bool(_OPEN.match(s))
    got, open_box, end = boxes(tail)
    last = tail[-90:]
    mark = value = False
    if not got and not open_box and not empty:
        m = None
        for m in _MARK.finditer(tail):
            pass
        if m:
            v = (m["v"] or "").strip(BLANK + "*$")
            mark, value = True, bool(v) and balance(v) <= 0 and not v.endswith(("+", "-", "=", ",", "\\", "^", "_", "/")) and not _COMMAND_END.search(v)
    full = any(b.strip(BLANK) for b in got)
    complete = full and len(got) >= slots and not open_box
    deficit = 0 < len(got) < slots and not open_box
    final = bool(got) or open_box or mark
    c = last[-1:]
    rest = tail[end:].strip(BLANK + "$.*") if got else ""
    stop = c in ".!?。"
    f = [
        empty, s.lower() in NOTHING, bool(got) and not full, not final, not final and stop, open_box, mark and not value, deficit, 0, bool(got) and rest in (",", ";"), opened and not complete,
        bool(_CUTMARK.search(last)) and not empty, not final and bool(_WORD_END.search(last)), c in "([{$\\=+-*/,:;&^_<" and bool(c), not final and tail.count("$") % 2 == 1, not final and balance(last) > 0, complete, value, 0, 0,
        0, 0, 0, 0, 0, 0, close >= 0 and not tail and not empty, len(s) < 40, stop, not final and not empty and not opened and stop, 0, 0, not final and not opened and concludes(tail), 0,
    ]
    return f, tail


def answer_shape(t: str, slots: int) -> list[float]:
    """Dense features of an answer that need no other text."""
    s = t.strip(BLANK)
    words = re.findall(r"[^\W\d_]{2,}", re.sub(r"\\[A-Za-z]+", " ", s))
    c = s[-1:]
    b = balance(s)
    odd = s.count('"') % 2 == 1
    return [
        nothing_in(s), s.lower() in NOTHING, s.replace(" ", "") in ("\\boxed{}", "\\fbox{}"), b > 0 or s.count("$") % 2 == 1 or s.count("\\begin") > s.count("\\end"), c in "+-=*/^_\\<>&" and len(s) > 1, t[-1:] == " " and c in "+-=*/,(", bool(_COMMAND_END.search(s)) and b > 0, odd, 0, 0, 0,
        0, 0, any(x.isdigit() for x in s), len(words) >= 3, len(words) >= 1, not words and any(x.isdigit() for x in s), c in ",;", len(s) == 1 and s.isalpha(), slots > 1 and b > 0, 0,
    ]


class Questions:
    """Word pairs and language of a set of questions, for many texts to be held against."""

    def __init__(self, texts: pa.Array, tongue: language.Tongue):
        data, off = at.buffers(texts)
        w = at.Words(data, off)
        self.words, self.tongue = w.count, tongue
        self.lang = language.sentences(texts, tongue, w).main()
        pair, row = pairs(w)
        self.key = np.unique(_own(pair, row))
        # owner of each key is not stored: keys of different questions differ by construction
        self.size = np.bincount(row[np.unique(_own(pair, row), return_index=True)[1]], minlength=len(texts)) if len(pair) else np.zeros(len(texts), np.int64)

    def cover(self, w: at.Words, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of each text's word pairs that its question has, and of the question's that it has."""
        n = w.rows
        mine, theirs = np.zeros(n), np.zeros(n)
        q = self.words[owner]
        rows = np.flatnonzero((w.count >= 0.3 * q) & (w.count > 1))  # else no half of the question can be there
        if not len(rows) or not len(self.key):
            return mine, theirs
        pair, row = pairs(w, rows)
        if not len(pair):
            return mine, theirs
        k = _own(pair, owner[row])
        i = np.searchsorted(self.key, k)
        i[i == len(self.key)] = 0
        hit = self.key[i] == k
        mine = np.bincount(row, weights=hit, minlength=n) / np.maximum(np.bincount(row, minlength=n), 1)
        seen = np.unique(row[hit] * np.int64(len(self.key)) + i[hit]) // max(len(self.key), 1)
        theirs = np.bincount(seen, minlength=n) / np.maximum(self.size[owner], 1)
        return mine, theirs


_ANS = np.uint64(at.hash_text("ans"))


def pairs(w: at.Words, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of pairs of successive words of a text (blank marks left out), with their row."""
    keep = w.hash != _ANS
    if rows is not None:
        wanted = np.zeros(w.rows, bool)
        wanted[rows] = True
        keep &= wanted[w.row]
    h, r = w.hash[keep], w.row[keep]
    g = at.ngrams(h, 2)
    same = r[1:] == r[:-1] if len(r) > 1 else np.zeros(0, bool)
    return g[same], r[:-1][same] if len(r) > 1 else r[:0]


def _own(pair: np.ndarray, owner: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return at.mix(pair ^ (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25))


def grams(tails: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots and rows of the hashed words and word pairs of closing parts; the last words have slots of their own too."""
    w = at.Words(*at.buffers(tails))
    two = at.ngrams(w.hash, 2)
    same = w.row[1:] == w.row[:-1] if len(w.row) > 1 else np.zeros(0, bool)
    word = w.kind == 1
    last = np.arange(len(w.hash)) >= w.first[w.row + 1] - LAST
    salt = np.uint64(0xC2B2AE3D27D4EB4F)
    parts = [(w.hash[word], w.row[word]), (at.mix(w.hash[word & last] ^ salt), w.row[word & last])]
    if len(w.row) > 1:
        end = same & last[:-1]
        parts += [(two[same], w.row[:-1][same]), (at.mix(two[end] ^ salt), w.row[:-1][end])]
    return np.concatenate([linear.slots(h) for h, _ in parts]), np.concatenate([r for _, r in parts])


def closing(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots and rows of the last 1 to 5 bytes of each text."""
    data, off = at.buffers(texts)
    slot, row = [], []
    h = np.zeros(len(texts), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, 6):
            ok = np.flatnonzero(off[1:] - off[:-1] >= k)
            h[ok] = (h[ok] + np.uint64(1)) * np.uint64(0x100000001B3) + data[off[1:][ok] - k]
            slot.append(linear.slots(at.mix(at.mix(h[ok]) ^ np.uint64(k))))
            row.append(ok)
    return np.concatenate(slot), np.concatenate(row)


#: Logits of a sentence above its threshold at which it surely refuses.
SCALE = 4.0


class Refusals:
    """A linear model of sentences that decline to answer; a text has the score of its most refusing sentence."""

    def __init__(self, refusing: list[str], other: list[str]):
        n, slot, row, owner = _sentence_grams(at.Words(*at.buffers(pa.array(refusing + other, pa.string()))))
        y = (owner < len(refusing)).astype(float)[:, None]
        self.model = linear.Linear(1, 0).fit(np.zeros((n, 0)), slot, row, y) if refusing and other else None

    def score(self, texts: pa.Array, w: at.Words) -> np.ndarray:
        """How much the most refusing sentence of each text declines to answer, from -1 to 1."""
        out = np.full(len(texts), -SCALE)
        if self.model is None or not len(texts):
            return out
        n, slot, row, owner = _sentence_grams(w)
        s = self.model.scores(np.zeros((n, 0)), slot, row)[:, 0] - self.model.cut[0]
        np.maximum.at(out, owner, s)
        return np.clip(out, -SCALE, SCALE) / SCALE


def _sentence_grams(w: at.Words) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of sentences, slots and sentences of the n-grams (one to three words), and the text of each sentence."""
    data = w.data
    end = np.flatnonzero((data == 10) | (data == 46) | (data == 33) | (data == 63))
    key = np.searchsorted(end, w.start)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (w.row[1:] != w.row[:-1])
    sent = np.cumsum(new) - 1
    slot, row = [], []
    for k in (1, 2, 3):
        g = at.ngrams(w.hash, k) if k > 1 else w.hash
        own = sent[: len(g)]
        ok = (own == sent[k - 1 :]) if len(g) else np.zeros(0, bool)
        slot.append(linear.slots(at.mix(g[ok] ^ np.uint64(k))))
        row.append(own[ok])
    return int(new.sum()), np.concatenate(slot), np.concatenate(row), w.row[new]


def response_features(texts: pa.Array, owner: np.ndarray, questions: Questions, slots: np.ndarray, limit: np.ndarray, refusals: Refusals | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense matrix, n-gram slots and rows of a block of responses."""
    made = [response_shape(t, s) for t, s in zip(texts.to_pylist(), slots.tolist())]
    x = np.array([m[0] for m in made], float).reshape(len(made), len(RESPONSE))
    col = {k: i for i, k in enumerate(RESPONSE)}
    data, off = at.buffers(texts)
    w = at.Words(data, off)
    mine, theirs = questions.cover(w, owner)
    speech = language.sentences(texts, questions.tongue, w)
    alien = speech.other(questions.lang[owner])
    x[:, col["alien_sure"]] = speech.sure
    _pair(x, col, mine, theirs, alien)
    x[:, col["copy_no_final"]] = x[:, col["copy"]] * x[:, col["no_final"]]
    x[:, col["deficit_alien"]] = x[:, col["deficit"]] * (alien > 0.5)
    x[:, col["deficit"]] *= alien <= 0.5
    x[:, col["at_limit"]] = limit * (1 - np.maximum(x[:, col["complete_box"]], x[:, col["complete_value"]]))  # a full answer may end anywhere
    x[:, col["limit_no_final"]] = limit * x[:, col["no_final"]]
    if refusals:
        x[:, col["refuses"]] = refusals.score(texts, w)
        x[:, col["refuses_no_final"]] = np.maximum(x[:, col["refuses"]], 0) * x[:, col["no_final"]]
    slot, row = grams(pa.array([m[1] for m in made], pa.string()))
    more, at_ = closing(texts)
    return x, np.concatenate([slot, more]), np.concatenate([row, at_])


def answer_features(texts: pa.Array, owner: np.ndarray, questions: Questions, slots: np.ndarray, refusals: Refusals | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense matrix, n-gram slots and rows of a block of answers."""
    x = np.array([answer_shape(t, s) for t, s in zip(texts.to_pylist(), slots.tolist())], float).reshape(len(texts), len(ANSWER))
    col = {k: i for i, k in enumerate(ANSWER)}
    data, off = at.buffers(texts)
    w = at.Words(data, off)
    mine, theirs = questions.cover(w, owner)
    speech = language.sentences(texts, questions.tongue, w)
    _pair(x, col, mine, theirs, speech.other(np.where(questions.lang[owner] < 0, 0, questions.lang[owner])))
    if refusals:
        x[:, col["refuses"]] = refusals.score(texts, w)
    slot, row = grams(texts)
    return x, slot, row


def _pair(x: np.ndarray, col: dict[str, int], mine: np.ndarray, theirs: np.ndarray, alien: np.ndarray) -> None:
    x[:, col["cover_f"]] = mine > 0.8
    x[:, col["cover_both"]] = (mine > 0.8) & (theirs > 0.8)
    x[:, col["copy"]] = (mine > 0.85) & (theirs > 0.5)
    x[:, col["alien_some"]] = alien > 0.25
    x[:, col["alien"]] = alien > 0.5
