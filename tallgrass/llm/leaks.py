"""Problem 7: find documents that contain passages of held-out evaluation items.

Method: the test items form a BM25 inverted index whose posting lists carry block maxima.  Every
passage of every document (windows of ``WINDOW`` words, overlapping by ``PART`` words) is a query, answered by
block-max WAND (``Index.wand``): each term has a cursor in its postings, the pivot is the first
item that the sum of the terms' maxima can lift to the threshold, blocks whose maxima cannot reach
it are jumped over, and only items that survive are scored.  All passages of a block of texts
advance in step, so a round is a few numpy calls.  All items at or above the threshold are
retrieved; it is set for each item by the item itself, so that nearly every part of ``PART`` words
particular to it reaches it, and impacts are divided by it.

Each (document, item) pair is then verified on the words themselves.  A word of the question is
covered where it lies in a run of ``RUN`` successive words that the document has too, and counts
with the rarity of the run among the items: runs that many items share (answer instructions,
stock phrases) weigh little, however often one question is exported.  All parts of a divided
passage add up.  ``WORDS`` covered words verify a pair, or ``SHARE`` of all words of a question
shorter than that.  A pair with less, down to ``NEARLY`` of it, is verified if the document
has the item's answers too (``ANSWER`` letters or digits of them at least).

The index holds 8 bytes a posting.  Its size is checked before it goes to the workers: question
texts beyond ``SHARD_BYTES`` are split by id into several indexes with counts over all items, and
the documents are scanned once for each.  Documents are never shuffled, never cut; each comes out
once per leaked item.

Writing is levelled first: Unicode compatibility forms, accents, case, zero-width and soft
characters, entities, tags, emphasis and sizes of formulas; any mark separates words, and in
scripts without blanks each character is a word.

Defined results: null and empty texts contain nothing; repeated documents each count; an id that
eval_items lists more than once is one item with the union of its texts; a null question is no
item, nor is one of fewer than ``LEAST`` words.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm import arrowtext as at

WINDOW, STRIDE = 24, 14
RUN = 3
#: Words of the question that must recur, and share of a shorter question's words.
WORDS, SHARE = 14.0, 0.8
#: Fewest words of a question that is an item.
LEAST = 5
#: Share of the words that suffice together with the answers, and the letters and digits these must have.
NEARLY, ANSWER = 0.85, 6
#: Words of a part that shall be retrieved by itself, and share of an item's parts that may not be.
PART, MISSED = 10, 0.15
K1, B = 1.2, 0.75
#: Postings per block.
BLOCK = 8
#: Passages that advance in step.
TOGETHER = 4096
#: Most bytes of question texts in one index.
SHARD_BYTES = 8 << 20


def level(col: pa.Array) -> pa.Array:
    """Texts in one writing: see the module."""
    col = pc.replace_substring_regex(at.plain(col), r"\\(?:left|right|displaystyle|text[a-z]*|math[a-z]+|emph|[,;:! ])|[\x{00AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]", "")
    col = pc.replace_substring_regex(col, r"\\[dt]frac", r"\\frac")
    col = pc.replace_substring_regex(col, r"&(?:nbsp|amp|lt|gt|quot|#39|#160);", " ")
    col = pc.replace_substring_regex(col, r"</?[A-Za-z][A-Za-z0-9]{0,9}(?: [^<>]{0,60})?/?>", "")
    col = pc.replace_substring_regex(col, r"[_*`~]+", "")
    foreign = pc.invert(pc.string_is_ascii(col))
    if pc.any(foreign).as_py():
        far = pc.utf8_normalize(col.filter(foreign), form="NFKD")
        far = pc.replace_substring_regex(far, r"[\x{0300}-\x{036F}\x{00AD}\x{200B}-\x{200F}]", "")
        far = pc.replace_substring_regex(far, r"[\p{P}\p{S}\p{Z}]", " ")
        far = pc.replace_substring_regex(far, r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])", r" \1 ")
        col = pc.replace_with_mask(col, foreign, far)
    return pc.utf8_lower(col)


class Index:
    """BM25 index of item texts with block maxima, and the runs used for verification.

    ``counts`` gives, where the index holds a part of the items only, the number of items, their
    mean length, and for term and run hashes (sorted) the number of items that have them.
    """

    def __init__(self, ids: list[int], texts: list[str], answers: list[list[str]] | None = None, counts: dict | None = None):
        w = _words(level(pa.array(texts, pa.string())))
        self.ids = np.array(ids, np.int64)
        n = len(ids)
        self.items = n
        own = counts or _count(w, self.ids)
        total = max(own["items"], 1)
        self.slots = at.Slots(np.unique(w.hash))
        vocab = self.slots.keys
        pair, tf = np.unique(np.searchsorted(vocab, w.hash).astype(np.int64) * max(n, 1) + w.row, return_counts=True)
        t, d = pair // max(n, 1), pair % max(n, 1)
        df = np.minimum(_lookup(own["term"], own["term_df"], vocab), total)
        self.idf = np.log1p((total - df + 0.5) / (df + 0.5)).astype(np.float32)
        size = w.count / max(own["mean"], 1.0)
        impact = self.idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[d]))
        # runs: (item, position) by hash, and how rare each is among the items
        runs, row, pos = _runs(w)
        rare = np.log((total + 1) / np.maximum(_lookup(own["run"], own["run_df"], runs), 1)) / np.log(total + 1)
        rare = np.clip(rare, 0, 1) ** 2 if len(runs) else rare
        weight = np.zeros(len(w.hash))  # of each word of the items, by the rarest run it lies in
        for k in range(RUN):
            np.maximum.at(weight, w.first[row] + pos + k, rare)
        whole = np.bincount(w.row, weights=weight, minlength=n) if len(weight) else np.zeros(n)
        self.need = np.where(w.count < LEAST, np.inf, np.minimum(WORDS, np.where(w.count < 8, 0.999, SHARE) * whole))
        self.need[self.need <= 0] = np.inf
        impact /= self._enough(w, pair, impact, weight)[d]
        self.start = np.searchsorted(t, np.arange(len(vocab) + 2)).astype(np.int64)  # the last, a term without postings, pads
        self.item, self.impact = d.astype(np.int32), impact.astype(np.float32)
        chunk = np.arange(len(t)) - self.start[t]
        head = np.flatnonzero(chunk % BLOCK == 0)
        self.block_start = np.searchsorted(t[head], np.arange(len(vocab) + 2)).astype(np.int64)
        self.block_head = head.astype(np.int64)
        self.block_max = np.maximum.reduceat(self.impact, head) if len(head) else np.zeros(0, np.float32)
        self.block_last = self.item[np.append(head[1:], len(t)) - 1] if len(head) else np.zeros(0, np.int32)
        self.term_max = np.append(np.maximum.reduceat(self.impact, self.start[:-2]) if len(vocab) else [], 0).astype(np.float32)
        order = np.argsort(runs, kind="stable")
        self.run, self.run_item, self.run_pos, self.run_rare = runs[order], row[order].astype(np.int32), pos[order].astype(np.int32), rare[order].astype(np.float32)
        self.answers = [_answer_words(a) for a in answers] if answers else [[] for _ in ids]

    @staticmethod
    def _enough(w: at.Words, pair: np.ndarray, impact: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """BM25 score from which each item counts as retrieved.

        All but ``MISSED`` of its own parts of ``PART`` words reach it; parts that hardly weigh in
        verification do not count.  An item without such parts takes most of its own score.
        """
        n, words = w.rows, len(w.hash)
        out = np.ones(n)
        if not words:
            return out
        term = np.searchsorted(np.unique(w.hash), w.hash).astype(np.int64)
        name = term * n + w.row
        at_ = impact[np.searchsorted(pair, name)].astype(float)
        by = np.argsort(name, kind="stable")  # occurrences of a term in an item side by side
        again = np.flatnonzero(name[by][1:] == name[by][:-1])
        first, later = by[again], by[again + 1]
        once = at_.copy()
        once[later] = 0
        whole = np.bincount(w.row, weights=once, minlength=n)
        out = np.maximum(0.7 * whole, 1e-6)
        start = np.flatnonzero(w.row[: max(words - PART + 1, 0)] == w.row[PART - 1 :])
        if not len(start):
            return out
        total = lambda v: np.concatenate([[0.0], np.cumsum(v)])[np.array([start + PART, start])]
        up, down = total(at_)
        near = later - first < PART  # a passage asks for a term once
        twice = np.zeros(words + 1)
        np.add.at(twice, np.maximum(later[near] - PART + 1, w.first[w.row[later[near]]]), at_[later[near]])
        np.add.at(twice, first[near] + 1, -at_[later[near]])
        score = up - down - np.cumsum(twice)[start]
        up, down = total(weight)
        fair, row = (up - down) / PART >= 0.7, w.row[start]
        some = np.bincount(row[fair], minlength=n) > 0
        keep = fair | ~some[row]
        score, row = score[keep], row[keep]
        order = np.lexsort((score, row))
        score, many = score[order], np.bincount(row, minlength=n)
        head = np.cumsum(many) - many
        own = np.flatnonzero(many)
        place = MISSED * (many[own] - 1)
        low = head[own] + np.floor(place).astype(np.int64)
        high = np.minimum(low + 1, head[own] + many[own] - 1)
        out[own] = np.maximum(score[low] + (score[high] - score[low]) * (place - np.floor(place)), 1e-6)
        return out

    def nbytes(self) -> int:
        """Bytes of the index."""
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray)) + self.slots.keys.nbytes + self.slots.table.nbytes

    def retrieve(self, w: at.Words) -> np.ndarray:
        """Distinct (row, item) pairs, as row * items + item, with a passage above the threshold."""
        nothing = np.zeros(0, np.int64)
        term = self.slots.find(w.hash)
        known = np.flatnonzero(term >= 0)
        if not len(known):
            return nothing
        term = term[known].astype(np.int64)
        place = known - w.first[w.row[known]]
        slots = w.count // STRIDE + 1
        base = np.concatenate([[0], np.cumsum(slots)])
        hi = base[w.row[known]] + place // STRIDE  # a word lies in its own window, and the one before where they overlap
        lo = np.where((place >= STRIDE) & (place % STRIDE < WINDOW - STRIDE), hi - 1, -1)
        passage, word = np.concatenate([hi, lo[lo >= 0]]), np.concatenate([term, term[lo >= 0]])
        alive = np.bincount(passage, weights=self.term_max[word], minlength=base[-1])[passage] >= 1  # repeats only raise it
        terms = len(self.slots.keys)
        both = np.unique(passage[alive] * terms + word[alive])  # a passage asks for a term once
        passage, word = both // terms, both % terms
        alive = np.bincount(passage, weights=self.term_max[word], minlength=base[-1])[passage] >= 1
        passage, word = passage[alive], word[alive]
        if not len(passage):
            return nothing
        head = np.flatnonzero(np.diff(passage, prepend=-1))
        size = np.diff(np.append(head, len(passage)))
        doc = np.searchsorted(base, passage[head], side="right") - 1
        found = []
        for a in range(0, len(head), TOGETHER):
            b = min(a + TOGETHER, len(head))
            grid = np.full((b - a, int(size[a:b].max())), terms, np.int64)
            grid[np.repeat(np.arange(b - a), size[a:b]), np.arange(size[a:b].sum()) - np.repeat(np.cumsum(size[a:b]) - size[a:b], size[a:b])] = word[head[a] : head[a] + size[a:b].sum()]
            p, item = self.wand(grid)
            found.append(doc[a + p] * self.items + item)
        return np.unique(np.concatenate(found))

    def _block(self, term: np.ndarray, at_: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks from those of ``at_`` on in which the items ``target`` would lie, and whether there is one."""
        block = self.block_start[term] + (at_ - self.start[term]) // BLOCK
        end = self.block_start[term + 1]
        far = np.flatnonzero((block < end) & (self.block_last[np.minimum(block, len(self.block_last) - 1)] < target))
        lo, hi, want = block[far] + 1, end[far], target[far]
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            low = open_ & (self.block_last[np.minimum(mid, len(self.block_last) - 1)] < want)
            lo, hi = np.where(low, mid + 1, lo), np.where(open_ & ~low, mid, hi)
        block[far] = lo
        return block, block < end

    def _seek(self, term: np.ndarray, at_: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Places of the first postings behind ``at_`` with an item of at least ``target``."""
        stop = self.start[term + 1]
        at_ = at_ + 1
        far = np.flatnonzero((at_ < stop) & (self.item[np.minimum(at_, len(self.item) - 1)] < target))
        if not len(far):
            return at_
        g, want = term[far], target[far]
        block, inside = self._block(g, at_[far], want)
        lo = np.where(inside, np.maximum(self.block_head[np.minimum(block, len(self.block_head) - 1)], at_[far]), stop[far])
        hi = np.where(inside, np.minimum(self.block_head[np.minimum(block, len(self.block_head) - 1)] + BLOCK, stop[far]), stop[far])
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            low = open_ & (self.item[np.minimum(mid, len(self.item) - 1)] < want)
            lo, hi = np.where(low, mid + 1, lo), np.where(open_ & ~low, mid, hi)
        at_[far] = lo
        return at_

    def wand(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages (rows of ``grid``, term numbers, padded with the number of terms) and items that reach 1."""
        end = np.int32(self.items)
        p, width = np.arange(len(grid)), grid.shape[1]
        at_ = self.start[grid]
        item = np.where(at_ < self.start[grid + 1], self.item[np.minimum(at_, len(self.item) - 1)], end)
        bound = self.term_max[grid]
        got_p, got_i = [], []
        while True:
            lead = np.arange(len(p)) * width
            key = np.sort(item.astype(np.int64) * width + np.arange(width), axis=1)  # items with their columns
            can = np.cumsum(bound.ravel()[lead[:, None] + key % width], axis=1) >= 1 - 1e-5
            pivot = (key.ravel()[lead + can.argmax(axis=1)] // width).astype(np.int32)
            live = can[:, -1] & (pivot < end)
            if np.count_nonzero(live) * 4 < 3 * len(p):  # leave finished passages behind
                p, item, at_, grid, bound, pivot = p[live], item[live], at_[live], grid[live], bound[live], pivot[live]
                live = np.ones(len(p), bool)
            if not live.any():
                break
            upto = item <= np.where(live, pivot, -1)[:, None]  # the terms that can have the pivot
            f = np.flatnonzero(upto)
            r = f // width
            g, x, want, now = grid.ravel()[f], at_.ravel()[f], pivot[r], item.ravel()[f]
            block, inside = self._block(g, x, want)
            block = np.minimum(block, len(self.block_last) - 1)
            most = np.bincount(r, weights=np.where(inside, self.block_max[block], 0), minlength=len(p))
            hope = most >= 1 - 1e-5
            away = np.bincount(r, weights=now != want, minlength=len(p)) > 0
            # without hope: on behind the nearest end of these blocks, or to the next term's item
            target = pivot.copy()
            lost = live & ~hope
            if lost.any():
                i = np.flatnonzero(lost[r])
                edge = np.full(len(p), end)
                np.minimum.at(edge, r[i], np.where(inside[i], self.block_last[block[i]] + 1, end).astype(np.int32))
                target[lost] = np.minimum(edge[lost], np.where(upto[lost], end, item[lost]).min(axis=1))
            # with hope and all terms there: score, then on by one item
            ready = live & hope & ~away
            if ready.any():
                i = np.flatnonzero(ready[r])
                score = np.bincount(r[i], weights=self.impact[x[i]], minlength=len(p))
                hit = ready & (score >= 1 - 1e-5)
                got_p.append(p[hit])
                got_i.append(pivot[hit])
                target[ready] += 1
            go = np.flatnonzero(now < target[r])
            to = self._seek(g[go], x[go], target[r[go]])
            at_.ravel()[f[go]] = to
            item.ravel()[f[go]] = np.where(to < self.start[g[go] + 1], self.item[np.minimum(to, len(self.item) - 1)], end)
        return (np.concatenate(got_p), np.concatenate(got_i).astype(np.int64)) if got_p else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def covered(self, w: at.Words, pairs: np.ndarray) -> np.ndarray:
        """Words of the item, weighed by rarity, that recur in each of the pairs (sorted, as of ``retrieve``)."""
        n = self.items
        out = np.zeros(len(pairs))
        runs, row, _ = _runs(w, np.unique(pairs // n))
        s, e = np.searchsorted(self.run, runs, side="left"), np.searchsorted(self.run, runs, side="right")
        hits = np.repeat(np.arange(len(runs)), e - s)
        at_ = np.arange(len(hits)) - np.repeat(np.cumsum(e - s) - (e - s), e - s) + np.repeat(s, e - s)
        pair = row[hits] * n + self.run_item[at_]
        k = np.searchsorted(pairs, pair)
        ok = np.flatnonzero((k < len(pairs)) & (pairs[np.minimum(k, len(pairs) - 1)] == pair)) if len(pairs) else np.zeros(0, np.int64)
        if not len(ok):
            return out
        k, at_ = k[ok], at_[ok]
        longest = np.int64(self.run_pos.max() + RUN + 1)
        name = np.concatenate([k * longest + self.run_pos[at_] + j for j in range(RUN)])
        rare = np.tile(self.run_rare[at_], RUN)
        order = np.argsort(name, kind="stable")
        name, rare = name[order], rare[order]
        head = np.flatnonzero(np.diff(name, prepend=-1))
        return np.bincount(name[head] // longest, weights=np.maximum.reduceat(rare, head), minlength=len(pairs))

    def verify(self, w: at.Words, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the retrieved pairs those that hold: the pairs, their covered words, whether the answers recur."""
        words = self.covered(w, pairs) if len(pairs) else np.zeros(0)
        share = words / self.need[pairs % max(self.items, 1)]
        near = np.flatnonzero(share >= NEARLY)
        answered = np.array([self._answered(w, int(p)) for p in pairs[near]], bool)
        keep = (share[near] >= 1 - 1e-9) | answered
        return pairs[near][keep], words[near][keep], answered[keep]

    def _answered(self, w: at.Words, pair: int) -> bool:
        """Whether every answer of the item stands in the text, as a run of words."""
        answers = self.answers[pair % self.items]
        if sum(a[1] for a in answers) < ANSWER:
            return False
        row = pair // self.items
        own = w.hash[w.first[row] : w.first[row + 1]]
        return all(len(own) >= len(a) and bool(np.isin(at.ngrams(own, len(a)), at.ngrams(a, len(a))).any()) for a, _ in answers)


def _answer_words(answers: list[str] | None) -> list[tuple[np.ndarray, int]]:
    """Word hashes of each answer that has words, with its number of letters and digits."""
    texts = [a for a in answers or [] if a]
    w = _words(level(pa.array(texts, pa.string())))
    size = at.row_sum((w.end - w.start).astype(float), w.row, w.rows)
    return [(w.hash[w.first[r] : w.first[r + 1]], int(size[r])) for r in range(w.rows) if w.count[r]]


def _words(col: pa.Array) -> at.Words:
    return at.Words(*at.buffers(col))


def _runs(w: at.Words, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of runs of RUN words within a row, with row and position in the row."""
    g = at.ngrams(w.hash, RUN)
    row = w.row[: len(g)]
    ok = row == w.row[RUN - 1 :] if len(g) else np.zeros(0, bool)
    if rows is not None:
        ok &= np.isin(row, rows)
    i = np.flatnonzero(ok)
    return g[i], row[i].astype(np.int64), i - w.first[row[i]]


def _lookup(keys: np.ndarray, values: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Values of sorted keys, all of which exist."""
    return values[np.searchsorted(keys, want)] if len(want) else np.zeros(0, np.int64)


def _text_hash(w: at.Words) -> np.ndarray:
    """A hash of each row's words in order."""
    with np.errstate(over="ignore"):
        place = (np.arange(len(w.hash)) - w.first[w.row]).astype(np.uint64)
        mixed = at.mix(w.hash ^ at.mix(place + np.uint64(1)))
        total = np.append(np.uint64(0), np.cumsum(mixed, dtype=np.uint64))
        return at.mix(total[w.first[1:]] - total[w.first[:-1]])


def _tokens(w: at.Words) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    yield "term", w.hash, w.row
    runs, row, _ = _runs(w)
    yield "run", runs, row


def _count(w: at.Words, ids: np.ndarray) -> dict:
    """Items that have each term and run: distinct ids or distinct texts, whichever are fewer."""
    text = _text_hash(w)
    full = np.flatnonzero(w.count > 0)
    out = {"items": min(len(np.unique(ids[full])), len(np.unique(text[full]))), "mean": float(w.count.mean()) if w.rows else 0.0}
    for kind, h, row in _tokens(w):
        keys = np.unique(h)
        k = np.searchsorted(keys, h)
        many = [np.unique(k * np.int64(w.rows + 1) + np.unique(of, return_inverse=True)[1][row]) // (w.rows + 1) for of in (ids, text)]
        out[kind], out[f"{kind}_df"] = keys, np.minimum(*(np.bincount(m, minlength=len(keys)) for m in many)) if len(keys) else np.zeros(0, np.int64)
    return out


def _item_rows(items: DataFrame, item_key: str, question: str, answer: str) -> DataFrame:
    """Distinct (id, question) with answers; an id's re-exports with other answers are one row each text."""
    gold = F.col(answer).cast("array<string>") if answer in items.columns else F.lit(None).cast("array<string>")
    rows = items.select(F.col(item_key).cast("bigint").alias("id"), F.col(question).alias("q"), gold.alias("a")).where("id is not null and q is not null")
    return rows.groupBy("id", "q").agg(F.max("a").alias("a"))


def _far_counts(rows: DataFrame) -> tuple[DataFrame, dict]:
    """Counts of terms and runs over all items, distributed, and their number and mean length."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _words(level(batch.column(1)))
            ids, text = batch.column(0).to_numpy(zero_copy_only=False), _text_hash(w).view(np.int64)
            for kind, h, row in [("item", w.count.astype(np.uint64), np.arange(w.rows)), *_tokens(w)]:
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(ids[row]), pa.array(text[row])], names=["kind", "h", "id", "t"])

    seen = rows.select("id", "q").mapInArrow(emit, "kind string, h bigint, id bigint, t bigint")
    few = F.least(F.count_distinct("id"), F.count_distinct("t")).alias("df")
    whole = seen.where("kind = 'item'").agg(F.least(F.count_distinct(F.when(F.col("h") > 0, F.col("id"))), F.count_distinct(F.when(F.col("h") > 0, F.col("t")))).alias("n"), F.avg("h").alias("m")).first()
    return seen.where("kind <> 'item'").groupBy("kind", "h").agg(few), {"items": whole.n, "mean": whole.m or 0.0}


def build_indexes(items: DataFrame, *, item_key: str = "id", question: str = "question", answer: str = "answer") -> Iterator[Index]:
    """The indexes of the held-out items: one, or one for each part of the ids where the texts are large."""
    rows = _item_rows(items, item_key, question, answer)
    size = rows.agg(F.sum(F.octet_length("q"))).first()[0] or 0
    parts = -(-size // SHARD_BYTES)
    if parts <= 1:
        got = rows.orderBy("id", "q").collect()
        yield Index([r.id for r in got], [r.q for r in got], [r.a for r in got])
        return
    df, base = _far_counts(rows)
    for k in range(parts):
        part = rows.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)
        got = part.orderBy("id", "q").collect()
        w = _words(level(pa.array([r.q for r in got], pa.string())))
        counts = dict(base)
        for kind, h, _ in _tokens(w):
            keys = np.unique(h)
            mine = items.sparkSession.createDataFrame(pa.table({"h": keys.view(np.int64)}))
            table = df.where(F.col("kind") == kind).join(mine, "h", "left_semi").select("h", "df").toArrow()
            names = table["h"].to_numpy().view(np.uint64)
            order = np.argsort(names)
            counts[kind], counts[f"{kind}_df"] = names[order], table["df"].to_numpy()[order]
        yield Index([r.id for r in got], [r.q for r in got], [r.a for r in got], counts)


def evidence(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "id") -> DataFrame:
    """``(key, item_key, words, answered)``, once per pair: a scan of two columns, no shuffle, for each index."""
    kind = docs.schema[key].dataType.simpleString()
    out = None
    for made in build_indexes(items, item_key=item_key):
        index = docs.sparkSession.sparkContext.broadcast(made)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for batch in batches:
                raw = at.plain(batch.column(1))
                for a, b in at.blocks(raw):
                    w = _words(level(raw.slice(a, b - a)))
                    pairs, words, answered = ix.verify(w, ix.retrieve(w)) if ix.items else (np.zeros(0, np.int64),) * 3
                    if len(pairs):
                        told = pd.DataFrame({"r": pairs // ix.items, "i": ix.ids[pairs % ix.items], "w": words, "a": answered})
                        told = told.sort_values("w", ascending=False).drop_duplicates(["r", "i"])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(told["r"].to_numpy() + a)), pa.array(told["i"].to_numpy()), pa.array(told["w"].to_numpy()), pa.array(told["a"].to_numpy(bool))], names=[key, item_key, "words", "answered"])

        part = docs.select(docs[key], docs[text].cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, `{item_key}` bigint, words double, answered boolean")
        out = part if out is None else out.unionByName(part)
    return out


def leaked(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "id") -> DataFrame:
    """``(key, item_key)``, once per pair."""
    return evidence(docs, items, key=key, text=text, item_key=item_key).select(key, item_key)
