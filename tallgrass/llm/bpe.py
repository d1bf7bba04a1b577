"""Problem 6: encode a whole corpus with a public byte-level BPE vocabulary.

Method: texts are cut into pre-tokens; the distinct pre-tokens a worker has not seen yet go
through length-bucketed, padded numpy matrices in which every row merges its leftmost
minimum-rank pair in each round.  Pair ranks come from an open-addressing hash table, finished
rows leave the matrix (compaction), and merged columns close up.  Pre-tokens too long for a
matrix are merged one by one with the same rule, all occurrences of the best pair per round
(equal to leftmost-first, since a pair that holds a merged token always ranks later).

Defined results: an empty or null text has the ids ``[]``; special-token strings in a text are
ordinary text; every document comes out once per input row, under its own key.  Extra columns
are ignored and never read.  The vocabulary folder is the parameter ``tokenizers``.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallgrass.llm import arrowtext as at

TOKENIZERS = "/opt/tokenizers"
#: Distinct pre-tokens a worker remembers before it starts afresh.
CACHE_WORDS = 200_000
#: Longest pre-token (bytes) that goes through a padded matrix.
BUCKETS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48)
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORDS = regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_ASCII = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_NONE = np.int32(2**31 - 1)


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, in order; they cover the text completely."""
    return (_ASCII if text.isascii() else _WORDS).findall(text)


def _byte_names() -> dict[str, int]:
    """The printable stand-in of each byte in vocabularies stored as JSON."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Byte ids and the merge table (pair of ids -> rank, merged id) as flat numpy arrays."""

    def __init__(self, byte_ids: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.byte_ids = byte_ids.astype(np.int32)
        bits = max(4, int(np.ceil(np.log2(max(len(left), 1) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, _NONE, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._home(key)
        todo = np.arange(len(key))
        while len(todo):  # each round places what finds its slot free, the rest moves on by one
            free = self.keys[slot[todo]] == -1
            cand = todo[free]
            _, firsts = np.unique(slot[cand], return_index=True)
            put = cand[firsts]
            self.keys[slot[put]], self.rank[slot[put]], self.merged[slot[put]] = key[put], rank[put], merged[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _home(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``_NONE`` where the pair never merges) and table slot of each pair."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        key[(a < 0) | (b < 0)] = -2
        flat = key.ravel()
        slot = self._home(flat)
        open_ = np.flatnonzero((self.keys[slot] != flat) & (self.keys[slot] != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            k = self.keys[slot[open_]]
            open_ = open_[(k != flat[open_]) & (k != -1)]
        rank = np.where(self.keys[slot] == flat, self.rank[slot], _NONE)
        return rank.reshape(key.shape), slot.reshape(key.shape)

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each pre-token."""
        out: list[tuple[int, ...]] = [()] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        lo = 0
        for hi in BUCKETS:
            rows = np.flatnonzero((size > lo) & (size <= hi))
            for part in range(0, len(rows), 1 << 15):
                self._bucket(words, rows[part : part + (1 << 15)], hi, out)
            lo = hi
        for r in np.flatnonzero(size > lo):
            out[r] = tuple(self._long(self.byte_ids[np.frombuffer(words[r], np.uint8)]).tolist())
        return out

    def _bucket(self, words: list[bytes], rows: np.ndarray, width: int, out: list) -> None:
        raw = np.frombuffer(b"".join(words[r].ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
        length = np.array([len(words[r]) for r in rows])
        m = np.where(np.arange(width) < length[:, None], self.byte_ids[raw], -1)
        if width > 1:
            rank, slot = self.find(m[:, :-1], m[:, 1:])
        while len(rows):
            best = rank.argmin(axis=1) if m.shape[1] > 1 else np.zeros(len(rows), np.int64)
            at_row = np.arange(len(rows))
            done = rank[at_row, best] == _NONE if m.shape[1] > 1 else np.ones(len(rows), bool)
            if done.any():
                for r, ids in zip(rows[done].tolist(), m[done].tolist()):
                    out[r] = tuple(x for x in ids if x >= 0)
                keep = ~done
                rows, m, rank, slot, best = rows[keep], m[keep], rank[keep], slot[keep], best[keep]
                if not len(rows):
                    return
                at_row = np.arange(len(rows))
            m[at_row, best] = self.merged[slot[at_row, best]]
            step = np.arange(m.shape[1] - 1)
            m = np.take_along_axis(m, step + (step > best[:, None]), axis=1)
            if m.shape[1] == 1:
                rank, slot = rank[:, :0], slot[:, :0]
                continue
            step = step[:-1]
            move = step + (step >= best[:, None])
            rank, slot = np.take_along_axis(rank, move, axis=1), np.take_along_axis(slot, move, axis=1)
            for side in (best - 1, best):  # only the two pairs that touch the merged token change
                ok = np.flatnonzero((side >= 0) & (side < m.shape[1] - 1))
                c = side[ok]
                rank[ok, c], slot[ok, c] = self.find(m[ok, c], m[ok, c + 1])

    def _long(self, ids: np.ndarray) -> np.ndarray:
        while len(ids) > 1:
            rank, slot = self.find(ids[:-1], ids[1:])
            low = rank.min()
            if low == _NONE:
                break
            hit = np.flatnonzero(rank == low)
            if ids[hit[0]] == ids[hit[0] + 1]:  # a pair of equal ids can overlap itself: every second of a run
                run = np.concatenate([[0], np.cumsum(np.diff(hit) != 1)])
                first = hit[np.searchsorted(run, run)]
                hit = hit[(hit - first) % 2 == 0]
            ids[hit] = self.merged[slot[hit[0]]]
            ids = np.delete(ids, hit + 1)
        return ids


@lru_cache(maxsize=4)
def load(name: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> Vocabulary:
    """Read a vocabulary: ``<name>.json`` with a merge list, else ``<name>.tiktoken`` ranks."""
    try:
        whole = json.load(open(f"{tokenizers}/{name}.json", encoding="utf-8"))
    except FileNotFoundError:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{tokenizers}/{name}.tiktoken", "rb"))}
        pairs = [(ranks[w[:k]], ranks[w[k:]], r, r) for w, r in ranks.items() for k in range(1, len(w)) if w[:k] in ranks and w[k:] in ranks]
        return Vocabulary(np.array([ranks[bytes([b])] for b in range(256)]), *np.array(pairs, np.int64).T)
    cut, model = whole.get("pre_tokenizer") or {}, whole["model"]
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or cut.get("use_regex") is False or whole.get("normalizer"):
        raise ValueError(f"{name}: only vocabularies of plain byte-level pre-tokens are supported")
    vocab, names = model["vocab"], _byte_names()
    of_byte = np.zeros(256, np.int64)
    for ch, b in names.items():
        of_byte[b] = vocab[ch]
    pairs = []
    for r, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        pairs.append((vocab[a], vocab[b], r, vocab[a + b]))
    return Vocabulary(of_byte, *np.array(pairs, np.int64).T)


def encode(texts: list[str], vocab: Vocabulary, cache: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat ids of a list of texts; ``cache`` holds pre-tokens encoded before."""
    cut = [pretokens(t) for t in texts]
    new = list(set(chain.from_iterable(cut)).difference(cache))
    if len(cache) + len(new) > CACHE_WORDS:
        cache.clear()
        new = list(set(chain.from_iterable(cut)))
    cache.update(zip(new, vocab.encode_words([w.encode("utf-8", "surrogatepass") for w in new])))
    get = cache.__getitem__
    flat: list[int] = []
    ends = [0]
    for words in cut:
        flat.extend(chain.from_iterable(map(get, words)))
        ends.append(len(flat))
    return np.array(ends, np.int32), np.array(flat, np.int32)


def encode_corpus(df: DataFrame, *, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """``(key, ids)`` of every row of ``df``: a scan of two columns and no shuffle.

    The merge table has the size of the vocabulary (about 50,000 pairs, under 3 MB) whatever
    the corpus, and goes to the workers as one broadcast.
    """
    table = df.sparkSession.sparkContext.broadcast(load(name, tokenizers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, cache = table.value, {}
        for batch in batches:
            col = at.plain(batch.column(1))
            for a, b in at.blocks(col, 4 << 20):
                ends, flat = encode(col.slice(a, b - a).to_pylist(), vocab, cache)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key], df[text].cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
