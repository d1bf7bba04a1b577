"""Problem 8: estimate the level of schooling a document is written for.

Method: gradient-boosted regression trees over distributions of length (words per sentence,
letters and syllables per word), vocabulary (how typical each word and each sentence is of each
band, by hashed word statistics), syntax (marks, maths, capitals, joining words) and cohesion
(words carried from sentence to sentence, repetition).  Grades are predicted out of fold, with
the sources of the documents (at most ``FOLDS`` groups of them) as folds; the cut points between bands are calibrated on those
predictions.

The model is fitted on a bounded sample of rated documents (``RATED``, smallest key hashes, texts of
at most ``LONGEST`` bytes); its trees are grown on features whose word statistics never saw the
document's fold, as they will be for documents without a rating.  Scoring reads every document whole, in one scan without a shuffle.

Defined results: bands are compared without case and outer blanks, an unknown or null band is no
rating, repeated and disagreeing ratings are averaged; a document outside ``lang = 'en'`` or
under ``min_chars`` characters gets no row; without any usable rating every document gets the
lowest band.  Repeated documents get a row each.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm import arrowtext as at
from tallgrass.llm.boosting import Boosted

BANDS = ("primary", "middle", "secondary", "university")
#: Most rated documents the model is fitted on.
RATED = 6000
#: Most bytes of a text the model is fitted on, and most folds.
LONGEST, FOLDS = 1 << 16, 10
BITS = 17
_SHIFT = np.uint64(64 - BITS)
_VOWEL = np.zeros(256, bool)
for _c in b"aeiouyAEIOUY":
    _VOWEL[_c] = True
_MARKS = b",;:$\\?()'-"
_JOIN = np.array([at.hash_text(w) for w in "and but so then because while whereas which that whence moreover notwithstanding consequently therefore hence if when".split()], np.uint64)


class Parts:
    """Words, sentences and marks of a block of texts."""

    def __init__(self, col: pa.Array):
        self.data, self.off = at.buffers(col)
        d, n = self.data, len(self.data)
        self.w = w = at.Words(d, self.off)
        self.n = len(self.off) - 1
        space = np.zeros(n + 1, bool)
        space[:n] = (d == 32) | ((d >= 9) & (d <= 13))
        space[n] = True
        end = np.flatnonzero((d == 10) | (((d == 46) | (d == 33) | (d == 63)) & space[1:]))
        key = np.searchsorted(end, w.start) if n else np.zeros(0, np.int64)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (w.row[1:] != w.row[:-1])
        self.sent = np.cumsum(new) - 1  # sentence of each word
        self.sent_row = w.row[new]
        self.slot = (w.hash >> _SHIFT).astype(np.int64)
        self.slot[w.kind == 2] = 0  # all numbers are one word


def _stats(v: np.ndarray, row: np.ndarray, n: int) -> list[np.ndarray]:
    c = np.maximum(np.bincount(row, minlength=n), 1)
    m = at.row_sum(v, row, n) / c
    sd = np.sqrt(np.maximum(at.row_sum(v * v, row, n) / c - m * m, 0))
    top = np.zeros(n)
    np.maximum.at(top, row, v)
    return [m, sd, top]


def features(p: Parts, table: np.ndarray) -> np.ndarray:
    """Feature matrix of a block; ``table`` holds the log odds of each word slot for each band."""
    w, n = p.w, p.n
    words = np.maximum(w.count, 1)
    ns = len(p.sent_row)
    size = (w.end - w.start).astype(float)
    out = _stats(np.bincount(p.sent, minlength=ns).astype(float), p.sent_row, n)  # words a sentence
    real = w.kind == 1
    out += _stats(size[real], w.row[real], n)[:2]
    out += [at.row_sum((real & (size >= k)).astype(float), w.row, n) / words for k in (3, 6, 9, 12)]
    out += [at.row_sum((~real).astype(float), w.row, n) / words]
    vow = _VOWEL[p.data]
    syl = vow.copy()
    syl[1:] &= ~vow[:-1]
    chars = np.maximum(np.diff(p.off), 1)
    acc = np.concatenate([[0], np.cumsum(syl)])
    out += [(acc[p.off[1:]] - acc[p.off[:-1]]) / words]
    for c in _MARKS:
        acc = np.concatenate([[0], np.cumsum(p.data == c)])
        out.append((acc[p.off[1:]] - acc[p.off[:-1]]) / chars * 100)
    acc = np.concatenate([[0], np.cumsum((p.data >= 65) & (p.data <= 90))])
    out.append((acc[p.off[1:]] - acc[p.off[:-1]]) / chars)
    out.append(at.row_sum(np.isin(w.hash, _JOIN).astype(float), w.row, n) / words)
    # vocabulary: word scores, then sentence posteriors
    t = table[p.slot]
    for b in range(len(BANDS)):
        out.append(at.row_sum(t[:, b], w.row, n) / words)
    grade = t[:, 1] + 2 * t[:, 2] + 3 * t[:, 3]
    out += [at.row_sum((grade < c).astype(float), w.row, n) / words for c in (-2, -1, -0.3, 0.3, 1, 2)]
    s = np.stack([np.bincount(p.sent, weights=t[:, b], minlength=ns) for b in range(len(BANDS))], axis=1) if ns else np.zeros((0, len(BANDS)))
    post = np.exp(s - s.max(axis=1, keepdims=True, initial=-1e9))
    post /= np.maximum(post.sum(axis=1, keepdims=True), 1e-12)
    sents = np.maximum(np.bincount(p.sent_row, minlength=n), 1)
    for b in range(len(BANDS)):
        out.append(at.row_sum(post[:, b], p.sent_row, n) / sents)
    long = np.bincount(p.sent, minlength=ns).astype(float)
    for b in range(len(BANDS)):  # the same by words instead of sentences
        out.append(at.row_sum(post[:, b] * long, p.sent_row, n) / words)
    mean = post[:, 1] + 2 * post[:, 2] + 3 * post[:, 3]
    out += _stats(mean, p.sent_row, n)
    # cohesion: words carried over from the sentence before; share of distinct words
    key = w.row.astype(np.uint64) << np.uint64(44) | (w.hash >> np.uint64(20))
    by = np.argsort(key, kind="stable")  # equal words of a text side by side, in the order of its sentences
    again = key[by][1:] == key[by][:-1]
    carried = again & (np.diff(p.sent[by]) == 1)
    out.append(np.bincount(w.row[by][1:][carried], minlength=n) / words)
    out.append((w.count - np.bincount(w.row[by][1:][again], minlength=n)) / words)
    out.append(np.log1p(words))
    return np.stack([np.asarray(o, float) for o in out], axis=1)


def word_table(slots: list[np.ndarray], grades: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """Log odds of each word slot for each band against all, from documents and mean grades."""
    c = np.zeros((1 << BITS, len(BANDS)))
    lo = np.clip(np.floor(grades).astype(int), 0, len(BANDS) - 1)
    hi = np.minimum(lo + 1, len(BANDS) - 1)
    up = grades - lo
    for s, a, b, u in zip(slots, lo, hi, up):
        s = np.unique(s)  # a document tells of a word once
        c[s, a] += 1 - u
        c[s, b] += u
    seen = c.sum(axis=1)
    docs = np.maximum(np.bincount(lo, weights=1 - up, minlength=len(BANDS)) + np.bincount(hi, weights=up, minlength=len(BANDS)), 1)
    p = (c + smooth) / (docs + 2 * smooth)
    t = np.log(p / p.mean(axis=1, keepdims=True))
    t[seen == 0] = 0
    return t


def folds_of(sources: np.ndarray) -> np.ndarray:
    """Fold of each document: by source, several sources to a fold where there are more than ``FOLDS``; five folds of a single source."""
    number, names = pd.factorize(pd.Series(sources, dtype=object).fillna(""))
    if len(names) == 1:
        return np.arange(len(number)) % 5
    return number if len(names) <= FOLDS else np.array([zlib.crc32(str(n).encode()) % FOLDS for n in names])[number]


class Model:
    """Word table, trees and calibrated cut points."""

    def __init__(self, texts: list[str], grades: np.ndarray, sources: np.ndarray):
        grades = np.asarray(grades, float)
        self.report = pd.DataFrame({"source": [], "n": [], "accuracy": [], "mae": []})
        self.cuts = np.arange(len(BANDS) - 1) + 0.5
        self.trees: Boosted | None = None
        if len(texts) == 0:
            return
        folds = folds_of(sources)
        order = np.argsort(folds, kind="stable")  # documents of a fold side by side
        texts, grades, sources, folds = [texts[i] for i in order], grades[order], np.asarray(sources, object)[order], folds[order]
        parts = []
        for k in np.unique(folds):
            col = at.plain(pa.array([t for t, f in zip(texts, folds) if f == k], pa.string()))
            parts += [(k, Parts(col.slice(a, b - a))) for a, b in at.blocks(col)]
        slots = [s for _, p in parts for s in np.split(p.slot, np.cumsum(p.w.count)[:-1])]
        tables = {}
        for k in np.unique(folds):  # word statistics of a document never hold its own fold
            rest = np.flatnonzero(folds != k)
            tables[k] = word_table([slots[i] for i in rest], grades[rest])
        x = np.concatenate([features(p, tables[k]) for k, p in parts])
        out = np.zeros(len(texts))
        for k in np.unique(folds):
            rest = folds != k
            out[~rest] = Boosted().fit(x[rest], grades[rest]).predict(x[~rest]) if rest.any() else grades.mean()
        truth = np.rint(grades).astype(int)
        self.cuts = calibrate(out, truth)
        got = np.searchsorted(self.cuts, out)
        r = pd.DataFrame({"source": sources, "ok": got == truth, "err": np.abs(out - grades)})
        self.report = r.groupby("source", dropna=False).agg(n=("ok", "size"), accuracy=("ok", "mean"), mae=("err", "mean")).reset_index()
        self.report["source"] = [None if s != s else s for s in self.report["source"]]
        self.table = word_table(slots, grades).astype(np.float32)
        self.trees = Boosted().fit(x, grades)

    def grades(self, col: pa.Array) -> np.ndarray:
        """Estimated grades of a block of texts."""
        return np.zeros(len(col)) if self.trees is None else self.trees.predict(features(Parts(col), self.table))

    def bands(self, col: pa.Array) -> np.ndarray:
        """Band numbers of a block of texts."""
        return np.zeros(len(col), np.int64) if self.trees is None else np.searchsorted(self.cuts, self.grades(col))


def calibrate(pred: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Cut points, in the middle half between two bands, that put most held-out predictions into their band."""
    cuts = []
    for b in range(len(BANDS) - 1):
        grid = np.linspace(b + 0.25, b + 0.75, 51)
        near = (truth == b) | (truth == b + 1)
        right = [((pred[near] >= g) == (truth[near] > b)).sum() - abs(g - b - 0.5) for g in grid]
        cuts.append(grid[int(np.argmax(right))])
    return np.array(cuts)


def rated(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)``: the mean grade of every document with a usable rating."""
    band = F.lower(F.regexp_replace("band", r"^\s+|\s+$", ""))
    grade = F.array_position(F.array(*map(F.lit, BANDS)), band) - 1
    return labels.select("doc_id", grade.cast("double").alias("grade")).where("grade >= 0").groupBy("doc_id").agg(F.avg("grade").alias("grade"))


def sample_keys(docs: DataFrame, labels: DataFrame, bound: int, seed: int = 7) -> DataFrame:
    """``(doc_id, grade)`` of the rated documents the model is fitted on: those with the smallest key hashes."""
    own = rated(labels).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return own.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(bound)


def rated_documents(docs: DataFrame, labels: DataFrame, *, bound: int = RATED) -> pd.DataFrame:
    """Texts, sources and mean grades of at most ``bound`` rated documents, of at most ``LONGEST`` bytes each."""
    usable = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= LONGEST)).select("doc_id", "text", "source")
    return usable.join(F.broadcast(sample_keys(docs, labels, bound)), "doc_id").select("text", "source", "grade").limit(bound).toPandas()  # the limit matters where keys repeat


def fit(docs: DataFrame, labels: DataFrame, *, bound: int = RATED) -> Model:
    """The model of a set of rated documents."""
    got = rated_documents(docs.where("lang = 'en'"), labels, bound=bound)
    return Model(got["text"].tolist(), got["grade"].to_numpy(float), got["source"].to_numpy(object))


def accuracy(docs: DataFrame, labels: DataFrame, *, bound: int = RATED) -> DataFrame:
    """``(source, n, accuracy, mae)`` over all rated English documents: those of the sample out of fold, all others by the fitted model."""
    english = docs.where("lang = 'en' and text is not null")
    made = fit(docs, labels, bound=bound)
    model = docs.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, truth = at.plain(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in at.blocks(col):
                g, t = model.value.grades(col.slice(a, b - a)), truth[a:b]
                right = np.searchsorted(model.value.cuts, g) == np.rint(t)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(right.astype(float)), pa.array(np.abs(g - t))], names=["source", "ok", "err"])

    rest = rated(labels).join(sample_keys(docs.where("lang = 'en'"), labels, bound).select("doc_id"), "doc_id", "left_anti")
    far = english.select("doc_id", "source", "text").join(rest, "doc_id").select("source", "text", "grade").mapInArrow(run, "source string, ok double, err double")
    far = far.groupBy("source").agg(F.count("*").alias("n"), F.sum("ok").alias("ok"), F.sum("err").alias("err"))
    near = [(r.source, int(r.n), float(r.accuracy * r.n), float(r.mae * r.n)) for r in made.report.itertuples()]
    both = far.unionByName(docs.sparkSession.createDataFrame(near, "source string, n bigint, ok double, err double"))
    return both.groupBy("source").agg(F.sum("n").alias("n"), (F.sum("ok") / F.sum("n")).alias("accuracy"), (F.sum("err") / F.sum("n")).alias("mae"))


def levels(docs: DataFrame, labels: DataFrame, *, min_chars: int = 300, key: str = "doc_id") -> DataFrame:
    """``(key, band)`` of every English document of at least ``min_chars`` characters."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(BANDS)
        for batch in batches:
            col = at.plain(batch.column(1))
            for a, b in at.blocks(col):
                got = names[model.value.bands(col.slice(a, b - a))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(got.tolist(), pa.string())], names=[key, "band"])

    kind = docs.schema[key].dataType.simpleString()
    wanted = docs.where((F.col("lang") == "en") & (F.col("n_chars") >= min_chars))
    return wanted.select(wanted[key], wanted["text"].cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, band string")
