"""Problem 4: find responses that were cut by a field limit or a broken transfer.

Method: whole responses are cut on purpose; a hashed logistic regression is trained on their
closing characters and words, punctuation, open brackets and boxes, and whether they end at the
length at which their run cuts (``pairs.run_limits``, counted over all rows); its threshold is
calibrated on held-out cuts; then every record is scored.  Refusals, copies of the question,
empty texts and responses in other languages are among the whole examples, so the model learns
that they are no cuts.

Only the training sample is bounded (``pairs.SAMPLE``); limits and scores cover all rows, whole.

Defined results: null and empty responses are not cut; a response whose item is missing counts
as having one answer; repeated rows are judged each; run tags are compared without case and
outer blanks; a null tag is a run of its own without limit.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm import fieldshape as fs
from tallgrass.llm import linear, pairs


class Detector:
    """The trained regression."""

    def __init__(self, sample: pd.DataFrame, seed: int = 4):
        self.model, self.tongue = None, pairs.tongue_of(sample)
        if not len(sample):
            return
        rng = random.Random(seed)
        self.refusals = pairs.refusals_of(sample, rng)
        texts, questions, slots, limit, y = pairs.broken(sample, rng, self.tongue)
        if not texts:
            return
        x, slot, row = pairs.in_parts("response", texts, questions, slots, limit, self.tongue, refusals=self.refusals)
        self.model = linear.Linear(1, x.shape[1]).fit(x, slot, row, y[:, 1:2])
        self.held_out = self.model.held_out[0]

    def cut(self, texts: pa.Array, owner: np.ndarray, q: fs.Questions, slots: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether each text was cut."""
        if self.model is None:
            return np.zeros(len(texts), bool)
        x, slot, row = fs.response_features(texts, owner, q, slots, limit, self.refusals)
        return (self.model.scores(x, slot, row)[:, 0] > self.model.cut[0]) & (x[:, 0] == 0)


def judged(responses: DataFrame, items: DataFrame, *, bound: int = pairs.SAMPLE) -> DataFrame:
    """``(scan_idx, run_tag, cut)`` of every response: one scan for lengths and sample, one for the scores."""
    questions = pairs.question_frame(items)
    table = pairs.shipped(questions)
    counted, sample = pairs.survey(responses, bound)
    fitted = Detector(pairs.of_items(sample, questions, table)[["response", "question", "slots"]])
    model = responses.sparkSession.sparkContext.broadcast(fitted)

    def run(parts: Iterator[pairs.Part]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            got = model.value.cut(p.text, p.owner, p.questions, p.slots, p.limit)
            yield pa.RecordBatch.from_arrays([*p.columns, pa.array(got)], names=["scan_idx", "run_tag", "cut"])

    given = pairs.with_limits(responses, pairs.limits_of(counted))
    return pairs.judged_parts(given, questions, table, fitted.tongue, ["scan_idx", "_tag"], run, "scan_idx bigint, run_tag string, cut boolean")


def rates(found: DataFrame) -> DataFrame:
    """``(run_tag, rows, cut_rows, cut_rate)``: how often each source cuts."""
    out = found.groupBy("run_tag").agg(F.count("*").alias("rows"), F.count_if("cut").alias("cut_rows"))
    return out.withColumn("cut_rate", F.col("cut_rows") / F.col("rows"))
