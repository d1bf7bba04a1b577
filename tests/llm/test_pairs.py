"""Pair defects off the forms that were planted: wordings that training does not hold, whole answers without a box, long footers."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tallgrass.llm import fieldshape as fs
from tallgrass.llm import pairs
from tests.llm import test_text_operators as operators
from tests.llm.test_text_operators import QUESTIONS

#: Refusals worded as no part of the training grammar words them.
UNSEEN = (
    "Apologies, but solving that is beyond what I'm permitted to do.", "I would prefer to leave that alone.", "My apologies, this falls outside what I may talk about.", "Regrettably, I cannot offer any help on that matter.",
    "I'm not comfortable answering this one.", "I won't be giving an answer to this.", "Sorry, I am unable to process such a request.", "I must respectfully decline to respond.", "I can't be of help here.", "We are not able to assist you with this matter.",
    "I have decided not to answer that.", "I'd rather not get into this question.",
)
WHOLE = ("So x = 100.", "<think>\nadd both sides\n</think>\nThe answer is 100.", "Therefore the sum is 100.", "We add both sides. The total comes to 57.", "Adding gives 7. Hence the value of n is 12.")
FINE = ("does not exist", "no solution", "infinitely many solutions", "cannot be determined", "none of these", "increasing", "12", "x+1", "\\frac{1}{2}", "Yes", "all real numbers")
DECLINED = ("no comment", "not telling", "confidential", "I will not answer this", "I can't answer that question", "answer refused")


def tables(spark):
    """The tables of the other tests, whose own random numbers stay as they are."""
    state = operators.rng.getstate()
    try:
        return operators.tables(spark)
    finally:
        operators.rng.setstate(state)


@pytest.fixture(scope="module")
def model(spark):
    sft, resp, it, _ = tables(spark)
    s = sft.toPandas()
    s["slots"] = 1
    r = resp.where("response is not null").toPandas().merge(it.toPandas()[["id", "question"]], on="id", how="left")
    r["slots"] = 1
    import pandas as pd

    both = pd.concat([r[["response", "question", "slots"]], s[["response", "question", "slots"]]])
    return pairs.Classifier(both, s[["answer", "question", "slots", "response"]])


def judged(m, field, texts):
    q = fs.Questions(pa.array([QUESTIONS[0]]), m.tongue)
    n = len(texts)
    got = m.judge(field, pa.array(texts), np.zeros(n, int), q, np.ones(n, int), np.zeros(n))
    return [pairs.LABELS[k] if k >= 0 else None for k in got]


def test_refusals_in_other_words(model):
    got = judged(model, "response", list(UNSEEN))
    assert got.count("refusal") >= 9 and None not in got
    footer = "\n\nThis page is maintained by the volunteers of the mathematics club. " * 30
    assert judged(model, "response", [u + footer for u in UNSEEN]).count("refusal") >= 7


def test_whole_answers_without_a_box(model):
    assert judged(model, "response", list(WHOLE)).count(None) >= 4


def test_worded_answers(model):
    assert judged(model, "answer", list(FINE)).count(None) >= 10
    assert judged(model, "answer", list(DECLINED)).count("refusal") >= 5


def test_other_shapes(model):
    cut = "<think>\nFactor out the common term and simpl"
    assert judged(model, "response", ["\\boxed{}" * 30, (QUESTIONS[0] + " ") * 3, cut, "<think>\nFactor out the common term and simplify.\n</think>\n\nFinal Answer: \\boxed{5}", ""]) == ["empty", "copy", "truncated", None, "empty"]
    assert judged(model, "answer", ["\\frac{3}{", "", "N/A"]) == ["truncated", "empty", "empty"]


def test_refusals_are_made_of_parts():
    rng = random.Random(1)
    said = {pairs.refusal(rng) for _ in range(2000)}
    assert len(said) > 1000 and not any("{" in s for s in said)


def test_questions_too_large_to_send_are_joined(spark, monkeypatch):
    sft, resp, it, _ = tables(spark)
    want = {tuple(r) for r in pairs.defects(sft, resp, it).collect()}
    monkeypatch.setattr(pairs, "SHIPPED_BYTES", 10)
    monkeypatch.setattr(pairs, "SHIPPED_LIMITS", 0)
    got = {tuple(r) for r in pairs.defects(sft, resp, it).collect()}
    assert len(want ^ got) <= 0.01 * len(want)


def test_survey_counts_every_row_once(spark):
    rows = [(i, i % 7, " Run-A " if i % 3 else None, None if i % 11 == 0 else "x" * (i % 50)) for i in range(1000)]
    df = spark.createDataFrame(rows, "scan_idx bigint, id bigint, run_tag string, response string").repartition(3)
    counted, sample = pairs.survey(df, 100)
    assert {tuple(r) for r in counted.collect()} == {tuple(r) for r in pairs.lengths(df).collect()}
    assert len(sample) == 100 and sample["scan_idx"].is_unique and sample["response"].isna().any()
    again = pairs.survey(df.repartition(5), 100)[1]
    assert sorted(again["scan_idx"]) == sorted(sample["scan_idx"])
