"""Problem 1: flag defective answers and responses with their type of defect.

Method: a multi-label linear classifier (``linear.Linear``) over hashed n-grams of the closing
part and pair features (``fieldshape``), trained on responses broken on purpose: cut, copied from
their question in other writing, swapped with a response in another language, refused, emptied.
Refusals are put together from parts, a sentence model (``fieldshape.Refusals``) finds them
anywhere in a text, and whole responses that state their value without a box are among the whole
examples.  Thresholds are calibrated on held-out broken and whole fields.  A field gets the label whose
score lies farthest above its threshold, or none; only a field with nothing in it is ``empty`` whatever its scores.

Only the training sample is bounded (``SAMPLE`` rows of each table, of at most ``LONGEST`` bytes each);
scoring reads every row whole.  responses is read twice (lengths and sample, scores), sft_corpus
twice (sample, scores), without a shuffle of text.

Defined results: null is ``empty``; a response whose question is missing is judged without pair
features; a repeated item id has the question exported last; repeated rows are judged each; extra columns are
ignored; with no row to learn from, only ``empty`` is found.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.llm import arrowtext as at
from tallgrass.llm import fieldshape as fs
from tallgrass.llm import language
from tallgrass.llm.linear import Linear

LABELS = ("empty", "truncated", "refusal", "copy", "language")
#: Most rows of each table that the classifier is trained on.
SAMPLE = 2000
#: Most bytes of a text that is taken into the training sample.
LONGEST = 1 << 16
#: Most bytes of questions that are sent to the workers; more are joined to their responses.
SHIPPED_BYTES = 32 << 20
#: Most runs whose limits are sent to the workers, and parts of a run where more are joined.
SHIPPED_LIMITS, SALTS = 100_000, 64
#: Sentences the model of refusals is trained on.
SENTENCES = 6000
#: Of so many whole responses one is also shown without a box.
UNBOXED = 6
#: Share of a run's rows, and rows, that end at a length at least where it is the run's limit.
AT_LIMIT, ROWS_AT_LIMIT = 0.005, 5
#: Times the mean count of the ``BELOW`` lengths before it that a limit's count is at least.
SPIKE, BELOW = 3, 8
#: Longer rows for each row at a limit, at most: marks put behind a cut, and strays.
LONGER = 0.25

#: Material for broken fields.  Refusals are put together from parts, so that their forms are learnt, not their wording.
WHO = ("I", "I", "I", "We", "As an AI, I", "As an assistant I", "Sorry, but I", "I'm sorry, I", "I apologise, but I", "Unfortunately I", "I'm afraid I", "This system")
UNABLE = (
    "can't", "cannot", "can not", "could not possibly", "won't", "will not", "am unable to", "am not able to", "am not allowed to", "am not permitted to", "decline to", "refuse to", "must decline to", "have to decline to",
    "would rather not", "prefer not to", "would prefer not to", "do not wish to", "am not willing to", "am not in a position to", "do not feel able to", "have been told not to", "choose not to",
)
DO = (
    "answer", "solve", "do", "discuss", "attempt", "help with", "assist with", "respond to", "comment on", "provide an answer to", "give a solution for", "give a result for", "work on", "work through", "deal with", "go into", "take on", "finish",
    "continue with", "engage with", "say anything about", "complete", "share the result of",
)
WHAT = ("this", "that", "this one", "it", "this question", "that question", "this problem", "that problem", "this task", "this exercise", "your request", "this request", "the problem", "the question", "requests like this", "such a question")
OTHERWISE = (
    "No {n} will be {g} {h}.", "There will be no {n} {h}.", "A {n} cannot be {g} {h}.", "This is not something I {u} {v}.", "That is nothing I {u} {v}.", "This {t} cannot be {f}.", "I have no {n} to give {h}.", "Your {t} is declined.",
    "I must leave this {t} unanswered.", "I will stop {h} without a {n}.", "Let us {k} something else.", "Let's {k} another subject.", "Could we {k} a different topic?", "My {r} do not allow me to {w} this.", "It would be wrong of me to {w} this.",
    "I have to pass on this {t}.", "{W} this would not be {a}.", "{W} this for you is not {a}.", "This {t} falls outside what I {u} {v}.", "That lies beyond what I {u} {v}.", "{W} it {h} would be {b}.", "It would not be {a} to {w} this {h}.", "I would like to leave this {t} alone.", "I'd rather {k} something else.", "I refuse.", "I decline.", "No comment.",
)
FILL = {
    "n": ("solution", "answer", "result", "reply", "response"), "g": ("given", "provided", "offered", "shared", "shown", "disclosed"), "h": ("", "here", "for this", "to this", "today"), "u": ("can", "could", "may", "will", "want to", "am able to"),
    "v": ("help with", "do", "answer", "assist with", "solve", "support"), "t": ("question", "request", "problem", "task", "exercise"), "f": ("completed", "answered", "processed", "handled", "fulfilled"), "k": ("talk about", "discuss", "turn to", "speak about"),
    "W": ("Answering", "Solving", "Finishing", "Doing", "Completing", "Discussing"), "a": ("right", "proper", "fair", "correct", "suitable", "allowed"), "b": ("wrong", "unfair", "against the rules", "improper"),
    "r": ("guidelines", "rules", "instructions", "policies"), "w": ("answer", "solve", "finish", "discuss", "complete"),
}
WHY = (
    "", "", "It is against the rules.", "This seems to be an exam.", "My instructions forbid it.", "A drawing would be needed.", "Some information is not there.", "It is more than I can read.", "Someone at your school can help you.", "A good book will explain it.",
    "You are welcome to ask anything else.", "I hope you understand.", "Please put it in other words.", "Could I help with another matter?",
)
REFUSE_SHORT = (
    "refused", "refusing", "withheld", "not disclosed", "undisclosed", "confidential", "secret", "no comment", "not telling", "won't say", "will not say", "rather not say", "can't say", "cannot say", "not allowed", "not permitted", "request denied",
    "access denied", "denied", "declining", "skipped on purpose", "pass on this", "ask someone else", "ask a teacher", "look it up yourself", "not going to answer", "answer refused", "answer declined", "no answer from me", "unwilling to answer",
    "sorry", "sorry, no", "I pass", "this cannot be shared", "not for publication", "not available to you", "against the rules", "policy forbids it",
)
#: Whole answers in words, as mathematics writes them.
WORDED = (
    "does not exist", "no solution", "no solutions", "no real solution", "infinitely many solutions", "infinitely many", "undefined", "not defined", "cannot be determined", "none", "none of these", "all real numbers", "any real number", "always true",
    "never", "always", "sometimes true", "increasing", "decreasing", "neither", "both", "constant", "diverges", "converges", "converges absolutely", "parallel", "perpendicular", "not enough information", "impossible", "it is not possible",
    "not a function", "empty set", "the empty set", "yes", "no", "true", "false", "DNE", "even", "odd", "rational", "irrational", "prime", "not prime", "a circle", "an ellipse", "half", "twice as many", "the first one", "left", "right",
    "isosceles", "skewed right", "fail to reject", "reject the null hypothesis", "linearly independent", "one-to-one", "positive infinity", "no limit", "equal", "cannot be simplified", "not equal", "undetermined", "unbounded",
)
#: How a whole response ends that boxes nothing.
CONCLUDE = (
    "So {x} = {v}.", "Thus {x} = {v}.", "The answer is {v}.", "The answer is {v}", "Therefore the {y} is {v}.", "So the {y} is {v}.", "Thus, the {y} equals {v}.", "Hence the {y} is {v}.", "Therefore, {x} is {v}.", "So we get {v}.",
    "So, finally, the {y} is {v}.", "This gives {v} as the answer.", "We conclude that {x} = {v}.", "Finally, the {y} is {v}.", "So the correct choice is {v}.", "My answer: {v}", "It comes to {v}.", "Therefore {x} = {v}.", "Thus the {y} must be {v}.",
)
#: Sentences and words of other languages: the prose the language model starts from.
ELSEWHERE = {k: [t.strip() + "." for t in v.replace("。", ". ").split(". ") if len(t) > 12][:-1] for k, v in language.SEEDS.items() if k != "en"}
ELSEWHERE_WORDS = {k: [w for w in re.findall(r"[^\W\d_]+", v) if len(w.encode()) > 3] for k, v in language.SEEDS.items() if k != "en"}
_EMPTY = ("", " ", "\n\n", "\t", "​", "\xa0", "null", "N/A", "nan", "--", "-", "?", "…", "[]", "{}", '""', "\\boxed{}", "\\boxed{ }", "<think>\n\n</think>", "<think>\n</think>\n\n\\boxed{}", "Final Answer: \\boxed{}", "<think>\n\n</think>\n\nFinal Answer:\\boxed{ }", "<think></think>\n\nFinal Answer:", "Final Answer:", "ANSWER: ", "<think>\n</think>\n\n**Final Answer**\n")
RESULT = ("sum", "value", "total", "result", "answer", "number", "product", "area", "solution", "cost", "share", "difference", "probability", "final answer")
_LEAD = ("The problem says: ", "We have this question: ", "Let me repeat the task: ", "Given: ")


def question_frame(items: DataFrame) -> DataFrame:
    """``(id, question, slots)``: the question exported last of each item, and the answers it asks for."""
    last = F.max_by(F.struct("question", F.size(F.coalesce("answer", F.array().cast("array<string>"))).alias("answers")), F.struct("updated_at", "scan_idx"))
    q = items.where("id is not null and question is not null").groupBy("id").agg(last.alias("q"))
    blanks = F.regexp_count("q.question", F.lit(r"\[ANS\]"))
    return q.select("id", "q.question", F.greatest(F.lit(1), F.when(blanks > 0, blanks).otherwise(F.col("q.answers"))).alias("slots"))


def shipped(questions: DataFrame) -> pd.DataFrame | None:
    """The questions for the workers, sorted by id; None where they are too large to be sent."""
    if (questions.agg(F.sum(F.octet_length("question"))).first()[0] or 0) > SHIPPED_BYTES:
        return None
    return questions.orderBy("id").toPandas().astype({"id": "int64", "slots": "int64"})


def of_items(sample: pd.DataFrame, questions: DataFrame, table: pd.DataFrame | None) -> pd.DataFrame:
    """A sample of responses with the questions of their items."""
    if table is None:
        ids = questions.sparkSession.createDataFrame(sample[["id"]].dropna().drop_duplicates().astype("int64"))
        table = questions.join(F.broadcast(ids), "id").toPandas()
    out = sample.merge(table, on="id", how="left")
    out["slots"] = out["slots"].fillna(1)
    return out


def _tag() -> Column:
    return F.lower(F.trim("run_tag")).alias("_tag")


def lengths(responses: DataFrame) -> DataFrame:
    """``(_tag, c, b, n)``: rows of each run by characters and bytes, combined before the shuffle."""
    one = responses.where("response is not null").select(_tag(), F.length("response").alias("c"), F.octet_length("response").alias("b"))
    return one.groupBy("_tag", "c", "b").agg(F.count("*").alias("n"))


def limits_of(counted: DataFrame) -> DataFrame:
    """``(_tag, _chars, _bytes)`` of the runs that have a field limit, from their lengths.

    A limit is a length at which rows pile up against the lengths just below it, with few rows
    above: it need not be the run's greatest length.
    """

    def peak(col: str, name: str) -> DataFrame:
        at_len = counted.groupBy("_tag", F.col(col).alias("l")).agg(F.sum("n").alias("n"))
        run, own = Window.partitionBy("_tag").orderBy("l"), Window.partitionBy("_tag")
        below = F.coalesce(F.sum("n").over(run.rangeBetween(-BELOW, -1)), F.lit(0)) / BELOW
        above = F.sum("n").over(own) - F.sum("n").over(run.rangeBetween(Window.unboundedPreceding, 0))
        c = at_len.select("_tag", "l", "n", below.alias("below"), above.alias("above"), F.sum("n").over(own).alias("t"))
        spike = (F.col("n") >= ROWS_AT_LIMIT) & (F.col("n") >= AT_LIMIT * F.col("t")) & (F.col("n") >= SPIKE * F.col("below")) & (F.col("above") <= LONGER * F.col("n"))
        return c.groupBy("_tag").agg(F.max(F.when(spike, F.col("l"))).alias(name))

    return peak("c", "_chars").join(peak("b", "_bytes"), "_tag", "full")


def run_limits(responses: DataFrame) -> DataFrame:
    """``(_tag, _chars, _bytes)``: the field limit of each run in characters or bytes, null without one."""
    return limits_of(lengths(responses))


def with_limits(responses: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Responses with ``_limit``: whether the row ends at its run's field limit; and ``_at``, the same as the models see it.

    A cut within a character leaves up to three bytes less than the limit; for ``_at`` only a text
    with such characters is taken to have been cut within one.  The limits are sent to the workers;
    those of more than ``SHIPPED_LIMITS`` runs are joined instead, each run split into ``SALTS``
    parts so that no run's texts meet in one task.
    """
    limits = (run_limits(responses) if limits is None else limits).where("_chars is not null or _bytes is not null")
    rows = limits.limit(SHIPPED_LIMITS + 1).collect()
    marked = responses.withColumn("_tag", _tag())
    if len(rows) <= SHIPPED_LIMITS:
        joined = marked.join(F.broadcast(responses.sparkSession.createDataFrame(rows, "_tag string, _chars int, _bytes int")), "_tag", "left")
    else:
        salted = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = marked.withColumn("_salt", F.pmod(F.xxhash64("scan_idx"), F.lit(SALTS)).cast("int")).join(salted, ["_tag", "_salt"], "left")
    size, left = F.length("response"), F.col("_bytes") - F.octet_length("response")
    near = (size == F.col("_chars")) | left.between(0, 3)
    at_ = (size == F.col("_chars")) | (left == 0) | (left.between(1, 3) & (F.octet_length("response") > size))
    return joined.select("scan_idx", "id", "_tag", "response", F.coalesce(near, F.lit(False)).alias("_limit"), F.coalesce(at_, F.lit(False)).alias("_at"))


def _picked(df: DataFrame, bound: int, text: str) -> tuple[Column, Column]:
    """A hash of the key, and whether the row is a candidate of the sample: about a quarter more than wanted."""
    h = F.xxhash64(F.lit(11), "scan_idx")
    share = int((1 << 20) * min(1.0, 1.25 * bound / max(df.count(), 1)) + 64)
    return h, (F.pmod(h, F.lit(1 << 20)) < share) & (F.coalesce(F.octet_length(text), F.lit(0)) <= LONGEST)


def bounded(df: DataFrame, bound: int) -> pd.DataFrame:
    """The ``bound`` rows with the smallest key hashes."""
    h, picked = _picked(df, bound, "response")
    return df.where(picked).withColumn("_h", h).orderBy("_h").limit(bound).drop("_h").toPandas()


def survey(responses: DataFrame, bound: int) -> tuple[DataFrame, pd.DataFrame]:
    """Lengths of all rows by run (see ``lengths``) and a sample of rows, in one pass over the texts.

    Tasks count the lengths of their rows, and pass on the texts of the sample only; what they give
    is small and kept until both are taken from it.
    """
    h, picked = _picked(responses, bound, "response")
    narrow = responses.select(_tag(), F.length("response").alias("c"), F.octet_length("response").alias("b"), F.when(picked, h).alias("h"), "scan_idx", "id", F.when(picked, F.col("response")).alias("response"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            some = t.filter(pc.is_valid(t["c"])).group_by(["_tag", "c", "b"]).aggregate([([], "count_all")])
            none = pa.nulls(some.num_rows)
            cols = {"_tag": some["_tag"], "c": some["c"], "b": some["b"], "n": some["count_all"], "h": none.cast(pa.int64()), "scan_idx": none.cast(pa.int64()), "id": none.cast(pa.int64()), "response": none.cast(pa.string())}
            yield from pa.table(cols).combine_chunks().to_batches()
            kept = t.filter(pc.is_valid(t["h"]))
            if kept.num_rows:
                none = pa.nulls(kept.num_rows)
                yield from pa.table({"_tag": none.cast(pa.string()), "c": none.cast(pa.int32()), "b": none.cast(pa.int32()), "n": none.cast(pa.int64()), **{k: kept[k] for k in ("h", "scan_idx", "id", "response")}}).combine_chunks().to_batches()

    seen = narrow.mapInArrow(count, "_tag string, c int, b int, n bigint, h bigint, scan_idx bigint, id bigint, response string").persist()
    sample = seen.where("h is not null").orderBy("h").limit(bound).select("scan_idx", "id", "response").toPandas()
    return seen.where("n is not null").groupBy("_tag", "c", "b").agg(F.sum("n").alias("n")), sample


def rewritten(q: str, rng: random.Random) -> str:
    """A question in another writing of the same words."""
    for f in rng.sample([str.upper, lambda s: s.replace(" ", "  ") + "\n", lambda s: s.replace("[ANS]", "____").replace("$", ""), lambda s: "Question: " + s, lambda s: "> " + s, str.lower, lambda s: s, lambda s: s.rsplit(". ", 1)[0] + "."], rng.choice((0, 1, 1, 2))):
        q = f(q)
    return q


def cut(t: str, rng: random.Random) -> str:
    """A whole response cut before its final answer is complete, now and then with a mark of the cut."""
    box = max(t.rfind("\\boxed{"), t.rfind("\\fbox{"))
    end = t.find("}", box) if box >= 0 else fs.value_start(t)
    start = max(t.rfind("</think>"), t.rfind("</redacted_thinking>"), 0)
    end = max(1, end)
    kind = rng.random()
    if kind < 0.3 and start < end:
        t = t[: rng.randint(start, end)]
    elif kind < 0.4 and (k := t.rfind(". ", 0, end)) > 0:
        t = t[: k + 1]
    else:
        t = t[: rng.randint(min(end, 1 + end // 8), end)]
    return t + rng.choice(("",) * 12 + ("…", "...", " [...]", "<br", "\n", " "))


def refusal(rng: random.Random) -> str:
    """A sentence that declines to answer."""
    if rng.random() < 0.35:
        said = rng.choice(OTHERWISE)
        return " ".join(said.format(**{k: rng.choice(v) for k, v in FILL.items()}).split()).replace(" .", ".")
    return f"{rng.choice(WHO)} {rng.choice(UNABLE)} {rng.choice(DO)} {rng.choice(WHAT)}."


def refused(t: str, rng: random.Random) -> str:
    """A refusal, alone or after reasoning, now and then with much behind it."""
    r = " ".join(x for x in (refusal(rng), rng.choice(WHY), rng.choice(WHY)) if x)
    body = t.split("</", 1)[0].rsplit("\\boxed", 1)[0]
    kind = rng.random()
    if kind < 0.3:
        body = body[: rng.randint(0, len(body))].rsplit(". ", 1)[0]
        r = body + (". " if body and body[-1:] != "." else " ") + r + ("\n</think>\n\n" + refusal(rng) if body.startswith("<think>") and rng.random() < 0.7 else "")
    elif kind < 0.4:
        r = "> " + r + "\n"
    elif kind < 0.5:
        r += "\n\n" + body.replace("<think>", "").strip()[: rng.randint(0, 600)].rsplit(". ", 1)[0] + "."
    return rng.choice((str, str, str.lower, lambda s: s.replace("'", "’")))(r)


def unboxed(t: str, rng: random.Random) -> str | None:
    """A whole response that ends in a sentence with its value instead of a box; None where it has another number of boxes than one."""
    got, left_open, _ = fs.boxes(t)
    if len(got) != 1 or left_open or not got[0].strip():
        return None
    v = rng.choice((got[0], got[0], f"${got[0]}$", str(rng.randint(2, 9999))))
    said = rng.choice(CONCLUDE).format(v=v, x=rng.choice(("x", "y", "n", "it", "$x$", "a", "the value")), y=rng.choice(RESULT))
    head, closed, _ = t.partition("</think>")
    reasoning = head.replace("<think>", "").split("\\boxed", 1)[0].strip().rsplit("\n", 1)[0]
    kind = rng.random()
    if kind < 0.35:
        return said
    if kind < 0.7 and closed:
        return head + "</think>\n\n" + said
    return (reasoning + rng.choice(("\n\n", "\n", " ")) + said) if reasoning else said


def alien(rng: random.Random, t: str, home: str | None = None) -> str:
    """A response in another language than ``home`` with its own final answer, now and then with a first sentence of the original."""
    said = rng.choice([v for k, v in ELSEWHERE.items() if k != home])
    lead = t.split(". ", 1)[0] + ". " if rng.random() < 0.4 else rng.choice(("", "<think>\n"))
    k = max(t.rfind("\\boxed{"), t.rfind("\\fbox{"))
    final = t[k:].rstrip() if k >= 0 else f"\\boxed{{{rng.randint(2, 999)}}}"
    return lead[:200] + " ".join(rng.choice(said) for _ in range(rng.randint(2, 9))) + "\n</think>" * ("<think>" in lead) + "\n\n" + rng.choice(("", "", rng.choice(said).split(" ")[0] + " ")) + final


def _unfinished(a: str, rng: random.Random) -> str:
    """A value that visibly breaks off."""
    n = rng.randint(2, 99)
    return rng.choice((f"\\frac{{{n}}}{{", f"\\frac{{{n}", f"\\left({n} - \\fr", f"({n}, ", f"[{n}, \\inft", f"{n}x + ", f"\\sqrt{{{n}", f"{n} = ", f"\\{{{n}, ", f"{n}x^2 - ", f"(-\\infty, {n}", f"\\begin{{pmatrix}}{n} & ", f"${n}x", f"{a}, \\frac{{"))


def _agree(answer: str, response: str) -> bool:
    """Whether the boxes of a response hold what the answer holds, letter by letter."""
    got = "".join(c for b in fs.boxes(response)[0] for c in b if c.isalnum())
    return bool(got) and got == "".join(c for c in answer.replace("\\boxed", "") if c.isalnum())


def whole(x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    """Rows whose shape shows no defect at all."""
    c = {k: i for i, k in enumerate(names)}
    if "complete_box" in c:
        return ((x[:, c["complete_box"]] + x[:, c["complete_value"]]) > 0) & (x[:, c["alien_some"]] == 0) & (x[:, c["copy"]] == 0) & (x[:, c["nothing"]] == 0)
    bad = ("nothing", "unbalanced", "operator_end", "command_end", "alien", "copy", "words3", "open_quote")
    return ~(x[:, [c[b] for b in bad]] > 0).any(axis=1)


def in_parts(name, texts, questions, slots, limit, tongue, refusals=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of training texts, each with its own question, in parts so that memory stays small."""
    xs, ss, rs = [], [], []
    for a in range(0, len(texts), 512):
        b = min(a + 512, len(texts))
        col, q, own = pa.array(texts[a:b], pa.string()), fs.Questions(pa.array(questions[a:b], pa.string()), tongue), np.arange(b - a)
        x, slot, row = fs.response_features(col, own, q, slots[a:b], limit[a:b], refusals) if name == "response" else fs.answer_features(col, own, q, slots[a:b], refusals)
        xs.append(x)
        ss.append(slot.astype(np.int32))
        rs.append((row + a).astype(np.int32))
    if not xs:
        return np.zeros((0, len(fs.RESPONSE if name == "response" else fs.ANSWER))), np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(xs), np.concatenate(ss), np.concatenate(rs)


def broken(s: pd.DataFrame, rng: random.Random, tongue: language.Tongue):
    """Whole responses and the same broken on purpose: texts, questions, slots, limit marks, labels."""
    texts, qs, slots = s["response"].fillna("").tolist(), s["question"].fillna("").tolist(), s["slots"].to_numpy(int)
    x, _, _ = in_parts("response", texts, qs, slots, np.zeros(len(s)), tongue)
    good = np.flatnonzero(whole(x, fs.RESPONSE)).tolist()
    home = language.sentences(pa.array(qs, pa.string()), tongue).main()
    for i in good:
        if rng.random() < 0.15 and qs[i]:  # a whole response may repeat its question before it goes on
            head, tag, rest = texts[i].partition("<think>\n")
            texts[i] = head + tag + rng.choice(_LEAD) + qs[i] + "\n" + rest if tag else rng.choice(_LEAD) + qs[i] + " " + texts[i]
    rows = [(texts[i], qs[i], slots[i], rng.random() < 0.004, None) for i in good]
    for i in good[:: UNBOXED]:
        if slots[i] == 1 and (said := unboxed(texts[i], rng)):
            rows.append((said, qs[i], slots[i], False, None))
            end = said.rstrip().rfind(" ")
            for k in (0, 1) if end > 4 else ():  # and the same cut before its value
                rows.append((said[: rng.randint(max(3, end - 40), end)], qs[i], slots[i], bool(k), 1))
    for i in good:
        rows.append((cut(texts[i], rng), qs[i], slots[i], rng.random() < 0.5, 1))
        k = rng.random()
        if k < 0.35:
            rows.append((refused(texts[i], rng), qs[i], slots[i], False, 2))
        elif k < 0.6 and qs[i]:
            rows.append((rewritten(qs[i], rng), qs[i], slots[i], False, 3))
        elif k < 0.85:
            rows.append((alien(rng, texts[i], language.LANGS[home[i]]), qs[i] or "What is the sum of these?", slots[i], False, 4))
        else:
            rows.append((rng.choice(_EMPTY), qs[i], slots[i], False, 0))
    return _rows(rows)


def broken_answers(s: pd.DataFrame, rng: random.Random, tongue: language.Tongue):
    """The same for answers."""
    texts, qs, slots = s["answer"].fillna("").tolist(), s["question"].fillna("").tolist(), s["slots"].to_numpy(int)
    x, _, _ = in_parts("answer", texts, qs, slots, np.zeros(len(s)), tongue)
    # an answer that its response ends on is whole even where it has words
    agreed = np.array([_agree(a, r) for a, r in zip(texts, s["response"].fillna("").tolist())], bool)
    good = np.flatnonzero(whole(x, fs.ANSWER) | (agreed & (x[:, fs.ANSWER.index("nothing")] == 0))).tolist()
    rows = [(texts[i], qs[i], slots[i], False, None) for i in good]
    foreign = language.sentences(pa.array(texts, pa.string()), tongue).other(np.zeros(len(texts), np.int64)) > 0
    mother = language.sentences(pa.array(qs, pa.string()), tongue).main()
    home = [i for i in good if not foreign[i]] or good  # values that are packed together are in one language
    worded = [texts[i] for i in home if any(c.isalpha() for c in texts[i]) and "\\" not in texts[i]] or [""]
    for i in home[::2]:  # fields that pack several values, words among them, are whole too
        some = [rng.choice((rng.choice(worded), texts[rng.choice(home)], rng.choice(worded))) for _ in range(rng.randint(2, 4))]
        quote = rng.random() < 0.4
        some = ['"' + v.replace('"', '""') + '"' if quote and ("," in v or ";" in v or rng.random() < 0.3) else v for v in some]
        rows.append((rng.choice((", ", ",", "; ", ";", " and ", "\n", " | ")).join(some), qs[i] if mother[i] == 0 else "What is the sum of these?", len(some), False, None))
    rows += [(rng.choice((str, str, str.capitalize))(w), "What is the sum of these?", 1, False, None) for w in WORDED for _ in range(1 + len(good) // 400)]
    for i in good:
        k = rng.random()
        if k < 0.25:
            rows.append((rng.choice(_EMPTY[:17]), qs[i], slots[i], False, 0))
        elif k < 0.5:
            rows.append((_unfinished(texts[i], rng), qs[i], slots[i], False, 1))
        elif k < 0.7:
            rows.append((rng.choice((rng.choice(REFUSE_SHORT), refusal(rng).rstrip("."))), qs[i], slots[i], False, 2))
        elif k < 0.85 and qs[i]:
            rows.append((rewritten(qs[i], rng), qs[i], slots[i], False, 3))
        else:
            said = rng.choice(rng.choice(list(ELSEWHERE.values()))[3:])
            said = rng.choice((said, said, f"{rng.randint(2, 99)} {said}", f"{said} {rng.randint(2, 99)}", f"{rng.randint(2, 99)} {said} {rng.randint(2, 99)}"))
            rows.append((said, "What is the sum of these?", slots[i], False, 4))
    return _rows(rows)


def _rows(rows):
    y = np.zeros((len(rows), len(LABELS)))
    for i, r in enumerate(rows):
        if r[4] is not None:
            y[i, r[4]] = 1
    return [r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows], int), np.array([r[3] for r in rows], float), y


def tongue_of(sample: pd.DataFrame) -> language.Tongue:
    """The language model, refined on the sample's questions and responses."""
    texts = [t for c in ("question", "response") for t in sample[c].dropna().tolist()[::3]] if len(sample) else []
    return language.Tongue().refine(pa.array(texts, pa.string()))


def refusals_of(sample: pd.DataFrame, rng: random.Random) -> fs.Refusals:
    """The model of refusing sentences: refusals made here against sentences of responses that end in a box, worded answers and conclusions."""
    texts = [t for t in sample["response"].dropna().tolist() if fs.boxes(t)[0]] if len(sample) else []
    other = [p for t in texts for p in t.replace("\n", ". ").split(". ") if len(p) > 3]
    other = rng.sample(other, min(len(other), SENTENCES)) + [*WORDED] * 8
    other += [rng.choice(CONCLUDE).format(v=rng.randint(2, 999), x=rng.choice("xyn"), y=rng.choice(RESULT)) for _ in range(SENTENCES // 8)]
    other += [" ".join(w.split()[: rng.randint(1, 2)]) for w in WHO] * 8  # a refusal that only begins is none
    other += [" ".join(p.split()[: rng.randint(1, 3)]) for p in other[: SENTENCES // 6]]
    said = [refusal(rng) for _ in range(SENTENCES // 2)] + [rng.choice(REFUSE_SHORT) for _ in range(SENTENCES // 8)]
    return fs.Refusals(said, other)


class Classifier:
    """The two linear models (responses, answers) and their thresholds."""

    def __init__(self, sample: pd.DataFrame, answers: pd.DataFrame, seed: int = 3):
        """``sample``: response, question, slots; ``answers``: answer, question, slots, response."""
        rng = random.Random(seed)
        self.response = self.answer = None
        self.held_out: dict[str, list[float]] = {}
        self.tongue = tongue_of(sample)
        self.refusals = refusals_of(sample, rng)
        if len(sample):
            self.response = self._fit("response", *broken(sample, rng, self.tongue))
        if len(answers):
            self.answer = self._fit("answer", *broken_answers(answers, rng, self.tongue))

    def _fit(self, name, texts, questions, slots, limit, y) -> Linear | None:
        if not texts:  # no whole field to learn from
            return None
        x, slot, row = in_parts(name, texts, questions, slots, limit, self.tongue, refusals=self.refusals)
        m = Linear(len(LABELS), x.shape[1]).fit(x, slot, row, y)
        self.held_out[name] = m.held_out
        return m

    def judge(self, name: str, texts: pa.Array, owner: np.ndarray, q: fs.Questions, slots: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Label number of each text, -1 for none."""
        if name == "response":
            x, slot, row = fs.response_features(texts, owner, q, slots, limit, self.refusals)
        else:
            x, slot, row = fs.answer_features(texts, owner, q, slots, self.refusals)
        m = self.response if name == "response" else self.answer
        empty = x[:, 0] > 0
        if m is None:
            return np.where(empty, 0, -1)
        over = m.scores(x, slot, row) - m.cut
        best = over.argmax(axis=1)
        found = over[np.arange(len(best)), best] > 0
        return np.where(empty, 0, np.where(found, best, -1))  # nothing at all is empty, whatever the scores


class Known:
    """Questions by item id, as the workers need them."""

    def __init__(self, table: pd.DataFrame, tongue: language.Tongue):
        self.ids = table["id"].to_numpy(np.int64)
        self.questions = fs.Questions(pa.array([*table["question"], ""], pa.string()), tongue)
        self.slots = np.append(table["slots"].to_numpy(int), 1)

    def owner(self, ids: pa.Array) -> np.ndarray:
        """Number of the question of each id; the last, an empty one, where there is none."""
        want = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(self.ids):
            return np.zeros(len(want), np.int64)
        at_ = np.minimum(np.searchsorted(self.ids, want), len(self.ids) - 1)
        return np.where(self.ids[at_] == want, at_, len(self.ids))


@dataclass
class Part:
    """A block of responses: their texts, key columns, questions and whether they end at a limit."""

    text: pa.Array
    columns: list[pa.Array]
    owner: np.ndarray
    questions: fs.Questions
    slots: np.ndarray
    limit: np.ndarray


def judged_parts(given: DataFrame, questions: DataFrame, table: pd.DataFrame | None, tongue: language.Tongue, columns: list[str], judge: Callable[[Iterator[Part]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Responses (of ``with_limits``) judged block by block, each with the question of its item.

    Questions that fit are sent to the workers; otherwise they are joined to the responses by id,
    where a hot item is split by the skew join.
    """
    sc = given.sparkSession.sparkContext
    known = sc.broadcast(Known(table, tongue)) if table is not None else None
    speech = None if known else sc.broadcast(tongue)
    if known is None:
        given = given.join(questions.select("id", F.col("question").alias("_question"), F.col("slots").alias("_slots")), "id", "left")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
        for batch in batches:
            text, limit = at.plain(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            own = known.value.owner(batch.column(1)) if known else None
            for a, b in at.blocks(text):
                cut = [batch.column(k).slice(a, b - a) for k in range(batch.num_columns)]
                if known:
                    k = known.value
                    yield Part(text.slice(a, b - a), cut[3 : 3 + len(columns)], own[a:b], k.questions, k.slots[own[a:b]], limit[a:b])
                else:
                    q, slots = at.plain(cut[-2]), cut[-1].fill_null(1).to_numpy(zero_copy_only=False).astype(int)
                    yield Part(text.slice(a, b - a), cut[3 : 3 + len(columns)], np.arange(b - a), fs.Questions(q, speech.value), slots, limit[a:b])

    extra = [] if known else ["_question", "_slots"]
    return given.select("response", "id", "_at", *columns, *extra).mapInArrow(lambda batches: judge(blocks(batches)), schema)


def sample_pairs(sft: DataFrame, responses: pd.DataFrame, bound: int = SAMPLE) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Training rows: responses with their questions, answers with theirs."""
    s = bounded(sft.select("scan_idx", "question", "answer", "response"), bound)
    s["slots"] = np.maximum(1, s["question"].fillna("").str.count(r"\[ANS\]"))
    both = pd.concat([responses[["response", "question", "slots"]], s[["response", "question", "slots"]]])
    return both, s[["answer", "question", "slots", "response"]]


def defects(sft: DataFrame, responses: DataFrame, items: DataFrame, *, bound: int = SAMPLE) -> DataFrame:
    """``(tab, scan_idx, fld, defect)``, one row per defective field."""
    questions = question_frame(items)
    table = shipped(questions)
    counted, sample = survey(responses, bound)
    sc = sft.sparkSession.sparkContext
    fitted = Classifier(*sample_pairs(sft, of_items(sample, questions, table), bound))
    model = sc.broadcast(fitted)
    schema = "tab string, scan_idx bigint, fld string, defect string"

    def told(tab: str, fld: str, key: pa.Array, label: np.ndarray) -> pa.RecordBatch:
        i = np.flatnonzero(label >= 0)
        names = [LABELS[k] for k in label[i]]
        return pa.RecordBatch.from_arrays([pa.array([tab] * len(i), pa.string()), key.take(pa.array(i)), pa.array([fld] * len(i), pa.string()), pa.array(names, pa.string())], names=["tab", "scan_idx", "fld", "defect"])

    def of_responses(parts: Iterator[Part]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            yield told("responses", "response", p.columns[0], model.value.judge("response", p.text, p.owner, p.questions, p.slots, p.limit))

    def of_sft(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            question, answer, response = (at.plain(batch.column(k)) for k in (1, 2, 3))
            for a, b in at.blocks(response):
                own = np.arange(b - a)
                part = question.slice(a, b - a)
                q = fs.Questions(part, model.value.tongue)
                slots = np.array([max(1, t.count("[ANS]")) for t in part.to_pylist()], int)
                for fld, col in (("response", response), ("answer", answer)):
                    label = model.value.judge(fld, col.slice(a, b - a), own, q, slots, np.zeros(b - a))
                    yield told("sft_corpus", fld, batch.column(0).slice(a, b - a), label)

    one = judged_parts(with_limits(responses, limits_of(counted)), questions, table, fitted.tongue, ["scan_idx"], of_responses, schema)
    two = sft.select("scan_idx", "question", "answer", "response").mapInArrow(of_sft, schema)
    return one.unionByName(two)
