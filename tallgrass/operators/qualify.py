"""Qualifying raw traces as training rows: one chain with parameters for all sources."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.functions import brackets as br
from tallgrass.functions import fixed_values as fx
from tallgrass.functions import text as tx
from tallgrass.operators import decontaminate, reject, sampling
from tallgrass.sources.files import choice_question

_PAIR = T.StructType([T.StructField("response", T.StringType()), T.StructField("answer", T.StringType())])
_FINAL = re.compile(fx.FREEFORM_FINAL)


def _last_line(s: str) -> str:
    return next((x.strip() for x in reversed(s.rstrip().splitlines()) if x.strip()), "")


def _last_box(s: str) -> tuple[int, str] | None:
    """Place and text of the last box, command included."""
    c = br.last_box(s)
    if c is None:
        return None
    i = max(s.rfind("\\boxed{" + c + "}"), s.rfind("\\fbox{" + c + "}"))
    return i, s[i : s.find("{", i) + len(c) + 2]


def ended_on_box(solution: str) -> tuple[str | None, str | None]:
    """A solution cut after its last box, which stands on a line of its own, and the boxed answer."""
    s = solution.strip()
    got = _last_box(s)
    if got is None:
        return None, None
    i, box = got
    head = s[:i].rstrip()
    return (f"{head}\n{box}" if head else box), box[box.index("{") + 1 : -1].strip()


def wrapped(reasoning: str, final: str) -> str:
    """Reasoning between tags, the final line after them."""
    body = reasoning.strip()
    return "\n".join([fx.THINK_OPEN, *([body] if body else []), fx.THINK_CLOSE, "", final.strip()])


def reformatted(trace: str) -> tuple[str | None, str | None]:
    """A trace in the wrapped form, and its answer; (None, None) where it has no box.

    Without tags all before the last box is reasoning.  With tags the box is taken after the
    reasoning if there is one, else from its end.
    """
    s = trace.strip()
    if fx.THINK_OPEN not in s or fx.THINK_CLOSE not in s:
        response, answer = ended_on_box(s)
        if not answer:
            return None, None
        final = _last_line(response)
        return wrapped(response.rstrip()[: -len(final)], final), answer
    inner, after = s.split(fx.THINK_OPEN, 1)[1].split(fx.THINK_CLOSE, 1) if fx.THINK_CLOSE in s.split(fx.THINK_OPEN, 1)[1] else ("", s)
    outside, inside = _last_box(after), _last_box(inner)
    if outside:
        final = _last_line(after)
        final = final if _FINAL.match(final) else outside[1]
        answer = br.last_box(final)
        return (wrapped(inner, final), answer.strip()) if answer else (None, None)
    if inside:
        return wrapped(inner[: inside[0]], inside[1]), br.last_box(inside[1])
    return None, None


@F.pandas_udf(_PAIR)
def ended_on_box_udf(solution: pd.Series) -> pd.DataFrame:
    """:func:`ended_on_box` over a batch."""
    return pd.DataFrame([(None, None) if s is None else ended_on_box(s) for s in solution], columns=["response", "answer"])


@F.pandas_udf(_PAIR)
def reformatted_udf(trace: pd.Series) -> pd.DataFrame:
    """:func:`reformatted` over a batch."""
    return pd.DataFrame([(None, None) if s is None else reformatted(s) for s in trace], columns=["response", "answer"])


@dataclass(frozen=True)
class Rules:
    """Parameters of the chain; a rule that is None is not tested."""

    chars: tuple[int, int] | None = None
    pass_rate: tuple[float, float] | None = None
    dropped_sources: Sequence[str] = ()
    categories: Sequence[str] = ()
    inline_choices: bool = False
    figures: bool = True
    wrapped_already: bool = False
    wrap: bool = True
    max_tokens: int | None = fx.MAX_TOKENS
    max_response: int | None = None
    renames: dict[str, str] = field(default_factory=dict)


NUMINA = Rules(chars=(2001, 10**9), dropped_sources=fx.DROPPED_SOURCES, inline_choices=True, figures=False, max_response=12_000)
OPENMATH = Rules(chars=(2000, 12_000), pass_rate=fx.PASS_RATE)
OPENMATH_LONG = Rules(chars=(12_000, 28_000), pass_rate=fx.PASS_RATE)
OPENR1 = Rules(chars=(500, 12_000))
MATH = Rules(figures=False, wrap=False)
CHAT = Rules(chars=(15_000, 30_000), categories=("math",), wrapped_already=True)


def qualify(raw: DataFrame, rules: Rules, protected: DataFrame | None = None) -> DataFrame:
    """Rows of ``raw`` (problem, solution and what the rules name) with ``reason``, response and answer.

    Cheap tests come first and as a filter of their own; rewriting the trace, which needs Python,
    sees only rows that pass them.  A null reason means the row qualifies.
    """
    p, s = tx.strip(F.coalesce("problem", F.lit(""))), tx.strip(F.coalesce("solution", F.lit("")))
    base = raw.withColumn("problem", p).withColumn("solution", s)
    p, s = F.col("problem"), F.col("solution")
    tests: list[reject.Test] = []
    if rules.dropped_sources:
        tests.append(("dropped_source", F.coalesce("source", F.lit("")).isin(*rules.dropped_sources)))
    tests += [("empty_problem", p == ""), ("empty_solution", s == "")]
    if rules.categories:
        tests.append(("other_category", ~F.lower(F.coalesce("category", F.lit(""))).isin(*rules.categories)))
    if rules.pass_rate:
        rate = F.expr("try_cast(pass_rate as double)")
        tests.append(("pass_rate_out_of_range", F.coalesce(~rate.between(*rules.pass_rate), F.lit(True))))
    if rules.chars:
        tests.append(("response_length_out_of_range", ~F.length(s).between(*rules.chars)))
    tests.append(("cjk_text", p.rlike(fx.CJK) | s.rlike(fx.CJK)))
    if rules.figures:
        tests.append(("figure_dependent", tx.has(p, fx.FIGURE) | tx.has(s, fx.FIGURE)))
    if rules.inline_choices:
        tests.append(("inline_mcq", tx.inline_choices(p)))
    if rules.wrapped_already:
        tests.append(("missing_thinking_wrapper", ~(s.contains(fx.THINK_OPEN) & s.contains(fx.THINK_CLOSE))))
    tests.append(("missing_boxed_hint", ~s.rlike(fx.BOX_HINT)))
    name = lambda n: rules.renames.get(n, n)
    marked = base.withColumn("reason", reject.reason([(name(n), t) for n, t in tests]))
    dropped, rest = [marked.where("reason is not null")], marked.where("reason is null").drop("reason")
    if protected is not None:
        rest = decontaminate.containment(rest, protected, "problem")
        dropped.append(rest.where("hit").drop("hit").withColumn("reason", F.lit(name("decontam"))))
        rest = rest.where("not hit").drop("hit")
    made = rest.withColumn("_r", (reformatted_udf if rules.wrap else ended_on_box_udf)("solution")).withColumn("response", F.col("_r.response")).withColumn("answer", F.col("_r.answer")).drop("_r")
    r = F.col("response")
    late: list[reject.Test] = [("bad_format", r.isNull() | (tx.strip(F.coalesce("answer", F.lit(""))) == "")), ("bad_final_line", ~tx.last_line(r).rlike(fx.FREEFORM_FINAL))]
    if rules.max_response:
        late.append(("long_trace", F.length(r) > rules.max_response))
    if rules.max_tokens:
        late.append(("too_long_tokens", tx.token_estimate(p, r) > rules.max_tokens))
    out = made.withColumn("reason", reject.reason([(name(n), t) for n, t in late]))
    for one in dropped:
        out = out.unionByName(one, allowMissingColumns=True)
    return out


def qualify_choices(raw: DataFrame, protected: DataFrame | None = None, target: int = 4) -> DataFrame:
    """Multiple-choice rows (query, choices, gold) with ``reason``, question, options, letter and a stock response."""
    o = F.transform(F.coalesce("choices", F.array().cast("array<string>")), tx.choice_text)
    q = choice_question(F.coalesce("query", F.lit("")))
    df = raw.withColumn("options", o).withColumn("question", q)
    gold = F.get("gold", F.lit(0))
    letter = tx.gold_letter(gold, F.col("options"))
    df = df.withColumn("answer", letter)
    tests: list[reject.Test] = [
        ("missing_choices", F.size("options") == 0), ("empty_choice_text", F.exists("options", lambda x: F.coalesce(x, F.lit("")) == "")), ("empty_problem", F.col("question") == ""), ("bad_gold_index", F.col("answer").isNull()),
        ("insufficient_distractors", F.size("options") < target),
    ]
    marked = df.withColumn("reason", reject.reason(tests))
    if protected is not None:
        keys = protected.select(tx.overlap_key(F.col("question")).alias("_key"), F.lit(True).alias("_is")).distinct()
        marked = marked.withColumn("_key", tx.overlap_key(F.col("question"))).join(keys, "_key", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_is"), "public_overlap"))).drop("_key", "_is")
    return marked.withColumn("response", F.when(F.col("reason").isNull(), stock_response(F.col("answer"))))


def stock_response(letter: Column) -> Column:
    """A response that only names a letter, for rows without a trace."""
    return F.concat(F.lit("Comparing the options with the conditions leaves one of them.\n\nThe correct choice is "), letter, F.lit(".\n\\boxed{"), letter, F.lit("}"))


def pool_then_sample(df: DataFrame, n: int, position: str, key: str, times: int = 5, seed: int = 42) -> DataFrame:
    """A sample of ``n`` from the first ``times * n`` rows in scan order; an error if fewer than ``n`` qualify."""
    pool = df.orderBy(position).limit(times * n)
    if (got := pool.count()) < n:
        raise ValueError(f"only {got} rows qualify; {n} are needed")
    return sampling.reservoir(pool, n, key, seed)


def quota_corpus(df: DataFrame, bucket: str, quotas: dict[str, int], position: str, key: str, top_up: DataFrame | None = None, anchor: str = "anchor", backfill: str | None = None, donors: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """A corpus by quotas: first rows of each bucket, the anchor topped up at random, one bucket backfilled from others' overflow.

    Backfill takes donors' rows beyond their quota (off unless a bucket is named).
    """
    picked = sampling.quota(df, bucket, quotas, position)
    if top_up is not None and anchor in quotas:
        have = picked.where(F.col(bucket) == anchor)
        missing = quotas[anchor] - have.count()
        if missing > 0:
            more = sampling.reservoir(top_up.join(picked.select(key), key, "left_anti"), missing, key, seed).withColumn(bucket, F.lit(anchor))
            picked = picked.unionByName(more, allowMissingColumns=True)
    if backfill:
        missing = quotas[backfill] - picked.where(F.col(bucket) == backfill).count()
        if missing > 0:
            over = df.where(F.col(bucket).isin(*donors)).join(picked.select(key), key, "left_anti")
            picked = picked.unionByName(sampling.reservoir(over, missing, key, seed + 7).withColumn(bucket, F.lit(backfill)), allowMissingColumns=True)
    return picked


def violations(df: DataFrame, max_tokens: int = fx.MAX_TOKENS) -> DataFrame:
    """Contract of ready rows: a row per broken rule with its count; empty when all hold."""
    r = F.coalesce("response", F.lit(""))
    line = tx.last_line(r)
    rules = {
        "task_type": ~F.coalesce("task_type", F.lit("")).isin("mcq", "freeform"), "final_line": ~F.when(F.col("task_type") == "mcq", line.rlike(fx.MCQ_FINAL)).otherwise(line.rlike(fx.FREEFORM_FINAL)),
        "wrapper": ~(tx.thinking_open(r) & tx.thinking_closed(r)), "tokens": F.coalesce("template_tokens", F.lit(0)) > max_tokens, "answer": tx.strip(F.coalesce("answer", F.lit(""))) == "", "cjk": F.col("question").rlike(fx.CJK) | r.rlike(fx.CJK),
    }
    broken = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in rules.items()]))
    return df.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("rows"))
