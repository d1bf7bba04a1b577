"""Grading, votes and repair: plans that need the grader run it as an Arrow function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions import fixed_values as fx
from tallgrass.functions import judging
from tallgrass.functions import text as tx
from tallgrass.operators import voting
from tallgrass.plans.base import GRADED, ITEMS, graded, items
from tallgrass.plans.grade_cases import CASES, response
from tallgrass.plans.registry import Registry
from tallgrass.sources.tables import table

query = Registry()
#: Most items whose kinds are broadcast to the responses; more are joined by a shuffle.
SHIPPED = 20_000
#: Answers that every rule of the grader leaves equal to themselves, and cues that move the place of an answer.
PLAIN = "^([1-9][0-9]*([.][0-9]+)?|[A-Za-z]{2,})$"
MOVES = "herefore|#### |# Answer"


def last_responses(spark: SparkSession, d: str) -> DataFrame:
    """Last response of each run and item with its item: the row's place is found on narrow columns, the text joined after."""
    t = table(spark, d, "responses", "scan_idx", "id", "run_tag", "response").withColumn("run", F.lower(F.trim("run_tag"))).drop("run_tag")
    last = t.groupBy("run", "id").agg(F.max("scan_idx").alias("scan_idx")).select("scan_idx")
    return t.join(last, "scan_idx", "left_semi").join(items(spark, d), "id")


def boxed_exactly(response_: F.Column, gold: F.Column) -> F.Column:
    """Whether a response is right without the grader: its boxes are the plain gold answers, letter by letter, in one line.

    Plain answers are numbers and words, which no rule of the grader rewrites unequally; a response
    with a cue that moves the place of the answer is left to the grader.
    """
    line = F.concat(F.lit("\\boxed{"), F.array_join(gold, "}, \\boxed{"), F.lit("}"))
    plain = ~F.exists(gold, lambda g: ~g.rlike(PLAIN)) & (F.size(gold) > 0)
    tail = F.substring_index(response_, fx.THINK_CLOSE, -1)
    return F.coalesce(plain & F.contains(tail, line) & (F.regexp_count(tail, F.lit(r"oxed\{")) == F.size(gold)) & ~response_.rlike(MOVES), F.lit(False))


_EXACT = f"""coalesce(len(gold) > 0 and len(list_filter(gold, lambda g: not regexp_matches(g, '{PLAIN}'))) = 0
    and contains(split_part(coalesce(response, ''), '</think>', -1), concat('\\boxed{{', array_to_string(gold, '}}, \\boxed{{'), '}}'))
    and len(regexp_extract_all(split_part(coalesce(response, ''), '</think>', -1), 'oxed\\{{')) = len(gold) and not regexp_matches(response, '{MOVES}'), false)"""


@query("select n, equal from (values " + ", ".join(f"({i}, {str(ok).lower()})" for i, (_, _, ok) in enumerate(CASES)) + ") t(n, equal)")
def grade_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The grader over hand-made cases."""
    rows = [(i, response(said), list(gold)) for i, (said, gold, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "n int, response string, gold array<string>").select("n", judging.grade_udf("response", "gold").alias("equal"))


@query(f"""with {ITEMS}, t as (select lower(trim(run_tag)) as run, id, response from (select *, row_number() over (partition by lower(trim(run_tag)), id order by scan_idx desc) as r from responses) where r = 1)
    select run, count(*) as n, count(*) filter (where response is null) as missing, count(*) filter (where {_EXACT}) as exact from t join items using (id) where not coalesce(len(options), 0) > 0 group by run""")
def grade_screen(spark: SparkSession, d: str) -> DataFrame:
    """Free-form answers that are decided before the grader: missing, and right letter by letter."""
    r = last_responses(spark, d).where(~tx.is_mcq(F.col("options")))
    return r.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("response").isNull()).alias("missing"), F.count_if(boxed_exactly(F.col("response"), F.col("gold"))).alias("exact"))


def with_grade(r: DataFrame, response_: str = "response", name: str = "ok") -> DataFrame:
    """Rows with their grade; only what is not decided in the JVM goes to Python."""
    exact = boxed_exactly(F.col(response_), F.col("gold"))
    return r.withColumn("_exact", exact).withColumn(name, F.col("_exact") | judging.grade_udf(F.when(~F.col("_exact"), F.col(response_)), F.col("gold"))).drop("_exact")


@query()
def auto_grade(spark: SparkSession, d: str) -> DataFrame:
    """Automatic grades of all runs by kind of question: letters for choices, the grader for the rest."""
    r = last_responses(spark, d)
    mcq = tx.is_mcq(F.col("options"))
    ff = with_grade(r.where(~mcq))
    mc = r.where(mcq).withColumn("ok", F.coalesce(tx.letter(F.col("response")) == F.upper(F.col("gold")[0]), F.lit(False)))
    both = ff.select("run", F.lit("freeform").alias("kind"), "ok").unionByName(mc.select("run", F.lit("mcq").alias("kind"), "ok"))
    return both.groupBy("run", "kind").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_correct"), F.round(100.0 * F.avg(F.col("ok").cast("int")), 4).alias("pct"))


@query()
def lenient_grade(spark: SparkSession, d: str) -> DataFrame:
    """Strict against lenient grades of the free-form answers of every run: a 2 x 2 table each."""
    r = last_responses(spark, d).where(~tx.is_mcq(F.col("options")))
    g = r.select("run", judging.grade_udf("response", "gold").alias("strict"), judging.lenient_udf("response", "gold").alias("lenient"))
    return g.groupBy("run", "strict", "lenient").agg(F.count("*").alias("n"))


@query()
def grade_causes(spark: SparkSession, d: str) -> DataFrame:
    """Why free-form answers fail: nothing extracted, another count, or a value, by kind of value error."""
    r = last_responses(spark, d).where(~tx.is_mcq(F.col("options")))
    return r.select("run", judging.cause_udf("response", "gold").alias("kind")).groupBy("run", "kind").agg(F.count("*").alias("n"))


@query()
def repair_no_harm(spark: SparkSession, d: str) -> DataFrame:
    """Repair of misaligned answers: changed, recovered and broken responses (broken must be 0)."""
    r = last_responses(spark, d).where(~tx.is_mcq(F.col("options")) & F.col("response").isNotNull())
    r = r.withColumn("n", tx.blank_count(F.col("question"), F.col("options"))).withColumn("fix", judging.repaired_udf("response", "n"))
    r = with_grade(r, name="before").withColumn("changed", F.col("fix.changed"))
    # an unchanged response keeps its grade: only repaired ones are graded again
    g = r.select("run", "changed", "before", F.when(F.col("changed"), judging.grade_udf(F.when(F.col("changed"), F.col("fix.response")), F.col("gold"))).otherwise(F.col("before")).alias("after"))
    return g.groupBy("run").agg(
        F.count("*").alias("n"), F.count_if("changed").alias("changed"), F.count_if(~F.col("before") & F.col("after")).alias("recovered"), F.count_if(F.col("before") & ~F.col("after")).alias("broken")
    )


@query()
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    """Vote on each item over every stored response: the family of the run is the prompt.

    Exact repeats of run, id and response (rows of resumed runs) are one sample.  Text never
    reaches a shuffle: answers are read in the scan and repeats are found by digest.
    """
    i = items(spark, d).select("id", F.size("gold").alias("n_gold"), tx.is_mcq(F.col("options")).alias("is_mcq"))
    if i.count() <= SHIPPED:
        i = F.broadcast(i)
    r = table(spark, d, "responses", "scan_idx", "id", "run_tag", "response").where("response is not null").join(i, "id")
    answer = F.array_join(judging.canonical_udf("response", "n_gold", "is_mcq"), "; ").alias("answer")
    r = r.select(F.lower(F.trim("run_tag")).alias("run"), "id", F.sha2("response", 256).alias("digest"), "scan_idx", answer, (~tx.thinking_closed(F.col("response"))).alias("unclosed"), F.length("response").alias("chars"))
    first = F.min(F.struct("scan_idx", "answer", "unclosed", "chars"))
    r = r.groupBy("run", "id", "digest").agg(first.alias("s")).select("run", "id", "s.*").withColumn("prompt", F.split("run", "-")[0])
    v = voting.majority(r, "id", "answer", "prompt", "scan_idx", ["unclosed", "chars"], "chars")
    return v.select("id", "answer", "votes", "prompts", "score", F.col("trace").alias("trace_chars"))


@query(f"""with {GRADED}, v as (select id, pred, count(*) as votes, min(scan_idx) as first_at from graded where n_boxes > 0 group by 1, 2)
    select id, pred, votes from (select *, row_number() over (partition by id order by votes desc, first_at) as r from v) where r = 1""")
def plain_vote(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent boxed answer of each item over all runs, ties to the one seen first."""
    return voting.plain_majority(graded(spark, d).where("n_boxes > 0"), "id", "pred", "scan_idx")


@query(f"""with {GRADED}, v as (select id, pred, count(*) as votes, count(distinct split_part(run, '-', 1)) as prompts, min(scan_idx) as first_at from graded where n_boxes > 0 group by 1, 2),
    b as (select *, row_number() over (partition by id order by votes + 0.5 * prompts desc, votes desc, prompts desc, first_at) as r from v)
    select count(*) as items, round(avg(votes), 6) as mean_votes, count(*) filter (where votes > 1) as repeated from b where r = 1""")
def vote_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means over the scored vote."""
    g = graded(spark, d).where("n_boxes > 0").withColumn("prompt", F.split("run", "-")[0]).withColumn("len", F.col("chars")).withColumn("text", F.lit(""))
    v = voting.majority(g, "id", "pred", "prompt", "scan_idx", ["len"], "text")
    return v.agg(F.count("*").alias("items"), F.round(F.avg("votes"), 6).alias("mean_votes"), F.count_if(F.col("votes") > 1).alias("repeated"))


@query(f"""with {GRADED}, w as (select id, pred, row_number() over (partition by id order by count(*) desc, min(scan_idx)) as r from graded where n_boxes > 0 group by 1, 2)
    select split_part(g.run, '-', 1) as family, count(*) as n, count(*) filter (where g.pred = w.pred) as picked, round(count(*) filter (where g.pred = w.pred) * 100.0 / count(*), 6) as rate from graded g join w on g.id = w.id and w.r = 1 group by 1""")
def pick_rate(spark: SparkSession, d: str) -> DataFrame:
    """How often each family of runs agrees with the vote."""
    g = graded(spark, d)
    v = voting.plain_majority(g.where("n_boxes > 0"), "id", "pred", "scan_idx").select("id", F.col("pred").alias("winner"))
    j = g.join(v, "id").groupBy(F.split("run", "-")[0].alias("family"))
    hit = F.count_if(F.col("pred") == F.col("winner"))
    return j.agg(F.count("*").alias("n"), hit.alias("picked"), F.round(hit * 100.0 / F.count("*"), 6).alias("rate"))


@query()
def answer_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Training rows whose final box equals their stored answer, by source."""
    c = table(spark, d, "sft_corpus", "source", "answer", "response").where("answer is not null and response is not null")
    b = F.array_join(tx.boxes(tx.final_section(F.col("response"))), ", ")
    c = c.select("source", "answer", b.alias("pred"))
    same = c.where("pred = answer").select("source", F.lit(True).alias("ok"))
    rest = c.where("pred <> answer").select("source", judging.equal_udf("pred", "answer").alias("ok"))
    return same.unionByName(rest).groupBy("source").agg(F.count("*").alias("n"), F.count_if("ok").alias("aligned"))


QUERIES, SQL = query.queries, query.sql
