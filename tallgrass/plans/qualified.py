"""Qualification plans over the stored corpus, which stands in for raw sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions import fixed_values as fx
from tallgrass.functions import judging
from tallgrass.functions import text as tx
from tallgrass.operators import qualify
from tallgrass.plans.base import corpus, items
from tallgrass.plans.corpus import LAST_LINE
from tallgrass.plans.grading import last_responses
from tallgrass.plans.registry import Registry, quoted

query = Registry()


def raw(spark: SparkSession, d: str) -> DataFrame:
    """Corpus rows under the names of a raw source."""
    c = corpus(spark, d, "scan_idx", "hf_source", "source_id", "question", "response", "pass_rate_72b_tir", "topic")
    return c.select("scan_idx", F.col("hf_source").alias("source"), "source_id", F.col("question").alias("problem"), F.col("response").alias("solution"), F.col("pass_rate_72b_tir").cast("string").alias("pass_rate"), "topic")


@query()
def qualify_traces(spark: SparkSession, d: str) -> DataFrame:
    """Rows by reject reason under the rules of three kinds of source, evaluation questions kept out."""
    out, protected = None, items(spark, d)
    for name, rules in (("numina", qualify.NUMINA), ("openmath", qualify.OPENMATH), ("openr1", qualify.OPENR1)):
        one = qualify.qualify(raw(spark, d), rules, protected).groupBy(F.lit(name).alias("rules"), F.coalesce("reason", F.lit("ready")).alias("reason")).agg(F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def qualified_rows(spark: SparkSession, d: str) -> DataFrame:
    """Ready rows of one set of rules, in the wrapped form."""
    q = qualify.qualify(raw(spark, d), qualify.OPENR1, items(spark, d)).where("reason is null")
    return q.select("scan_idx", "source_id", "answer", F.length("response").alias("trace_chars"), tx.last_line(F.col("response")).alias("final_line"))


@query()
def qualify_long_and_chat(spark: SparkSession, d: str) -> DataFrame:
    """Rows by reject reason under the rules of worked solutions, of long traces and of wrapped chats."""
    out, protected = None, items(spark, d)
    source = raw(spark, d).withColumn("category", F.lit("math"))
    for name, rules in (("math", qualify.MATH), ("openmath_long", qualify.OPENMATH_LONG), ("chat", qualify.CHAT)):
        one = qualify.qualify(source, rules, protected).groupBy(F.lit(name).alias("rules"), F.coalesce("reason", F.lit("ready")).alias("reason")).agg(F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def qualify_choice_rows(spark: SparkSession, d: str) -> DataFrame:
    """Multiple-choice rows by reject reason, evaluation questions kept out."""
    c = corpus(spark, d, "question", "options", "answer").where(tx.is_mcq(F.col("options")))
    gold = F.array((F.ascii("answer") - 65).cast("int"))
    rows = c.select(F.col("question").alias("query"), F.col("options").alias("choices"), F.when(F.length("answer") == 1, gold).alias("gold"))
    return qualify.qualify_choices(rows, items(spark, d)).groupBy(F.coalesce("reason", F.lit("ready")).alias("reason")).agg(F.count("*").alias("rows"))


@query()
def pooled_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twenty rows at random from the first hundred in scan order that end on a box."""
    c = corpus(spark, d, "scan_idx", "source", "response").where(tx.last_line(F.coalesce("response", F.lit(""))).rlike(fx.FREEFORM_FINAL))
    return qualify.pool_then_sample(c, 20, "scan_idx", "scan_idx").select("scan_idx", "source")


@query()
def any_order_answers(spark: SparkSession, d: str) -> DataFrame:
    """Wrong answers of several slots that are right in another order, by run."""
    r = last_responses(spark, d).where(~tx.is_mcq(F.col("options")) & (F.size("gold") > 1))
    e = r.select("run", "gold", judging.grade_udf("response", "gold").alias("ok"), judging.extracted_udf("response").alias("got")).where(~F.col("ok") & (F.size("got") == F.size("gold")))
    return e.groupBy("run").agg(F.count("*").alias("n"), F.count_if(judging.any_order_udf("got", "gold")).alias("other_order"))


@query()
def quota_corpus(spark: SparkSession, d: str) -> DataFrame:
    """A corpus by topic quotas with the anchor topped up."""
    c = corpus(spark, d, "scan_idx", "question", "trace_chars").withColumn("bucket", tx.route(tx.topic(F.col("question"))))
    got = qualify.quota_corpus(c, "bucket", {"geometry": 40, "probability/stats": 20, "trigonometry": 15, "anchor": 60}, "scan_idx", "scan_idx", top_up=c, backfill="trigonometry", donors=["geometry"])
    return got.groupBy("bucket").agg(F.count("*").alias("rows"), F.countDistinct("scan_idx").alias("ids"))


_LINE = LAST_LINE.format("coalesce(response, '')")
_CJK = "'[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\x{3040}-\\x{30ff}\\x{ac00}-\\x{d7af}]'"


@query(f"""with v as (select unnest(list_filter([case when coalesce(task_type, '') not in ('mcq', 'freeform') then 'task_type' end,
        case when not (case when task_type = 'mcq' then regexp_matches({_LINE}, {quoted(fx.MCQ_FINAL)}) else regexp_matches({_LINE}, {quoted(fx.FREEFORM_FINAL)}) end) then 'final_line' end,
        case when not (regexp_matches(coalesce(response, ''), {quoted(fx.OPEN_TAG)}) and regexp_matches(coalesce(response, ''), {quoted(fx.CLOSE_TAG)})) then 'wrapper' end,
        case when coalesce(template_tokens, 0) > {fx.MAX_TOKENS} then 'tokens' end, case when regexp_replace(coalesce(answer, ''), '^\\s+|\\s+$', '', 'g') = '' then 'answer' end,
        case when regexp_matches(question, {_CJK}) or regexp_matches(coalesce(response, ''), {_CJK}) then 'cjk' end], lambda x: x is not null)) as rule from sft_corpus)
    select rule, count(*) as rows from v group by rule""")
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    """Broken contract rules of the stored corpus."""
    return qualify.violations(corpus(spark, d, "task_type", "question", "response", "answer", "template_tokens"))


@query()
def precision_recoverable(spark: SparkSession, d: str) -> DataFrame:
    """Wrong free-form answers of the right count that fail only through rounding: within 1 %, within 0.1 %, or rounded gold."""
    r = last_responses(spark, d).where(~tx.is_mcq(F.col("options")))
    e = r.select("run", "gold", judging.grade_udf("response", "gold").alias("ok"), judging.extracted_udf("response").alias("got")).where((~F.col("ok")) & (F.size("got") == F.size("gold")))
    k = e.withColumn("kind", judging.rounding_udf("got", "gold"))
    return k.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("kind").bitwiseAND(1) > 0).alias("near_1pc"), F.count_if(F.col("kind").bitwiseAND(2) > 0).alias("near_01pc"), F.count_if(F.col("kind").bitwiseAND(4) > 0).alias("rounded"))


@query("""select scan_idx, length(coalesce(response, '')) as chars, right(coalesce(response, ''), 120) as tail from responses where scan_idx in (0, 1, 2, 3, 4)""")
def trace_view(spark: SparkSession, d: str) -> DataFrame:
    """Lengths and ends of a few responses, picked by key."""
    from tallgrass.sources.tables import table

    r = table(spark, d, "responses", "scan_idx", "response").where(F.col("scan_idx").isin(0, 1, 2, 3, 4))
    t = F.coalesce("response", F.lit(""))
    return r.select("scan_idx", F.length(t).cast("bigint").alias("chars"), F.right(t, F.lit(120)).alias("tail"))


QUERIES, SQL = query.queries, query.sql
