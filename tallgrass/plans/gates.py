"""Gates: counters over a whole table and the decision that follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions import fixed_values as fx
from tallgrass.functions import text as tx
from tallgrass.plans.base import GRADED, ITEMS, corpus, graded, items
from tallgrass.plans.corpus import _KEY, LAST_LINE, question, response
from tallgrass.plans.evaluation import NEW, OLD
from tallgrass.plans.registry import Registry, quoted

query = Registry()
#: Hard failures beyond which a corpus is built again, and characters of a trace that is too short to keep.
HARD_FAILURES, SHORT, READY = 2, 500, 2000

_LINE = LAST_LINE.format("coalesce(response, '')")
_CJK = "'[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\x{3040}-\\x{30ff}\\x{ac00}-\\x{d7af}]'"
_R = "coalesce(response, '')"


@query(f"""with {ITEMS}, k as (select distinct {_KEY.format('question')} as key from items), c as (select
        count(*) filter (where not (regexp_matches({_R}, {quoted(fx.OPEN_TAG)}) and regexp_matches({_R}, {quoted(fx.CLOSE_TAG)}))) as missing_wrapper, count(*) filter (where not regexp_matches({_LINE}, {quoted(fx.FREEFORM_FINAL)})) as bad_final,
        count(*) filter (where regexp_matches(question, {_CJK}) or regexp_matches({_R}, {_CJK})) as cjk, count(*) filter (where len(regexp_extract_all(question, '(?i)\\([A-J]\\)')) >= {fx.INLINE_CHOICES}) as inline_choices,
        count(*) filter (where {_KEY.format('question')} in (select key from k)) as overlap, count(*) filter (where coalesce(trace_chars, 0) < {SHORT}) as short from sft_corpus)
    select *, missing_wrapper + bad_final + cjk + inline_choices + overlap + short as hard, missing_wrapper + bad_final + cjk + inline_choices + overlap + short > {HARD_FAILURES} as rebuild from c""")
def corpus_gate(spark: SparkSession, d: str) -> DataFrame:
    """Hard failures of the corpus, and whether it must be built again."""
    keys = items(spark, d).select(tx.overlap_key(F.col("question")).alias("_key"), F.lit(True).alias("_is")).distinct()
    c = corpus(spark, d, "question", "response", "trace_chars").withColumn("_key", tx.overlap_key(question())).join(keys, "_key", "left")
    counters = {
        "missing_wrapper": ~(tx.thinking_open(response()) & tx.thinking_closed(response())), "bad_final": ~tx.last_line(response()).rlike(fx.FREEFORM_FINAL), "cjk": question().rlike(fx.CJK) | response().rlike(fx.CJK),
        "inline_choices": tx.inline_choices(question()), "overlap": F.col("_is"), "short": F.coalesce("trace_chars", F.lit(0)) < SHORT,
    }
    one = c.agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in counters.items()])
    hard = sum((F.col(n) for n in counters), F.lit(0))
    return one.withColumn("hard", hard).withColumn("rebuild", F.col("hard") > HARD_FAILURES)


@query(f"""with b as (select coalesce(blank_count, len(regexp_extract_all(question, '\\[ANS\\]'))) as n, len(regexp_extract_all(question, '\\[ANS\\]')) as marks, len(regexp_extract_all({_LINE}, {quoted(fx.BOX_3)}, 1)) as boxes,
        coalesce(len(options), 0) > 0 as is_mcq from sft_corpus where supplement_mode is not null)
    select count(*) as rows, count(*) filter (where n <> marks) as count_against_marks, count(*) filter (where n < 2) as too_few, count(*) filter (where n > 4) as too_many, count(*) filter (where boxes <> n) as boxes_against_count,
        count(*) filter (where not is_mcq and n <= 1) as single_freeform from b""")
def multi_blank_issues(spark: SparkSession, d: str) -> DataFrame:
    """The five issues of supplementary rows with several blanks."""
    c = corpus(spark, d, "question", "response", "options", "blank_count", "supplement_mode").where("supplement_mode is not null")
    c = c.select(F.coalesce("blank_count", tx.blanks(question())).alias("n"), tx.blanks(question()).alias("marks"), F.size(tx.boxes(tx.last_line(response()), fx.BOX_3)).alias("boxes"), tx.is_mcq(F.col("options")).alias("is_mcq"))
    issues = {"count_against_marks": "n <> marks", "too_few": "n < 2", "too_many": "n > 4", "boxes_against_count": "boxes <> n", "single_freeform": "not is_mcq and n <= 1"}
    return c.agg(F.count("*").alias("rows"), *[F.count_if(F.coalesce(F.expr(t), F.lit(False))).alias(n) for n, t in issues.items()])


@query(f"""select case when coalesce(trace_chars, 0) < {READY} then 'trace_chars_below_min' when regexp_matches({_LINE}, {quoted(fx.MCQ_FINAL)}) then 'letter_final' else 'kept' end as reason, count(*) as rows from sft_corpus group by 1""")
def ready_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows that stay in a free-form corpus: long enough, and no lone letter as final line."""
    reason = F.when(F.coalesce("trace_chars", F.lit(0)) < READY, "trace_chars_below_min").when(tx.last_line(response()).rlike(fx.MCQ_FINAL), "letter_final").otherwise("kept")
    return corpus(spark, d, "trace_chars", "response").groupBy(reason.alias("reason")).agg(F.count("*").alias("rows"))


@query(f"""with {GRADED}, p as (select id, max(case when run = '{OLD}' then 1 else 0 end) as a, max(case when run = '{NEW}' then 1 else 0 end) as b from graded where run in ('{OLD}', '{NEW}') group by id)
    select count(*) filter (where a = 1) as old_n, count(*) filter (where b = 1) as new_n, count(*) filter (where a = 1 and b = 1) as shared, count(*) filter (where a = 0 and b = 1) as missing,
        count(*) filter (where a = 0 and b = 1) = 0 as complete, count(*) filter (where a = 1 and b = 1) > 0 as comparable from p""")
def pair_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether two runs can be compared: items they share, and items of the new run that the old one lacks (there must be none)."""
    g = graded(spark, d).where(F.col("run").isin(OLD, NEW)).groupBy("id").agg(F.max((F.col("run") == OLD).cast("int")).alias("a"), F.max((F.col("run") == NEW).cast("int")).alias("b"))
    n = g.agg(F.count_if(F.col("a") == 1).alias("old_n"), F.count_if(F.col("b") == 1).alias("new_n"), F.count_if(F.expr("a = 1 and b = 1")).alias("shared"), F.count_if(F.expr("a = 0 and b = 1")).alias("missing"))
    return n.withColumn("complete", F.col("missing") == 0).withColumn("comparable", F.col("shared") > 0)


QUERIES, SQL = query.queries, query.sql
