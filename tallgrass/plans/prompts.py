"""Prompts, messages and response assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions import fixed_values as fx
from tallgrass.functions import text as tx
from tallgrass.plans.base import ITEMS, corpus, items
from tallgrass.plans.registry import Registry, quoted

query = Registry()

_MCQ = "coalesce(len(options), 0) > 0"
_N = "len(regexp_extract_all(question, '\\[ANS\\]'))"
_OPTIONS = "array_to_string(list_transform(options, lambda o, i: chr(cast(64 + i as integer)) || '. ' || regexp_replace(o, '^\\s+|\\s+$', '', 'g')), chr(10))"
_USER = f"(case when {_MCQ} then question || chr(10) || chr(10) || 'Options:' || chr(10) || {_OPTIONS} else question end)"
_A, _B, _C = fx.EXACT_LAYOUT_MANY.split("%d")


@query(f"with {ITEMS} select id, md5({_USER}) as user_md5, length({_USER}) as user_chars, case when {_MCQ} then {quoted(fx.MCQ_BASELINE)} else {quoted(fx.MATH_BASELINE)} end as system from items")
def prompt_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Baseline prompts of all items."""
    u = tx.prompt_user(F.col("question"), F.col("options"))
    return items(spark, d).select("id", F.md5(u).alias("user_md5"), F.length(u).cast("bigint").alias("user_chars"), tx.prompt_system(F.col("options")).alias("system"))


_MULTI = f"(case when not ({_MCQ}) and {_N} > 1 then question || chr(10) || chr(10) || 'The problem has ' || {_N} || ' [ANS] blanks. After your reasoning, give ' || {_N} || ' comma-separated \\boxed{{}} values in order: ' || array_to_string(list_transform(range({_N}), lambda x: '\\boxed{{...}}'), ', ') else {_USER} end)"


@query(f"with {ITEMS} select id, md5({_MULTI}) as user_md5, not ({_MCQ}) and {_N} > 1 as many from items")
def prompt_multi_blank(spark: SparkSession, d: str) -> DataFrame:
    """Multi-blank prompts of all items."""
    q, o = F.col("question"), F.col("options")
    return items(spark, d).select("id", F.md5(tx.multi_blank_user(q, o)).alias("user_md5"), (~tx.is_mcq(o) & (tx.blanks(q) > 1)).alias("many"))


@query(f"""with {ITEMS} select id, case when {_MCQ} then 'mcq/exact_v1' when {_N} > 1 then 'multi-blank/exact_v1' else 'single-blank/exact_v1' end as mode,
    md5({_USER} || chr(10) || chr(10) || case when {_MCQ} then {quoted(fx.EXACT_LAYOUT_MCQ)} when {_N} > 1 then {quoted(_A)} || {_N} || {quoted(_B)} || {_N} || {quoted(_C)} else {quoted(fx.EXACT_LAYOUT_SINGLE)} end) as user_md5 from items""")
def prompt_exact(spark: SparkSession, d: str) -> DataFrame:
    """Exact-layout prompts and their mode."""
    q, o = F.col("question"), F.col("options")
    return items(spark, d).select("id", tx.prompt_mode(q, o).alias("mode"), F.md5(tx.exact_user(q, o)).alias("user_md5"))


@query(f"select scan_idx, 3 as turns, md5({_USER}) as user_md5, length(coalesce(response, '')) as response_chars from sft_corpus")
def training_messages(spark: SparkSession, d: str) -> DataFrame:
    """Chat messages of the training rows."""
    m = tx.messages(F.col("question"), F.col("options"), F.coalesce("response", F.lit("")))
    c = corpus(spark, d, "scan_idx", "question", "options", "response").withColumn("m", m)
    return c.select("scan_idx", F.size("m").alias("turns"), F.md5(F.col("m")[1]["content"]).alias("user_md5"), F.length(F.col("m")[2]["content"]).cast("bigint").alias("response_chars"))


@query(f"with {ITEMS} select id, array_to_string(list_transform(gold, lambda a: '\\boxed{{' || a || '}}'), ', ') as line, greatest({_N}, len(gold)) as blanks from items where not ({_MCQ})")
def boxed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Final line of each free-form item's gold answers, and its blanks once padded."""
    i = items(spark, d).where(~tx.is_mcq(F.col("options")))
    return i.select("id", tx.boxed_line(F.col("gold")).alias("line"), tx.blanks(tx.pad_blanks(F.col("question"), F.size("gold"))).cast("bigint").alias("blanks"))


@query(f"""with {ITEMS} select id, len(options) as n, ascii(gold[1]) - 65 as gold_index, regexp_replace(trim(options[1]), '^\\([A-J]\\)\\s*', '') as first_option from items where {_MCQ}""")
def choice_labels(spark: SparkSession, d: str) -> DataFrame:
    """Gold index and first option, unlabelled, of the multiple-choice items."""
    i = items(spark, d).where(tx.is_mcq(F.col("options")))
    return i.select("id", F.size("options").cast("bigint").alias("n"), (F.ascii(F.col("gold")[0]) - 65).alias("gold_index"), tx.choice_text(F.col("options")[0]).alias("first_option"))


@query("""select scan_idx, cast(ceil((length(question) + length(coalesce(response, ''))) / 4.0) as integer) as tokens, template_tokens is distinct from 0 and template_tokens is not null as stored from sft_corpus""")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Offline token estimates beside whether a count is stored (the estimate is a stub for a chat template)."""
    c = corpus(spark, d, "scan_idx", "question", "response", "template_tokens")
    return c.select("scan_idx", tx.token_estimate(F.col("question"), F.coalesce("response", F.lit(""))).alias("tokens"), (F.col("template_tokens").isNotNull() & (F.coalesce("template_tokens", F.lit(0)) != 0)).alias("stored"))


QUERIES, SQL = query.queries, query.sql
