"""Corpus curation: reject chains, decontamination, topics, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.functions import fixed_values as fx
from tallgrass.functions import text as tx
from tallgrass.operators import decontaminate, reject
from tallgrass.plans.base import ITEMS, corpus, items
from tallgrass.plans.registry import Registry, quoted
from tallgrass.sources.tables import table

query = Registry()
#: Rows shown of each reason for a reject.
EXAMPLES = 20

_LAST = f"coalesce(list_filter(regexp_split_to_array({{0}}, '\\r\\n|[\\n\\r\\x0b\\x0c]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '')[-1], '')"
LAST_LINE = f"regexp_replace({_LAST}, '^\\s+|\\s+$', '', 'g')"


def question() -> Column:
    """The question of a row."""
    return F.col("question")


def response() -> Column:
    """The response of a row, empty where it is null."""
    return F.coalesce("response", F.lit(""))


def final_line_ok() -> Column:
    """Whether the last line is a lone box of the right kind."""
    line = tx.last_line(response())
    return F.when(F.col("task_type") == "mcq", line.rlike(fx.MCQ_FINAL)).otherwise(line.rlike(fx.FREEFORM_FINAL))


def ready_tests() -> list[tuple[str, Column]]:
    """The order in which a training row is tested."""
    low, high = fx.PASS_RATE
    return [
        ("dropped_source", F.coalesce("hf_source", F.lit("")).isin(*fx.DROPPED_SOURCES)),
        ("empty_problem", tx.strip(F.coalesce("question", F.lit(""))) == ""),
        ("cjk_text", question().rlike(fx.CJK) | response().rlike(fx.CJK)),
        ("figure_dependent", tx.has(question(), fx.FIGURE)),
        ("inline_mcq", tx.inline_choices(question())),
        ("pass_rate_out_of_band", ~F.coalesce("pass_rate_72b_tir", F.lit(low)).between(low, high)),
        ("short_trace", F.length(tx.strip(response())) <= 500),
        ("missing_boxed", ~response().rlike(fx.BOX_HINT)),
        ("bad_final_line", ~final_line_ok()),
        ("long_trace", F.length(response()) > fx.LONG_TRACE[1]),
        ("too_long_tokens", F.coalesce("template_tokens", F.lit(0)) > fx.MAX_TOKENS),
    ]


_FINAL_OK = f"case when task_type = 'mcq' then regexp_matches({LAST_LINE.format('r')}, {quoted(fx.MCQ_FINAL)}) else regexp_matches({LAST_LINE.format('r')}, {quoted(fx.FREEFORM_FINAL)}) end"
_READY = f"""ready as (
    select *, case
        when coalesce(hf_source, '') in ('gsm8k', 'orca_math') then 'dropped_source'
        when regexp_replace(coalesce(question, ''), '^\\s+|\\s+$', '', 'g') = '' then 'empty_problem'
        when regexp_matches(question, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]') or regexp_matches(r, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]') then 'cjk_text'
        when regexp_matches(question, '(?i)' || {quoted(fx.FIGURE)}) then 'figure_dependent'
        when len(regexp_extract_all(question, '(?i)\\([A-J]\\)')) >= 3 then 'inline_mcq'
        when not coalesce(pass_rate_72b_tir, 0.05) between 0.05 and 0.70 then 'pass_rate_out_of_band'
        when length(regexp_replace(r, '^\\s+|\\s+$', '', 'g')) <= 500 then 'short_trace'
        when not regexp_matches(r, {quoted(fx.BOX_HINT)}) then 'missing_boxed'
        when not ({_FINAL_OK}) then 'bad_final_line'
        when length(r) > 12000 then 'long_trace'
        when coalesce(template_tokens, 0) > 7900 then 'too_long_tokens' end as reason
    from (select *, coalesce(response, '') as r from sft_corpus))"""


@query(f"with {_READY} select coalesce(reason, 'kept') as reason, count(*) as rows from ready group by 1")
def corpus_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Rows by the first test they fail."""
    return reject.counts(corpus(spark, d), ready_tests())


@query(f"""with {_READY}
    select source, count(*) as scanned, count(*) filter (where reason is null) as ready, round(count(*) filter (where reason is null) * 100.0 / count(*), 6) as retention,
        mode(reason order by reason) is not null as has_rejects from ready group by source""")
def corpus_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Rows scanned and ready by source, and the retention rate."""
    r = corpus(spark, d).withColumn("reason", reject.reason(ready_tests()))
    return r.groupBy("source").agg(
        F.count("*").alias("scanned"), F.count_if(F.col("reason").isNull()).alias("ready"),
        F.round(F.count_if(F.col("reason").isNull()) * 100.0 / F.count("*"), 6).alias("retention"), F.coalesce(F.bool_or(F.col("reason").isNotNull()), F.lit(False)).alias("has_rejects"),
    )


@query("""select lower(reason) as reason, count(*) as rows, round(count(*) * 100.0 / sum(count(*)) over (), 6) as pct
    from (select distinct on (source_id, lower(reason)) * from rejects order by source_id, lower(reason), scan_idx) group by 1""")
def reject_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rejects by reason in any case, repeated rows once."""
    r = table(spark, d, "rejects", "source_id", "reason").select("source_id", F.lower("reason").alias("reason")).distinct()
    c = r.groupBy("reason").agg(F.count("*").alias("rows"))
    return c.withColumn("pct", F.round(F.col("rows") * 100.0 / F.sum("rows").over(Window.partitionBy()), 6))


@query("""select lower(reason) as reason, count(*) as rows from rejects group by 1 order by rows desc, reason limit 5""")
def top_rejects(spark: SparkSession, d: str) -> DataFrame:
    """The five most frequent reasons."""
    return table(spark, d, "rejects", "reason").groupBy(F.lower("reason").alias("reason")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "reason").limit(5)


@query("""select scan_idx, source, reason, question_preview from (
    select scan_idx, source, lower(reason) as reason, question_preview, row_number() over (partition by lower(reason) order by scan_idx) as r from rejects
    where lower(reason) not in ('short_trace', 'dropped_source')) where r <= 20""")  # EXAMPLES
def reject_examples(spark: SparkSession, d: str) -> DataFrame:
    """Rejects kept for inspection: bulk reasons are counted only, of the others the first ``EXAMPLES`` rows each are shown."""
    r = table(spark, d, "rejects", "scan_idx", "source", "reason", "question_preview").withColumn("reason", F.lower("reason")).where(~F.col("reason").isin("short_trace", "dropped_source"))
    rank = F.row_number().over(Window.partitionBy("reason").orderBy("scan_idx"))  # every task keeps that many rows of a reason before the shuffle
    return r.withColumn("r", rank).where(f"r <= {EXAMPLES}").select("scan_idx", "source", "reason", "question_preview")


_KEY = (
    "trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(lower({0}), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '$', ''), "
    "'\\\\(?:mathrm|mathbf|text|textbf)\\{{([^}}]*)\\}}', '\\1', 'g'), '[^a-z0-9\\\\=+\\-*/^_{{}}().,\\[\\]]+', ' ', 'g'), '\\s+', ' ', 'g'))"
)


@query(f"select scan_idx, {_KEY.format('question')} as key, length({_KEY.format('question')}) as key_chars from sft_corpus")
def overlap_keys(spark: SparkSession, d: str) -> DataFrame:
    """Overlap key of every question."""
    k = tx.overlap_key(question())
    return corpus(spark, d, "scan_idx", "question").select("scan_idx", k.alias("key"), F.length(k).cast("bigint").alias("key_chars"))


@query(f"""with {ITEMS} select count(*) as kept, count(distinct c.source_id) as kept_ids from sft_corpus c
    where {_KEY.format('c.question')} not in (select {_KEY.format('question')} from items)""")
def decontaminate_exact(spark: SparkSession, d: str) -> DataFrame:
    """Training rows whose question is no evaluation question, however typeset."""
    kept = decontaminate.exact(corpus(spark, d, "source_id", "question"), items(spark, d))
    return kept.agg(F.count("*").alias("kept"), F.countDistinct("source_id").alias("kept_ids"))


@query(f"""with {ITEMS}, p as (select distinct {_KEY.format('substr(question, 1, 200)')} as prefix from items where length({_KEY.format('substr(question, 1, 200)')}) >= 20),
    k as (select doc_id, {_KEY.format('text')} as f, {_KEY.format('substr(text, 1, 200)')} as h from documents where text is not null)
    select doc_id from k where exists (select 1 from p where contains(f, prefix) or contains(prefix, h) or contains(h, prefix))""")
def decontaminate_containment(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain an evaluation question's prefix, or whose prefix is in one."""
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    return decontaminate.containment(docs, items(spark, d), "text").where("hit").select("doc_id")


def _topic_sql(text: str) -> str:
    """SQL of the topic with the largest summed weight, the earliest of those tied."""
    names = list(dict.fromkeys(t for t, _, _ in fx.TOPIC_RULES))
    score = {n: " + ".join(f"(case when regexp_matches({text}, '(?i)' || {quoted(p)}) then {w} else 0 end)" for t, w, p in fx.TOPIC_RULES if t == n) for n in names}
    rows = ", ".join(f"{{'score': {score[n]}, 'rank': {-i}, 'topic': {quoted(n)}}}" for i, n in enumerate(names))
    return f"(case when list_max([{rows}]).score > 0 then list_max([{rows}]).topic else 'other' end)"


@query(f"select scan_idx, {_topic_sql('question')} as topic from sft_corpus")
def topic_classify(spark: SparkSession, d: str) -> DataFrame:
    """Topic of every question by weighted rules."""
    return corpus(spark, d, "scan_idx", "question").select("scan_idx", tx.topic(question()).alias("topic"))


@query(f"""select bucket, count(*) as rows from (select case when topic in ('probability/stats', 'geometry', 'trigonometry') then topic
        when topic in ('integration', 'derivatives', 'limits', 'linear algebra', 'complex analysis', 'polynomials/algebra', 'number theory', 'logs/exponents', 'arithmetic/word problems', 'other') then 'anchor' end as bucket
    from (select {_topic_sql('question')} as topic from sft_corpus)) group by 1""")
def route_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Rows by quota bucket."""
    return corpus(spark, d, "question").select(tx.route(tx.topic(question())).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("rows"))


@query(f"""select topic, count(*) as rows from (select case when regexp_matches(question, '(?i)' || {quoted(fx.SEQUENCE_TOPIC)}) then 'sequence_recurrence'
    when regexp_matches(question, '(?i)' || {quoted(fx.NUMBER_THEORY)}) then 'number_theory' when regexp_matches(question, '(?i)' || {quoted(fx.GEOMETRY_TOPIC)}) then 'geometry' else coalesce(hf_source, source) end as topic
    from sft_corpus) group by 1""")
def source_topics(spark: SparkSession, d: str) -> DataFrame:
    """Rows by topic from keywords, else from the source."""
    return corpus(spark, d, "question", "hf_source", "source").select(tx.source_topic(F.coalesce("hf_source", "source"), question()).alias("topic")).groupBy("topic").agg(F.count("*").alias("rows"))


@query(f"""select bucket, count(*) as rows from (select case when regexp_matches(question, {quoted('(?i)' + fx.GEOMETRY_QUESTION)}) or length(question) >= {fx.LONG_QUESTION} then 'weak'
    when regexp_matches(question, {quoted('(?i)' + fx.PROBABILITY_QUESTION)}) or regexp_matches(question, {quoted('(?i)' + fx.SEQUENCE_QUESTION)}) then 'adjacent' else 'diverse' end as bucket from sft_corpus) group by 1""")
def mix_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Rows by bucket of a mixed source: weak, adjacent, diverse."""
    return corpus(spark, d, "question").select(tx.mix_bucket(question()).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("rows"))


@query(f"""select count(*) filter (where regexp_matches(question, {quoted('(?i)' + fx.GEOMETRY)})) as geometry, count(*) filter (where regexp_matches(question, {quoted('(?i)' + fx.GEOMETRY_QUESTION)})) as geometry_question,
    count(*) filter (where regexp_matches(question, {quoted('(?i)' + fx.SEQUENCE_LONG)})) as sequence_long, count(*) filter (where regexp_matches(question, {quoted('(?i)' + fx.SEQUENCE_TOPIC)})) as sequence_topic,
    count(*) filter (where regexp_matches(question, {quoted('(?i)' + fx.FIGURE)})) as figure, count(*) filter (where regexp_matches(coalesce(response, ''), {quoted('(?i)' + fx.HARD_WORDS)})) as hard_words from sft_corpus""")
def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    """Rows that each keyword pattern matches."""
    pats = {"geometry": (question(), fx.GEOMETRY), "geometry_question": (question(), fx.GEOMETRY_QUESTION), "sequence_long": (question(), fx.SEQUENCE_LONG), "sequence_topic": (question(), fx.SEQUENCE_TOPIC), "figure": (question(), fx.FIGURE), "hard_words": (response(), fx.HARD_WORDS)}
    return corpus(spark, d, "question", "response").agg(*[F.count_if(tx.has(c, p)).alias(k) for k, (c, p) in pats.items()])


@query(f"""with base as (select *, coalesce(response, '') as r, len(regexp_extract_all(regexp_split_to_array(coalesce(response, ''), {quoted(fx.CLOSE_TAG)})[-1], {quoted(fx.ANY_BOX_3)}, 1)) as n_boxes,
        len(regexp_extract_all(question, '\\[ANS\\]')) as n_blanks from sft_corpus)
    select count(*) as rows, count(*) filter (where regexp_replace(coalesce(answer, ''), '^\\s+|\\s+$', '', 'g') = '') as empty_answer, count(*) filter (where r = '') as empty_response,
        count(*) filter (where not regexp_matches(r, {quoted(fx.OPEN_TAG)}) or not regexp_matches(r, {quoted(fx.CLOSE_TAG)})) as no_wrapper, count(*) filter (where not ({_FINAL_OK})) as bad_final_line,
        count(*) filter (where not regexp_matches(r, {quoted(fx.BOX_HINT)})) as no_box, count(*) filter (where coalesce(template_tokens, 0) > 7900) as over_tokens, count(*) filter (where trace_chars is distinct from length(response)) as stale_chars,
        count(*) filter (where options is not null and len(options) > 0 and task_type <> 'mcq') as options_mismatch, count(*) filter (where n_blanks > 1 and n_boxes <> n_blanks) as box_blank_mismatch,
        count(*) - count(distinct source_id) as repeats, count(*) filter (where topic is null) as no_topic from base""")
def corpus_audit(spark: SparkSession, d: str) -> DataFrame:
    """Issue counters over the corpus, in one pass."""
    n_boxes, n_blanks = F.size(tx.boxes(tx.final_section(response()))), tx.blanks(question())
    return corpus(spark, d).agg(
        F.count("*").alias("rows"), F.count_if(tx.strip(F.coalesce("answer", F.lit(""))) == "").alias("empty_answer"), F.count_if(response() == "").alias("empty_response"),
        F.count_if(~tx.thinking_open(response()) | ~tx.thinking_closed(response())).alias("no_wrapper"), F.count_if(~final_line_ok()).alias("bad_final_line"), F.count_if(~response().rlike(fx.BOX_HINT)).alias("no_box"),
        F.count_if(F.coalesce("template_tokens", F.lit(0)) > fx.MAX_TOKENS).alias("over_tokens"), F.count_if(~F.col("trace_chars").eqNullSafe(F.length("response"))).alias("stale_chars"),
        F.count_if(tx.is_mcq(F.col("options")) & (F.col("task_type") != "mcq")).alias("options_mismatch"), F.count_if((n_blanks > 1) & (n_boxes != n_blanks)).alias("box_blank_mismatch"),
        (F.count("*") - F.countDistinct("source_id")).alias("repeats"), F.count_if(F.col("topic").isNull()).alias("no_topic"),
    )


@query("""with b as (select blank_count, len(regexp_extract_all(question, '\\[ANS\\]')) as blanks, len(regexp_extract_all(coalesce(answer, ''), '\\\\boxed\\{')) as boxes, source_id, supplement_mode from sft_corpus where supplement_mode is not null)
    select supplement_mode, count(*) as rows, count(*) filter (where blank_count <> blanks) as blanks_disagree, count(*) filter (where blanks < 2) as too_few, count(*) - count(distinct source_id) as repeats from b group by 1""")
def multi_blank_audit(spark: SparkSession, d: str) -> DataFrame:
    """Whether multi-blank rows have the blanks they claim."""
    c = corpus(spark, d, "question", "blank_count", "source_id", "supplement_mode").where("supplement_mode is not null").withColumn("blanks", tx.blanks(question()))
    return c.groupBy("supplement_mode").agg(
        F.count("*").alias("rows"), F.count_if(F.col("blank_count") != F.col("blanks")).alias("blanks_disagree"), F.count_if(F.col("blanks") < 2).alias("too_few"), (F.count("*") - F.countDistinct("source_id")).alias("repeats")
    )


@query(f"""with {_READY}, k as (select * from (select *, row_number() over (partition by source_id order by scan_idx) as n from ready where reason is null) where n = 1)
    select count(*) as final_rows, count(*) filter (where weak_topic) as weak_rows, round(count(*) filter (where weak_topic) / greatest(count(*), 1), 4) as weak_fraction, round(avg(length(r)), 1) as mean_chars,
        count(distinct source) as sources, sum(length(r))::bigint as chars from k""")
def corpus_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the ready rows, each source id once (its first row)."""
    k = corpus(spark, d, "scan_idx", "source", "source_id", "task_type", "hf_source", "weak_topic", "question", "response", "pass_rate_72b_tir", "template_tokens")
    ready = k.where(reject.reason(ready_tests()).isNull())
    first = ready.groupBy("source_id").agg(F.min_by(F.struct("source", "weak_topic", F.length(response()).alias("chars")), "scan_idx").alias("k")).select("k.*")
    return first.agg(
        F.count("*").alias("final_rows"), F.count_if("weak_topic").alias("weak_rows"), F.round(F.count_if("weak_topic") / F.greatest(F.count("*"), F.lit(1)), 4).alias("weak_fraction"),
        F.round(F.avg("chars"), 1).alias("mean_chars"), F.countDistinct("source").alias("sources"), F.sum("chars").alias("chars"),
    )


@query("""select count(*) as rows, count(distinct source_id) as kept, count(*) - count(distinct source_id) as dropped from sft_corpus""")
def first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """Rows left when each source id keeps its first row in scan order."""
    c = corpus(spark, d, "scan_idx", "source_id")
    first = c.groupBy("source_id").agg(F.min("scan_idx").alias("scan_idx"), F.count("*").alias("n"))
    return first.agg(F.sum("n").alias("rows"), F.count("*").alias("kept"), (F.sum("n") - F.count("*")).alias("dropped"))


QUERIES, SQL = query.queries, query.sql
