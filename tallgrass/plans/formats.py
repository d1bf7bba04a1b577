"""Format reports over responses: boxes, letters, tags, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions import fixed_values as fx
from tallgrass.functions import text as tx
from tallgrass.functions.judging import last_group_udf
from tallgrass.plans.base import _TAIL, GRADED, corpus, graded
from tallgrass.plans.registry import Registry, quoted
from tallgrass.sources.tables import table

query = Registry()
PHRASES = ("final answer", "answer is", "therefore", "let me check", "wait")


@query(f"""select scan_idx, array_to_string(b, ' | ') as boxes, len(b) as n_boxes, coalesce(b[-1], '') as last_box from (
    select scan_idx, regexp_extract_all({_TAIL}, {quoted(fx.ANY_BOX_3)}, 1) as b from responses)""")
def boxed_extract(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of every response's final section."""
    b = tx.boxes(tx.final_section(F.coalesce("response", F.lit(""))))
    r = table(spark, d, "responses", "scan_idx", "response").select("scan_idx", b.alias("b"))
    return r.select("scan_idx", F.array_join("b", " | ").alias("boxes"), F.size("b").cast("bigint").alias("n_boxes"), F.coalesce(F.try_element_at("b", F.lit(-1)), F.lit("")).alias("last_box"))


@query()
def box_groups(spark: SparkSession, d: str) -> DataFrame:
    """Rows by the size of the last group of boxes (braces of any depth)."""
    g = table(spark, d, "responses", "response").select(F.size(last_group_udf("response")).alias("boxes"))
    return g.groupBy("boxes").agg(F.count("*").alias("rows"))


@query(f"""with {GRADED} select run, case when correct then 'right' when opened and not closed then 'truncated' when all_boxes = 0 then 'no_box' else 'wrong_box' end as mode, count(*) as n from graded group by 1, 2""")
def failure_modes(spark: SparkSession, d: str) -> DataFrame:
    """How responses fail: truncated, without a box, or with a wrong one."""
    m = F.when(F.col("correct"), "right").when(F.col("opened") & ~F.col("closed"), "truncated").when(F.col("all_boxes") == 0, "no_box").otherwise("wrong_box")
    return graded(spark, d).groupBy("run", m.alias("mode")).agg(F.count("*").alias("n"))


@query(f"with {GRADED} select gold, letter, count(*) as n, count(*) filter (where gold = letter) as hits from graded where is_mcq group by 1, 2")
def letter_bias(spark: SparkSession, d: str) -> DataFrame:
    """Chosen letters against gold letters."""
    return graded(spark, d).where("is_mcq").groupBy("gold", "letter").agg(F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("letter")).alias("hits"))


LETTERS = "ABCDEFGHIJ"
_LETTER_COUNTS = ", ".join(f"count(*) filter (where letter = '{x}') as \"{x}\"" for x in LETTERS)


@query(f"""with {GRADED} select gold, {_LETTER_COUNTS}, count(*) filter (where letter not in ({", ".join(f"'{x}'" for x in LETTERS)})) as other from graded where is_mcq group by gold""")
def letter_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Confusion matrix of letters: one count a letter, and of whatever else was chosen."""
    counts = [F.count_if(F.col("letter") == x).alias(x) for x in LETTERS]
    return graded(spark, d).where("is_mcq").groupBy("gold").agg(*counts, F.count_if(~F.col("letter").isin(*LETTERS)).alias("other"))


@query(f"""with {GRADED} select correct, count(*) as n, count(*) filter (where closed) as closed_n, count(*) filter (where all_boxes > 0) as boxed_n, round(avg(all_boxes), 6) as mean_boxes, round(avg(chars), 6) as mean_chars from graded group by correct""")
def think_tally(spark: SparkSession, d: str) -> DataFrame:
    """Tags, boxes and lengths by outcome."""
    return graded(spark, d).groupBy("correct").agg(
        F.count("*").alias("n"), F.count_if("closed").alias("closed_n"), F.count_if(F.col("all_boxes") > 0).alias("boxed_n"), F.round(F.avg("all_boxes"), 6).alias("mean_boxes"), F.round(F.avg("chars"), 6).alias("mean_chars")
    )


@query(f"with {GRADED} select run, count(*) as n, count(*) filter (where closed and n_boxes = 0 and all_boxes > 0) as only_inside from graded group by run")
def answer_only_in_think(spark: SparkSession, d: str) -> DataFrame:
    """Responses whose boxes all lie in the reasoning."""
    return graded(spark, d).groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("closed") & (F.col("n_boxes") == 0) & (F.col("all_boxes") > 0)).alias("only_inside"))


_PHRASE_ROWS = ", ".join(f"({quoted(p)})" for p in PHRASES)


@query(f"select p as phrase, count(*) as n from responses, (values {_PHRASE_ROWS}) t(p) where contains(lower(right(coalesce(response, ''), 500)), p) group by p")
def phrase_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Responses with each phrase among their last 500 characters: one scan, one flag a phrase."""
    tail = F.lower(F.right(F.coalesce("response", F.lit("")), F.lit(500)))
    hits = F.array_compact(F.array(*[F.when(F.contains(tail, F.lit(p)), F.lit(p)) for p in PHRASES]))
    return table(spark, d, "responses", "response").select(F.explode(hits).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))


_SLICE = f"count(*) as n, count(*) filter (where closed) as closed_n, count(*) filter (where n_boxes = n_gold) as aligned, count(*) filter (where chars >= {fx.NEAR_CAP_CHARS}) as near_cap, round(avg(chars), 6) as mean_chars"


@query(f"""with {GRADED} select 'all' as slice, {_SLICE} from graded union all select 'mcq', {_SLICE} from graded where is_mcq union all select 'freeform', {_SLICE} from graded where not is_mcq union all select 'multi', {_SLICE} from graded where n_gold > 1""")
def slice_report(spark: SparkSession, d: str) -> DataFrame:
    """Format health of slices that overlap: each row goes to its slices, then one aggregate."""
    g = graded(spark, d)
    slices = F.array_compact(F.array(F.lit("all"), F.when(F.col("is_mcq"), "mcq").otherwise("freeform"), F.when(F.col("n_gold") > 1, "multi")))
    return g.withColumn("slice", F.explode(slices)).groupBy("slice").agg(
        F.count("*").alias("n"), F.count_if("closed").alias("closed_n"), F.count_if(F.col("n_boxes") == F.col("n_gold")).alias("aligned"), F.count_if(F.col("chars") >= fx.NEAR_CAP_CHARS).alias("near_cap"), F.round(F.avg("chars"), 6).alias("mean_chars")
    )


@query(f"""with {GRADED} select run, count(*) as n, round(100.0 * count(*) filter (where opened or closed) / count(*), 6) as tag_rate, count(*) filter (where chars = 0) as empty_n, count(*) filter (where not opened and not closed and all_boxes > 0) as answer_only,
    count(*) filter (where n_boxes > n_gold) as surplus, round(avg(chars), 6) as mean_chars from graded group by run""")
def health_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Tag emission, empty and bare answers, surplus boxes and length by run."""
    tag = F.col("opened") | F.col("closed")
    return graded(spark, d).groupBy("run").agg(
        F.count("*").alias("n"), F.round(F.lit(100.0) * F.count_if(tag) / F.count("*"), 6).alias("tag_rate"), F.count_if(F.col("chars") == 0).alias("empty_n"), F.count_if(~tag & (F.col("all_boxes") > 0)).alias("answer_only"),
        F.count_if(F.col("n_boxes") > F.col("n_gold")).alias("surplus"), F.round(F.avg("chars"), 6).alias("mean_chars"),
    )


@query(f"""with {GRADED}, f as (select scan_idx, array_to_string(list_filter([case when opened and not closed then 'truncated' end, case when all_boxes = 0 then 'no_box' end, case when n_boxes > n_gold then 'extra_boxes' end,
    case when n_boxes < n_gold and all_boxes > 0 then 'missing_boxes' end, case when chars >= {fx.NEAR_CAP_CHARS} then 'near_cap' end, case when chars = 0 then 'empty' end], lambda x: x is not null), ',') as flags from graded) select scan_idx, flags from f where flags <> ''""")
def flags_export(spark: SparkSession, d: str) -> DataFrame:
    """Responses with at least one flag."""
    flag = lambda c, n: F.when(c, F.lit(n))
    b, g, a = F.col("n_boxes"), F.col("n_gold"), F.col("all_boxes")
    flags = F.array_compact(F.array(
        flag(F.col("opened") & ~F.col("closed"), "truncated"), flag(a == 0, "no_box"), flag(b > g, "extra_boxes"), flag((b < g) & (a > 0), "missing_boxes"), flag(F.col("chars") >= fx.NEAR_CAP_CHARS, "near_cap"), flag(F.col("chars") == 0, "empty"),
    ))
    return graded(spark, d).select("scan_idx", flags.alias("f")).where(F.size("f") > 0).select("scan_idx", F.array_join("f", ",").alias("flags"))


@query("""select count(*) as n, count(*) filter (where ascii(upper(regexp_extract(coalesce(response, ''), '\\\\boxed\\{([A-Za-z])\\}', 1))) - 65 < len(options) and regexp_extract(coalesce(response, ''), '\\\\boxed\\{([A-Za-z])\\}', 1) <> '') as emitted
    from sft_corpus where options is not null and len(options) > 0""")
def mcq_emission(spark: SparkSession, d: str) -> DataFrame:
    """Multiple-choice rows that box a letter among their options."""
    c = corpus(spark, d, "options", "response").where(tx.is_mcq(F.col("options")))
    return c.agg(F.count("*").alias("n"), F.count_if(tx.emits_letter(F.coalesce("response", F.lit("")), F.col("options"))).alias("emitted"))


@query(f"""select count(*) as n, round(avg(length({_TAIL})), 6) as mean_tail, count(*) filter (where regexp_matches(coalesce(response, ''), {quoted(fx.OPEN_TAG)}) and regexp_matches(coalesce(response, ''), {quoted(fx.CLOSE_TAG)})) as wrapped from sft_corpus""")
def trace_split(spark: SparkSession, d: str) -> DataFrame:
    """Final sections and wrappers of the training responses."""
    r = F.coalesce("response", F.lit(""))
    return corpus(spark, d, "response").agg(F.count("*").alias("n"), F.round(F.avg(F.length(tx.final_section(r))), 6).alias("mean_tail"), F.count_if(tx.thinking_open(r) & tx.thinking_closed(r)).alias("wrapped"))


QUERIES, SQL = query.queries, query.sql
