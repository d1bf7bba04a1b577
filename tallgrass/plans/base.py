"""Views that many plans share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions import fixed_values as fx
from tallgrass.functions import text as tx
from tallgrass.plans.registry import quoted
from tallgrass.sources.tables import table


def items(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items, the last export of each id."""
    t = table(spark, d, "eval_items")
    newest = F.max_by(F.struct("question", "options", "answer", "scan_idx"), F.struct("updated_at", "scan_idx"))
    return t.groupBy("id").agg(newest.alias("i")).select("id", "i.question", "i.options", F.col("i.answer").alias("gold"))


ITEMS = """items as (
    select id, question, options, answer as gold
    from (select *, row_number() over (partition by id order by updated_at desc, scan_idx desc) as r from eval_items) where r = 1)"""


def traces(spark: SparkSession, d: str) -> DataFrame:
    """Narrow features of the last response of each run and item.

    The text itself never reaches the shuffle: features are projected first, and the last row is
    kept by an aggregate that combines on the map side, so neither a hot item nor a large run
    makes a large group.
    """
    t = table(spark, d, "responses", "scan_idx", "id", "run_tag", "response")
    r = F.coalesce("response", F.lit(""))
    tail = tx.final_section(r)
    f = t.select(
        F.lower(F.trim("run_tag")).alias("run"), "id", "scan_idx", F.length(r).alias("chars"), tx.thinking_open(r).alias("opened"), tx.thinking_closed(r).alias("closed"),
        tx.boxes(tail).alias("boxes"), F.regexp_count(r, F.lit(fx.BOX_HINT)).alias("all_boxes"), tx.letter(r).alias("letter"), F.length(tail).alias("tail_chars"),
    )
    last = F.max_by(F.struct("scan_idx", "chars", "opened", "closed", "boxes", "all_boxes", "letter", "tail_chars"), "scan_idx")
    return f.groupBy("run", "id").agg(last.alias("t")).select("run", "id", "t.*")


_TAIL = f"regexp_split_to_array(coalesce(response, ''), {quoted(fx.CLOSE_TAG)})[-1]"
TRACES = f"""traces as (
    select lower(trim(run_tag)) as run, id, scan_idx, length(coalesce(response, '')) as chars,
        regexp_matches(coalesce(response, ''), {quoted(fx.OPEN_TAG)}) as opened, regexp_matches(coalesce(response, ''), {quoted(fx.CLOSE_TAG)}) as closed,
        regexp_extract_all({_TAIL}, {quoted(fx.ANY_BOX_3)}, 1) as boxes, len(regexp_extract_all(coalesce(response, ''), {quoted(fx.BOX_HINT)})) as all_boxes,
        coalesce(nullif(upper(regexp_extract(coalesce(response, ''), '\\\\boxed\\{{([A-Za-z])\\}}', 1)), ''), regexp_extract_all(upper(coalesce(response, '')), '\\b([A-Z])\\b', 1)[-1], '') as letter,
        length({_TAIL}) as tail_chars
    from (select *, row_number() over (partition by lower(trim(run_tag)), id order by scan_idx desc) as r from responses) where r = 1)"""


def graded(spark: SparkSession, d: str) -> DataFrame:
    """Trace features with question kind and correctness: the boxes are the gold answers, in order."""
    i = items(spark, d).select(
        "id", tx.is_mcq(F.col("options")).alias("is_mcq"), F.size("gold").alias("n_gold"), F.array_join("gold", "; ").alias("gold"), tx.blanks(F.col("question")).alias("blanks"), F.length("question").alias("q_chars")
    )
    g = traces(spark, d).join(i, "id").withColumn("n_boxes", F.size("boxes")).withColumn("pred", F.array_join("boxes", "; "))
    return g.withColumn("correct", F.col("pred") == F.col("gold")).drop("boxes")


GRADED = f"""{ITEMS}, {TRACES}, graded as (
    select t.run, t.id, t.scan_idx, chars, opened, closed, all_boxes, letter, tail_chars, coalesce(len(options), 0) > 0 as is_mcq, len(i.gold) as n_gold,
        array_to_string(i.gold, '; ') as gold, len(regexp_extract_all(question, '\\[ANS\\]')) as blanks, length(question) as q_chars,
        len(boxes) as n_boxes, array_to_string(boxes, '; ') as pred, array_to_string(boxes, '; ') = array_to_string(i.gold, '; ') as correct
    from traces t join items i using (id))"""


def accuracy(correct: str = "correct") -> F.Column:
    """Percent correct, 0 of no rows."""
    return F.coalesce(F.lit(100.0) * F.count_if(correct) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))


ACC = "coalesce(100.0 * count(*) filter (where correct) / nullif(count(*), 0), 0.0)"


def corpus(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Training rows."""
    return table(spark, d, "sft_corpus", *columns)
