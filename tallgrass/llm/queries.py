"""Queries of the training-data operators, and SQL for those that SQL can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm import bpe, leaks, packing, pairs, proportion, reading_level, truncation
from tallgrass.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective fields with their defect."""
    return pairs.defects(table(spark, d, "sft_corpus"), table(spark, d, "responses"), table(spark, d, "eval_items"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Target rows whose target exceeds the supply."""
    return proportion.allocate(table(spark, d, "sft_corpus"), table(spark, d, "mix_targets")).where("unmet").select("mix_id", "category")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    """The samples of all mixes."""
    return proportion.sample(table(spark, d, "sft_corpus"), table(spark, d, "mix_targets"))


def p2_seats(spark: SparkSession, d: str) -> DataFrame:
    """Target, supply and seats of every target row."""
    return proportion.allocate(table(spark, d, "sft_corpus"), table(spark, d, "mix_targets")).drop("cat")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that must be divided, by kind of container: the packing's rows of several pieces."""
    packed = packing.pack(table(spark, d, "sft_corpus"), table(spark, d, "pack_bins"))
    return packed.where("parts > 1 and part = 0").select("bin_id", "scan_idx")


def p3_packed(spark: SparkSession, d: str) -> DataFrame:
    """The assignment of pieces to containers."""
    return packing.pack(table(spark, d, "sft_corpus"), table(spark, d, "pack_bins"))


def p3_space(spark: SparkSession, d: str) -> DataFrame:
    """Containers, the fewest possible, and the share of unused space of each kind."""
    p = p3_packed(spark, d).groupBy("bin_id", "capacity", "grp", "container").agg(F.sum("length").alias("used"))
    out = p.groupBy("bin_id", "capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("used"))
    return out.withColumn("least", F.ceil(F.col("used") / F.col("capacity"))).withColumn("unused", 1 - F.col("used") / (F.col("containers") * F.col("capacity")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Responses that were cut."""
    return truncation.judged(table(spark, d, "responses"), table(spark, d, "eval_items")).where("cut").select("scan_idx")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    """Each run's rate of cut responses."""
    return truncation.rates(truncation.judged(table(spark, d, "responses"), table(spark, d, "eval_items")))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return bpe.encode_corpus(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that leak evaluation items."""
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items, the documents that leak each, and the most words of it that one of them has."""
    rows = leaks.evidence(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return rows.groupBy("id").agg(F.count("*").alias("documents"), F.max("words").alias("most_words"), F.count_if("answered").alias("answered"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Level of schooling of English documents."""
    return reading_level.levels(table(spark, d, "documents"), table(spark, d, "level_labels"))


def p8_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of the level model on all rated documents, none of which it was fitted on, by source."""
    return reading_level.accuracy(table(spark, d, "documents"), table(spark, d, "level_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_sample, p2_seats, p3_found, p3_packed, p3_space, p4_found, p4_rates, p6_ids, p7_found, p7_items, p8_found, p8_accuracy)}

_CAT = "regexp_replace(lower(trim({0})), '[\\s_-]+', '_', 'g')"
SQL = {
    "p2_found": f"""
        with supply as (
            select 'topic' as by_field, {_CAT.format('topic')} as cat, count(*) as n from sft_corpus where topic is not null group by 1, 2
            union all
            select 'weak_topic', cast(weak_topic as varchar), count(*) from sft_corpus where weak_topic is not null group by 1, 2)
        select m.mix_id, m.category
        from mix_targets m left join supply s on s.by_field = m.by_field and s.cat = {_CAT.format('m.category')}
        where greatest(cast(share as decimal(12, 6)) * cast(sample_frac as decimal(12, 6)) * (select count(*) from sft_corpus), min_rows) > coalesce(s.n, 0)""",
    "p3_found": """
        select b.bin_id, c.scan_idx from pack_bins b join sft_corpus c
        on (b.item_field = 'template_tokens' and c.template_tokens > b.capacity) or (b.item_field = 'trace_chars' and c.trace_chars > b.capacity)""",
}
