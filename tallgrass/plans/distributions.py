"""Distributions: counts, histograms, quantiles by several index rules, groups of equal size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.functions import fixed_values as fx
from tallgrass.functions import text as tx
from tallgrass.operators import ranking
from tallgrass.plans.base import ACC, GRADED, accuracy, corpus, graded
from tallgrass.plans.registry import Registry
from tallgrass.sources.tables import table

query = Registry()


@query("select source, count(*) as rows, round(count(*) * 100.0 / sum(count(*)) over (), 1) as pct from documents group by source")
def source_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Rows and percent by source."""
    c = table(spark, d, "documents", "source").groupBy("source").agg(F.count("*").alias("rows"))
    return c.withColumn("pct", F.round(F.col("rows") * 100.0 / F.sum("rows").over(Window.partitionBy()), 1))


def _case(value: str, edges: tuple[int, ...]) -> str:
    return "case " + " ".join(f"when {value} <= {e} then '<={e}'" for e in edges) + f" else '>{edges[-1]}' end"


@query(f"select {_case('trace_chars', fx.TRACE_EDGES)} as bucket, count(*) as rows from sft_corpus where trace_chars is not null group by 1")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Right-closed histogram of trace lengths."""
    c = corpus(spark, d, "trace_chars").where("trace_chars is not null")
    return c.groupBy(tx.bucket(F.col("trace_chars"), fx.TRACE_EDGES).alias("bucket")).agg(F.count("*").alias("rows"))


@query(f"select {_case('template_tokens', fx.TOKEN_EDGES)} as bucket, count(*) as rows from sft_corpus where template_tokens is not null group by 1")
def token_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Right-closed histogram of token counts."""
    c = corpus(spark, d, "template_tokens").where("template_tokens is not null")
    return c.groupBy(tx.bucket(F.col("template_tokens"), fx.TOKEN_EDGES).alias("bucket")).agg(F.count("*").alias("rows"))


_SORTED = "with s as (select list_sort(list(trace_chars)) as v, count(*) as n, avg(trace_chars) as m, median(trace_chars) as med from sft_corpus where trace_chars is not null)"


@query(f"{_SORTED} select round(m, 1) as mean, round(med, 1) as median, v[greatest(0, cast(floor(0.95::double * n) as bigint) - 1) + 1] as p95 from s")
def dist_stats_v1(spark: SparkSession, d: str) -> DataFrame:
    """Mean, median and lower-index 95th percentile, exact from value counts."""
    c = corpus(spark, d, "trace_chars").where("trace_chars is not null")
    q = ranking.histogram_quantiles(c, "trace_chars", (0.95,))
    return c.agg(F.round(F.avg("trace_chars"), 1).alias("mean"), F.round(F.percentile("trace_chars", 0.5), 1).alias("median")).join(q)


@query(f"""{_SORTED} select v[greatest(0, cast(floor(0.25::double * n) as bigint) - 1) + 1] as p25, v[greatest(0, cast(floor(0.5::double * n) as bigint) - 1) + 1] as p50, v[greatest(0, cast(floor(0.95::double * n) as bigint) - 1) + 1] as p95 from s""")
def dist_stats_v2(spark: SparkSession, d: str) -> DataFrame:
    """Lower-index quartiles and 95th percentile."""
    return ranking.histogram_quantiles(corpus(spark, d, "trace_chars"), "trace_chars", (0.25, 0.5, 0.95))


@query(f"""{_SORTED} select v[least(n - 1, cast(floor(0.5::double * n) as bigint)) + 1] as p50, v[least(n - 1, cast(floor(0.95::double * n) as bigint)) + 1] as p95 from s""")
def dist_stats_upper(spark: SparkSession, d: str) -> DataFrame:
    """Upper-index median and 95th percentile."""
    return ranking.histogram_quantiles(corpus(spark, d, "trace_chars"), "trace_chars", (0.5, 0.95), lower=False)


@query("select source, round(quantile_cont(n_chars, 0.9), 6) as p90, round(quantile_cont(n_chars, 0.95), 6) as p95, count(*) as rows from documents where n_chars is not null group by source")
def quantile_interpolated(spark: SparkSession, d: str) -> DataFrame:
    """Interpolated quantiles of document lengths by source."""
    c = table(spark, d, "documents", "source", "n_chars").where("n_chars is not null")
    return c.groupBy("source").agg(F.round(F.percentile("n_chars", 0.9), 6).alias("p90"), F.round(F.percentile("n_chars", 0.95), 6).alias("p95"), F.count("*").alias("rows"))


@query(f"with {GRADED} select correct, count(*) as n, round(avg(chars), 6) as mean, round(median(chars), 6) as median, min(chars) as least, max(chars) as most from graded group by correct")
def length_by_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of right and wrong responses."""
    c = F.col("chars")
    return graded(spark, d).groupBy("correct").agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.percentile(c, 0.5), 6).alias("median"), F.min(c).cast("bigint").alias("least"), F.max(c).cast("bigint").alias("most"))


@query(f"""with {GRADED} select case when is_mcq then 'mcq' else 'freeform' end as scope, count(*) filter (where correct) as "right", count(*) filter (where not correct and n_boxes = n_gold) as value_error, count(*) filter (where not correct and n_boxes <> n_gold) as count_error from graded group by 1""")
def error_crosstab(spark: SparkSession, d: str) -> DataFrame:
    """Scope against kind of error: a pivot."""
    kind = F.when(F.col("correct"), "right").when(F.col("n_boxes") == F.col("n_gold"), "value_error").otherwise("count_error")
    g = graded(spark, d).select(F.when(F.col("is_mcq"), "mcq").otherwise("freeform").alias("scope"), kind.alias("kind"), "id")
    return g.groupBy("scope").pivot("kind", ["right", "value_error", "count_error"]).agg(F.count("id")).na.fill(0)


@query(f"""with {GRADED}, e as (select quantile_cont(q_chars, [0.25, 0.5, 0.75]) as e from graded)
    select case when q_chars <= e[1] then 1 when q_chars <= e[2] then 2 when q_chars <= e[3] then 3 else 4 end as quartile, count(*) as n, round({ACC}, 6) as pct from graded, e group by 1""")
def qcut_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy by equal-frequency quartile of question length: interpolated edges, right-closed."""
    g = graded(spark, d)
    e = g.agg(F.percentile("q_chars", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("e"))
    q = F.when(F.col("q_chars") <= F.col("e")[0], 1).when(F.col("q_chars") <= F.col("e")[1], 2).when(F.col("q_chars") <= F.col("e")[2], 3).otherwise(4)
    return g.join(F.broadcast(e)).groupBy(q.alias("quartile")).agg(F.count("*").alias("n"), F.round(accuracy(), 6).alias("pct"))


@query("""with e as (select quantile_cont(n_chars, [0.25, 0.5, 0.75]) as e from documents where lang = 'en')
    select lang, case when n_chars <= e[1] then 1 when n_chars <= e[2] then 2 when n_chars <= e[3] then 3 else 4 end as grp, count(*) as n from documents, e where n_chars is not null group by 1, 2""")
def fixed_cut(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each language by the quartile edges of the English ones."""
    docs = table(spark, d, "documents", "lang", "n_chars").where("n_chars is not null")
    edges = ranking.edges(docs.where("lang = 'en'"), "n_chars")
    return docs.groupBy("lang", ranking.cut(F.col("n_chars"), edges).alias("grp")).agg(F.count("*").alias("n"))


@query("""with r as (select id, length(question) as c, row_number() over (order by length(question), id, scan_idx) as r, count(*) over () as n from eval_items)
    select cast(least(floor((r - 1) / greatest(floor(n / 4), 1)), 3) as bigint) as grp, count(*) as n, min(c) as least, max(c) as most from r group by 1""")
def index_quartiles(spark: SparkSession, d: str) -> DataFrame:
    """Index-sliced quartiles: floor(n / 4) rows each, the remainder in the last."""
    c = table(spark, d, "eval_items", "question").groupBy(F.length("question").alias("c")).agg(F.count("*").alias("k"))
    return ranking.index_slices(c, "c", "k").select("grp", "n", F.col("least").cast("bigint").alias("least"), F.col("most").cast("bigint").alias("most"))


@query("""with c as (select n_chars, count(*) as k from documents where n_chars is not null group by 1) select n_chars, round(sum(k) over (order by n_chars) * 1.0 / sum(k) over (), 9) as cdf from c""")
def length_cdf(spark: SparkSession, d: str) -> DataFrame:
    """Empirical distribution function of document lengths, a row per distinct length."""
    c = table(spark, d, "documents", "n_chars").where("n_chars is not null").groupBy("n_chars").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.orderBy("n_chars").rowsBetween(Window.unboundedPreceding, 0))
    return c.select("n_chars", F.round(upto * 1.0 / F.sum("k").over(Window.partitionBy()), 9).alias("cdf"))


@query("select scan_idx, source, row_number() over (partition by source order by scan_idx) - 1 as pos from sft_corpus")
def running_index(spark: SparkSession, d: str) -> DataFrame:
    """Running index of each row within its source.

    Positions are counted within ranges of the scan order and shifted by the rows before, so that
    a source with a third of all rows is not numbered in one task.
    """
    c = corpus(spark, d, "scan_idx", "source").withColumn("_range", F.floor(F.col("scan_idx") / 50_000))
    n = c.groupBy("source", "_range").agg(F.count("*").alias("_n"))
    n = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    r = c.withColumn("_r", F.row_number().over(Window.partitionBy("source", "_range").orderBy("scan_idx")) - 1)
    return r.join(n, ["source", "_range"]).select("scan_idx", "source", (F.col("_r") + F.col("_before")).alias("pos"))


@query("select lower(trim(band)) as band, count(*) as ratings, count(distinct doc_id) as docs, count(distinct rater) as raters from level_labels where band is not null group by 1")
def band_counts(spark: SparkSession, d: str) -> DataFrame:
    """Ratings, documents and raters by band."""
    r = table(spark, d, "level_labels").where("band is not null")
    return r.groupBy(F.lower(F.trim("band")).alias("band")).agg(F.count("*").alias("ratings"), F.countDistinct("doc_id").alias("docs"), F.countDistinct("rater").alias("raters"))


QUERIES, SQL = query.queries, query.sql
