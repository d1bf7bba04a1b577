"""Joins, set operations, integrity checks and top-k reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions import text as tx
from tallgrass.plans.base import GRADED, ITEMS, corpus, graded, items
from tallgrass.plans.registry import Registry
from tallgrass.sources.tables import table

query = Registry()


@query(f"""with {ITEMS}, r as (select id, count(*) as n, coalesce(sum(length(response)), 0) as chars from responses where lower(trim(run_tag)) = 'priv-402' group by id)
    select i.id, coalesce(n, 0) as responses, cast(coalesce(chars, 0) as bigint) as chars from items i left join r using (id)""")
def left_default(spark: SparkSession, d: str) -> DataFrame:
    """Every item with its responses of a run, nothing where it has none."""
    r = table(spark, d, "responses", "id", "run_tag", "response").where(F.lower(F.trim("run_tag")) == "priv-402")
    c = r.groupBy("id").agg(F.count("*").alias("responses"), F.coalesce(F.sum(F.length("response")), F.lit(0)).alias("chars"))
    return items(spark, d).select("id").join(c, "id", "left").fillna(0, ["responses", "chars"])


@query(f"with {ITEMS} select count(*) as rows, count(i.id) as matched, count(*) - count(i.id) as unmatched from responses r left join items i on i.id = r.id")
def index_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether every response finds its item: the gate of an inner join by index."""
    r = table(spark, d, "responses", "id").join(items(spark, d).select("id", F.lit(1).alias("m")), "id", "left")
    return r.agg(F.count("*").alias("rows"), F.count("m").alias("matched"), (F.count("*") - F.count("m")).alias("unmatched"))


@query("select count(*) as remaining from (select distinct id from eval_items) i where id not in (select id from responses where lower(trim(run_tag)) = 'tmp-smoke')")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    """Items a run still has to answer: an anti join with its checkpoint."""
    done = table(spark, d, "responses", "id", "run_tag").where(F.lower(F.trim("run_tag")) == "tmp-smoke").select("id")
    return table(spark, d, "eval_items", "id").distinct().join(done, "id", "left_anti").agg(F.count("*").alias("remaining"))


@query("""select source, count(*) as unused from sft_corpus where source_id not in (select source_id from rejects) group by source""")
def unused_rows(spark: SparkSession, d: str) -> DataFrame:
    """Training rows whose source id was not rejected before."""
    return corpus(spark, d, "source", "source_id").join(table(spark, d, "rejects", "source_id"), "source_id", "left_anti").groupBy("source").agg(F.count("*").alias("unused"))


_WATCHED = "select distinct unnest(ids) as id from watch_sets"


@query(f"""with e as (select distinct id from eval_items), w as ({_WATCHED})
    select case when w.id is null then 'unwatched' when e.id is null then 'unknown' else 'watched' end as state, count(*) as n from e full join w on e.id = w.id group by 1""")
def integrity_diff(spark: SparkSession, d: str) -> DataFrame:
    """Full outer difference of item ids and watched ids."""
    e = table(spark, d, "eval_items", "id").distinct().withColumn("e", F.lit(1))
    w = table(spark, d, "watch_sets", "ids").select(F.explode("ids").alias("id")).distinct().withColumn("w", F.lit(1))
    state = F.when(F.col("w").isNull(), "unwatched").when(F.col("e").isNull(), "unknown").otherwise("watched")
    return e.join(w, "id", "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""with r as (select id, count(*) as n, count(*) filter (where coalesce(response, '') = '') as e from responses where lower(trim(run_tag)) = 'pub-101' group by id)
    select 'row_count' as gate, (select cast(sum(n) as bigint) from r) as got, (select count(distinct id) from eval_items) as want union all select 'missing', (select count(distinct id) from eval_items where id not in (select id from r)), 0
    union all select 'extra', (select count(*) from r where id not in (select id from eval_items)), 0 union all select 'duplicates', (select count(*) from r where n > 1), 0 union all select 'empty', (select cast(sum(e) as bigint) from r), 0""")
def integrity_gates(spark: SparkSession, d: str) -> DataFrame:
    """Gate table of a submission: rows, missing, extra, duplicate and empty ids, from one full join."""
    r = table(spark, d, "responses", "id", "run_tag", "response").where(F.lower(F.trim("run_tag")) == "pub-101")
    r = r.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.coalesce("response", F.lit("")) == "").alias("e"))
    i = table(spark, d, "eval_items", "id").distinct().withColumn("i", F.lit(1))
    one = r.join(i, "id", "full").agg(
        F.sum("n").alias("rows"), F.count("i").alias("want"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("i").isNull()).alias("extra"), F.count_if(F.col("n") > 1).alias("dup"), F.sum("e").alias("empty")
    )
    zero = F.lit(0).cast("bigint")
    gates = [("row_count", F.col("rows"), F.col("want")), ("missing", F.col("missing"), zero), ("extra", F.col("extra"), zero), ("duplicates", F.col("dup"), zero), ("empty", F.col("empty"), zero)]
    return one.select(F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), a.alias("got"), b.alias("want")) for g, a, b in gates])).alias("g")).select("g.*")


@query("select id, count(*) as n, min(scan_idx) as first_at from eval_items group by id having count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that occur more than once."""
    return table(spark, d, "eval_items", "id", "scan_idx").groupBy("id").agg(F.count("*").alias("n"), F.min("scan_idx").alias("first_at")).where("n > 1")


@query("""select count(*) as n, count(distinct cast(cast(id as varchar) as bigint)) as ids, cast(sum(cast(cast(id as varchar) as bigint)) as bigint) as total from eval_items""")
def id_casts(spark: SparkSession, d: str) -> DataFrame:
    """Ids read as text and compared as numbers."""
    i = table(spark, d, "eval_items", "id").select(F.expr("try_cast(cast(id as string) as bigint)").alias("id"))
    return i.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum("id").alias("total"))


@query(f"""with {GRADED} select count(*) filter (where n_boxes = n_gold) as aligned, count(*) filter (where pred = gold) as in_order,
    count(*) filter (where array_to_string(list_sort(string_split(pred, '; ')), '; ') = array_to_string(list_sort(string_split(gold, '; ')), '; ')) as any_order from graded where not is_mcq""")
def array_matches(spark: SparkSession, d: str) -> DataFrame:
    """Answers equal place by place, and as multisets."""
    g = graded(spark, d).where("not is_mcq")
    p, q = F.split("pred", "; "), F.split("gold", "; ")
    return g.agg(F.count_if(F.col("n_boxes") == F.col("n_gold")).alias("aligned"), F.count_if(F.col("pred") == F.col("gold")).alias("in_order"), F.count_if(tx.same_multiset(p, q)).alias("any_order"))


@query(f"""with {GRADED}, w as (select run, id from graded where correct), x as (select g.run, g.id, len(list_filter(string_split(g.gold, '; '), lambda a: list_contains(string_split(g.pred, '; '), a))) as hits, g.n_gold from graded g)
    select run, count(*) filter (where hits = n_gold) as all_in_boxes, count(*) filter (where hits > 0 and hits < n_gold) as some_in_boxes from x group by run""")
def gold_in_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose gold answers are all, or partly, among the boxes."""
    p, q = F.split("pred", "; "), F.split("gold", "; ")
    hits = F.size(F.filter(q, lambda a: F.array_contains(p, a)))
    g = graded(spark, d).withColumn("hits", hits)
    return g.groupBy("run").agg(F.count_if(F.col("hits") == F.col("n_gold")).alias("all_in_boxes"), F.count_if((F.col("hits") > 0) & (F.col("hits") < F.col("n_gold"))).alias("some_in_boxes"))


@query("select scan_idx, trace_chars from sft_corpus where trace_chars is not null order by trace_chars desc, scan_idx limit 25")
def topk_longest(spark: SparkSession, d: str) -> DataFrame:
    """The longest traces, ties to the earlier row: a bounded top-k, no sort of all rows."""
    return corpus(spark, d, "scan_idx", "trace_chars").where("trace_chars is not null").orderBy(F.desc("trace_chars"), "scan_idx").limit(25)


@query("""select scan_idx, trace_chars from sft_corpus where trace_chars between 2000 and 12000 and contains(coalesce(response, ''), '</think>') order by trace_chars desc, scan_idx limit 25""")
def longest_accepted(spark: SparkSession, d: str) -> DataFrame:
    """Longest-first acceptance until enough: filter, then top-k, since acceptance looks at one row."""
    c = corpus(spark, d, "scan_idx", "trace_chars", "response").where(F.col("trace_chars").between(2000, 12000) & F.contains(F.coalesce("response", F.lit("")), F.lit("</think>")))
    return c.select("scan_idx", "trace_chars").orderBy(F.desc("trace_chars"), "scan_idx").limit(25)


@query(f"with {GRADED} select is_mcq, run, id, chars from graded where not correct order by is_mcq, run, id limit 20")
def sorted_head(spark: SparkSession, d: str) -> DataFrame:
    """First wrong rows in the order of kind, run and id."""
    return graded(spark, d).where("not correct").select("is_mcq", "run", "id", F.col("chars").cast("bigint").alias("chars")).orderBy("is_mcq", "run", "id").limit(20)


@query(f"with {GRADED}, a as (select run, 100.0 * avg(correct::int) as pct from graded group by run) select arg_max(run, (pct, run)) as best, arg_min(run, (pct, run)) as worst, round(max(pct), 6) as best_pct, round(min(pct), 6) as worst_pct from a")
def best_and_worst(spark: SparkSession, d: str) -> DataFrame:
    """Best and worst run."""
    a = graded(spark, d).groupBy("run").agg((F.lit(100.0) * F.avg(F.col("correct").cast("int"))).alias("pct"))
    k = F.struct("pct", "run")
    return a.agg(F.max_by("run", k).alias("best"), F.min_by("run", k).alias("worst"), F.round(F.max("pct"), 6).alias("best_pct"), F.round(F.min("pct"), 6).alias("worst_pct"))


@query("""select part, count(*) as rows, cast(sum(trace_chars) as bigint) as chars from (
    select 'base' as part, trace_chars from sft_corpus where supplement_mode is null union all select 'supplement', trace_chars from sft_corpus where supplement_mode is not null union all select 'reject', trace_chars from rejects) group by part""")
def union_parts(spark: SparkSession, d: str) -> DataFrame:
    """Base, supplement and reject rows in one table, columns missing in a part left null."""
    c = corpus(spark, d, "scan_idx", "trace_chars", "supplement_mode")
    base = c.where("supplement_mode is null").withColumn("part", F.lit("base"))
    extra = c.where("supplement_mode is not null").withColumn("part", F.lit("supplement"))
    r = table(spark, d, "rejects", "scan_idx", "reason", "trace_chars").withColumn("part", F.lit("reject"))
    u = base.unionByName(extra).unionByName(r, allowMissingColumns=True)
    return u.groupBy("part").agg(F.count("*").alias("rows"), F.sum("trace_chars").alias("chars"))


@query("""select (select count(*) from (select distinct source_id from sft_corpus union select distinct source_id from rejects)) as any_n, (select count(*) from (select source_id from sft_corpus intersect select source_id from rejects)) as both_n,
    (select count(*) from (select source_id from sft_corpus except select source_id from rejects)) as corpus_only""")
def key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection and difference of two key sets, from one grouping."""
    a = corpus(spark, d, "source_id").select("source_id", F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = table(spark, d, "rejects", "source_id").select("source_id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    k = a.unionByName(b).groupBy("source_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return k.agg(F.count("*").alias("any_n"), F.count_if(F.expr("a = 1 and b = 1")).alias("both_n"), F.count_if(F.expr("a = 1 and b = 0")).alias("corpus_only"))


@query("""select c_mktsegment, n_name, count(distinct o_orderkey) as orders, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join nation on c_nationkey = n_nationkey
    where o_orderdate >= timestamp '1995-01-01' group by 1, 2""")
def star_join(spark: SparkSession, d: str) -> DataFrame:
    """A star join with filter and aggregate."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp"))
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    li = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    n = table(spark, d, "nation", "n_nationkey", "n_name")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return j.groupBy("c_mktsegment", "n_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


QUERIES, SQL = query.queries, query.sql
