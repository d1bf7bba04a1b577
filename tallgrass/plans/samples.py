"""Sampling and synthesis plans; uniform numbers come from md5, so SQL draws the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions import fixed_values as fx
from tallgrass.functions import text as tx
from tallgrass.operators import sampling
from tallgrass.plans.base import _TAIL, ITEMS, corpus, items
from tallgrass.plans.registry import Registry, quoted
from tallgrass.sources.tables import table

query = Registry()


def _u(key: str, seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || cast({key} as varchar)), 1, 8))::bigint / 4294967296.0)"


@query(f"""select source, scan_idx from (select source, scan_idx, row_number() over (partition by source order by {_u('scan_idx', 42)}, scan_idx) as r, count(*) over (partition by source) as n from sft_corpus) where r <= greatest(1, floor(n * 0.2::double))""")
def stratified_holdout(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of each source, at least one row."""
    return sampling.stratified_fraction(corpus(spark, d, "source", "scan_idx"), ["source"], 0.2, "scan_idx").select("source", "scan_idx")


@query(f"""with recursive {ITEMS}, w as (select id, (case when coalesce(len(options), 0) > 0 then 'mcq' else 'freeform' end) || '/' || len(regexp_extract_all(question, '\\[ANS\\]')) as stratum from items),
    s as (select stratum, count(*) as n, row_number() over (order by {_u('stratum', 42)}, stratum) as i, count(*) over () as m, sum(count(*)) over () as total from w group by stratum),
    k as (select i, stratum, least(case when m > 1 then greatest(round_even(60.0 * n / total, 0), 1) else n end, n, 60)::bigint as k, 60 as open from s where i = 1
        union all select s.i, s.stratum, least(case when s.i < s.m then greatest(round_even(60.0 * s.n / s.total, 0), 1) else s.n end, s.n, k.open - k.k)::bigint, (k.open - k.k)::int from s join k on s.i = k.i + 1)
    select id, stratum from (select w.*, k.k, row_number() over (partition by w.stratum order by {_u('id', 42)}, id) as r from w join k on k.stratum = w.stratum) where r <= k""")
def proportional_watch(spark: SparkSession, d: str) -> DataFrame:
    """A watch set of 60 items in proportion to their kind and number of blanks."""
    i = items(spark, d).select("id", F.concat_ws("/", F.when(tx.is_mcq(F.col("options")), "mcq").otherwise("freeform"), tx.blanks(F.col("question")).cast("string")).alias("stratum"))
    return sampling.proportional(i, "stratum", 60, "id")


@query(f"""select scan_idx, weak_topic from sft_corpus order by ln(greatest({_u('scan_idx', 7)}, 1e-12)) / (case when weak_topic then 3.0 else 1.0 end) desc, scan_idx limit 100""")
def weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred rows without replacement, weak topics three times as likely."""
    w = F.when(F.col("weak_topic"), fx.WEAK_WEIGHT).otherwise(1.0)
    return sampling.weighted(corpus(spark, d, "scan_idx", "weak_topic"), 100, w, "scan_idx", seed=7)


@query(f"select scan_idx, source from sft_corpus where trace_chars > 1000 order by {_u('scan_idx', 11)}, scan_idx limit 150")
def reservoir(spark: SparkSession, d: str) -> DataFrame:
    """A reservoir of qualifying rows."""
    return sampling.reservoir(corpus(spark, d, "scan_idx", "source", "trace_chars").where("trace_chars > 1000"), 150, "scan_idx", seed=11).select("scan_idx", "source")


@query("""select source, scan_idx from (select source, scan_idx, row_number() over (partition by source order by scan_idx) as r from sft_corpus) where (source = 'numina_cot_clean' and r <= 40) or (source = 'math_train' and r <= 25) or (source = 'openr1_pool' and r <= 10)""")
def quota_buckets(spark: SparkSession, d: str) -> DataFrame:
    """First rows of each source up to its quota, in scan order."""
    return sampling.quota(corpus(spark, d, "source", "scan_idx"), "source", {"numina_cot_clean": 40, "math_train": 25, "openr1_pool": 10}, "scan_idx")


@query(f"""select source, scan_idx from (select source, scan_idx, row_number() over (partition by source order by {_u('scan_idx', 5)}, scan_idx) as r from sft_corpus) where (source = 'numina_cot_clean' and r <= 50) or (source = 'math_train' and r <= 30) or (source = 'openr1_pool' and r <= 20)""")
def bucket_mix(spark: SparkSession, d: str) -> DataFrame:
    """A random sample of each bucket of fixed size."""
    return sampling.mixed(corpus(spark, d, "source", "scan_idx"), "source", {"numina_cot_clean": 50, "math_train": 30, "openr1_pool": 20}, "scan_idx", seed=5).select("source", "scan_idx")


_GEO = quoted("(?i)" + fx.GEOMETRY)


@query(f"""with b as (select scan_idx, trace_chars, regexp_matches(question, {_GEO}) as geo from sft_corpus where trace_chars is not null and trace_chars <= 12000),
    r as (select *, row_number() over (partition by geo order by trace_chars desc, scan_idx) as r from b), p as (select *, case when geo and r <= 30 then 0 when not geo then 1 else 2 end as p from r)
    select scan_idx, trace_chars, geo from p order by p, trace_chars desc, scan_idx limit 100""")
def long_trace_supplement(spark: SparkSession, d: str) -> DataFrame:
    """A hundred longest traces, three in ten of them on geometry."""
    c = corpus(spark, d, "scan_idx", "trace_chars", "question").where(F.col("trace_chars").isNotNull() & (F.col("trace_chars") <= fx.LONG_TRACE[1]))
    c = c.select("scan_idx", "trace_chars", tx.has(F.col("question"), fx.GEOMETRY).alias("geo"))
    return sampling.longest_with_share(c, F.col("geo"), 100, fx.GEOMETRY_SHARE, "trace_chars", "scan_idx")


@query()
def compose_multi_blank(spark: SparkSession, d: str) -> DataFrame:
    """Single-answer rows of a topic composed into questions of three parts, with combined reasoning and boxes."""
    r = F.coalesce("response", F.lit(""))
    c = corpus(spark, d, "scan_idx", "source_id", "topic", "question", "response", "weak_topic").where("topic is not null")
    b = tx.boxes(tx.final_section(r))
    c = c.where((F.size(b) == 1) & (F.length(r) <= fx.LONG_TRACE[1] / 3)).withColumn("box", b[0]).withColumn("why", tx.reasoning(r))
    parts = sampling.compose(c.withColumn("topic", F.lower(F.trim("topic"))), 3, "topic", "scan_idx")
    q = tx.pad_blanks(F.col("question"), F.lit(1))
    part = F.struct("_place", q.alias("q"), "box", "why", "source_id", "weak_topic")
    g = parts.groupBy("_group", "topic").agg(F.array_sort(F.collect_list(part)).alias("p"))
    label = lambda i: F.char(i + 97)
    question = F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("("), label(i), F.lit(") "), x["q"])), "\n\n")
    why = F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("### Part ("), label(i), F.lit(")\n"), x["why"])), "\n\n")
    return g.select(
        F.array_join(F.transform("p", lambda x: x["source_id"]), "+").alias("source_id"), "topic", question.alias("question"), tx.wrap_thinking(why, tx.boxed_line(F.transform("p", lambda x: x["box"]))).alias("response"),
        F.array_join(F.transform("p", lambda x: x["box"]), ", ").alias("answer"), F.size("p").alias("blank_count"), F.exists("p", lambda x: F.coalesce(x["weak_topic"], F.lit(False))).alias("weak_topic"), F.lit("composed").alias("supplement_mode"),
    )


_STRIPPED = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_WHY = f"""case when regexp_matches(response, {quoted(fx.OPEN_TAG)}) and regexp_matches(response, {quoted(fx.CLOSE_TAG)}) then {_STRIPPED.format(f"regexp_extract(response, {quoted('(?s)' + fx.OPEN_TAG + '(.*?)' + fx.CLOSE_TAG)}, 1)")}
    else {_STRIPPED.format(f"regexp_extract({_STRIPPED.format('response')}, '(?s)^(.*)' || chr(10) || '[^' || chr(10) || ']*$', 1)")} end"""


@query(f"""with r as (select scan_idx, {_STRIPPED.format('question')} as q, len(regexp_extract_all(question, '\\[ANS\\]')) as n, regexp_extract_all({_TAIL}, {quoted(fx.ANY_BOX_3)}, 1) as b, {_WHY} as why from sft_corpus)
    select scan_idx, case when n >= len(b) then q else q || (case when q = '' then '' else chr(10) || chr(10) end) || array_to_string(list_transform(range(len(b) - n), lambda x: 'Answer: [ANS]'), chr(10)) end as question,
        '<think>' || chr(10) || (case when why <> '' then why || chr(10) else '' end) || '</think>' || chr(10) || chr(10) || array_to_string(list_transform(b, lambda x: '\\boxed{{' || x || '}}'), ', ') as response,
        array_to_string(b, ', ') as answer, len(b) as blank_count, 'native' as supplement_mode from r where len(b) between 2 and 4""")
def native_multi_blank(spark: SparkSession, d: str) -> DataFrame:
    """Rows that end on two to four boxes, rewritten with as many blanks and one final line."""
    r = F.coalesce("response", F.lit(""))
    c = corpus(spark, d, "scan_idx", "question", "response").withColumn("b", tx.boxes(tx.final_section(r))).where(F.size("b").between(2, 4))
    return c.select(
        "scan_idx", tx.pad_blanks(F.col("question"), F.size("b")).alias("question"), tx.wrap_thinking(tx.reasoning(F.col("response")), tx.boxed_line(F.col("b"))).alias("response"),
        F.array_join("b", ", ").alias("answer"), F.size("b").alias("blank_count"), F.lit("native").alias("supplement_mode"),
    )


@query()
def option_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Multiple-choice rows widened to ten options by wrong options of their topic, in md5 order, with the letter moved along.

    The distinct wrong options of a topic are numbered, and each row draws ten of the numbers (all
    if there are fewer), each set as likely as any other.  Ten are enough whichever of them are
    the row's own options, so no row meets all options of a large topic, yet it may get any.
    """
    c = corpus(spark, d, "scan_idx", "topic", "options", "answer").where(tx.is_mcq(F.col("options"))).withColumn("topic", F.lower(F.trim(F.coalesce("topic", F.lit("")))))
    at = F.ascii("answer") - 65
    c = c.where((F.length("answer") == 1) & at.between(0, F.size("options") - 1)).withColumn("gold", F.element_at("options", (at + 1).cast("int")))
    wrong = c.select("topic", F.explode(F.array_except("options", F.array("gold"))).alias("o")).where("o is not null").distinct()
    pool = sampling.numbered(wrong, ["topic"], "o").select("topic", "o", F.col("_number").alias("number"))
    rows = c.where(F.size("options") < 10).select("scan_idx", "topic").join(wrong.groupBy("topic").agg(F.count("*").alias("n")), "topic")
    drawn = rows.select("scan_idx", "topic", F.explode(sampling.draw(F.col("scan_idx"), F.col("n"), 10)).alias("number")).join(pool, ["topic", "number"])
    e = c.join(drawn.groupBy("scan_idx").agg(F.collect_list("o").alias("pool")), "scan_idx", "left")
    by_key = lambda x: F.md5(F.concat(F.col("scan_idx").cast("string"), F.lit(":"), x))
    order = lambda a: F.transform(F.array_sort(F.transform(a, lambda x: F.struct(by_key(x).alias("k"), x.alias("o")))), lambda s: s["o"])
    more = F.slice(order(F.array_except(F.coalesce("pool", F.array().cast("array<string>")), "options")), 1, F.greatest(F.lit(0), 10 - F.size("options")))
    e = e.withColumn("expanded", order(F.array_distinct(F.concat("options", more))))
    return e.select("scan_idx", F.size("options").alias("original_n_options"), F.size("expanded").alias("expanded_to"), F.array_join("expanded", " | ").alias("options"), F.char(F.array_position("expanded", F.col("gold")) + 64).alias("answer"))


@query(f"select scan_idx, row_number() over (order by {_u('scan_idx', 3)}, scan_idx) as place from sft_corpus order by place limit 20")
def spot_check(spark: SparkSession, d: str) -> DataFrame:
    """Twenty rows at random, in order."""
    c = corpus(spark, d, "scan_idx").withColumn("u", tx.uniform(F.col("scan_idx"), 3)).orderBy("u", "scan_idx").limit(20)
    s = c.agg(F.array_sort(F.collect_list(F.struct("u", "scan_idx"))).alias("s"))
    return s.select(F.posexplode("s").alias("p", "x")).select("x.scan_idx", (F.col("p") + 1).cast("bigint").alias("place"))


@query(f"""with {ITEMS}, v(variant, prefix) as (values ('plain', ''), ('careful', 'Work carefully. '), ('brief', 'Be brief. ')) select id, variant, length(prefix || question) as chars from items, v""")
def prompt_variants(spark: SparkSession, d: str) -> DataFrame:
    """Every item under each of three prompt variants: a generator over the fixed list, no join."""
    v = F.array(*[F.struct(F.lit(a).alias("variant"), F.lit(b).alias("prefix")) for a, b in (("plain", ""), ("careful", "Work carefully. "), ("brief", "Be brief. "))])
    return items(spark, d).select("id", "question", F.explode(v).alias("v")).select("id", "v.variant", F.length(F.concat("v.prefix", "question")).cast("bigint").alias("chars"))


@query(f"""with u as (select doc_id, {_u('doc_id', 42)} as u from documents) select round(avg(u), 6) as mean, count(*) filter (where u < 0.1) as tenth, count(*) as n from u""")
def uniform_check(spark: SparkSession, d: str) -> DataFrame:
    """The portable uniform numbers of all documents, summed up."""
    u = table(spark, d, "documents", "doc_id").select(tx.uniform(F.col("doc_id"), 42).alias("u"))
    return u.agg(F.round(F.avg("u"), 6).alias("mean"), F.count_if(F.col("u") < 0.1).alias("tenth"), F.count("*").alias("n"))


QUERIES, SQL = query.queries, query.sql
