"""Evaluation reports: accuracy by slice, watch sets, flips between runs, solvability, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.functions import fixed_values as fx
from tallgrass.functions import text as tx
from tallgrass.plans.base import ACC, GRADED, accuracy, graded, items
from tallgrass.plans.corpus import _topic_sql
from tallgrass.plans.registry import Registry
from tallgrass.sources.tables import table

query = Registry()
OLD, NEW = "pub-101", "pub-103"


@query(f"with {GRADED} select run, count(*) as n, count(*) filter (where correct) as n_correct, round({ACC}, 6) as pct from graded group by run")
def accuracy_by_run(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of every run."""
    return graded(spark, d).groupBy("run").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.round(accuracy(), 6).alias("pct"))


@query(f"""with {GRADED} select case when grouping(is_mcq) = 1 then 'overall' when is_mcq then 'mcq' else 'freeform' end as slice, case when grouping(many) = 1 then 'any' when many then 'multi' else 'single' end as blanks,
    count(*) as n, round({ACC}, 6) as pct from (select *, n_gold > 1 as many from graded) group by grouping sets ((), (is_mcq), (is_mcq, many))""")
def accuracy_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy overall, by kind of question and by number of answers: one rollup."""
    g = graded(spark, d).withColumn("many", F.col("n_gold") > 1).rollup("is_mcq", "many")
    out = g.agg(F.count("*").alias("n"), F.round(accuracy(), 6).alias("pct"), F.grouping("is_mcq").alias("a"), F.grouping("many").alias("b"))
    kind = F.when(F.col("a") == 1, "overall").when(F.col("is_mcq"), "mcq").otherwise("freeform")
    return out.select(kind.alias("slice"), F.when(F.col("b") == 1, "any").when(F.col("many"), "multi").otherwise("single").alias("blanks"), "n", "pct")


@query(f"with {GRADED} select n_gold, count(*) as n, round({ACC}, 6) as pct from graded where not is_mcq group by 1")
def accuracy_by_blanks(spark: SparkSession, d: str) -> DataFrame:
    """Free-form accuracy by number of answers."""
    return graded(spark, d).where("not is_mcq").groupBy("n_gold").agg(F.count("*").alias("n"), F.round(accuracy(), 6).alias("pct")).withColumn("n_gold", F.col("n_gold").cast("bigint"))


@query(f"""with {GRADED} select label, count(*) as n, min(n_gold) as from_n, round({ACC}, 6) as pct from (
    select *, case when n_gold <= 5 then cast(n_gold as varchar) when n_gold <= 10 then '6-10' else '11+' end as label from graded) group by label""")
def accuracy_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy by blank label, with an order key."""
    g = graded(spark, d).withColumn("label", tx.blank_label(F.col("n_gold")))
    return g.groupBy("label").agg(F.count("*").alias("n"), F.min("n_gold").cast("bigint").alias("from_n"), F.round(accuracy(), 6).alias("pct"))


@query(f"""with {GRADED}, w as (select name, unnest(ids) as id from watch_sets)
    select name, run, count(*) as n, count(*) filter (where correct) as n_correct, round({ACC}, 6) as pct from (select distinct name, id from w) join graded using (id) group by name, run""")
def watch_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of each run on each watch set."""
    w = table(spark, d, "watch_sets", "name", "ids").select("name", F.explode("ids").alias("id")).distinct()
    return graded(spark, d).join(w, "id").groupBy("name", "run").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.round(accuracy(), 6).alias("pct"))


@query(f"with {GRADED} select run, id, correct from graded where id in (select unnest(ids) from watch_sets where name = 'multi_blank')")
def watch_filter(spark: SparkSession, d: str) -> DataFrame:
    """Results on one watch set: a semi join."""
    w = table(spark, d, "watch_sets", "name", "ids").where("name = 'multi_blank'").select(F.explode("ids").alias("id"))
    return graded(spark, d).join(w, "id", "left_semi").select("run", "id", "correct")


def paired(spark: SparkSession, d: str) -> DataFrame:
    """Two runs side by side."""
    g = graded(spark, d)
    a = g.where(F.col("run") == OLD).select("id", "is_mcq", "n_gold", F.col("correct").alias("was"), F.col("chars").alias("chars_was"))
    b = g.where(F.col("run") == NEW).select("id", F.col("correct").alias("is"), F.col("chars").alias("chars_is"))
    return a.join(b, "id")


PAIRED = f"""{GRADED}, paired as (select a.id, a.is_mcq, a.n_gold, a.correct as was, a.chars as chars_was, b.correct as "is", b.chars as chars_is
    from (select * from graded where run = '{OLD}') a join (select * from graded where run = '{NEW}') b using (id))"""
_FLIP_SQL = """count(*) as n, count(*) filter (where not was and "is") as gained, count(*) filter (where was and not "is") as lost,
    count(*) filter (where not was and "is") - count(*) filter (where was and not "is") as net, count(*) filter (where was and "is") as both_right, count(*) filter (where not was and not "is") as both_wrong"""


def flips() -> list[F.Column]:
    """Counts of answers gained and lost between two runs."""
    was, now = F.col("was"), F.col("is")
    return [
        F.count("*").alias("n"), F.count_if(~was & now).alias("gained"), F.count_if(was & ~now).alias("lost"), (F.count_if(~was & now) - F.count_if(was & ~now)).alias("net"),
        F.count_if(was & now).alias("both_right"), F.count_if(~was & ~now).alias("both_wrong"),
    ]


@query(f"with {PAIRED} select {_FLIP_SQL} from paired")
def flip_summary(spark: SparkSession, d: str) -> DataFrame:
    """Items gained and lost between two runs."""
    return paired(spark, d).agg(*flips())


@query(f"with {PAIRED} select case when is_mcq then 'mcq' else 'freeform' end as slice, {_FLIP_SQL} from paired group by 1")
def flip_by_slice(spark: SparkSession, d: str) -> DataFrame:
    """The same by kind of question."""
    return paired(spark, d).groupBy(F.when(F.col("is_mcq"), "mcq").otherwise("freeform").alias("slice")).agg(*flips())


@query(f"""with {PAIRED} select id, chars_was, chars_is, chars_is - chars_was as delta, case when chars_was = 0 then 0.0 else round(100.0 * (chars_is - chars_was) / chars_was, 6) end as pct from paired where not "is" order by pct, id limit 8""")
def trace_collapse(spark: SparkSession, d: str) -> DataFrame:
    """The eight wrong items whose response shrank most."""
    p = paired(spark, d).where("not is").select("id", F.col("chars_was").cast("bigint"), F.col("chars_is").cast("bigint"))
    pct = F.coalesce(F.round(F.try_divide(F.lit(100.0) * (F.col("chars_is") - F.col("chars_was")), F.col("chars_was")), 6), F.lit(0.0))
    return p.withColumn("delta", F.col("chars_is") - F.col("chars_was")).withColumn("pct", pct).orderBy("pct", "id").limit(8)


TOPICS = f"topics as (select id, {_topic_sql('question')} as topic from items)"


def by_topic(spark: SparkSession, d: str, run: str) -> DataFrame:
    """Accuracy of a run by topic."""
    t = items(spark, d).select("id", tx.topic(F.col("question")).alias("topic"))
    g = graded(spark, d).where(F.col("run") == run).join(t, "id").groupBy("topic")
    mcq = F.count_if("is_mcq")
    return g.agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.round(accuracy(), 2).alias("pct"), mcq.alias("mcq_n"), F.round(F.lit(100.0) * F.count_if(F.col("is_mcq") & F.col("correct")) / F.nullif(mcq, F.lit(0)), 2).alias("mcq_pct"))


_BY_TOPIC = f"""select topic, count(*) as n, count(*) filter (where correct) as n_correct, round({ACC}, 2) as pct, count(*) filter (where is_mcq) as mcq_n,
    round(100.0 * count(*) filter (where is_mcq and correct) / nullif(count(*) filter (where is_mcq), 0), 2) as mcq_pct from graded join topics using (id) where run = '%s' group by topic"""


@query(f"with {GRADED}, {TOPICS} {_BY_TOPIC % NEW}")
def topic_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy by topic, and that of its multiple-choice questions where it has any."""
    return by_topic(spark, d, NEW)


@query(f"with {GRADED}, {TOPICS}, a as ({_BY_TOPIC % OLD}), b as ({_BY_TOPIC % NEW}) select topic, a.pct as pct_old, b.pct as pct_new, round(b.pct - a.pct, 1) as delta from a join b using (topic)")
def topic_delta(spark: SparkSession, d: str) -> DataFrame:
    """Change of accuracy by topic between two runs."""
    a, b = (by_topic(spark, d, r).select("topic", F.col("pct").alias(c)) for r, c in ((OLD, "pct_old"), (NEW, "pct_new")))
    return a.join(b, "topic").withColumn("delta", F.round(F.col("pct_new") - F.col("pct_old"), 1))


@query(f"""with {GRADED}, {TOPICS}, t as (select topic, count(*) as items_n from topics group by 1), w as (select topic, count(*) as wrong from graded join topics using (id) where run = '{NEW}' and not correct group by 1)
    select topic, items_n, coalesce(wrong, 0) as wrong, round(100.0 * coalesce(wrong, 0) / items_n, 4) as error_rate from t left join w using (topic)""")
def topic_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """Wrong answers of a run over all items of a topic, answered or not."""
    t = items(spark, d).select("id", tx.topic(F.col("question")).alias("topic"))
    wrong = graded(spark, d).where((F.col("run") == NEW) & ~F.col("correct")).join(t, "id").groupBy("topic").agg(F.count("*").alias("wrong"))
    out = t.groupBy("topic").agg(F.count("*").alias("items_n")).join(wrong, "topic", "left").fillna(0, ["wrong"])
    return out.withColumn("error_rate", F.round(F.lit(100.0) * F.col("wrong") / F.col("items_n"), 4))


@query(f"""with {GRADED}, s as (select i.id, coalesce(len(options), 0) > 0 as is_mcq, count(correct) as k, count(*) filter (where correct) as c from items i left join graded g on g.id = i.id group by 1, 2)
    select case when is_mcq then 'mcq' else 'freeform' end as kind, case when c = 0 then 'never' when c = k then 'reliable' else 'unstable' end as state, count(*) as n from s group by 1, 2""")
def solvability(spark: SparkSession, d: str) -> DataFrame:
    """Items that no, some or every run solves; an item without samples is never solved."""
    i = items(spark, d).select("id", tx.is_mcq(F.col("options")).alias("mcq"))
    s = i.join(graded(spark, d).select("id", "correct"), "id", "left").groupBy("id", "mcq").agg(F.count("correct").alias("k"), F.count_if("correct").alias("c"))
    state = F.when(F.col("c") == 0, "never").when(F.col("c") == F.col("k"), "reliable").otherwise("unstable")
    return s.groupBy(F.when(F.col("mcq"), "mcq").otherwise("freeform").alias("kind"), state.alias("state")).agg(F.count("*").alias("n"))


@query(f"""with {GRADED}, f as (select id, min(run) as run from graded where correct group by id)
    select run, count(*) as newly, cast(sum(count(*)) over (order by run) as bigint) as solved from f group by run""")
def marginal_unlock(spark: SparkSession, d: str) -> DataFrame:
    """Items first solved by each run in order, and how many are solved by then."""
    first = graded(spark, d).where("correct").groupBy("id").agg(F.min("run").alias("run"))
    c = first.groupBy("run").agg(F.count("*").alias("newly"))
    return c.withColumn("solved", F.sum("newly").over(Window.orderBy("run")))


@query(f"""with {GRADED}, a as (select distinct id from graded where run = 'sft-301' and correct), b as (select distinct id from graded where run = '{OLD}' and correct)
    select (select count(*) from (select id from a intersect select id from b)) as both_n, (select count(*) from (select id from a except select id from b)) as only_a, (select count(*) from (select id from b except select id from a)) as only_b,
    (select count(*) from (select id from a union select id from b)) as any_n""")
def solved_sets(spark: SparkSession, d: str) -> DataFrame:
    """Items solved by both of two runs, by one only, by any: intersect, except and union."""
    g = graded(spark, d).where("correct").select("run", "id")
    a, b = (g.where(F.col("run") == r).select("id").distinct() for r in ("sft-301", OLD))
    parts = {"both_n": a.intersect(b), "only_a": a.subtract(b), "only_b": b.subtract(a), "any_n": a.union(b).distinct()}
    long = None
    for k, v in parts.items():
        one = v.select(F.lit(k).alias("k"))
        long = one if long is None else long.unionByName(one)
    return long.agg(*[F.count_if(F.col("k") == k).alias(k) for k in parts])


@query(f"with {GRADED} select count(*) as n from (select id from graded where run = 'sft-301') a join (select id from graded where run = '{OLD}') b using (id) join items using (id)")
def three_way(spark: SparkSession, d: str) -> DataFrame:
    """Items that two runs and the item table share."""
    g = graded(spark, d).select("run", "id")
    a, b = (g.where(F.col("run") == r).select("id") for r in ("sft-301", OLD))
    return a.join(b, "id").join(items(spark, d).select("id"), "id").agg(F.count("*").alias("n"))


_BUCKET = "case when opened and not closed then 'truncated' when n_boxes <> n_gold then 'misformat' when is_mcq then 'clean_mcq' else 'clean_freeform' end"


def bucket() -> F.Column:
    """Risk bucket of a response."""
    return F.when(F.col("opened") & ~F.col("closed"), "truncated").when(F.col("n_boxes") != F.col("n_gold"), "misformat").when(F.col("is_mcq"), "clean_mcq").otherwise("clean_freeform")


@query(f"with {GRADED} select {_BUCKET} as bucket, count(*) as n, round({ACC}, 6) as pct from graded group by 1")
def risk_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Rows and accuracy by risk bucket."""
    return graded(spark, d).groupBy(bucket().alias("bucket")).agg(F.count("*").alias("n"), F.round(accuracy(), 6).alias("pct"))


@query(f"""with {GRADED}, l as (select {_BUCKET} as bucket, {ACC} as rate from graded where run = '{OLD}' group by 1), m as (select {_BUCKET} as bucket, count(*) as n from graded where run = '{NEW}' group by 1),
    o as (select {ACC} as observed from graded where run = '{NEW}'), w as (select {ACC} as labelled from graded where run = '{OLD}'), x as (select sum(n * coalesce(rate, 0)) / sum(n) as expected from m left join l using (bucket))
    select round(expected, 6) as expected, round(observed, 6) as observed, round(observed - expected, 6) as residual, round(labelled - expected, 6) as drag from x, o, w""")
def gap_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """Score a run should have by another run's bucket rates and its own bucket mix, and what is left."""
    g = graded(spark, d).withColumn("bucket", bucket())
    rates = g.where(F.col("run") == OLD).groupBy("bucket").agg(accuracy().alias("rate"), F.count("*").alias("n_old"), F.count_if("correct").alias("c_old"))
    mix = g.where(F.col("run") == NEW).groupBy("bucket").agg(F.count("*").alias("n_new"), F.count_if("correct").alias("c_new"))
    both = mix.join(rates, "bucket", "full")
    total = lambda a, b: F.lit(100.0) * F.sum(a) / F.nullif(F.sum(b), F.lit(0))
    one = both.agg((F.sum(F.coalesce("n_new", F.lit(0)) * F.coalesce("rate", F.lit(0.0))) / F.sum("n_new")).alias("e"), total("c_new", "n_new").alias("o"), total("c_old", "n_old").alias("l"))
    return one.select(F.round("e", 6).alias("expected"), F.round("o", 6).alias("observed"), F.round(F.col("o") - F.col("e"), 6).alias("residual"), F.round(F.col("l") - F.col("e"), 6).alias("drag"))


@query(f"""with {GRADED}, t as (select count(*) as n, count(*) filter (where correct) as c, count(*) filter (where {_BUCKET} = 'truncated') as truncated, count(*) filter (where {_BUCKET} = 'misformat') as misformat from graded)
    select n, round(100.0 * c / n, 6) as pct, round(100.0 * (c + 0.5 * truncated) / n, 6) as pct_half_truncated, round(100.0 * (c + misformat) / n, 6) as pct_all_misformat from t""")
def opportunity(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy if half the truncated, or all the misformatted, responses were right."""
    b = graded(spark, d).withColumn("bucket", bucket())
    t = b.agg(F.count("*").alias("n"), F.count_if("correct").alias("c"), F.count_if(F.col("bucket") == "truncated").alias("t"), F.count_if(F.col("bucket") == "misformat").alias("m"))
    pct = lambda x: F.round(F.lit(100.0) * x / F.col("n"), 6)
    return t.select("n", pct(F.col("c")).alias("pct"), pct(F.col("c") + 0.5 * F.col("t")).alias("pct_half_truncated"), pct(F.col("c") + F.col("m")).alias("pct_all_misformat"))


@query(f"""with {GRADED} select run, count(*) as n, round({ACC}, 6) as pct, round(196.0 * sqrt(avg(correct::int) * (1 - avg(correct::int)) / count(*)), 6) as half_width from graded group by run""")
def noise_band(spark: SparkSession, d: str) -> DataFrame:
    """Half-width of the 95 % interval of each run's accuracy, in points."""
    p = F.avg(F.col("correct").cast("int"))
    return graded(spark, d).groupBy("run").agg(F.count("*").alias("n"), F.round(accuracy(), 6).alias("pct"), F.round(F.lit(196.0) * F.sqrt(p * (F.lit(1) - p) / F.count("*")), 6).alias("half_width"))


@query(f"""with {GRADED}, s as (select run, {ACC} as overall, coalesce(100.0 * count(*) filter (where correct and is_mcq) / nullif(count(*) filter (where is_mcq), 0), 0.0) as mcq, avg(chars) as mean_chars from graded group by run), b as (select mean_chars as base from s where run = '{OLD}')
    select run, round(overall, 6) as overall, round(mcq, 6) as mcq, overall >= {fx.GATE_OVERALL} and mcq >= {fx.GATE_MCQ} as passed, (mean_chars - base) / base < -0.2 as collapsed from s, b""")
def eval_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether each run passes the gates, and whether its responses collapsed against the old run's length."""
    mcq = F.coalesce(F.lit(100.0) * F.count_if(F.col("correct") & F.col("is_mcq")) / F.nullif(F.count_if("is_mcq"), F.lit(0)), F.lit(0.0))
    s = graded(spark, d).groupBy("run").agg(accuracy().alias("o"), mcq.alias("m"), F.avg("chars").alias("c"))
    base = F.max(F.when(F.col("run") == OLD, F.col("c"))).over(Window.partitionBy())
    s = s.withColumn("base", base)
    return s.select("run", F.round("o", 6).alias("overall"), F.round("m", 6).alias("mcq"), ((F.col("o") >= fx.GATE_OVERALL) & (F.col("m") >= fx.GATE_MCQ)).alias("passed"), ((F.col("c") - F.col("base")) / F.col("base") < -0.2).alias("collapsed"))


@query(f"""with {PAIRED}, s as (select is_mcq, 100.0 * avg("is"::int) - 100.0 * avg(was::int) as gain from paired group by 1), o as (select 100.0 * avg("is"::int) - 100.0 * avg(was::int) as gain from paired)
    select round(o.gain, 6) as gain, round(min(s.gain), 6) as worst, o.gain >= {fx.SHIP_GAIN} and min(s.gain) >= -{fx.SHIP_LOSS} as ship from o, s group by o.gain""")
def ship_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether a run gains enough overall and loses too much in no slice."""
    point = lambda c: F.avg(F.col(c).cast("int")) * 100.0
    s = paired(spark, d).groupBy("is_mcq").agg((point("is") - point("was")).alias("gain"), F.count("*").alias("n"), F.count_if("is").alias("a"), F.count_if("was").alias("b"))
    one = s.agg((F.lit(100.0) * F.sum("a") / F.sum("n") - F.lit(100.0) * F.sum("b") / F.sum("n")).alias("g"), F.min("gain").alias("w"))
    return one.select(F.round("g", 6).alias("gain"), F.round("w", 6).alias("worst"), ((F.col("g") >= fx.SHIP_GAIN) & (F.col("w") >= -fx.SHIP_LOSS)).alias("ship"))


@query(f"""with {GRADED} select run, case when correct then 'right' when all_boxes = 0 then 'no_box' when is_mcq then 'wrong_letter' when n_boxes <> n_gold then 'count_mismatch' else 'value' end as step, count(*) as n from graded group by 1, 2""")
def error_walk(spark: SparkSession, d: str) -> DataFrame:
    """First cause of each wrong answer, by run."""
    step = F.when(F.col("correct"), "right").when(F.col("all_boxes") == 0, "no_box").when(F.col("is_mcq"), "wrong_letter").when(F.col("n_boxes") != F.col("n_gold"), "count_mismatch").otherwise("value")
    return graded(spark, d).groupBy("run", step.alias("step")).agg(F.count("*").alias("n"))


@query(f"""with {GRADED} select id, coalesce(max(correct::int) filter (where run = '{OLD}'), -1) as first_pass, coalesce(max(correct::int) filter (where run = '{NEW}'), -1) as second_pass,
    coalesce(max(correct::int) filter (where run = '{NEW}' and all_boxes > 0), max(correct::int) filter (where run = '{OLD}'), -1) as kept from graded where run in ('{OLD}', '{NEW}') group by id""")
def two_pass(spark: SparkSession, d: str) -> DataFrame:
    """Second pass where it has a box, else the first; -1 for a pass that is missing."""
    c = F.col("correct").cast("int")
    old, new = F.col("run") == OLD, F.col("run") == NEW
    g = graded(spark, d).where(old | new).groupBy("id")
    no = F.lit(-1)
    first, second, boxed = F.max(F.when(old, c)), F.max(F.when(new, c)), F.max(F.when(new & (F.col("all_boxes") > 0), c))
    return g.agg(F.coalesce(first, no).alias("first_pass"), F.coalesce(second, no).alias("second_pass"), F.coalesce(boxed, first, no).alias("kept"))


QUERIES, SQL = query.queries, query.sql
