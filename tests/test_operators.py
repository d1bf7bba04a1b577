"""Relational operators on small fixtures, nulls and ties among them."""

import math

from pyspark.sql import functions as F

from tallgrass.functions import text as tx
from tallgrass.operators import decontaminate, ranking, reject, sampling, voting


def test_reject_order_and_nulls(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id int, x int")
    tests = [("low", F.col("x") < 10), ("odd", F.col("id") % 2 == 1)]
    assert {r.reason: r.rows for r in reject.counts(df, tests).collect()} == {"low": 1, "odd": 1, "kept": 1}
    kept, dropped = reject.split(df, tests)
    assert [r.id for r in kept.collect()] == [2] and dropped.count() == 2
    assert {(r.id, r.reason) for r in reject.two_phase(df, tests[:1], tests[1:]).collect()} == {(1, "low"), (2, None), (3, "odd")}
    assert reject.counts(df.limit(0), tests).count() == 0


def test_overlap_key_and_decontamination(spark):
    long = "Find the least number of silent lanterns that the northern guild of Brell can carry home"
    items = spark.createDataFrame([(1, long + " in $3$ days"), (2, "short")], "id int, question string")
    rows = [(1, "FIND the least   number of silent lanterns that the northern guild of Brell can carry home in 3 days"), (2, "Intro. " + long + " in 3 days, please"), (3, "other text entirely, nothing to see here"), (4, "")]
    df = spark.createDataFrame(rows, "n int, question string")
    assert sorted(r.n for r in decontaminate.exact(df, items).collect()) == [2, 3, 4]
    small = {r.n: r.hit for r in decontaminate.containment(df, items).collect()}
    assert small == {1: True, 2: True, 3: False, 4: True}  # an empty key is in every prefix
    keep, decontaminate.SHIPPED = decontaminate.SHIPPED, 0
    try:
        assert {r.n: r.hit for r in decontaminate.containment(df, items).collect()} == small
    finally:
        decontaminate.SHIPPED = keep


def test_samples(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3 == 0).alias("hot"), F.when(F.col("id") < 5, "rare").otherwise("common").alias("s"))
    got = {r.s: r["count"] for r in sampling.stratified_fraction(df, ["s"], 0.1, "id").groupBy("s").count().collect()}
    assert got == {"rare": 1, "common": 99}
    p = sampling.proportional(df, "s", 100, "id")
    assert p.count() == 100 and p.where("s = 'rare'").count() <= 1 and sampling.proportional(df, "s", 5000, "id").count() == 1000
    w = sampling.weighted(df, 300, F.when(F.col("hot"), 50.0).otherwise(1.0), "id")
    assert w.count() == 300 and w.where("hot").count() > 200
    assert {r.id for r in sampling.reservoir(df, 50, "id").collect()} == {r.id for r in sampling.reservoir(df.repartition(7), 50, "id").collect()}
    q = sampling.quota(df, "s", {"rare": 3, "common": 7}, "id")
    assert sorted(r.id for r in q.collect()) == [0, 1, 2, 5, 6, 7, 8, 9, 10, 11]
    c = sampling.compose(df, 4, "s", "id")
    sizes = {r["count"] for r in c.groupBy("_group").count().collect()}
    assert sizes == {4} and c.select("id").distinct().count() == c.count()
    long = sampling.longest_with_share(df.withColumn("n", F.col("id")), F.col("hot"), 20, 0.3, "n", "id")
    assert long.count() == 20 and long.where("hot").count() == 6
    assert sampling.reservoir(df.limit(0), 5, "id").count() == 0 and sampling.quota(df.limit(0), "s", {"rare": 1}, "id").count() == 0


def test_null_strata(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(40)], "id int, s string")
    assert sampling.stratified_fraction(df, ["s"], 0.25, "id").count() == 10


def test_index_quantiles(spark):
    xs = [5, 1, 9, 9, 3, 7, 2, 8, 4, 6, 9]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x int")
    s, n = sorted(xs), len(xs)
    r = ranking.histogram_quantiles(df, "x", (0.25, 0.5, 0.95)).first()
    assert [r.p25, r.p50, r.p95] == [s[max(0, int(p * n) - 1)] for p in (0.25, 0.5, 0.95)]
    r = ranking.histogram_quantiles(df, "x", (0.5, 0.95), lower=False).first()
    assert [r.p50, r.p95] == [s[min(n - 1, int(p * n))] for p in (0.5, 0.95)]
    got = spark.range(1, 11).select(ranking.index_group(F.col("id"), F.lit(10)).alias("g")).groupBy("g").count().collect()
    assert sorted((r.g, r["count"]) for r in got) == [(0, 2), (1, 2), (2, 2), (3, 4)]


def test_votes(spark):
    rows = [(1, 0, "p", "A", 3), (1, 1, "p", "B", 2), (1, 2, "q", "B", 9), (1, 3, "p", None, 1), (2, 0, "p", "X", 5), (2, 1, "p", "Y", 5), (3, 0, "p", None, 4), (3, 1, "p", None, 2)]
    df = spark.createDataFrame(rows, "id int, at int, prompt string, answer string, size int").withColumn("text", F.concat(F.lit("t"), "size"))
    got = {r.id: (r.answer, r.votes, r.score, r.trace) for r in voting.majority(df, "id", "answer", "prompt", "at", ["size"], "text").collect()}
    assert got == {1: ("B", 2, 3.0, "t2"), 2: ("X", 1, 1.5, "t5"), 3: (None, 0, 0.0, "t2")}
    assert {r.id: r.answer for r in voting.plain_majority(df, "id", "answer", "at").collect()} == {1: "B", 2: "X"}


def test_text_functions(spark):
    rows = [("a \\boxed{c} </think>\nfinal \\boxed{\\frac{1}{2}}\n \n", ["x", "y", "z"]), ("B or D", None), (None, []), ("", ["(A) one"])]
    df = spark.createDataFrame(rows, "r string, o array<string>")
    got = df.select(
        tx.letter(F.coalesce("r", F.lit(""))).alias("letter"), tx.last_line(F.coalesce("r", F.lit(""))).alias("last"), tx.is_mcq(F.col("o")).alias("mcq"), F.size(tx.boxes(F.coalesce("r", F.lit("")))).alias("n"),
        tx.emits_letter(F.coalesce("r", F.lit("")), F.col("o")).alias("emits"),
    ).collect()
    assert [tuple(r) for r in got] == [("C", "final \\boxed{\\frac{1}{2}}", True, 2, True), ("D", "B or D", False, 0, False), ("", "", False, 0, False), ("", "", True, 0, False)]
    one = spark.createDataFrame([("Sum? [ANS]", 3)], "q string, n int").select(tx.pad_blanks(F.col("q"), F.col("n")).alias("p")).first().p
    assert one == "Sum? [ANS]\n\nAnswer: [ANS]\nAnswer: [ANS]"
    tie = spark.createDataFrame([("a matrix and complex things",), ("nothing",)], "q string").select(tx.topic(F.col("q")).alias("t")).collect()
    assert [r.t for r in tie] == ["linear algebra", "other"]
    us = [r.u for r in spark.range(2000).select(tx.uniform(F.col("id"), 1).alias("u")).collect()]
    assert 0 <= min(us) and max(us) < 1 and math.isclose(sum(us) / len(us), 0.5, abs_tol=0.03)


def test_blank_labels_and_prompts(spark):
    df = spark.createDataFrame([("Q [ANS] and [ANS]", None), ("Q", [" a ", "b"]), ("Q", [])], "q string, o array<string>")
    q, o = F.col("q"), F.col("o")
    rows = df.select(tx.blank_count(q, o).alias("n"), tx.prompt_mode(q, o).alias("m"), tx.prompt_user(q, o).alias("u"), tx.multi_blank_user(q, o).alias("w")).collect()
    assert [(r.n, r.m) for r in rows] == [(2, "multi-blank/exact_v1"), (None, "mcq/exact_v1"), (1, "single-blank/exact_v1")]
    assert rows[1].u == "Q\n\nOptions:\nA. a\nB. b" and rows[0].w.endswith("in order: \\boxed{...}, \\boxed{...}") and rows[2].w == "Q"
    labels = [r.l for r in spark.createDataFrame([(1,), (5,), (6,), (11,)], "n int").select(tx.blank_label(F.col("n")).alias("l")).collect()]
    assert labels == ["1", "5", "6-10", "11+"]
