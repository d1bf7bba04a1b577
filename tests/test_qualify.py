"""The qualification chain on rows made for each reason."""

from pyspark.sql import functions as F

from tallgrass.operators import qualify as q


def test_rewriting():
    assert q.ended_on_box("so \\boxed{1} and \\boxed{\\frac{1}{2}} done") == ("so \\boxed{1} and\n\\boxed{\\frac{1}{2}}", "\\frac{1}{2}")
    assert q.ended_on_box("none") == (None, None) and q.ended_on_box("\\boxed{3}") == ("\\boxed{3}", "3")
    assert q.reformatted("a b\n\\boxed{2}") == ("<think>\na b\n</think>\n\n\\boxed{2}", "2")
    assert q.reformatted("<think>\nwhy\n</think>\nIt is \\boxed{5}.") == ("<think>\nwhy\n</think>\n\n\\boxed{5}", "5")
    assert q.reformatted("<think>\nwhy \\boxed{6}\n</think>\n") == ("<think>\nwhy\n</think>\n\n\\boxed{6}", "6")
    assert q.reformatted("<think>x</think> y") == (None, None) and q.reformatted("") == (None, None)


def test_chain(spark):
    body = "word " * 500
    rows = [
        (1, "math", "Find x.", body + "\\boxed{1}", "0.5"), (2, "gsm8k", "Find x.", body + "\\boxed{1}", "0.5"), (3, "m", " ", body, "0.5"), (4, "m", "Q", None, "0.5"), (5, "m", "Q", body + "\\boxed{1}", "n/a"), (6, "m", "Q", body + "\\boxed{1}", "0.9"),
        (7, "m", "Q", "short \\boxed{1}", "0.5"), (8, "m", "求 x", body + "\\boxed{1}", "0.5"), (9, "m", "See the figure", body + "\\boxed{1}", "0.5"), (10, "m", "(A) 1 (B) 2 (C) 3", body + "\\boxed{1}", "0.5"), (11, "m", "Q", body, "0.5"),
        (12, "m", "The protected question about seven silent lamps on the pier", body + "\\boxed{1}", "0.5"), (13, "m", "Q2", body + "\\boxed{ }", "0.5"), (14, None, None, None, None),
    ]
    raw = spark.createDataFrame(rows, "id int, source string, problem string, solution string, pass_rate string")
    protected = spark.createDataFrame([("The protected question about seven silent lamps on the pier",)], "question string")
    rules = q.Rules(chars=(100, 5000), pass_rate=(0.05, 0.7), dropped_sources=("gsm8k",), inline_choices=True)
    got = {r.id: r.reason for r in q.qualify(raw, rules, protected).collect()}
    assert got == {
        1: None, 2: "dropped_source", 3: "empty_problem", 4: "empty_solution", 5: "pass_rate_out_of_range", 6: "pass_rate_out_of_range", 7: "response_length_out_of_range", 8: "cjk_text", 9: "figure_dependent", 10: "inline_mcq",
        11: "missing_boxed_hint", 12: "decontam", 13: "bad_format", 14: "empty_problem",
    }
    ready = q.qualify(raw, rules).where("reason is null").withColumn("task_type", F.lit("freeform")).withColumn("question", F.col("problem")).withColumn("template_tokens", F.lit(1))
    assert q.violations(ready).count() == 0 and q.qualify(raw.limit(0), rules, protected).count() == 0


def test_choices(spark):
    rows = [(1, "Q: Sum? Answer Choices: (A) 1", ["(A) 1", "(B) 2"], [1]), (2, "Q", [], [0]), (3, "Q", ["(A) ", "x"], [0]), (4, " ", ["1", "2"], [0]), (5, "Q", ["1", "2"], [5]), (6, "Q", ["1"], [0]), (7, "Known", ["1", "2"], [0]), (8, None, None, None)]
    raw = spark.createDataFrame(rows, "id int, query string, choices array<string>, gold array<int>")
    known = spark.createDataFrame([("known",)], "question string")
    got = {r.id: (r.reason, r.answer) for r in q.qualify_choices(raw, known, target=2).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: None, 2: "missing_choices", 3: "empty_choice_text", 4: "empty_problem", 5: "bad_gold_index", 6: "insufficient_distractors", 7: "public_overlap", 8: "missing_choices"}
    assert got[1][1] == "B"


def test_quotas(spark):
    df = spark.range(300).select(F.col("id"), F.when(F.col("id") % 10 == 0, "trig").when(F.col("id") % 2 == 0, "geo").otherwise("anchor").alias("b"))
    got = q.quota_corpus(df, "b", {"geo": 20, "trig": 50, "anchor": 30}, "id", "id", backfill="trig", donors=["geo"])
    sizes = {r.b: r["count"] for r in got.groupBy("b").count().collect()}
    assert sizes == {"geo": 20, "trig": 50, "anchor": 30} and got.select("id").distinct().count() == 100
    assert q.pool_then_sample(df, 10, "id", "id").where("id >= 50").count() == 0
    try:
        q.pool_then_sample(df.limit(3), 10, "id", "id")
        raise AssertionError
    except ValueError:
        pass
