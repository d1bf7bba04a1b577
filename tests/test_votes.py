"""The vote over every stored response on hand-made tables."""

import datetime

from tallgrass.plans import catalog

NOW = datetime.datetime(2026, 1, 1)


def tables(spark, d, items, responses):
    spark.createDataFrame(items, "id bigint, question string, options array<string>, answer array<string>, scan_idx bigint, updated_at timestamp").write.parquet(f"{d}/eval_items.parquet")
    spark.createDataFrame(responses, "scan_idx bigint, id bigint, run_tag string, response string, written_at timestamp").write.parquet(f"{d}/responses.parquet")


def test_every_sample_votes(spark, tmp_path):
    items = [(1, "Sum? [ANS]", None, ["7"], 0, NOW), (2, "Product? [ANS]", None, ["9"], 1, NOW), (3, "None? [ANS]", None, ["1"], 2, NOW)]
    said = [
        (1, "dev-1-sc5", "So \\boxed{7}"), (1, "DEV-1-sc5 ", "Thus it is \\boxed{7}"), (1, "dev-1-sc5", "Hence \\boxed{7}."), (1, "dev-1-sc5", "Then \\boxed{8}"), (1, "dev-1-sc5", "Then \\boxed{8}"), (1, "dev-1-sc5", "Then \\boxed{8}"),
        (1, "pub-1", "Then \\boxed{8}"), (2, "pub-1", "First \\boxed{9}"), (2, "pub-1", "Last \\boxed{5}"), (2, "pub-1", None),
    ]
    tables(spark, str(tmp_path), items, [(n, i, run, text, NOW) for n, (i, run, text) in enumerate(said)])
    got = {r.id: (r.answer, r.votes, r.prompts, r.score, r.trace_chars) for r in catalog.QUERIES["majority_vote"](spark, str(tmp_path)).collect()}
    # 7 has three samples of one family; 8 two once repeats of a run count once, but of two families
    assert got == {1: ("7", 3, 1, 3.5, 12), 2: ("9", 1, 1, 1.5, 15)}


def test_vote_without_broadcast(spark, tmp_path, monkeypatch):
    from tallgrass.plans import grading

    tables(spark, str(tmp_path), [(1, "Sum? [ANS]", None, ["7"], 0, NOW)], [(n, 1, "pub-1", f"{n} \\boxed{{{n % 2}}}", NOW) for n in range(5)])
    monkeypatch.setattr(grading, "SHIPPED", 0)
    assert [(r.answer, r.votes) for r in catalog.QUERIES["majority_vote"](spark, str(tmp_path)).collect()] == [("0", 3)]


def test_lenient_grade_of_all_runs(spark, tmp_path):
    tables(spark, str(tmp_path), [(1, "Sum? [ANS]", None, ["7"], 0, NOW)], [(0, 1, "pub-102", "\\boxed{7}", NOW), (1, 1, "dev-9", "\\boxed{8}", NOW), (2, 1, "x", "\\boxed{7}", NOW)])
    got = {r.run: (r.strict, r.lenient, r.n) for r in catalog.QUERIES["lenient_grade"](spark, str(tmp_path)).collect()}
    assert got == {"pub-102": (True, True, 1), "dev-9": (False, False, 1), "x": (True, True, 1)}
