"""Sampling plans on tables larger than any bound they once had."""

from pyspark.sql import functions as F

from tallgrass.operators import sampling
from tallgrass.plans import catalog


def test_draw(spark):
    got = spark.range(3000).select(F.col("id"), sampling.draw(F.col("id"), F.lit(25).cast("bigint"), 10).alias("a"), sampling.draw(F.col("id"), F.lit(7).cast("bigint"), 10).alias("b")).collect()
    assert all(len(set(r.a)) == 10 and set(r.a) <= set(range(25)) and r.b == list(range(7)) for r in got)
    times = [sum(n in r.a for r in got) for n in range(25)]
    assert 1050 < min(times) and max(times) < 1350


def test_numbered(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 2).alias("s"))
    got = sampling.numbered(df, ["s"], "id", seed=3).withColumn("u", sampling.uniform(F.col("id"), 3)).toPandas()
    assert len(got) == 5000
    for _, g in got.groupby("s", dropna=False):
        assert g.sort_values(["u", "id"])["_number"].tolist() == list(range(len(g))) and set(g["_size"]) == {len(g)}


def test_options_from_the_whole_topic(spark, tmp_path):
    rows = [(n, "algebra", [f"gold {n}", f"w{n}a", f"w{n}b", f"w{n}c"], "A") for n in range(400)]
    rows += [(400 + n, " Sets", [f"s{n}a", f"s{n}b", f"s{n}c"], "B") for n in range(4)] + [(404, "Sets", [f"x{n}" for n in range(11)], "C")]
    rows += [(405, "logic", ["p", "q"], "A"), (406, "logic", ["r", "q"], "A")]
    spark.createDataFrame(rows, "scan_idx bigint, topic string, options array<string>, answer string").write.parquet(f"{tmp_path}/sft_corpus.parquet")
    got = {r.scan_idx: r for r in catalog.QUERIES["option_expansion"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(407))
    used = set()
    for n, _, own, letter in rows:
        r, shown = got[n], got[n].options.split(" | ")
        assert r.original_n_options == len(own) and set(own) <= set(shown) and len(set(shown)) == len(shown) == r.expanded_to
        assert shown[ord(r.answer) - 65] == own[ord(letter) - 65]
        assert r.expanded_to == (max(10, len(own)) if n < 405 else 2)  # "q" is all that logic has
        if n < 400:
            used |= set(shown) - set(own)
    wrong = {f"w{n}{x}" for n in range(400) for x in "abc"}
    assert used <= wrong and len(used) > 0.8 * len(wrong)  # 2,400 draws of 1,200 options leave out 13 %


def test_compose_leaves_out_only_remainders(spark):
    n = {"large": 19_001, "small": 11, "tiny": 2, "few": 990}
    df = spark.createDataFrame([(t, k) for t, m in n.items() for k in range(m)], "t string, k int").withColumn("id", F.concat_ws(":", "t", "k"))
    got = sampling.compose(df, 3, "t", "id").withColumn("u", sampling.uniform(F.col("id"), 42)).toPandas()
    assert got.groupby("t")["_group"].nunique().to_dict() == {t: m // 3 for t, m in n.items() if m >= 3}
    assert set(got.groupby("_group")["_place"].agg(lambda x: tuple(sorted(x)))) == {(0, 1, 2)} and got["id"].is_unique
    for _, g in got.sort_values(["u", "id"]).groupby("t"):  # groups are runs of the random order
        assert g["_place"].tolist() == [0, 1, 2] * (len(g) // 3) and (g["_group"].to_numpy().reshape(-1, 3).T[0].repeat(3) == g["_group"]).all()
