"""Short texts inside texts, index slices, unparsed fields, blanks in CSV, keys of streams."""

import random

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import text as tx
from tallgrass.operators import decontaminate, packed_values, ranking
from tallgrass.session import scratch
from tallgrass.sources import files
from tallgrass.streaming import incremental


def test_fragments_against_search():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 60))) for _ in range(30)]
    f = decontaminate.Fragments(texts)
    for _ in range(3000):
        t = rng.choice(texts)
        a = rng.randint(0, len(t))
        s = t[a : a + rng.randint(0, 20)] + rng.choice(["", "", "b"])
        assert f.has(s) == any(s in x for x in texts)
    assert not decontaminate.Fragments([]).has("a")


def test_containment_joined_and_shipped_alike(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9)))
    items = [" ".join(word() for _ in range(rng.choice((2, 3, 5, 9, 30)))) + rng.choice(["", " what is the number of these"]) for _ in range(60)]
    rows = [items[rng.randrange(60)][rng.randint(0, 3) : rng.randint(4, 80)] for _ in range(120)] + [word() + " " + rng.choice(items) + " " + word() for _ in range(60)] + ["", None, "a", "the number of", "x" * 500]
    df = spark.createDataFrame(list(enumerate(rows)), "n int, question string")
    protected = spark.createDataFrame([(i,) for i in items], "question string")
    want = {r.n: r.hit for r in decontaminate.containment(df, protected).collect()}
    for shipped in (0, 7):
        monkeypatch.setattr(decontaminate, "SHIPPED", shipped)
        assert {r.n: bool(r.hit) for r in decontaminate.containment(df, protected).collect()} == {k: bool(v) for k, v in want.items()}
    assert sum(map(bool, want.values())) > 40


@pytest.mark.parametrize("n", [0, 1, 3, 4, 10, 41])
def test_index_slices_against_rows(spark, n):
    rng = random.Random(n)
    xs = sorted(rng.randint(1, 6) for _ in range(n))
    got = {r.grp: (r.n, r.least, r.most) for r in ranking.index_slices(spark.createDataFrame([(x,) for x in xs], "v int").groupBy("v").agg(F.count("*").alias("k")), "v", "k").collect()}
    size, want = max(n // 4, 1), {}
    for i, x in enumerate(xs):
        want.setdefault(min(i // size, 3), []).append(x)
    assert got == {g: (len(v), min(v), max(v)) for g, v in want.items()}


def test_unparsed_fields_come_out(spark):
    rows = [(1, "3, 4", 2), (2, "3, 4, 5", 2), (3, "7", 3), (4, None, 2), (5, "a; ; c", 3)]
    df = spark.createDataFrame(rows, "scan_idx bigint, answer string, n int")
    left = {r.scan_idx: (r.slots, r.found) for r in packed_values.unparsed(df, "answer", F.col("n")).collect()}
    whole = {r.scan_idx for r in packed_values.split_values(df, "answer", F.col("n")).collect()}
    assert set(left) | whole == {1, 2, 3, 5} and not set(left) & whole and left[3] == (3, 1)


def test_csv_keeps_blanks(spark, tmp_path):
    df = spark.createDataFrame([(1, "  a\t"), (2, "\tb \n"), (3, "c")], "id bigint, response string")
    files.write_long_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_long_csv(spark, str(tmp_path / "c"), df.schema).collect())) == [(1, "  a\t"), (2, "\tb \n"), (3, "c")]


def test_scratch_is_deleted(spark):
    with scratch(spark) as folder:
        spark.range(3).write.parquet(f"{folder}/x")
        assert files.exists(spark, f"{folder}/x")
    assert not files.exists(spark, folder)


def test_null_keys_come_once(spark, tmp_path):
    sink = incremental.append_new(str(tmp_path / "t"), ["run", "id"], "at")
    batch = spark.createDataFrame([("a", 1, 1), ("a", None, 2), ("a", None, 3), (None, 1, 4)], "run string, id int, at int")
    sink(batch, 0)
    sink(batch, 1)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_mix_buckets(spark):
    q = ["The triangle ABC", "A fair probability", "Find the sequence", "Solve x", "y" * 435]
    df = spark.createDataFrame([(x,) for x in q], "q string")
    assert [r[0] for r in df.select(tx.mix_bucket(F.col("q"))).collect()] == ["weak", "adjacent", "adjacent", "diverse", "weak"]
