"""Field limits of runs whose greatest length is not the limit."""

from tallgrass.llm import pairs


def test_limit_below_the_greatest_length(spark):
    rows = [("bytes", "é" * (n % 3) + "x" * (200 + 5 * n)) for n in range(40)] + [("bytes", "é" * 8 + "x" * 496)] * 2
    rows += [("bytes", "é" * 20 + "x" * 472)] * 12 + [("bytes", "é" * 21 + "x" * 472)]  # 512 bytes in 492 characters, one row beyond
    rows += [("free", "x" * (100 + 7 * n)) for n in range(60)] + [("free", "yes")] * 20  # short answers alike are no limit
    rows += [("steady", "x" * (300 + n // 6)) for n in range(60)]  # as many at each length
    df = spark.createDataFrame([(n, 1, t, r) for n, (t, r) in enumerate(rows)], "scan_idx bigint, id bigint, run_tag string, response string")
    got = {r._tag: (r._chars, r._bytes) for r in pairs.run_limits(df).collect()}
    assert got["bytes"][1] == 512 and got["free"] == (None, None) and got["steady"] == (None, None)
    at = {r.scan_idx for r in pairs.with_limits(df).where("_limit").collect()}
    assert at == {n for n, (t, r) in enumerate(rows) if t == "bytes" and 509 <= len(r.encode()) <= 512}
    # one byte short of the limit: cut within a character, or plain text that ends there by itself
    more = df.union(spark.createDataFrame([(900, 1, "bytes", "é" * 20 + "x" * 471), (901, 1, "bytes", "x" * 511)], df.schema))
    assert {r.scan_idx: (r._limit, r._at) for r in pairs.with_limits(more).where("scan_idx >= 900").collect()} == {900: (True, True), 901: (True, False)}
