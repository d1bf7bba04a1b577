"""Sources and sinks on whole tables: what is written to the shared folder is read back and summed up.

Each query writes, reads and measures at once, then deletes its folder; its result is a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.functions import text as tx
from tallgrass.plans.base import corpus
from tallgrass.plans.registry import Registry
from tallgrass.session import scratch
from tallgrass.sources import files
from tallgrass.sources.tables import table

query = Registry()
_ROW = T.StructType([T.StructField("scan_idx", T.LongType()), T.StructField("source", T.StringType()), T.StructField("question", T.StringType()), T.StructField("response", T.StringType())])
_TOTALS = "count(*) as rows, sum(scan_idx)::bigint as keys, sum(length(question))::bigint as question_chars, sum(length(response))::bigint as response_chars"


def _kept(df: DataFrame) -> DataFrame:
    """A small result, computed before its files go."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.sum("scan_idx").alias("keys"), F.sum(F.length("question")).alias("question_chars"), F.sum(F.length("response")).alias("response_chars"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d, "scan_idx", "source", "question", "response")


@query(f"select {_TOTALS} from sft_corpus")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The corpus as JSON lines and back under its schema."""
    with scratch(spark) as folder:
        files.write_jsonl(_rows(spark, d), f"{folder}/rows")
        return _kept(_totals(files.read_jsonl(spark, f"{folder}/rows", _ROW, strict=True)))


@query("""select count(*) as rows, count(distinct id) as ids, sum(len(answer))::bigint as answers, count(*) filter (where options is not null) as with_options from eval_items where answer is not null""")
def items_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Items as JSON lines whose single answers are strings, read as lists again."""
    t = table(spark, d, "eval_items", "id", "question", "options", "answer").where("answer is not null")
    one = F.when(F.size("answer") == 1, F.to_json(F.struct(F.col("answer")[0].alias("answer")))).otherwise(F.to_json(F.struct("answer")))
    rest = F.to_json(F.struct("id", "question", "options"))
    line = F.concat(F.expr("substring(_rest, 1, length(_rest) - 1)"), F.lit(","), F.expr("substring(_one, 2)"))
    with scratch(spark) as folder:
        t.select(rest.alias("_rest"), one.alias("_one")).select(line.alias("value")).write.text(f"{folder}/items")
        got = files.read_items(spark, f"{folder}/items")
        return _kept(got.agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.sum(F.size("answer")).alias("answers"), F.count_if(F.col("options").isNotNull()).alias("with_options")))


@query("select count(*) as rows, sum(scan_idx)::bigint as keys, sum(length(coalesce(response, '')))::bigint as chars from responses")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Responses as CSV with line breaks and quotes in fields, checked by its writer, and read back; an empty field is null."""
    r = table(spark, d, "responses", "scan_idx", "response")
    with scratch(spark) as folder:
        files.write_long_csv(r, f"{folder}/csv")
        got = files.read_long_csv(spark, f"{folder}/csv", r.schema)
        return _kept(got.agg(F.count("*").alias("rows"), F.sum("scan_idx").alias("keys"), F.sum(F.length(F.coalesce("response", F.lit("")))).alias("chars")))


@query("select count(*) as rows, sum(length(upper(question)))::bigint as chars from eval_items where id is not null")
def csv_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """A CSV of items rewritten with its questions in capitals."""
    t = table(spark, d, "eval_items", "id", "question").where("id is not null")
    with scratch(spark) as folder:
        files.write_long_csv(t, f"{folder}/a")
        files.rewrite_csv(spark, f"{folder}/a", f"{folder}/b", t.schema, lambda df: df.withColumn("question", F.upper("question")))
        got = files.read_long_csv(spark, f"{folder}/b", t.schema)
        return _kept(got.agg(F.count("*").alias("rows"), F.sum(F.length("question")).alias("chars")))


@query("select source as hf_config, count(*) as rows from sft_corpus where source is not null group by 1")
def config_union(spark: SparkSession, d: str) -> DataFrame:
    """The sources of the corpus fanned out into a folder each, and read as configurations of one table."""
    with scratch(spark) as folder:
        rows = _rows(spark, d).where("source is not null")
        files.fan_out(rows.withColumn("part", F.col("source")), f"{folder}/by", "part")
        names = sorted(r[0] for r in rows.select("source").distinct().collect())
        one = files.read_configs(lambda c: spark.read.schema(_ROW).json(f"{folder}/by/part={c}"), names)
        return _kept(one.groupBy("hf_config").agg(F.count("*").alias("rows")))


@query("select count(*) filter (where scan_idx % 3 = 0) as first, count(*) as rows, count(*) filter (where scan_idx % 3 <> 0) as missing from responses")
def resume_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A checkpoint table that holds a third of the rows, resumed: what is missing, and all rows in the end."""
    r = table(spark, d, "responses", "scan_idx", "id")
    with scratch(spark) as folder:
        path = f"{folder}/done"
        files.append(r.where("scan_idx % 3 = 0"), path)
        first = spark.read.parquet(path).count()
        missing = files.remaining(r, path, "scan_idx")
        n = missing.count()
        files.append(missing, path)
        rows = spark.read.parquet(path).count()
    return spark.createDataFrame([(first, rows, n)], "first bigint, rows bigint, missing bigint")


@query("select count(*) as rows, count(distinct source_id) as distinct_ids, round(avg(trace_chars), 1) as mean_chars, true as same, true as cached from sft_corpus")
def manifest_of_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of the corpus, its fingerprint in two partitionings, and a build that is cached by version."""
    c = corpus(spark, d, "source_id", "topic", "trace_chars")
    m = files.manifest(c)
    same = files.fingerprint(c) == files.fingerprint(c.repartition(7))
    with scratch(spark) as folder:
        built = []

        def build() -> DataFrame:
            built.append(1)
            return c

        for _ in range(2):
            rows = files.cached(spark, f"{folder}/c", "v1", build).count()
    return spark.createDataFrame([(rows, m["distinct_ids"], float(m["trace_chars"]["mean"]), same, len(built) == 1)], "rows bigint, distinct_ids bigint, mean_chars double, same boolean, cached boolean")


@query("select count(*) as rows, count(*) filter (where response is not null) as first_turns, count(*) filter (where response is not null and length(response) <= 10000) as verified from sft_corpus")
def conversation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows as conversations and as lists of generations: the assistant's first turn, and the first verified generation of moderate length."""
    c = corpus(spark, d, "question", "response")
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), F.col(c).alias("value"))
    c = c.select(F.array(turn("human", "question"), turn("gpt", "response")).alias("conversations"), F.array(F.lit("no"), F.col("response")).alias("g"), F.array(F.lit(False), F.col("response").isNotNull()).alias("ok"))
    return c.agg(F.count("*").alias("rows"), F.count(files.first_turn(F.col("conversations"), "gpt")).alias("first_turns"), F.count(files.verified_generation(F.col("g"), F.col("ok"))).alias("verified"))


@query("select scan_idx, position from (select scan_idx, row_number() over (order by scan_idx) - 1 as position from sft_corpus) where position < 500")
def capped_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first five hundred rows of the corpus in scan order: the cap is the feature."""
    first = corpus(spark, d, "scan_idx").orderBy("scan_idx").limit(500)
    s = first.agg(F.array_sort(F.collect_list("scan_idx")).alias("s")).select(F.posexplode("s").alias("position", "scan_idx"))
    return files.scan_cap(s, "position", 500).select("scan_idx", F.col("position").cast("bigint").alias("position"))


@query("""select count(*) as rows, sum(length(regexp_replace(coalesce(question, ''), '^\\s+|\\s+$', '', 'g')))::bigint as chars from sft_corpus where options is not null and len(options) > 0""")
def choice_questions(spark: SparkSession, d: str) -> DataFrame:
    """Multiple-choice questions in the query layout of their source, taken out of it again."""
    c = corpus(spark, d, "question", "options").where(tx.is_mcq(F.col("options")))
    q = tx.strip(F.coalesce("question", F.lit("")))
    layout = F.concat(F.lit("Q: "), q, F.lit(" Answer Choices: "), F.array_join("options", " "))
    return c.select(files.choice_question(layout).alias("q")).agg(F.count("*").alias("rows"), F.sum(F.length("q")).alias("chars"))


QUERIES, SQL = query.queries, query.sql
