"""Queries over what speaks for or against a claim."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..operators import guards
from .registry import query
from .views import seconds, table, v_code, v_files, v_lines, with_views


def _doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return v_lines(spark, sf).withColumnRenamed("doc_id", "doc")


_PARAGRAPHS = with_views("SELECT 1 FROM v_lines").rsplit(" SELECT 1", 1)[0] + r""", runs AS (SELECT *, sum(CASE WHEN trim(before) = '' OR left(ltrim(text), 1) IN ('#', '>', '|') OR left(ltrim(text), 3) IN ('```', '~~~') OR left(ltrim(text), 2) IN ('- ', '* ', '+ ') OR regexp_matches(ltrim(text), '^[0-9]+[.)] ') OR left(ltrim(before), 1) IN ('#', '|') OR left(ltrim(before), 3) IN ('```', '~~~') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS paragraph
 FROM (SELECT *, lag(text, 1, '') OVER (PARTITION BY doc_id ORDER BY line) AS before FROM v_lines)) """


@query(_PARAGRAPHS + "SELECT doc_id AS doc, CAST(paragraph AS BIGINT) AS paragraph, string_agg(trim(text), ' ' ORDER BY line) AS whole FROM runs WHERE trim(text) <> '' GROUP BY ALL")
def paragraph_join(spark: SparkSession, sf: str) -> DataFrame:
    p = guards.paragraphs(_doc_lines(spark, sf))
    rows = F.sort_array(F.collect_list(F.struct("line", F.trim("text").alias("t"))))
    return p.groupBy("doc", "paragraph").agg(F.array_join(F.transform(rows, lambda x: x["t"]), " ").alias("whole"))


@query()
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    """RE2 has no look-behind; tests compare with a loop."""
    return guards.sentences(_doc_lines(spark, sf))


@query(with_views("SELECT path, CASE WHEN key % 7 = 0 AND key % 5 <> 0 THEN true ELSE false END AS ignored FROM (SELECT 'out/x' || (key % 7) || '/' || key || CASE WHEN key % 5 = 0 THEN '.keep' ELSE '.log' END AS path, key FROM v_files)"))
def gitignore_rules(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("key")
    paths = v_files(spark, sf).select(F.concat(F.lit("out/x"), F.pmod(key, F.lit(7)), F.lit("/"), key, F.when(F.pmod(key, F.lit(5)) == 0, ".keep").otherwise(".log")).alias("path"))
    rules = guards.ignore_rules(spark.createDataFrame([(".gitignore", "# built\n*.tmp\n"), ("out/.gitignore", "/x0/*\n!*.keep\n")], "path string, text string"))
    return guards.ignored_paths(paths, rules)


@query("SELECT p_partkey::VARCHAR AS doc, 3 + n AS line, CASE n WHEN 0 THEN 'top' WHEN 1 THEN 'top/src' WHEN 2 THEN 'top/src/f' || p_partkey || '.py' ELSE 'top/docs' END AS path FROM part, (SELECT unnest([0, 1, 2, 3]) AS n)")
def tree_paths(spark: SparkSession, sf: str) -> DataFrame:
    texts = F.array(F.lit("top/"), F.lit("├── src/"), F.concat(F.lit("│   └── f"), "p_partkey", F.lit(".py  # main")), F.lit("└── docs"))
    lines = F.transform(texts, lambda t, i: F.struct((i + 3).alias("line"), t.alias("text")))
    return guards.drawn_paths(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("doc"), lines.alias("lines")))


@query("SELECT p_partkey AS doc, 1 AS line, 'pkg' || p_size AS module, unnest([lower(p_brand[1:5]), 'x']) AS name FROM part")
def example_imports(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit(">>> from pkg"), "p_size", F.lit(" import ("), F.lower(F.substring("p_brand", 1, 5)), F.lit(" as b, x)"))
    return guards.example_imports(table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), F.lit(1).alias("line"), text.alias("text")))


@query(with_views("SELECT DISTINCT path AS doc, regexp_extract(text, 'def (\\w+)', 1) AS name FROM v_code WHERE line = 1"))
def example_names(spark: SparkSession, sf: str) -> DataFrame:
    return guards.example_names(v_code(spark, sf).select(F.col("path").alias("doc"), "text"))


@query("SELECT o_orderkey AS doc, 1 AS line, 'cli.py' AS path, 'sub' || (o_orderkey % 5) AS word FROM orders WHERE o_orderkey % 5 > 1")
def subcommand_missing(spark: SparkSession, sf: str) -> DataFrame:
    scripts = spark.createDataFrame([("cli.py", "p.add_parser('sub0')\n@app.command(\"sub1\")"), ("one.py", "p.add_parser('a')")], "path string, text string")
    calls = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(1).alias("line"), F.lit("cli.py").alias("path"), F.concat(F.lit("sub"), F.pmod("o_orderkey", F.lit(5))).alias("word"))
    return guards.unknown_subcommands(calls, scripts)


@query(with_views("SELECT o_orderkey AS doc, 1 AS line, path, '--flag' || (o_orderkey % 9) AS flag FROM orders JOIN v_files ON key = o_orderkey % 200 WHERE NOT EXISTS (SELECT 1 FROM v_code c WHERE regexp_extract(c.path, '^(.*)/', 1) = regexp_extract(v_files.path, '^(.*)/', 1) AND c.text = 'FLAG = ''--flag' || (o_orderkey % 9) || '''')"))
def flag_missing(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "orders").join(v_files(spark, sf), F.col("key") == F.pmod("o_orderkey", F.lit(200))).select(F.col("o_orderkey").alias("doc"), F.lit(1).alias("line"), "path", F.concat(F.lit("--flag"), F.pmod("o_orderkey", F.lit(9))).alias("flag"))
    return guards.unknown_flags(calls, v_code(spark, sf))


@query("""WITH c AS (SELECT o_orderkey AS doc, 1 AS line, 'p' || (o_orderkey % 4) || '/x' AS folder, 's' || (o_orderkey % 3) AS script FROM orders)
 SELECT doc, line, folder, script, CASE WHEN folder LIKE 'p1%' AND script = 's1' THEN 'p1/package.json' WHEN script = 's0' THEN 'package.json' WHEN script = 's1' THEN 'p1/package.json' END AS manifest, NOT (script = 's0' OR (folder LIKE 'p1%' AND script = 's1')) AS far FROM c""")
def npm_workspace(spark: SparkSession, sf: str) -> DataFrame:
    scripts = spark.createDataFrame([("package.json", "", "s0"), ("p1/package.json", "p1", "s1"), ("p2/package.json", "p2", "s1x")], "manifest string, folder string, script string")
    of = lambda k: F.pmod("o_orderkey", F.lit(k))
    claims = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(1).alias("line"), F.concat(F.lit("p"), of(4), F.lit("/x")).alias("folder"), F.concat(F.lit("s"), of(3)).alias("script"))
    return guards.package_script(claims, scripts)


@query("SELECT p_name || p_partkey AS path, (1 + p_size % 2)::BIGINT AS tests FROM part")
def test_counts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("def test_a(): pass\n"), F.when(F.pmod("p_size", F.lit(2)) == 1, "    async def test_b(): pass\n").otherwise("def helper(): test_c()\n"))
    return guards.test_counts(table(spark, sf, "part").select(F.concat("p_name", "p_partkey").alias("path"), text.alias("text")))


@query(with_views("SELECT section, line, used FROM (SELECT doc_id AS section, line, CAST(sum(CAST(round_even(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / 4.0 + (length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))) / 1.5, 0) AS BIGINT) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS used FROM v_lines) WHERE used <= 200"))
def section_cut(spark: SparkSession, sf: str) -> DataFrame:
    lines = v_lines(spark, sf).withColumnRenamed("doc_id", "section")
    return guards.within_budget(lines, token_estimate(F.col("text")), 200).select("section", "line", "used")


@query("SELECT event_id AS path FROM events WHERE epoch(ts)::BIGINT < (SELECT max(floor(epoch(ts))::BIGINT) FROM events) - (CASE WHEN event_type = 'view' THEN 7 ELSE 3 END) * 86400")
def prune_aged(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias("path"), "event_type", seconds("ts").alias("mtime"))
    newest = e.agg(F.max("mtime").alias("now"))
    return guards.aged_out(e.join(F.broadcast(newest)), F.col("now"), F.when(F.col("event_type") == "view", 7).otherwise(3)).select("path")  # one row is broadcast
