"""Queries that read and render pages in order, and watch files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import markdown, render, shell
from ..streaming import watch
from .registry import query
from .views import table, v_md


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("line", "text")))
    return v_md(spark, sf).groupBy("doc").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


@query()
def scan_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of what a sequential reading finds; tests compare the parts with literal pages."""
    pages = markdown.scan(_pages(spark, sf))
    return pages.select("doc", *(F.size(c).cast("long").alias(c) for c in ("headings", "spans", "links", "fences", "tables", "stray", "ignored", "anchors")))


@query()
def md_to_html(spark: SparkSession, sf: str) -> DataFrame:
    return render.render(_pages(spark, sf), lang="en").select("doc", "ok", "html")


@query("SELECT o_orderkey, ['python', 'tools/run ' || o_orderkey || '.py', '--flag=' || o_orderpriority, 'a b'] AS argv FROM orders")
def shell_argv(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit("python  'tools/run "), "o_orderkey", F.lit(".py' --flag=\""), "o_orderpriority", F.lit('"  a" "b'))
    return table(spark, sf, "orders").select("o_orderkey", shell.shell_argv(line).alias("argv"))


@query()
def shell_commands(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("cd app && python -m mod"), F.pmod("o_orderkey", F.lit(7)), F.lit(" --v; make t"), F.pmod("o_orderkey", F.lit(3)))
    fences = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("doc"), F.lit(1).alias("start"), F.lit("sh").alias("lang"), F.array(F.struct(F.lit(2).alias("line"), text.alias("text"))).alias("lines"))
    return shell.block_commands(fences)


@query("""SELECT s.o_orderkey AS doc, CASE WHEN t.o_orderkey IS NULL THEN 'missing' WHEN s.o_orderkey % 5 = 0 THEN 'foreign' WHEN s.o_orderkey % 4 <> 0 THEN 'fresh' ELSE 'stale' END AS state FROM orders s LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) t USING (o_orderkey)""")
def cache_decide(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.lit("k").alias("key"), F.lit(1).alias("mtime"), F.lit(2).alias("size"))
    made = o.filter("doc % 3 <> 0").select("doc", (F.col("doc") % 5 != 0).alias("made_here"), "key", "mtime", F.when(F.col("doc") % 4 != 0, F.col("size")).otherwise(9).alias("size"))
    return render.cache_state(o, made).select("doc", "state")


@query("SELECT o_orderkey AS doc, substr(sha1(o_orderkey::VARCHAR || chr(0) || coalesce(nullif(o_orderstatus, 'P'), chr(1)) || chr(0) || o_orderpriority), 1, 16) AS key FROM orders")
def settings_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), render.settings_key(F.col("o_orderkey"), F.nullif("o_orderstatus", F.lit("P")), F.col("o_orderpriority")).alias("key"))


def _polls(spark: SparkSession, sf: str) -> DataFrame:
    """Polls of a file for each user: time and size change with every third event, content with every seventh; at the tenth and eleventh of each eleven the file is missing."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    p = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("path"), nth.alias("poll"))
    return p.select("path", "poll", F.expr("if(poll % 11 < 2, NULL, poll div 3)").alias("mtime"), F.expr("poll div 3").alias("size"), F.expr("concat('c', poll div 7)").alias("digest"))


_SETTLED = """WITH p AS (SELECT concat('u', user_id) AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS poll FROM events), q AS (SELECT *, CASE WHEN poll % 11 < 2 THEN NULL ELSE poll // 3 END AS mtime, concat('c', poll // 7) AS digest FROM p),
 seen AS (SELECT * FROM (SELECT *, mtime = lag(mtime) OVER (PARTITION BY path ORDER BY poll) AS twice FROM q WHERE mtime IS NOT NULL) WHERE twice), fresh AS (SELECT * FROM (SELECT *, lag(digest) OVER (PARTITION BY path ORDER BY poll) AS b FROM seen) WHERE b IS NULL OR b <> digest),
 told AS (SELECT path, poll, digest FROM fresh UNION ALL SELECT path, poll, NULL FROM (SELECT *, lag(mtime) OVER (PARTITION BY path ORDER BY poll) AS b, lag(poll) OVER (PARTITION BY path ORDER BY poll) AS n FROM q) WHERE mtime IS NULL AND (b IS NOT NULL OR n IS NULL))
 SELECT path, poll, digest, count(digest) OVER (PARTITION BY path ORDER BY poll) AS revision FROM told"""


@query(_SETTLED)
def watch_settled(spark: SparkSession, sf: str) -> DataFrame:
    return watch.settled_changes(_polls(spark, sf))


@query(_SETTLED)
def watch_debounce(spark: SparkSession, sf: str) -> DataFrame:
    """The same by a stream with state. Its folders lie in the shared folder of the session, or without one in a local session's temporary folder."""
    folder = _folder(spark)
    _polls(spark, sf).repartition(2, "path").write.parquet(f"{folder}/polls")
    return watch.run_to_end(spark, watch.watch(spark.readStream.schema(watch.POLLS).parquet(f"{folder}/polls")), folder)


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='tidemark-stream-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("SELECT sha1(CAST(replace(text, chr(13) || chr(10), chr(10)) AS VARCHAR)) AS digest, min(CAST(doc_id AS VARCHAR)) AS path, count(*) AS copies FROM documents GROUP BY 1")
def watch_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return watch.distinct_contents(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"))


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("ts", F.to_timestamp("ts"))
    return watch.windowed_counts(e).withColumn("start", F.unix_timestamp("start"))
