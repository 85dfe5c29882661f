"""Decision logs as pages: what their rows say, what becomes of them, which decision stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions
from .registry import query
from .views import VIEWS, table, with_views

#: A log for each customer: orders are decisions, in the order of their keys; `k` chooses what the row says of itself.
VIEWS["v_log_rows"] = """SELECT concat('c', o_custkey, '/docs/DECISIONS.md') AS log, 'D' || id AS id, lead('D' || id) OVER w AS after, row_number() OVER w AS nth, id % 7 AS k, count(*) OVER (PARTITION BY o_custkey) AS n
  FROM (SELECT DISTINCT o_custkey, o_orderkey % 100000 AS id FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY id)"""


def v_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(doc, path, line, text): the pages of these logs, line by line: a header, and a row for each decision with its status or, with k = 5, without that cell."""
    keys = table(spark, sf, "orders").select("o_custkey", F.pmod("o_orderkey", F.lit(100_000)).alias("id")).distinct()
    rows = keys.selectExpr("*", "id % 7 AS k", "lead(concat('D-', id)) OVER (PARTITION BY o_custkey ORDER BY id) AS after", "row_number() OVER (PARTITION BY o_custkey ORDER BY id) AS nth")
    status = F.expr("CASE k WHEN 1 THEN concat('superseded by ', coalesce(after, 'D-0')) WHEN 2 THEN concat('agreed by all of them; superseded by ', coalesce(after, 'D-0')) WHEN 3 THEN 'partially superseded' WHEN 4 THEN 'Deprecated' ELSE 'active' END")
    title = F.when((F.col("k") == 6) & F.col("after").isNotNull(), F.concat(F.lit("replaces "), "after")).otherwise("title")
    text = F.when(F.col("k") == 5, F.concat(F.lit("| **D-"), "id", F.lit("** | **withdrawn** |"))).otherwise(F.concat(F.lit("| D-"), "id", F.lit(" | "), title, F.lit(" | "), status, F.lit(" |")))
    doc = F.concat(F.lit("c"), "o_custkey", F.lit("/docs/DECISIONS.md"))
    heads = keys.select("o_custkey").distinct().select(doc.alias("doc"), F.posexplode(F.array(F.lit("| Id | What | Status |"), F.lit("|---|---|---|"))).alias("p", "text")).select("doc", F.col("doc").alias("path"), (F.col("p") + 1).alias("line"), "text")
    return heads.unionByName(rows.select(doc.alias("doc"), doc.alias("path"), (F.col("nth") + 2).cast("int").alias("line"), text.alias("text")))


FOLD = """own AS (SELECT log, id, nth, after, k, n, CASE k WHEN 1 THEN 'superseded' WHEN 2 THEN 'amended' WHEN 3 THEN 'amended' WHEN 4 THEN 'superseded' WHEN 5 THEN 'amended' ELSE 'active' END AS status FROM v_log_rows WHERE n >= 2),
  later AS (SELECT log, after AS id, id AS newer FROM own WHERE k = 6 AND after IS NOT NULL),
  fold AS (SELECT o.log, CAST(nth + 2 AS INT) AS line, o.id, CASE WHEN status = 'active' AND newer IS NOT NULL THEN 'amended' ELSE status END AS status,
    CASE WHEN k IN (1, 2) THEN coalesce(after, 'D0') WHEN k IN (4, 5) THEN '' ELSE '' END AS told, CASE WHEN status = 'superseded' THEN NULL ELSE newer END AS newer FROM own o LEFT JOIN later USING (log, id))"""


@query(with_views("SELECT 0 FROM v_log_rows").rsplit(" SELECT 0", 1)[0] + f", {FOLD} SELECT log, line, id, status, array_to_string([x for x in [nullif(told, ''), newer] if x IS NOT NULL], ',') AS by_ FROM fold")
def decision_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Statuses by header, by bold marks and by later rows."""
    return decisions.decisions(v_log_lines(spark, sf)).select("log", "line", "id", "status", F.array_join("by", ",").alias("by_"))


@query(
    with_views("SELECT 0 FROM v_log_rows").rsplit(" SELECT 0", 1)[0]
    + f""", {FOLD}, next_ AS (SELECT log, id, told AS now FROM fold WHERE status = 'superseded' AND told <> ''),
  ways AS (SELECT log, id, now, 1 AS steps FROM next_ UNION ALL SELECT w.log, w.id, n.now, steps + 1 FROM ways w JOIN next_ n ON n.log = w.log AND n.id = w.now WHERE steps < 1000)
  SELECT log, id, arg_max(now, steps) AS now FROM ways GROUP BY log, id"""
)
def decisions_standing(spark: SparkSession, sf: str) -> DataFrame:
    """The decision that stands in the place of each superseded one."""
    return decisions.standing(decisions.decisions(v_log_lines(spark, sf)))
