"""Repository-shaped views of the driver's tables, once as DataFrames and once as SQL: files, claims, history, lines, Markdown, decisions, code.

The tables hold no Markdown and no trees, so these stand for them in queries that an oracle can repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str) -> str:
    """`sql` behind the views that it names."""
    used: list[str] = []

    def need(text: str) -> None:
        for name, body in VIEWS.items():
            if name in text and name not in used:
                need(body)
                if name not in used:
                    used.append(name)

    need(sql)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in used) + " " + sql


def path_of() -> Column:
    return F.concat(F.lit("src/"), F.lower(F.replace(F.col("p_type"), F.lit(" "), F.lit("/"))), F.lit("/"), F.lower(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))), F.lit("_"), F.col("p_partkey"), F.lit(".py"))


def seconds(ts: str) -> Column:
    """Seconds since 1970 of a time without zone, whatever the session's zone."""
    return F.unix_date(F.to_date(ts)).cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))


def v_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(path_of().alias("path"), F.col("p_partkey").alias("key"))


def v_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims on paths: right ones, other letter case, bare names, a letter dropped, a folder that never was."""
    of = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(5))
    path = F.col("path")
    target = F.when(of == 0, path).when(of == 1, F.upper(path)).when(of == 2, F.regexp_extract(path, "([^/]*)$", 1)).when(of == 3, F.concat(F.substring(path, 1, 6), path.substr(F.lit(8), F.length(path)))).otherwise(F.concat(F.lit("gone/"), path))
    rows = table(spark, sf, "lineitem").join(v_files(spark, sf), F.col("l_partkey") == F.col("key"))
    return rows.select(F.concat(F.lit("docs/o"), F.col("l_orderkey"), F.lit(".md")).alias("doc"), F.col("l_linenumber").cast("long").alias("line"), target.alias("target"), F.col("l_shipdate").alias("written"))


def v_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).cast("long").alias("line"), "text")


def v_events(spark: SparkSession, sf: str) -> DataFrame:
    """A history of paths: `epoch` counts seconds, a view is a modification, an error a deletion, a signup an addition."""
    kind = F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "A").otherwise("M")
    return table(spark, sf, "events").select(F.concat(F.lit("src/u"), F.col("user_id"), F.lit(".py")).alias("path"), seconds("ts").alias("epoch"), F.col("event_id").alias("commit"), kind.alias("kind"))


def v_blame(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that name such a path, and when they were written."""
    return table(spark, sf, "events").filter("event_type = 'purchase'").select(F.concat(F.lit("docs/d"), F.pmod("event_id", F.lit(97)), F.lit(".md")).alias("doc"), F.col("event_id").alias("line"), F.concat(F.lit("src/u"), F.pmod(F.col("user_id") * 7, F.lit(151)), F.lit(".py")).alias("path"), seconds("ts").alias("written"))


def v_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decision logs, one for each customer: an order is a decision, replaced by the customer's next one where it is finished."""
    status = F.when(F.col("o_orderstatus") == "F", "superseded").when(F.col("o_orderstatus") == "P", "amended").otherwise("active")
    return table(spark, sf, "orders").select(F.concat(F.lit("c"), F.pmod("o_custkey", F.lit(20)), F.lit("/decisions.md")).alias("log"), F.col("o_orderkey").alias("number"), status.alias("status"), F.col("o_custkey").alias("owner"))


def v_md(spark: SparkSession, sf: str) -> DataFrame:
    """Markdown lines (doc, line, text): a front matter, headings, lists, fences, tables with odd rows, directives, links."""
    n = F.col("o_orderkey")
    by = lambda k: F.pmod(n, F.lit(k))
    doc = F.concat(F.lit("docs/g"), F.expr("o_custkey div 20"), F.lit(".md"))
    text = (
        F.when(by(13) == 0, F.concat(F.lit("## Order "), F.col("o_orderpriority")))
        .when(by(13) == 1, F.concat(F.lit("| "), n, F.lit(" | "), F.col("o_orderstatus"), F.lit(" |")))
        .when(by(13) == 2, F.concat(F.lit("| "), n, F.lit(" |")))
        .when(by(13) == 3, F.lit("| id | status |"))
        .when(by(13) == 4, F.lit("|---|---|"))
        .when(by(13) == 5, F.lit("```"))
        .when(by(13) == 6, F.concat(F.lit("See [order "), n, F.lit("](../src/o"), n, F.lit(".py#L"), by(7), F.lit(") and `src/o"), n, F.lit(".py`.")))
        .when(by(13) == 7, F.lit(""))
        .when(by(13) == 8, F.lit("<!-- tidemark: ignore-start -->"))
        .when(by(13) == 9, F.lit("<!-- tidemark: ignore-end -->"))
        .when(by(13) == 10, F.concat(F.lit("Run `tool --flag"), by(9), F.lit("` with `pkg"), by(5), F.lit("=="), by(3), F.lit(".0` or `call_"), by(8), F.lit("()`, see D-"), n, F.lit(".")))
        .when(by(13) == 11, F.concat(F.lit("### Part "), by(4)))
        .otherwise(F.concat(F.lit("It was removed in v1."), by(6), F.lit("; the key token = abcdef"), n))
    )
    line = F.expr("row_number() OVER (PARTITION BY o_custkey div 20 ORDER BY o_orderkey)").cast("long")
    return table(spark, sf, "orders").select(doc.alias("doc"), line.alias("line"), text.alias("text"))


def v_code(spark: SparkSession, sf: str) -> DataFrame:
    """Code lines (path, line, text) of the files."""
    texts = F.array(
        F.concat(F.lit("def call_"), F.pmod("key", F.lit(8)), F.lit("(x): return f'build_{x}_"), F.col("key"), F.lit("'")),
        F.concat(F.lit("FLAG = '--flag"), F.pmod("key", F.lit(6)), F.lit("'")),
        F.concat(F.lit("import mod_"), F.pmod("key", F.lit(11))),
        F.concat(F.lit("print('TODO "), F.col("key"), F.lit("')")),
    )
    return v_files(spark, sf).select("path", F.posexplode(texts).alias("p", "text")).select("path", (F.col("p") + 1).cast("long").alias("line"), "text")


VIEWS: dict[str, str] = {
    "v_files": "SELECT concat('src/', lower(replace(p_type, ' ', '/')), '/', lower(replace(p_name, ' ', '_')), '_', p_partkey, '.py') AS path, p_partkey AS key FROM part",
    "v_claims": """SELECT concat('docs/o', l_orderkey, '.md') AS doc, CAST(l_linenumber AS BIGINT) AS line, l_shipdate AS written,
      CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN path WHEN 1 THEN upper(path) WHEN 2 THEN regexp_extract(path, '([^/]*)$', 1)
        WHEN 3 THEN concat(substr(path, 1, 6), substr(path, 8)) ELSE concat('gone/', path) END AS target
      FROM lineitem JOIN v_files ON l_partkey = key""",
    "v_lines": "SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS text FROM documents",
    "v_events": "SELECT concat('src/u', user_id, '.py') AS path, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, event_id AS \"commit\", CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'A' ELSE 'M' END AS kind FROM events",
    "v_blame": "SELECT concat('docs/d', event_id % 97, '.md') AS doc, event_id AS line, concat('src/u', (user_id * 7) % 151, '.py') AS path, CAST(floor(epoch(ts)) AS BIGINT) AS written FROM events WHERE event_type = 'purchase'",
    "v_decisions": "SELECT concat('c', o_custkey % 20, '/decisions.md') AS log, o_orderkey AS number, CASE o_orderstatus WHEN 'F' THEN 'superseded' WHEN 'P' THEN 'amended' ELSE 'active' END AS status, o_custkey AS owner FROM orders",
    "v_md": """SELECT concat('docs/g', o_custkey // 20, '.md') AS doc, row_number() OVER (PARTITION BY o_custkey // 20 ORDER BY o_orderkey) AS line,
      CASE o_orderkey % 13 WHEN 0 THEN concat('## Order ', o_orderpriority) WHEN 1 THEN concat('| ', o_orderkey, ' | ', o_orderstatus, ' |') WHEN 2 THEN concat('| ', o_orderkey, ' |')
        WHEN 3 THEN '| id | status |' WHEN 4 THEN '|---|---|' WHEN 5 THEN '```' WHEN 6 THEN concat('See [order ', o_orderkey, '](../src/o', o_orderkey, '.py#L', o_orderkey % 7, ') and `src/o', o_orderkey, '.py`.')
        WHEN 7 THEN '' WHEN 8 THEN '<!-- tidemark: ignore-start -->' WHEN 9 THEN '<!-- tidemark: ignore-end -->'
        WHEN 10 THEN concat('Run `tool --flag', o_orderkey % 9, '` with `pkg', o_orderkey % 5, '==', o_orderkey % 3, '.0` or `call_', o_orderkey % 8, '()`, see D-', o_orderkey, '.')
        WHEN 11 THEN concat('### Part ', o_orderkey % 4) ELSE concat('It was removed in v1.', o_orderkey % 6, '; the key token = abcdef', o_orderkey) END AS text FROM orders""",
    "v_code": """SELECT path, unnest([1, 2, 3, 4]) AS line, unnest([concat('def call_', key % 8, '(x): return f''build_{x}_', key, ''''), concat('FLAG = ''--flag', key % 6, ''''), concat('import mod_', key % 11), concat('print(''TODO ', key, ''')')]) AS text FROM v_files""",
}
