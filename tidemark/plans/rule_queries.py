"""Queries over claims, findings, documents, retrieval and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import claims, documents, findings, lines, reports
from .registry import query
from .text_queries import _HEADS, _OPEN
from .views import seconds, table, v_code, v_decisions, v_events, v_files, v_lines, v_md, with_views

_SPANS = _OPEN.rstrip() + ", spans AS (SELECT doc, line, unnest(regexp_extract_all(text, '`([^`]+)`', 1)) AS code FROM clear) "


@query(_SPANS + """SELECT doc, line, code, CASE WHEN code LIKE '%==%' THEN 'dep' WHEN code LIKE 'src/%' THEN 'path' WHEN code LIKE '%()' THEN 'symbol' END AS kind,
 CASE WHEN code LIKE '%==%' THEN regexp_extract(code, '^([a-z0-9]+)', 1) WHEN code LIKE 'src/%' THEN code WHEN code LIKE '%()' THEN regexp_replace(code, '\\(\\)$', '') END AS target FROM spans WHERE code NOT LIKE 'tool %'""")
def inline_claims(spark: SparkSession, sf: str) -> DataFrame:
    return claims.inline_claims(lines.code_spans(v_md(spark, sf))).select("doc", "line", "code", "kind", "target")


@query(_OPEN + """SELECT doc, line, regexp_extract(dest, '^([^#]*)', 1) AS target, regexp_extract(dest, '#(.*)$', 1) AS anchor FROM (SELECT doc, line, regexp_extract(unnest(regexp_extract_all(regexp_replace(text, '`[^`]+`', '', 'g'), '\\[[^\\[\\]]*\\]\\([^)\\s]+\\)')), '\\(([^)]*)\\)$', 1) AS dest FROM clear)""")
def claim_links(spark: SparkSession, sf: str) -> DataFrame:
    return claims.link_claims(lines.links(v_md(spark, sf))).select("doc", "line", "target", "anchor")


_WORDS = with_views("SELECT 1 FROM v_files").rsplit(" SELECT 1", 1)[0]
_STRENGTH = "CASE k WHEN 0 THEN path WHEN 1 THEN regexp_extract(path, '([^/]*)$', 1) WHEN 2 THEN replace(path, 'src/', 'path/to/') WHEN 3 THEN 'v1.2.' || key WHEN 4 THEN 'a/b' || key WHEN 5 THEN 'http://x/' || key ELSE 'plain' || key END"


@query(f"{_WORDS} SELECT key, {_STRENGTH} AS text, CASE k WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE 0 END::BIGINT AS strength, k = 2 AS placeholder FROM (SELECT *, key % 7 AS k FROM v_files)")
def path_strength(spark: SparkSession, sf: str) -> DataFrame:
    k = F.pmod("key", F.lit(7))
    t = (
        F.when(k == 0, F.col("path")).when(k == 1, F.regexp_extract("path", "([^/]*)$", 1)).when(k == 2, F.replace("path", F.lit("src/"), F.lit("path/to/"))).when(k == 3, F.concat(F.lit("v1.2."), "key"))
        .when(k == 4, F.concat(F.lit("a/b"), "key")).when(k == 5, F.concat(F.lit("http://x/"), "key")).otherwise(F.concat(F.lit("plain"), "key"))
    )
    named = v_files(spark, sf).select("key", t.alias("text"))
    return named.select("key", "text", claims.path_strength(F.col("text")).alias("strength"), claims.has_placeholder(F.col("text")).alias("placeholder"))


@query("""WITH h AS (SELECT p_partkey AS line, CASE p_size % 3 WHEN 0 THEN concat('Release v1.', p_size, '.', p_partkey) WHEN 1 THEN concat('Needs version 2.', p_size, '.0 or later') ELSE p_name END AS title FROM part)
 SELECT line, title, regexp_extract(title, 'v(\\d+\\.\\d+\\.\\d+)', 1) AS version FROM h WHERE title LIKE 'Release%'""")
def claim_versions(spark: SparkSession, sf: str) -> DataFrame:
    title = F.when(F.pmod("p_size", F.lit(3)) == 0, F.concat(F.lit("Release v1."), "p_size", F.lit("."), "p_partkey")).when(F.pmod("p_size", F.lit(3)) == 1, F.concat(F.lit("Needs version 2."), "p_size", F.lit(".0 or later"))).otherwise(F.col("p_name"))
    return claims.heading_versions(table(spark, sf, "part").select(F.col("p_partkey").alias("line"), title.alias("title")))


_MENTIONS = with_views("SELECT 1 FROM v_md, v_decisions").rsplit(" SELECT 1", 1)[0] + ", mentions AS (SELECT doc, line, 'D' || CAST(regexp_extract(text, 'D-(\\d+)', 1) AS BIGINT) AS id FROM v_md WHERE regexp_matches(text, 'D-\\d+')), known AS (SELECT 'D' || number AS id, max(status) AS status FROM v_decisions WHERE number % 2 = 0 GROUP BY 1)"


@query(_MENTIONS + " SELECT doc, line, id FROM mentions")
def claim_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return claims.decision_mentions(v_md(spark, sf), ["D"])


@query(_MENTIONS + " SELECT doc, line, id, CASE WHEN status IS NULL THEN 'decision-unknown' ELSE 'decision-' || status END AS rule, CASE WHEN status IS NULL THEN 'error' WHEN status = 'superseded' THEN 'warning' ELSE 'info' END AS severity FROM mentions LEFT JOIN known USING (id) WHERE status IS NULL OR status <> 'active'")
def decision_findings(spark: SparkSession, sf: str) -> DataFrame:
    known = v_decisions(spark, sf).filter("number % 2 = 0").select(F.concat(F.lit("D"), "number").alias("id"), "status")
    return documents.decision_findings(claims.decision_mentions(v_md(spark, sf), ["D"]), known)


@query(with_views("""SELECT d.log, 'D' || d.number AS id, CASE WHEN d.status = 'active' AND r.by IS NOT NULL THEN 'amended' ELSE d.status END AS status, coalesce(r.by, '') AS by FROM v_decisions d LEFT JOIN
 (SELECT log, prev, string_agg(id, ',' ORDER BY id) AS by FROM (SELECT DISTINCT log, 'D' || number AS id, lag(number) OVER (PARTITION BY log ORDER BY number) AS prev, number FROM v_decisions) WHERE number % 3 = 0 AND prev IS NOT NULL GROUP BY ALL) r ON r.log = d.log AND r.prev = d.number"""))
def decision_status(spark: SparkSession, sf: str) -> DataFrame:
    before = F.expr("lag(number) OVER (PARTITION BY log ORDER BY number)")
    rows = v_decisions(spark, sf).withColumn("_before", before).select("log", F.concat(F.lit("D"), "number").alias("id"), "status", F.when((F.col("number") % 3 == 0) & F.col("_before").isNotNull(), F.concat(F.lit("D"), "_before")).alias("replaces"))
    return documents.decision_status(rows)


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings made of Markdown lines: a rule, a kind of document and a severity by place."""
    md = v_md(spark, sf).filter("text <> ''")
    return md.select(
        F.when(F.col("line") % 3 == 0, "path-gone").when(F.col("line") % 3 == 1, "table-shape").otherwise("link-broken").alias("rule"),
        F.when(F.col("line") % 2 == 0, "error").otherwise("warning").alias("severity"),
        F.col("doc").alias("path"), "line", F.lit(1).cast("long").alias("col"), F.substring("text", 1, 12).alias("claim"), "text",
        F.when(F.col("doc").endswith("7.md"), "plan").when(F.col("doc").endswith("9.md"), "history").otherwise("live").alias("kind"),
        F.concat(F.lit("see: "), F.substring("text", 1, 12)).alias("message"),
    )


_RAISED = with_views("SELECT 1 FROM v_md").rsplit(" SELECT 1", 1)[0] + """, raised AS (SELECT CASE line % 3 WHEN 0 THEN 'path-gone' WHEN 1 THEN 'table-shape' ELSE 'link-broken' END AS rule, CASE WHEN line % 2 = 0 THEN 'error' ELSE 'warning' END AS severity, doc AS path, line, 1::BIGINT AS col,
  substr(text, 1, 12) AS claim, text, CASE WHEN doc LIKE '%7.md' THEN 'plan' WHEN doc LIKE '%9.md' THEN 'history' ELSE 'live' END AS kind, 'see: ' || substr(text, 1, 12) AS message FROM v_md WHERE text <> ''),
 down AS (SELECT * REPLACE (CASE WHEN (kind = 'plan' OR regexp_matches(text, '^\\s*[-*+]\\s+\\[[xX]\\]|✅|\\bDONE\\b')) AND rule <> 'table-shape' THEN 'info' ELSE severity END AS severity) FROM raised WHERE kind <> 'history'),
 printed AS (SELECT *, substr(sha1(rule || chr(0) || path || chr(0) || claim || chr(0) || trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 16) AS fingerprint FROM down) """


def _printed(spark: SparkSession, sf: str) -> DataFrame:
    return findings.with_fingerprints(findings.downgraded(_findings(spark, sf)))


@query(_RAISED + "SELECT rule, severity, path, line, fingerprint FROM printed")
def findings_all(spark: SparkSession, sf: str) -> DataFrame:
    rules = findings.Rules()
    rules.register("all", lambda corpus: corpus["raised"])
    return rules.run({"raised": _findings(spark, sf)}).select("rule", "severity", "path", "line", "fingerprint")


@query(_RAISED + "SELECT rule, path, line, fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint, line ORDER BY col) AS n FROM (SELECT * FROM printed UNION ALL SELECT * FROM printed WHERE line % 5 = 0)) WHERE n = 1")
def dedup_findings(spark: SparkSession, sf: str) -> DataFrame:
    f = _printed(spark, sf)
    return findings.first_of_each(f.unionByName(f.filter("line % 5 = 0"))).select("rule", "path", "line", "fingerprint")


@query(_RAISED + "SELECT rule, CASE WHEN rule = 'path-gone' THEN 'info' ELSE severity END AS severity, path, line FROM printed")
def guess_demotion(spark: SparkSession, sf: str) -> DataFrame:
    return findings.sure_only(_printed(spark, sf)).select("rule", "severity", "path", "line")


@query(_RAISED + "SELECT rule, path, line, fingerprint FROM printed WHERE fingerprint NOT IN (SELECT fingerprint FROM printed WHERE line % 4 = 0)")
def baseline_anti(spark: SparkSession, sf: str) -> DataFrame:
    f = _printed(spark, sf)
    return findings.without_baseline(f, reports.baseline(f.filter("line % 4 = 0"))).select("rule", "path", "line", "fingerprint")


@query(_RAISED + "SELECT rule, path, line, severity FROM printed WHERE severity <> 'info' AND (path = 'docs/g1.md' OR path LIKE 'docs/g1.md/%' OR path = 'docs/g2.md')")
def severity_and_focus(spark: SparkSession, sf: str) -> DataFrame:
    return findings.in_focus(findings.at_least(_printed(spark, sf), "warning"), ["docs/g1.md", "docs/g2.md"]).select("rule", "path", "line", "severity")


@query(_RAISED + """, c AS (SELECT doc AS path, count(*) AS claims, count(*) FILTER (line % 2 = 1) AS ok, count(*) FILTER (line % 2 = 0) AS broken FROM v_md GROUP BY doc), f AS (SELECT path, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM printed GROUP BY path)
 SELECT path, claims, ok, broken, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(infos, 0) AS infos, CASE WHEN errors > 0 THEN 'red' WHEN warnings > 0 THEN 'yellow' ELSE 'green' END AS color FROM c LEFT JOIN f USING (path)""")
def doc_stats_findings(spark: SparkSession, sf: str) -> DataFrame:
    return findings.document_stats(_statuses(spark, sf), _printed(spark, sf))


def _statuses(spark: SparkSession, sf: str) -> DataFrame:
    return v_md(spark, sf).select("doc", F.when(F.col("line") % 2 == 1, "ok").otherwise("broken").alias("status"))


@query(_RAISED + "SELECT (SELECT count(DISTINCT doc) FROM v_md) AS docs, (SELECT count(*) FROM v_md) AS claims, (SELECT count(*) FROM v_md) AS checked, (SELECT count(*) FROM v_md WHERE line % 2 = 1) AS verified, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM printed")
def global_stats(spark: SparkSession, sf: str) -> DataFrame:
    return findings.totals(_statuses(spark, sf), _printed(spark, sf))


@query(_RAISED + "SELECT path, line, rule, max(CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) OVER (PARTITION BY path)::BIGINT AS worst, row_number() OVER (PARTITION BY path ORDER BY line, col, rule) AS position FROM printed")
def report_order(spark: SparkSession, sf: str) -> DataFrame:
    return findings.report_order(_printed(spark, sf)).select("path", "line", "rule", "worst", "position")


@query(_RAISED + "SELECT path, min(line) AS line, count(*) AS never, (SELECT count(*) FROM v_md m WHERE m.doc = path AND m.text <> '' AND m.line % 3 <> 1) AS links, 'foreign-links' AS rule FROM printed WHERE rule = 'link-broken' GROUP BY path HAVING never >= 3 AND 2 * never >= links")
def foreign_links(spark: SparkSession, sf: str) -> DataFrame:
    links = v_md(spark, sf).filter("text <> '' AND line % 3 <> 1").groupBy(F.col("doc").alias("path")).agg(F.count(F.lit(1)).alias("links"))
    return findings.collapsed_links(_printed(spark, sf), links)


@query(_RAISED + "SELECT path, line, '::' || CASE severity WHEN 'info' THEN 'notice' ELSE severity END || ' file=' || path || ',line=' || line || ',col=' || col || ',title=' || rule || '::' || message AS annotation FROM printed")
def github_annotations(spark: SparkSession, sf: str) -> DataFrame:
    return reports.annotations(_printed(spark, sf))


@query(_RAISED + """SELECT path, line, rule, '{"ruleId":"' || rule || '","level":"' || CASE severity WHEN 'info' THEN 'note' ELSE severity END || '","message":{"text":' || to_json(message) || '},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || path || '"},"region":{"startLine":' || line || ',"startColumn":' || col || '}}}],"partialFingerprints":{"tidemark/v1":"' || fingerprint || '"}}' AS result FROM printed""")
def sarif_rows(spark: SparkSession, sf: str) -> DataFrame:
    return reports.sarif(_printed(spark, sf))


@query(_RAISED + """SELECT path, line, '{"rule":"' || rule || '","severity":"' || severity || '","path":"' || path || '","line":' || line || ',"col":' || col || ',"message":' || to_json(message) || '}' AS json FROM printed""")
def json_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.json_lines(_printed(spark, sf))


@query(_RAISED + "SELECT path, path || chr(10) || string_agg('  ' || lpad(CAST(line AS VARCHAR), 5, ' ') || '  ' || rpad(severity, 7, ' ') || '  ' || rule || '  ' || message, chr(10) ORDER BY line, col) AS block FROM printed GROUP BY path")
def text_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.text_blocks(_printed(spark, sf))


@query(_RAISED + "SELECT rule, '| ' || severity || ' | `' || rule || '` | ' || count(*) || ' | ' || count(DISTINCT path) || ' |' AS row FROM printed GROUP BY severity, rule")
def markdown_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.markdown_summary(_printed(spark, sf))


@query(_RAISED + """, o AS (SELECT *, string_split(path, '/')[1] AS area FROM printed) SELECT area, '{"tool":"tidemark","version":"1","stats":{"errors":' || count(*) FILTER (severity = 'error') || ',"warnings":' || count(*) FILTER (severity = 'warning') || ',"infos":' || count(*) FILTER (severity = 'info') || '},"findings":[' ||
 string_agg('{"path":"' || path || '","line":' || line || ',"col":' || col || ',"rule":"' || rule || '","severity":"' || severity || '","message":' || to_json(message) || ',"fingerprint":"' || fingerprint || '"}', ',' ORDER BY CASE severity WHEN 'error' THEN -2 WHEN 'warning' THEN -1 ELSE 0 END, path, line, rule) || ']}' AS json FROM o GROUP BY area""")
def json_document(spark: SparkSession, sf: str) -> DataFrame:
    return reports.json_documents(_printed(spark, sf))


@query(_RAISED + """SELECT 'docs' AS area, '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"tidemark","version":"1"}},"results":[' || string_agg('{"ruleId":"' || rule || '","level":"' || CASE severity WHEN 'info' THEN 'note' ELSE severity END || '","message":{"text":' || to_json(message) || '},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || path || '"},"region":{"startLine":' || line || ',"startColumn":' || col || '}}}],"partialFingerprints":{"tidemark/v1":"' || fingerprint || '"}}', ',' ORDER BY path, line, rule) || ']}]}' AS json FROM printed""")
def sarif_log(spark: SparkSession, sf: str) -> DataFrame:
    return reports.sarif_logs(_printed(spark, sf))


@query(_RAISED + "SELECT count(*) FILTER (severity = 'error') || ' errors, ' || count(*) FILTER (severity = 'warning') || ' warnings, ' || count(*) FILTER (severity = 'info') || ' notes in ' || count(DISTINCT path) || ' documents' AS summary FROM printed")
def summary_line(spark: SparkSession, sf: str) -> DataFrame:
    return reports.summary_line(_printed(spark, sf))


@query(_RAISED + "SELECT path, line, rule FROM printed ORDER BY CASE severity WHEN 'error' THEN -2 WHEN 'warning' THEN -1 ELSE 0 END, path, line, col, rule LIMIT 50 OFFSET 20")
def findings_listed(spark: SparkSession, sf: str) -> DataFrame:
    return reports.listed(_printed(spark, sf), 50, 20).select("path", "line", "rule")


@query(_RAISED + """, st AS (SELECT path, CASE WHEN path LIKE '%7.md' THEN 'plan' ELSE 'live' END AS kind, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM printed GROUP BY path), t AS (SELECT *, CASE kind WHEN 'live' THEN 0 ELSE 1 END AS tier FROM st)
 SELECT path, tier, row_number() OVER (PARTITION BY tier ORDER BY errors DESC, warnings DESC, infos DESC, path) AS place FROM t""")
def document_order(spark: SparkSession, sf: str) -> DataFrame:
    per = _printed(spark, sf).groupBy("path").agg(*(F.count_if(F.col("severity") == x).alias(f"{x}s") for x in findings.RANKS))
    return reports.document_order(per.withColumn("kind", F.when(F.col("path").endswith("7.md"), "plan").otherwise("live"))).select("path", "tier", "place")


@query(_RAISED + "SELECT path, line, rule FROM printed WHERE path NOT IN (SELECT doc FROM v_md WHERE doc LIKE '%3.md')")
def findings_outside(spark: SparkSession, sf: str) -> DataFrame:
    docs = v_md(spark, sf).filter("doc LIKE '%3.md'").select(F.col("doc").alias("path"))
    return reports.outside_documents(_printed(spark, sf), docs).select("path", "line", "rule")


@query(_RAISED + "SELECT path, line, rule FROM printed WHERE path LIKE '%1.md' OR line % 5 = 0")
def focus_by_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth line is proved by a document in focus; others, also those in focus by their own path, lie under folders named by their last digit."""
    f = _printed(spark, sf).withColumns({"own": F.col("path"), "evidence": F.when(F.col("line") % 5 == 0, F.array(F.lit("x/a.md"), F.lit("guide/b.md"))).otherwise(F.array(F.lit("guides/c.md")))})
    placed = f.withColumn("path", F.when(F.col("own").endswith("1.md"), F.concat(F.lit("guide/"), "own")).otherwise(F.col("own")))
    return findings.in_focus(placed, ["guide/"]).select(F.col("own").alias("path"), "line", "rule")


_DOCS = "CASE p_partkey % 9 WHEN 0 THEN 'docs/plan-x.md' WHEN 1 THEN 'archive/a.md' WHEN 2 THEN 'docs/CHANGELOG.md' WHEN 3 THEN 'blog/2026-01-01-x.md' WHEN 4 THEN '2026-01-01-notes.md' WHEN 5 THEN 'rfcs/1/x.md' WHEN 6 THEN 'guide/v1/x.md' WHEN 7 THEN 'guide/v2/x.md' ELSE 'README.md' END"


@query(f"""SELECT p_partkey, {_DOCS} AS path, CASE WHEN p_size = 7 THEN 'plan' WHEN p_size = 8 THEN 'history' WHEN p_size = 9 THEN 'plan' ELSE CASE p_partkey % 9 WHEN 0 THEN 'plan' WHEN 1 THEN 'history' WHEN 2 THEN 'history' WHEN 3 THEN 'live' WHEN 4 THEN 'plan' WHEN 5 THEN 'plan' WHEN 6 THEN 'history' WHEN 7 THEN 'live' ELSE 'live' END END AS kind FROM part""")
def doc_classify(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "part").select("p_partkey", "p_size", F.expr(_DOCS).alias("path"))
    old = documents.old_versions(docs).withColumn("old", F.lit(True))
    size = F.col("p_size")
    kind = documents.document_kind(F.col("path"), F.when(size == 7, "plan").otherwise(""), F.when(size == 8, "Shipped").when(size == 9, "in  progress").otherwise(""), F.coalesce("old", F.lit(False)))
    return docs.join(old, "path", "left").select("p_partkey", "path", kind.alias("kind"))


@query("SELECT DISTINCT path FROM (SELECT 'docs/v' || (p_size % 4 + 1) || '.' || (p_size % 3) || '/' || p_brand || '.md' AS path, p_size % 4 + 1 AS a, p_size % 3 AS b FROM part), (SELECT max((p_size % 4 + 1) * 10 + p_size % 3) AS m FROM part) WHERE a * 10 + b < m")
def old_versions(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("docs/v"), F.pmod("p_size", F.lit(4)) + 1, F.lit("."), F.pmod("p_size", F.lit(3)), F.lit("/"), "p_brand", F.lit(".md"))
    return documents.old_versions(table(spark, sf, "part").select(path.alias("path")).distinct())


_TERM = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}]{2,}'), lambda t: len(t) >= 2)"
_BM25 = f"""WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS section, CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.4 END AS weight, {_TERM} AS t, text FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM s WHERE len(t) > 0),
 tf AS (SELECT section, weight, len(t) AS length, term, len(list_filter(t, lambda x: x = term)) AS tf FROM s, (SELECT unnest(['that', 'with', 'sich']) AS term)), df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
 scored AS (SELECT section, any_value(weight) * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS score FROM tf JOIN df USING (term), n WHERE tf > 0 GROUP BY section) """


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    of = F.pmod("doc_id", F.lit(3))
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("section"), F.when(of == 0, 1.0).when(of == 1, 0.7).otherwise(0.4).alias("weight"), "text")


@query(_BM25 + "SELECT section, round(score, 6) AS score FROM scored")
def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    return documents.bm25(_sections(spark, sf), "that with, sich that").withColumn("score", F.round("score", 6))


@query(_BM25 + "SELECT section, row_number() OVER (ORDER BY round(score, 6) DESC, section) AS place FROM scored ORDER BY place LIMIT 20")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    top = documents.bm25(_sections(spark, sf), "that with, sich that").withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "section").limit(20)
    return top.select("section", F.expr("row_number() OVER (ORDER BY score DESC, section)").cast("long").alias("place"))  # 20 rows


@query()
def context_pack(spark: SparkSession, sf: str) -> DataFrame:
    """The greedy choice is a fold; tests compare it with a loop."""
    s = _sections(spark, sf)
    scored = documents.bm25(s, "that with, sich that").withColumn("score", F.round("score", 6)).join(s, "section").select("section", "score", text.token_estimate(F.col("text")).alias("tokens"), F.col("text").alias("body"))
    return documents.context_pack(scored, 2000)


@query(_HEADS.rstrip() + """, ends AS (SELECT doc, max(line) AS n FROM v_md GROUP BY doc), parts AS (SELECT doc, line AS start, title FROM heads WHERE level <= 3 UNION ALL SELECT doc, 1, doc FROM ends WHERE doc NOT IN (SELECT doc FROM heads WHERE level <= 3 AND line = 1)),
 sec AS (SELECT doc, start, coalesce(lead(start) OVER (PARTITION BY doc ORDER BY start) - 1, n) AS stop FROM parts JOIN ends USING (doc)) SELECT sec.doc, start, count(*) AS stale FROM sec JOIN v_md m ON m.doc = sec.doc AND m.line BETWEEN start AND stop AND m.line % 3 = 0 GROUP BY ALL""")
def stale_marks(spark: SparkSession, sf: str) -> DataFrame:
    md = v_md(spark, sf)
    return documents.stale_marks(lines.sections(md), md.filter("line % 3 = 0").withColumn("rule", F.lit("x")))


@query("""WITH l AS (SELECT concat('d', event_id % 7) AS doc, event_id AS line, user_id, event_type, event_id % 2 AS v, epoch(ts)::BIGINT AS epoch FROM events),
 g AS (SELECT user_id, event_type, arg_max((doc, line, v, epoch), (epoch, doc, line)) AS nw FROM l GROUP BY user_id, event_type HAVING count(DISTINCT doc) >= 2 AND count(DISTINCT v) = 2)
 SELECT l.doc, l.line, nw[1] AS other, nw[2] AS other_line FROM l JOIN g USING (user_id, event_type) WHERE l.v <> nw[3] AND l.epoch < nw[4] AND l.doc <> nw[1]""")
def copies_diverged(spark: SparkSession, sf: str) -> DataFrame:
    """The user stands in letters, so that a line's shape names it and its only number is the value."""
    e = table(spark, sf, "events")
    user = F.translate(F.col("user_id").cast("string"), "0123456789", "abcdefghij")
    t = F.concat(F.lit("the user "), user, F.lit(" of this table had an event of the kind "), "event_type", F.lit(" and value "), F.pmod("event_id", F.lit(2)))
    return documents.diverged_copies(e.select(F.concat(F.lit("d"), F.pmod("event_id", F.lit(7))).alias("doc"), F.col("event_id").alias("line"), t.alias("text"), seconds("ts").alias("epoch")))


_IMPACT = with_views("SELECT 1 FROM v_md, v_code").rsplit(" SELECT 1", 1)[0]


@query(with_views("SELECT DISTINCT term FROM (SELECT concat('call_', key // 2) AS term, key FROM v_files) WHERE key % 3 < 2 AND term NOT IN (SELECT concat('call_', key // 2) FROM v_files WHERE key % 3 = 2)"))
def impact_lost_defs(spark: SparkSession, sf: str) -> DataFrame:
    """Two files define each name; two thirds of the files go."""
    d = v_files(spark, sf).select(F.concat(F.lit("call_"), F.expr("key div 2")).alias("term"), "key")
    return documents.lost_terms(d.filter("key % 3 < 2"), d.filter("key % 3 = 2"))


@query(_IMPACT + ", lost AS (SELECT DISTINCT regexp_extract(text, 'def (\\w+)', 1) AS term FROM v_code WHERE line = 1), alive AS (SELECT 'call_3' AS term), tok AS (SELECT DISTINCT doc, line, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS term FROM v_md) SELECT doc, line, term FROM tok WHERE term IN (SELECT term FROM lost) AND term NOT IN (SELECT term FROM alive)")
def impact_hits(spark: SparkSession, sf: str) -> DataFrame:
    lost = v_code(spark, sf).filter("line = 1").select(F.regexp_extract("text", r"def (\w+)", 1).alias("term"))
    return documents.impact(lost, spark.range(1).select(F.lit("call_3").alias("term")), v_md(spark, sf))


@query(_IMPACT + ", tok AS (SELECT DISTINCT doc, line, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS term FROM v_md) SELECT doc, line, term, doc LIKE '%7.md' AS late, row_number() OVER (PARTITION BY doc LIKE '%7.md' ORDER BY doc, line, term) AS place FROM tok WHERE term = 'call_3'")
def impact_order(spark: SparkSession, sf: str) -> DataFrame:
    lost = spark.range(1).select(F.lit("call_3").alias("term"))
    hits = documents.impact(lost, spark.range(0).select(F.lit("").alias("term")), v_md(spark, sf)).withColumn("kind", F.when(F.col("doc").endswith("7.md"), "plan").otherwise("live"))
    return documents.impact_order(hits).select("doc", "line", "term", "late", "place")


@query("""SELECT path, CAST(round_even(length(text) / 4.0, 0) AS BIGINT) AS tokens, 2::BIGINT AS lines, CASE WHEN path LIKE '%/%' THEN 'when working in ' || regexp_extract(path, '^(.*)/', 1) || '/' ELSE 'every session' END AS loaded
 FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN 'AGENTS.md' WHEN 1 THEN concat('pkg', p_size, '/CLAUDE.md') ELSE 'docs/x.md' END AS path, concat(p_name, chr(10), p_type) AS text FROM part) WHERE path <> 'docs/x.md'""")
def agent_cost(spark: SparkSession, sf: str) -> DataFrame:
    of = F.pmod("p_partkey", F.lit(3))
    files = table(spark, sf, "part").select(F.when(of == 0, "AGENTS.md").when(of == 1, F.concat(F.lit("pkg"), "p_size", F.lit("/CLAUDE.md"))).otherwise("docs/x.md").alias("path"), F.concat("p_name", F.lit("\n"), "p_type").alias("text"))
    return documents.agent_cost(files)


@query(with_views("SELECT doc_id, line FROM v_lines WHERE regexp_matches(text, '(?i)\\b(?:removed|deleted|renamed|deprecated|obsolete|legacy|formerly|no longer|used to|replaced|retired|dropped|moved to|was moved|old|do not use|don''t use|never use|avoid)\\b') UNION ALL SELECT -line, line FROM v_md WHERE text LIKE '%removed%'"))
def acknowledged_lines(spark: SparkSession, sf: str) -> DataFrame:
    gone = lambda df: df.filter(text.is_acknowledged(F.col("text")))
    return gone(v_lines(spark, sf)).select("doc_id", "line").union(gone(v_md(spark, sf)).select(-F.col("line"), "line"))


@query(with_views("SELECT kind, count(*) AS n, count(DISTINCT path) AS paths, max(epoch) AS newest FROM v_events GROUP BY kind"))
def event_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return v_events(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("paths"), F.max("epoch").alias("newest"))
