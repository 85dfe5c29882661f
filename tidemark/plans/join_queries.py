"""Queries that join claims with files, code and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ancestors, basename, dirname, glob_regex, normalise, relative, suffixes
from ..operators import history, inventory, resolve
from .registry import query
from .views import table, v_blame, v_claims, v_code, v_events, v_files, with_views


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    return v_claims(spark, sf).select("doc", "line", "target")


@query(with_views("SELECT DISTINCT doc, line, target, CASE WHEN f1.path IS NOT NULL THEN f1.path ELSE f2.path END AS hit, CASE WHEN f1.path IS NOT NULL THEN 0 WHEN f2.path IS NOT NULL THEN 1 END AS rank FROM v_claims LEFT JOIN v_files f1 ON f1.path = 'docs/' || target LEFT JOIN v_files f2 ON f2.path = target"))
def resolve_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.resolve(_claims(spark, sf).distinct(), v_files(spark, sf), F.array(F.lit("docs"), F.lit("")))


@query(with_views("SELECT doc, CAST(sum(CASE WHEN path IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS broken, count(*) AS claims FROM v_claims LEFT JOIN v_files ON path = target GROUP BY doc"))
def link_findings(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.resolve(_claims(spark, sf), v_files(spark, sf), F.array(F.lit(""))).groupBy("doc").agg(F.count_if(F.col("hit").isNull()).alias("broken"), F.count(F.lit(1)).alias("claims"))


_ENDS = "ends AS (SELECT path, array_to_string(list_slice(string_split(lower(path), '/'), n, len(string_split(path, '/'))), '/') AS e FROM v_files, LATERAL (SELECT unnest(range(1, len(string_split(path, '/')) + 1)) AS n))"
_WITH = with_views("SELECT 1 FROM v_claims, v_files").rsplit(" SELECT 1", 1)[0]


@query(f"{_WITH}, {_ENDS} SELECT doc, line, target, count(DISTINCT path) AS hits, min(path) AS first FROM v_claims JOIN ends ON e = lower(target) GROUP BY doc, line, target")
def suffix_join(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.suffix_hits(_claims(spark, sf), v_files(spark, sf))


@query(f"{_WITH}, {_ENDS} SELECT doc, line, target, min(path) AS suggestion FROM v_claims JOIN ends ON e = lower(target) GROUP BY doc, line, target HAVING count(DISTINCT path) = 1")
def elsewhere_suggestion(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.elsewhere(_claims(spark, sf), v_files(spark, sf))


@query(with_views("SELECT doc, line, target, path AS spelled FROM v_claims JOIN v_files ON lower(path) = lower(target) AND path <> target"))
def case_join(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.case_hits(_claims(spark, sf), v_files(spark, sf))


@query(with_views("SELECT doc, line, target FROM v_claims WHERE target NOT IN (SELECT path FROM v_files)"))
def missing_anti(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.missing(_claims(spark, sf), v_files(spark, sf)).select("doc", "line", "target")


def _misspelled(spark: SparkSession, sf: str) -> DataFrame:
    return v_files(spark, sf).select(F.concat(dirname(F.col("path")), F.lit("/"), F.substring(basename(F.col("path")), 2, 200)).alias("target"))


_MISSPELLED = "bad AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, substr(regexp_extract(path, '([^/]*)$', 1), 2) AS wanted FROM v_files), here AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name FROM v_files)"


@query(f"{_WITH}, {_MISSPELLED} SELECT dir || '/' || wanted AS target, arg_min(name, levenshtein(wanted, name) || name) AS name, min(levenshtein(wanted, name)) AS distance FROM bad JOIN here USING (dir) WHERE levenshtein(wanted, name) <= 2 GROUP BY ALL")
def near_typo_edit(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.edit_near(_misspelled(spark, sf), v_files(spark, sf))


@query()
def near_typo(spark: SparkSession, sf: str) -> DataFrame:
    """Ratcliff/Obershelp similarity has no SQL; tests compare with difflib."""
    return resolve.near_names(_misspelled(spark, sf), v_files(spark, sf))


_HOLDERS = "holders AS (SELECT concat('src/', lower(replace(p_type, ' ', '/'))) AS folder, min(p_size) AS version FROM part WHERE p_size % 3 = 0 GROUP BY 1 UNION ALL SELECT 'src', 0)"


def _holders(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "part").filter("p_size % 3 = 0").groupBy(F.concat(F.lit("src/"), F.lower(F.replace("p_type", F.lit(" "), F.lit("/")))).alias("folder")).agg(F.min("p_size").alias("version"))
    return own.unionByName(spark.range(1).select(F.lit("src").alias("folder"), F.lit(0).alias("version")))


@query(f"{_WITH}, {_HOLDERS} SELECT path, arg_max(folder, length(folder)) AS folder, arg_max(version, length(folder)) AS version FROM v_files JOIN holders ON starts_with(path, folder || '/') GROUP BY path")
def nearest_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.deepest(v_files(spark, sf).select("path"), "path", _holders(spark, sf), "folder")


@query(f"{_WITH}, {_HOLDERS}, pins AS (SELECT concat('src/', lower(replace(p_type, ' ', '/')), '/x.md') AS doc, p_size AS spec, p_partkey FROM part) SELECT p_partkey, doc, spec, arg_max(version, length(folder)) AS version FROM pins JOIN holders ON starts_with(doc, folder || '/') GROUP BY ALL HAVING arg_max(version, length(folder)) <> spec")
def dep_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    pins = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("src/"), F.lower(F.replace("p_type", F.lit(" "), F.lit("/"))), F.lit("/x.md")).alias("doc"), F.col("p_size").alias("spec"))
    return resolve.deepest(pins, "doc", _holders(spark, sf), "folder").filter("version <> spec").drop("folder")


_CODE = with_views("SELECT 1 FROM v_code").rsplit(" SELECT 1", 1)[0]


@query(f"{_CODE}, names AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM v_code) SELECT o_orderkey, concat('call_', o_orderkey % 13) AS name FROM orders WHERE concat('call_', o_orderkey % 13) NOT IN (SELECT name FROM names)")
def symbol_anti(spark: SparkSession, sf: str) -> DataFrame:
    names = v_code(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1)).alias("name"))
    claims = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("call_"), F.pmod("o_orderkey", F.lit(13))).alias("name"))
    return resolve.unknown_symbols(claims, names).select("o_orderkey", "name")


@query(_CODE + """, claims AS (SELECT DISTINCT concat('build_', o_orderkey % 40, '_', o_custkey) AS name FROM orders),
 t AS (SELECT DISTINCT replace(regexp_extract(text, 'f.(build[^'']*).', 1), '{x}', '[0-9]+') AS pattern FROM v_code WHERE line = 1) SELECT name, pattern FROM claims JOIN t ON regexp_full_match(name, pattern)""")
def template_match(spark: SparkSession, sf: str) -> DataFrame:
    claims = table(spark, sf, "orders").select(F.concat(F.lit("build_"), F.pmod("o_orderkey", F.lit(40)), F.lit("_"), "o_custkey").alias("name")).distinct()
    made = v_code(spark, sf).filter("line = 1").select(F.replace(F.regexp_extract("text", "f.(build[^']*).", 1), F.lit("{x}"), F.lit("[0-9]+")).alias("pattern")).distinct()
    return resolve.template_hits(claims, made)


@query(f"{_CODE} SELECT rule, path, line, text FROM (SELECT 'todo' AS rule, path, line, text, row_number() OVER (ORDER BY path, line) AS n FROM v_code WHERE regexp_matches(text, 'TODO .*7') UNION ALL SELECT 'flag', path, line, text, row_number() OVER (ORDER BY path, line) FROM v_code WHERE regexp_matches(path, '(?i)^src/promo/.*') AND regexp_matches(text, '--flag3')) WHERE n <= 50")
def forbid_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([("todo", glob_regex("**"), "TODO .*7"), ("flag", glob_regex("/src/promo/"), "--flag3")], "rule string, glob string, pattern string")
    return resolve.rule_hits(rules, v_code(spark, sf))


@query("""WITH docs AS (SELECT concat('web/', CASE p_size % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'de' ELSE 'guide' END, '/', lower(replace(p_name, ' ', '_')), '.md') AS path FROM part GROUP BY 1),
 v AS (SELECT substr(a.path, 1, 6) AS root, 'web/guide/' AS source, count(DISTINCT a.path) AS votes FROM docs a JOIN docs b ON substr(b.path, 11) = substr(a.path, 8) AND b.path LIKE 'web/guide/%' WHERE NOT a.path LIKE 'web/guide/%' GROUP BY 1) SELECT * FROM v WHERE votes >= 2""")
def mirror_vote(spark: SparkSession, sf: str) -> DataFrame:
    tree = F.when(F.pmod("p_size", F.lit(3)) == 0, "fr").when(F.pmod("p_size", F.lit(3)) == 1, "de").otherwise("guide")
    docs = table(spark, sf, "part").select(F.concat(F.lit("web/"), tree, F.lit("/"), F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit(".md")).alias("path")).distinct()
    return resolve.mirror_votes(docs, ["fr", "de"])


@query("""WITH a AS (SELECT url AS target, lower(regexp_replace(unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)), '[^\\p{L}\\p{N}]', '', 'g')) AS s FROM pages),
 l AS (SELECT doc_id AS doc, p.url AS target, regexp_extract(text, '^(\\S+)', 1) AS anchor FROM documents JOIN pages p ON p.page_id = doc_id % (SELECT count(*) FROM pages))
 SELECT doc, target, anchor FROM l WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.target = l.target AND s = lower(regexp_replace(anchor, '[^\\p{L}\\p{N}]', '', 'g')))""")
def anchor_check(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    anchors = pages.select(F.col("url").alias("path"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("anchor"))
    counted = table(spark, sf, "documents").join(F.broadcast(pages.agg(F.count(F.lit(1)).alias("n"))))  # one row
    links = counted.join(pages, F.col("page_id") == F.pmod("doc_id", F.col("n"))).select(F.col("doc_id").alias("doc"), F.col("url").alias("target"), F.regexp_extract("text", r"^(\S+)", 1).alias("anchor"))
    return resolve.anchor_findings(links, anchors)


@query("""WITH RECURSIVE i AS (SELECT DISTINCT n_nationkey AS page, (n_nationkey * 3 + 1) % 25 AS part FROM nation UNION SELECT n_nationkey, n_regionkey FROM nation),
 reach AS (SELECT page, part FROM i WHERE page <> part UNION SELECT r.page, i.part FROM reach r JOIN i ON i.page = r.part) SELECT DISTINCT page, part FROM reach WHERE page <> part""")
def import_closure(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    edges = n.select(F.col("n_nationkey").alias("page"), F.pmod(F.col("n_nationkey") * 3 + 1, F.lit(25)).alias("part")).union(n.select("n_nationkey", "n_regionkey")).distinct()
    return resolve.import_closure(edges)


@query(with_views("SELECT doc, line, path, written, (SELECT arg_max(kind, (epoch, \"commit\")) FROM v_events e WHERE e.path = b.path AND e.epoch <= b.written) AS state FROM v_blame b"))
def file_at_asof(spark: SparkSession, sf: str) -> DataFrame:
    return history.state_as_of(v_blame(spark, sf), v_events(spark, sf))


@query(with_views("SELECT path, max(epoch) AS epoch, arg_max(\"commit\", (epoch, \"commit\")) AS \"commit\" FROM v_events WHERE kind <> 'D' GROUP BY path"))
def last_seen(spark: SparkSession, sf: str) -> DataFrame:
    return history.last_seen(v_events(spark, sf))


@query(with_views("SELECT b.doc, b.line, b.path, b.written, min(e.epoch) AS gone, arg_min(e.\"commit\", (e.epoch, e.\"commit\")) AS gone_commit FROM v_blame b JOIN v_events e ON e.path = b.path AND e.kind = 'D' AND e.epoch > b.written GROUP BY ALL"))
def gone_by(spark: SparkSession, sf: str) -> DataFrame:
    return history.gone_by(v_blame(spark, sf), v_events(spark, sf))


@query(with_views("SELECT path, arg_max(kind, (epoch, \"commit\")) <> 'D' AS alive FROM v_events GROUP BY path"))
def current_state(spark: SparkSession, sf: str) -> DataFrame:
    return history.current_state(v_events(spark, sf))


@query("SELECT old, arg_min(new, (-moves, new)) AS new, max(moves) AS moves FROM (SELECT concat('n', c_nationkey) AS old, lower(c_mktsegment) AS new, count(*) AS moves FROM customer GROUP BY ALL) GROUP BY old")
def rename_majority(spark: SparkSession, sf: str) -> DataFrame:
    return history.majority_renames(table(spark, sf, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("old"), F.lower("c_mktsegment").alias("new")))


@query(with_views("""SELECT folder, departures, "returns" FROM (SELECT folder, departures, CAST(sum(CASE WHEN came > first THEN 1 ELSE 0 END) AS BIGINT) AS "returns" FROM (SELECT *, min(gone) OVER (PARTITION BY folder) AS first FROM
  (SELECT substr(path, 1, 6) AS folder, path, max(CASE WHEN kind = 'A' THEN epoch END) AS came, min(CASE WHEN kind = 'D' THEN epoch END) AS gone FROM v_events GROUP BY ALL)) JOIN (SELECT folder, count(DISTINCT gone) AS departures FROM (SELECT substr(path, 1, 6) AS folder, path, min(CASE WHEN kind = 'D' THEN epoch END) AS gone FROM v_events GROUP BY ALL) GROUP BY folder) USING (folder) GROUP BY folder, departures) WHERE departures >= 3 AND "returns" >= 2"""))
def work_queue(spark: SparkSession, sf: str) -> DataFrame:
    return history.work_queues(v_events(spark, sf).withColumn("folder", F.substring("path", 1, 6)))


@query(with_views("""SELECT doc, count(*) AS refs, CAST(sum(CASE WHEN epoch > t + 86400 THEN 1 ELSE 0 END) AS BIGINT) AS newer, array_to_string(list_slice(list(path ORDER BY epoch DESC, path) FILTER (epoch > t + 86400), 1, 3), ', ') AS examples
  FROM (SELECT DISTINCT doc, path FROM v_blame) r JOIN (SELECT path, max(epoch) AS epoch FROM v_events GROUP BY path) e USING (path) JOIN (SELECT doc, min(written) AS t FROM v_blame GROUP BY doc) d USING (doc) GROUP BY doc HAVING newer > 0"""))
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    refs = v_blame(spark, sf)
    touched = history.last_times(v_events(spark, sf)).unionByName(refs.groupBy(F.col("doc").alias("path")).agg(F.min("written").alias("epoch")))
    return history.freshness(refs.select("doc", "path"), touched)


@query("""WITH v AS (SELECT user_id, event_id AS epoch, list_distinct([event_type, 'n' || CAST(event_id % 5 AS VARCHAR)]) AS names, lag(list_distinct([event_type, 'n' || CAST(event_id % 5 AS VARCHAR)])) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
 SELECT concat('u', user_id) AS path, name, max(epoch) AS epoch FROM (SELECT user_id, epoch, names, unnest(b) AS name FROM v) WHERE NOT list_contains(names, name) GROUP BY ALL""")
def removed_by(spark: SparkSession, sf: str) -> DataFrame:
    versions = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("event_id").alias("epoch"), F.array("event_type", F.concat(F.lit("n"), F.pmod("event_id", F.lit(5)))).alias("names"))
    return history.removals(versions)


@query(with_views("SELECT path, max(epoch) AS epoch FROM v_events GROUP BY path"))
def last_touch(spark: SparkSession, sf: str) -> DataFrame:
    return history.last_times(v_events(spark, sf))


@query(with_views("SELECT path, array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS ancestor FROM v_files, LATERAL (SELECT unnest(range(0, len(string_split(path, '/')))) AS n)"))
def ancestor_explode(spark: SparkSession, sf: str) -> DataFrame:
    return v_files(spark, sf).select("path", F.explode(ancestors(F.col("path"))).alias("ancestor"))


@query(with_views("SELECT path, array_to_string(list_slice(string_split(path, '/'), n, len(string_split(path, '/'))), '/') AS suffix FROM v_files, LATERAL (SELECT unnest(range(1, len(string_split(path, '/')) + 1)) AS n)"))
def suffix_explode(spark: SparkSession, sf: str) -> DataFrame:
    return v_files(spark, sf).select("path", F.explode(suffixes(F.col("path"))).alias("suffix"))


@query(with_views("SELECT path, 'src/' || regexp_extract(path, '([^/]*)$', 1) AS normal, '../' || substr(path, 5) AS seen FROM v_files"))
def path_normalise(spark: SparkSession, sf: str) -> DataFrame:
    name = basename(F.col("path"))
    return v_files(spark, sf).select("path", normalise(F.concat(F.lit("./src//x/../"), name)).alias("normal"), relative(F.col("path"), F.lit("src/docs")).alias("seen"))


@query(with_views("SELECT path FROM v_files WHERE path NOT IN (SELECT path FROM v_files WHERE key % 4 = 0) UNION ALL SELECT regexp_replace(path, '\\.py$', '.html') FROM v_files WHERE key % 4 > 1"))
def rendered_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    f = v_files(spark, sf)
    page = F.regexp_replace("path", r"\.py$", ".html")
    tree = f.filter("key % 4 <> 0").select("path").union(f.select(page)).union(f.filter("key % 4 < 2").select(F.regexp_replace("path", r"\.py$", ".md")))
    return inventory.without_rendered(tree).filter("path NOT LIKE '%.md'")
