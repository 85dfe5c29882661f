"""Queries over proof by history, vetoes, places and changes of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages
from ..operators import places, verdicts
from .registry import query
from .rule_queries import _RAISED, _printed
from .views import seconds, table, v_blame, v_events, v_files, with_views

_JUDGED = with_views("SELECT 1 FROM v_blame, v_events").rsplit(" SELECT 1", 1)[0] + """, q AS (SELECT doc, line, path, CASE WHEN line % 10 = 0 THEN NULL ELSE written END AS written FROM v_blame),
 p AS (SELECT path, arg_max(kind, (epoch, "commit")) <> 'D' AS now, bool_or(kind <> 'D') AS ever FROM v_events GROUP BY path),
 j AS (SELECT q.*, coalesce(now, false) AS now, coalesce(ever, false) AS ever, CASE WHEN written IS NOT NULL THEN coalesce((SELECT arg_max(kind, (epoch, "commit")) FROM v_events e WHERE e.path = q.path AND e.epoch <= q.written) <> 'D', false) END AS was FROM q LEFT JOIN p USING (path)) """


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that name a path; one in ten is not committed."""
    return v_blame(spark, sf).withColumn("written", F.when(F.col("line") % 10 != 0, F.col("written")))


@query(_JUDGED + """, r AS (SELECT *, CASE WHEN was IS NULL AND now THEN 'path-removed-now' WHEN was THEN 'path-moved' WHEN ever THEN 'path-gone' ELSE 'path-missing' END AS rule FROM j WHERE NOT now OR was IS NULL)
 SELECT doc, line, path, rule, CASE rule WHEN 'path-removed-now' THEN 'error' WHEN 'path-moved' THEN CASE WHEN line % 3 = 0 THEN 'info' ELSE 'error' END WHEN 'path-gone' THEN CASE WHEN line % 3 = 0 THEN 'info' ELSE 'warning' END ELSE CASE WHEN doc LIKE '%1.md' THEN 'warning' ELSE 'info' END END AS severity FROM r""")
def path_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    judged = verdicts.against_history(_questions(spark, sf), v_events(spark, sf)).filter("NOT now OR then IS NULL")
    marked = judged.withColumns({"names_target": F.col("line") % 3 == 0, "agent": F.col("doc").endswith("1.md")})
    return verdicts.path_rules(marked).select("doc", "line", "path", "rule", "severity")


@query(_JUDGED + "SELECT doc, line, path, 'command-missing' AS rule, CASE WHEN coalesce(was, false) THEN 'error' ELSE 'warning' END AS severity FROM j WHERE NOT now AND (coalesce(was, false) OR doc LIKE '%2.md')")
def command_missing(spark: SparkSession, sf: str) -> DataFrame:
    judged = verdicts.against_history(_questions(spark, sf), v_events(spark, sf)).filter("NOT now").withColumn("folder_there", F.col("doc").endswith("2.md"))
    return verdicts.command_rules(judged).select("doc", "line", "path", "rule", "severity")


@query("""WITH e AS (SELECT user_id, event_id, event_id % 5 AS n, floor(epoch(ts))::BIGINT AS epoch FROM events), last AS (SELECT user_id, arg_max(n, (epoch, event_id)) AS now FROM e GROUP BY user_id),
 q AS (SELECT *, (SELECT arg_max(b.n, (b.epoch, b.event_id)) FROM e b WHERE b.user_id = e.user_id AND b.epoch <= e.epoch) AS was FROM e)
 SELECT event_id AS line, 'u' || user_id || '_n' || n AS name, 'symbol-gone' AS rule FROM q JOIN last USING (user_id) WHERE was = n AND now <> n""")
def symbol_gone(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    name = lambda part: F.concat(F.lit("u"), "user_id", F.lit("_"), part)
    number = name(F.concat(F.lit("n"), F.pmod("event_id", F.lit(5))))
    blobs = e.select(F.concat(F.lit("u"), "user_id").alias("path"), seconds("ts").alias("epoch"), F.col("event_id").alias("commit"), F.array(name(F.col("event_type")), number).alias("names"))
    asked = e.select(F.col("event_id").alias("line"), number.alias("path"), seconds("ts").alias("written"))
    return verdicts.gone_names(asked, verdicts.name_events(blobs), "symbol-gone", "symbol-removed-now").select("line", F.col("path").alias("name"), "rule")


_FLAGS = """WITH e AS (SELECT 'tools/u' || (user_id % 40) || '.py' AS script, '--' || event_type AS flag, event_id, floor(epoch(ts))::BIGINT AS epoch, CASE WHEN event_id % 3 = 0 THEN 'D' ELSE 'A' END AS kind FROM events),
 now AS (SELECT script, flag, arg_max(kind, (epoch, event_id)) AS now FROM e GROUP BY ALL)"""


@query(_FLAGS + """ SELECT 'd' AS doc, event_id AS line, script, flag, 'flag-removed' AS rule, CASE WHEN script LIKE '%1.py' THEN 'warning' ELSE 'info' END AS severity FROM e JOIN now USING (script, flag)
 WHERE now = 'D' AND (SELECT arg_max(b.kind, (b.epoch, b.event_id)) FROM e b WHERE b.script = e.script AND b.flag = e.flag AND b.epoch <= e.epoch) = 'A'""")
def flag_removed(spark: SparkSession, sf: str) -> DataFrame:
    script = F.concat(F.lit("tools/u"), F.pmod("user_id", F.lit(40)), F.lit(".py"))
    e = table(spark, sf, "events").select(script.alias("script"), F.concat(F.lit("--"), "event_type").alias("flag"), seconds("ts").alias("epoch"), F.col("event_id").alias("commit"), F.when(F.col("event_id") % 3 == 0, "D").otherwise("A").alias("kind"))
    asked = e.select(F.lit("d").alias("doc"), F.col("commit").alias("line"), "script", "flag", F.col("epoch").alias("written"))
    return verdicts.removed_flags(asked, e, e.filter(F.col("script").endswith("1.py")).select(F.col("script").alias("path")))


@query("SELECT DISTINCT 'd' || event_id % 9 AS doc, event_id AS line, 'u' || user_id || '.py' AS target, 'src/u' || user_id || '.py' AS path FROM events WHERE event_type = 'purchase'")
def ever_existed(spark: SparkSession, sf: str) -> DataFrame:
    claims = table(spark, sf, "events").filter("event_type = 'purchase'").select(F.concat(F.lit("d"), F.pmod("event_id", F.lit(9))).alias("doc"), F.col("event_id").alias("line"), F.concat(F.lit("u"), "user_id", F.lit(".py")).alias("target"))
    return verdicts.ever_existed(claims, v_events(spark, sf))


@query("SELECT p_name AS path, 'f' || p_partkey AS name, 'p' || p_size AS package FROM part WHERE p_size % 3 <> 0 AND p_size % 2 = 0")
def package_left(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("package", F.concat(F.lit("p"), "p_size"))
    names = p.select(F.col("p_name").alias("path"), F.concat(F.lit("f"), "p_partkey").alias("name"), "package")
    return verdicts.package_left(names, p.select("package", (F.col("p_size") % 3 == 0).alias("alive")), p.filter("p_size % 2 = 0").select("package"))


@query("""WITH b AS (SELECT user_id % 5 AS rev, 'f' || user_id AS path, event_id AS line, event_type AS name, event_id % 4 = 0 AS defined FROM events)
 SELECT rev, name, (arg_min((path, line), (NOT defined, path, line)))[1] AS path, (arg_min((path, line), (NOT defined, path, line)))[2] AS line, bool_or(defined) AS defined FROM b GROUP BY rev, name""")
def words_at_commit(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("rev", F.pmod("user_id", F.lit(5)))
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("def "), "event_type", F.lit("(x):"))).otherwise(F.concat(F.lit("run("), "event_type", F.lit(")")))
    blobs = e.select("rev", F.concat(F.lit("f"), "user_id").alias("path"), F.col("event_id").alias("line"), text.alias("text"))
    return verdicts.words_at(blobs, e.select("rev", F.col("event_type").alias("name")))


@query("""WITH v AS (SELECT user_id, event_id AS epoch, list_distinct([event_type, 'h' || event_id % 4]) AS h, lag(list_distinct([event_type, 'h' || event_id % 4])) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
 SELECT 'docs/u' || user_id || '.md' AS path, heading, max(epoch) AS epoch FROM (SELECT user_id, epoch, h, unnest(b) AS heading FROM v) WHERE NOT list_contains(h, heading) GROUP BY ALL""")
def lost_headings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return verdicts.lost_headings(e.select(F.concat(F.lit("docs/u"), "user_id", F.lit(".md")).alias("path"), F.col("event_id").alias("epoch"), F.array("event_type", F.concat(F.lit("h"), F.pmod("event_id", F.lit(4)))).alias("headings")))


@query(with_views("SELECT key, path, key % 6 = 3 AS told FROM v_files"))
def path_missing_guard(spark: SparkSession, sf: str) -> DataFrame:
    k = F.pmod("key", F.lit(6))
    before = F.when(k == 0, "For example, see ").when(k == 1, "First create the file ").when(k == 2, "There does not exist a ").when(k == 3, "See the file ").when(k == 4, "It was formerly in ").otherwise("If present, read ")
    return v_files(spark, sf).select("key", "path", verdicts.may_be_told(F.concat(before, "path"), F.col("path")).alias("told"))


_TRANSLATED = "CASE p_partkey % 5 WHEN 0 THEN 'd' || p_partkey || '/README-ja.md' WHEN 1 THEN 'd' || p_partkey || '/fr/a.md' WHEN 2 THEN 'e/fr/' || p_partkey || '.md' WHEN 3 THEN 'e/pt-br/' || p_partkey || '.md' ELSE 'f/' || p_partkey || '.md' END"


@query(f"SELECT path FROM (SELECT {_TRANSLATED} AS path, p_partkey % 5 AS k FROM part) WHERE k IN (0, 2, 3)")
def translated_pages(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.translated_pages(table(spark, sf, "part").select(F.expr(_TRANSLATED).alias("path")))


@query("SELECT p_partkey AS key, p_partkey % 4 = 0 AS route, p_partkey % 3 = 0 AS template FROM part")
def link_vetoes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    dest = F.when(k % 4 == 0, F.concat(F.lit("../../issues/"), k, F.lit("?x#y"))).when(k % 4 == 1, F.concat(F.lit("../issues/"), k)).when(k % 4 == 2, F.concat(F.lit("../../other/"), k)).otherwise("issues/1")
    folder = F.when(k % 3 == 0, "a/Templates/x.md").when(k % 3 == 1, "templates.md").otherwise("a/b/x.md")
    return table(spark, sf, "part").select(k.alias("key"), verdicts.is_web_route(F.lit("docs/a.md"), dest).alias("route"), verdicts.in_template_folder(folder).alias("template"))


@query("SELECT p_partkey AS key, p_partkey % 6 IN (0, 1, 3) AS identifier, p_partkey % 2 = 0 AS named FROM part")
def name_tests(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    word = F.when(k % 6 == 0, "run_all").when(k % 6 == 1, "runAll").when(k % 6 == 2, "Running").when(k % 6 == 3, "MAXSIZE").when(k % 6 == 4, "MAX").otherwise("run all")
    line = F.when(k % 4 == 0, "moved to `src/new_place.py`.").when(k % 4 == 2, "now (new_place.py)").when(k % 4 == 1, "see my_new_place.pyc").otherwise("gone")
    return table(spark, sf, "part").select(k.alias("key"), verdicts.identifier_like(word).alias("identifier"), verdicts.names_target(line, F.lit("src/new_place.py")).alias("named"))


@query("SELECT 'd' || p_partkey AS doc, 1 AS line, 'out/' || p_partkey || '.bin' AS target FROM part WHERE p_partkey % 3 < 2")
def code_string_paths(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("open('out/"), k, F.lit(".bin')"))).when(k % 3 == 1, F.concat(F.lit('join(d, "'), k, F.lit('.bin")'))).otherwise(F.concat(F.lit("# out/"), k, F.lit(".bin")))
    claims = p.select(F.concat(F.lit("d"), k).alias("doc"), F.lit(1).alias("line"), F.concat(F.lit("out/"), k, F.lit(".bin")).alias("target"))
    return verdicts.in_code_strings(claims, verdicts.code_strings(p.select(text.alias("text"))))


@query(with_views("SELECT 'd' AS doc, key AS line, CASE key % 3 WHEN 0 THEN replace(regexp_replace(path, '\\.py$', ''), '/', '.') WHEN 1 THEN replace(regexp_replace(substr(path, 5), '\\.py$', ''), '/', '.') ELSE 'no.' || key END AS module, CASE WHEN key % 3 < 2 THEN path END AS path FROM v_files"))
def module_variants(spark: SparkSession, sf: str) -> DataFrame:
    f = v_files(spark, sf)
    dotted = lambda c: F.replace(F.regexp_replace(c, r"\.py$", ""), F.lit("/"), F.lit("."))
    module = F.when(F.col("key") % 3 == 0, dotted(F.col("path"))).when(F.col("key") % 3 == 1, dotted(F.substring("path", 5, 500))).otherwise(F.concat(F.lit("no."), "key"))
    return verdicts.module_files(f.select(F.lit("d").alias("doc"), F.col("key").alias("line"), module.alias("module")), f)


@query("SELECT o_orderkey AS doc, 1 AS line, 'p' || o_orderkey % 4 AS folder, 't' || o_orderkey % 6 AS target, 'make-target-missing' AS rule, 'error' AS severity FROM orders WHERE (o_orderkey % 4 = 0 AND o_orderkey % 6 > 1) OR o_orderkey % 4 = 2")
def make_target_missing(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame([("p0", "t0"), ("p0", "t1"), ("p1", "t%"), ("p2", "x")], "folder string, target string")
    of = lambda a, k: F.concat(F.lit(a), F.pmod("o_orderkey", F.lit(k)))
    return verdicts.unknown_targets(table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(1).alias("line"), of("p", 4).alias("folder"), of("t", 6).alias("target")), known)


@query("SELECT 'pkg' || p_size || '/README.md' AS doc, p_partkey AS line, '1.' || p_size % 4 || '.0' AS version, '1.' || p_size % 3 || '.0' AS real, 'version-mismatch' AS rule, 'warning' AS severity FROM part WHERE p_size % 4 <> p_size % 3")
def version_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    of = lambda k: F.concat(F.lit("1."), F.pmod("p_size", F.lit(k)), F.lit(".0"))
    heads = p.select(F.concat(F.lit("pkg"), "p_size", F.lit("/README.md")).alias("doc"), F.col("p_partkey").alias("line"), of(4).alias("version"))
    return verdicts.version_mismatches(heads, p.select(F.concat(F.lit("pkg"), "p_size").alias("folder"), of(3).alias("version")))


@query("SELECT p_partkey AS rule, p_size % 4 = 1 AS fine FROM part")
def rule_invalid(spark: SparkSession, sf: str) -> DataFrame:
    k = F.pmod("p_size", F.lit(4))
    rules = table(spark, sf, "part").select(F.col("p_partkey").alias("rule"), F.when(k < 3, "**").otherwise("").alias("glob"), F.when(k == 0, "(a").when(k == 2, F.lit(None)).otherwise("a+").alias("pattern"))
    return verdicts.valid_rules(rules).select("rule", "fine")


_SITE = "SELECT 'docs/' || lower(replace(p_brand, '#', '')) || '/' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.md' ELSE '/index.mdx' END AS path, p_partkey AS key, p_brand FROM part"


@query(f"""WITH f AS ({_SITE} UNION ALL SELECT 'a_old/' || lower(replace(p_brand, '#', '')) || '/' || p_partkey || '/README.md', p_partkey, p_brand FROM part WHERE p_partkey % 5 = 0)
 SELECT 'd' AS doc, key AS line, '/' || lower(replace(p_brand, '#', '')) || '/' || key || '/#top' AS dest, min(path) AS page, count(*) > 1 AS far FROM f GROUP BY key, p_brand""")
def site_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumns({"brand": F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), "k": F.col("p_partkey")})
    pages = p.select(F.concat(F.lit("docs/"), "brand", F.lit("/"), "k", F.when(F.col("k") % 2 == 0, ".md").otherwise("/index.mdx")).alias("path"))
    pages = pages.union(p.filter("k % 5 = 0").select(F.concat(F.lit("a_old/"), "brand", F.lit("/"), "k", F.lit("/README.md"))))
    links = p.select(F.lit("d").alias("doc"), F.col("k").alias("line"), F.concat(F.lit("/"), "brand", F.lit("/"), "k", F.lit("/#top")).alias("dest")).filter(places.is_site_address(F.col("dest")))
    return places.site_pages(links, pages)


@query("""SELECT doc, min(line) AS line, count(*) AS links, string_agg(dest, ', ' ORDER BY line) FILTER (n <= 3) AS examples FROM
 (SELECT 'g' || o_custkey // 10 AS doc, o_orderkey AS line, '/g/' || o_orderkey || '/' AS dest, row_number() OVER (PARTITION BY o_custkey // 10 ORDER BY o_orderkey) AS n FROM orders) GROUP BY doc""")
def link_unverified(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return places.collapsed_site_links(o.select(F.concat(F.lit("g"), F.expr("o_custkey div 10")).alias("doc"), F.col("o_orderkey").alias("line"), F.concat(F.lit("/g/"), "o_orderkey", F.lit("/")).alias("dest")))


@query("SELECT 'w' || p_size || '/docs/a.md' AS doc, p_partkey AS line, '/img/' || p_partkey || '.png' AS target, 'w' || p_size || '/static/img/' || p_partkey || '.png' AS path FROM part WHERE p_size % 2 = 0 AND p_partkey % 5 <> 0")
def site_roots(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    folder = F.concat(F.lit("w"), "p_size")
    target = F.when(F.col("p_partkey") % 5 == 0, "../../../up.png").otherwise(F.concat(F.lit("/img/"), "p_partkey", F.lit(".png")))
    claims = p.select(F.concat(folder, F.lit("/docs/a.md")).alias("doc"), F.col("p_partkey").alias("line"), target.alias("target"))
    return places.site_roots(claims, p.filter("p_size % 2 = 0").select(folder.alias("folder")).distinct()).select("doc", "line", "target", "path")


@query("SELECT 'docs/a/x' || p_partkey || '.mdx' AS page, 'docs/p' || p_partkey || '.mdx' AS part FROM part WHERE p_partkey % 2 = 0")
def page_imports(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 2 == 0, F.concat(F.lit("import P from '../p"), k, F.lit(".mdx';"))).otherwise("import { x } from 'lib.mdx'")
    return places.page_imports(table(spark, sf, "part").select(F.concat(F.lit("docs/a/x"), k, F.lit(".mdx")).alias("doc"), F.lit(1).alias("line"), text.alias("text")))


@query("""WITH f AS (SELECT p_partkey % 10 AS d, CASE WHEN p_partkey % 3 = 0 THEN 'lib' ELSE 'src' END AS base FROM part), v AS (SELECT 'd' || d AS doc, 'app' AS top, base, count(*) AS hits FROM f GROUP BY ALL)
 SELECT doc, top, arg_min(base, (-hits, base)) AS base, max(hits) AS hits FROM v GROUP BY doc, top""")
def tree_reroot(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    own = F.concat(F.lit("app/f"), "p_partkey", F.lit(".py"))
    entries = p.select(F.concat(F.lit("d"), F.pmod("p_partkey", F.lit(10))).alias("doc"), F.lit("app").alias("top"), own.alias("path"))
    return places.rerooted(entries, p.select(F.concat(F.when(F.col("p_partkey") % 3 == 0, "lib/").otherwise("src/"), own).alias("path")))


@query("""SELECT CASE k WHEN 0 THEN 'moved/' || p_partkey WHEN 3 THEN 'new/' || p_partkey ELSE 'f' || p_partkey END AS path, CASE k WHEN 0 THEN 'R' WHEN 1 THEN 'D' WHEN 2 THEN 'M' ELSE 'A' END AS kind, CASE WHEN k = 0 THEN 'f' || p_partkey END AS other FROM (SELECT *, p_partkey % 7 AS k FROM part) WHERE k < 4""")
def tree_changes(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.concat(F.lit("f"), "p_partkey").alias("path"), F.concat(F.lit("h"), "p_partkey").alias("digest"), F.pmod("p_partkey", F.lit(7)).alias("k"), F.col("p_partkey").cast("string").alias("n"))
    path = F.when(F.col("k") == 0, F.concat(F.lit("moved/"), "n")).otherwise(F.col("path"))
    after = p.filter("k <> 1").select(path.alias("path"), F.when(F.col("k") == 2, F.concat(F.lit("x"), "n")).otherwise(F.col("digest")).alias("digest"))
    after = after.union(p.filter("k = 3").select(F.concat(F.lit("new/"), "n"), F.concat(F.lit("y"), "n")))
    return places.tree_changes(p.select("path", "digest"), after)


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'src/o' || o_orderkey || '.py' ELSE 'a/' || o_orderkey || '.md' END AS path FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT o_orderkey, 'b/x.md' FROM orders WHERE o_orderkey % 3 = 1")
def edited_paths(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    payload = (
        F.when(k % 3 == 0, F.concat(F.lit('{"tool":"edit","input":{"deep":[{"file_path": "src/o'), k, F.lit('.py"}]}}')))
        .when(k % 3 == 1, F.concat(F.lit('{"patch":"*** Begin Patch\\n*** Update File: a/'), k, F.lit('.md\\n@@\\n*** Move to: b/x.md\\n"}')))
        .otherwise('{"tool":"read","pattern":"x"}')
    )
    return places.edited_paths(table(spark, sf, "orders").select(k.alias("id"), payload.alias("payload")))


def _case(lang: int) -> str:
    rows = "".join(f" WHEN '{rule}' THEN '{texts[lang]}'" for rule, texts in messages.MESSAGES.items() if rule in ("path-gone", "table-shape", "link-broken"))
    return f"replace(CASE rule{rows} END, '{{}}', claim)"


@query(_RAISED + f"SELECT path, line, {_case(0)} AS en, {_case(1)} AS vi FROM printed")
def finding_messages(spark: SparkSession, sf: str) -> DataFrame:
    return _printed(spark, sf).select("path", "line", *(messages.message(F.col("rule"), F.col("claim"), x).alias(x) for x in ("en", "vi")))
