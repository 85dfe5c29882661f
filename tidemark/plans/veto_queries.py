"""Queries over what speaks against telling a path: vetoes by words, and pages that have their readers clone another project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vetoes
from .registry import query
from .views import table, v_files, with_views

_SAID = ["See ", "For example, see ", "Create the file ", "There is no such file as ", "It was replaced by ", "In v1.2 - v1.3 it was ", "You can configure ", "allowRead lists ", "If the project has one, read ", "Hồi đó là ", "It renders and copies all to ", "Trước đây là "]
_WHY = [None, "example", "made-later", "denied", "gone", "past", "reader-may", "access-list", "other-trees", "past", "build-output", "gone"]
_CASES = " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(_WHY) if w)


@query(with_views(f"""SELECT key, path, CASE WHEN key % 7 = 0 THEN 'not-live' ELSE CASE key % 12 {_CASES} END END AS veto,
 CASE WHEN key % 7 = 0 THEN 'skipped' WHEN key % 12 = 0 THEN 'missing' WHEN key % 12 = 10 THEN 'unverified' ELSE 'skipped' END AS status FROM v_files WHERE path NOT LIKE '%secret%'"""))
def path_vetoes(spark: SparkSession, sf: str) -> DataFrame:
    said = F.array(*(F.lit(s) for s in _SAID))
    files = v_files(spark, sf).filter("path NOT LIKE '%secret%'").withColumns({"before": F.get(said, F.pmod("key", F.lit(12)).cast("int")), "kind": F.when(F.col("key") % 7 == 0, "plan").otherwise("live")})
    return vetoes.with_veto(files, vetoes.word_vetoes(F.col("path"), F.col("before"), F.lit(""), F.col("kind"))).select("key", "path", "veto", "status")


@query("""WITH docs AS (SELECT p_partkey AS key, 's' || p_size || '/' || p_partkey || '.md' AS path, p_size FROM part), skill AS (SELECT DISTINCT p_size FROM part WHERE p_size % 2 = 0),
 enters AS (SELECT key, p_size FROM docs WHERE key % 50 = 7 AND key % 100 <> 7)
 SELECT path AS doc FROM docs WHERE (p_size % 2 = 0 AND p_size IN (SELECT p_size FROM enters)) OR (p_size % 2 = 1 AND key IN (SELECT key FROM enters))
 UNION ALL SELECT 's' || p_size || '/SKILL.md' FROM skill WHERE p_size IN (SELECT p_size FROM enters)""")
def other_projects(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_size", F.concat(F.lit("s"), "p_size", F.lit("/"), "p_partkey", F.lit(".md")).alias("path"))
    skills = p.filter("p_size % 2 = 0").select(F.concat(F.lit("s"), "p_size", F.lit("/SKILL.md")).alias("path")).distinct()
    docs = p.select("path").unionByName(skills).select(F.col("path").alias("doc"), F.lit("r").alias("repo"), "path")
    entered = p.filter("key % 50 = 7").select(F.col("path").alias("doc"), F.when(F.col("key") % 100 == 7, "r").otherwise("tool/").alias("folder"))
    return vetoes.other_projects(docs, entered, p.limit(1).select(F.lit("r").alias("repo"), F.lit("r").alias("name")))
