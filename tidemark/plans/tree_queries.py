"""Queries over drawn trees: what a block draws, its entries, and the folder from which it is drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trees
from .registry import query
from .views import table

_LEADS = ["The files of this repository:", "Suppose you have these files:", "Your own big project directory:", "You can add a page by creating files.", "With the following content structure:", "You can read it.\nIt grows by adding files.", "The tree below:", "Here a page is a file of its own"]
_WHY = [None, "example", "example", "example", "example", None, None, "example"]
_FIRST = ["├── f{}.py", "├── is it f{} -> go", "├── f{}.py -> g.py", "├── Ready for f{}?", "+---+ f{}"]
_DRAWS = [None, "diagram", None, "diagram", None]
_CASES = " ".join(f"WHEN p_partkey % 8 = {k} THEN '{w}'" for k, w in enumerate(_WHY) if w) + " " + " ".join(f"WHEN p_size % 5 = {k} THEN '{w}'" for k, w in enumerate(_DRAWS) if w)


@query(f"SELECT p_partkey AS doc, CASE WHEN p_size % 7 = 6 THEN 'language' {_CASES} END AS why FROM part")
def tree_blocks(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    first = F.replace(F.get(F.array(*(F.lit(t) for t in _FIRST)), F.pmod(size, F.lit(5)).cast("int")), F.lit("{}"), k.cast("string"))
    texts = F.array(first, F.lit("├── docs/"), F.lit("└── last.py"))
    lines = F.transform(texts, lambda t, i: F.struct((i + 3).cast("int").alias("line"), t.alias("text")))
    lead = F.get(F.array(*(F.lit(t) for t in _LEADS)), F.pmod(k, F.lit(8)).cast("int"))
    fences = table(spark, sf, "part").select(k.alias("doc"), F.lit(2).alias("start"), F.when(size % 7 == 6, "mermaid").otherwise("text").alias("lang"), lines.alias("lines"), F.lit("Files").alias("heading"), lead.alias("lead"), F.lit("").alias("after"))
    return trees.drawn(fences, fences.limit(0).select("doc")).select("doc", "why")


@query("""SELECT p_partkey::VARCHAR AS doc, n.line, CASE n.line WHEN 4 THEN 'src/' WHEN 5 THEN 'f' || p_partkey || '.py' ELSE 'last.py' END AS text,
 CASE WHEN p_size % 2 = 0 THEN '' ELSE 'top' || p_size || '/' END || CASE n.line WHEN 4 THEN 'src/' WHEN 5 THEN 'src/f' || p_partkey || '.py' ELSE 'last.py' END AS path,
 CASE WHEN p_size % 2 = 0 THEN '' ELSE 'top' || p_size END AS top FROM part, (SELECT unnest([4, 5, 8]) AS line) n""")
def tree_entries(spark: SparkSession, sf: str) -> DataFrame:
    top = F.concat(F.lit("top"), "p_size")
    texts = F.array(F.concat(top, F.lit("/")), F.lit("├── src/"), F.concat(F.lit("│   └── f"), "p_partkey", F.lit(".py  # main")), F.lit("├── a description of it"), F.lit("├── ..."), F.lit("└── last.py (old)"))
    lines = F.transform(texts, lambda t, i: F.struct((i + 3).cast("int").alias("line"), t.alias("text")))
    folder = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("web/"), top)).otherwise("web")
    blocks = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("doc"), folder.alias("folder"), lines.alias("lines"))
    return trees.tree_entries(blocks).select("doc", "line", "text", "path", "top")


@query("""WITH e AS (SELECT p_size, p_partkey, p_size % 4 AS kind, count(*) OVER (PARTITION BY p_size) AS n FROM part)
 SELECT 'd' || p_size AS doc, CASE WHEN kind IN (1, 3) AND n >= 2 THEN CASE kind WHEN 1 THEN 'pkg/' ELSE '' END ELSE 'clone/pkg/' END || 'f' || p_partkey || '.py' AS path FROM e""")
def tree_rebase(spark: SparkSession, sf: str) -> DataFrame:
    """Of each four trees one is drawn as it lies, one has its clone's folder on top, one was there once, and one has the package on top as well."""
    p = table(spark, sf, "part").select(F.concat(F.lit("d"), "p_size").alias("doc"), F.lit("r").alias("repo"), F.lit("").alias("folder"), F.lit("clone/pkg").alias("top"), F.concat(F.lit("f"), "p_partkey", F.lit(".py")).alias("sub"), F.pmod("p_size", F.lit(4)).alias("kind"))
    entries = p.select("repo", "doc", "folder", F.concat_ws("/", "top", "sub").alias("path"), "top", "sub")
    lies = F.when(F.col("kind") == 0, F.concat_ws("/", "top", "sub")).when(F.col("kind") == 3, F.col("sub")).otherwise(F.concat(F.lit("pkg/"), "sub"))
    once = p.filter("kind = 2").select("repo", F.concat_ws("/", "top", "sub").alias("candidate"))
    return trees.rebased(entries, p.select("repo", lies.alias("candidate")), once).select("doc", "path")
