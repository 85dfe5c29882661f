"""Operator 9: mixing sources to target weights by a Pfair schedule. DataFrame and SQL functions only.

Each source is cut into blocks of equal size. With weight w, block k of a source is released at floor(k / w) and due by ceil((k + 1) / w); one
block runs in each slot, of those released and not yet run the one due first. As the weights sum to one, every block meets
its due slot, so after any number of slots t each source has had w * t blocks, give or take less than one, as long as all sources last.

Weights are whole numbers of slots in a period, so the schedule repeats with the period: it is made once for a period, from the weights
alone, and block k of a source with quota a runs in period k div a at the slot of its (k mod a)-th block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LATE = 2**31 - 1


def quotas(shares: DataFrame, period: int) -> DataFrame:
    """(source, quota): slots of a period for each source of `shares` (source, share: whole number), at least one each, by largest remainders; ties go to the smaller name, null first."""
    every = Window.partitionBy()
    spread = shares.withColumns({"sources": F.count(F.lit(1)).over(every), "all": F.sum("share").over(every)})
    spare = F.lit(period).cast("long") - F.col("sources")
    cut = spread.withColumns({"base": F.expr(f"if(all = 0, ({period} - sources) div sources, (({period} - sources) * share) div all)"), "rest": F.expr(f"if(all = 0, 0, (({period} - sources) * share) % all)")})
    order = Window.orderBy(F.desc("rest"), F.asc_nulls_first("source"))
    left = cut.withColumns({"spare": spare - F.sum("base").over(every), "rank": F.row_number().over(order)})
    fits = F.when(F.col("sources") <= period, F.lit(1)).otherwise(F.raise_error(F.lit("more sources than slots in a period")).cast("int"))
    return left.select("source", (fits + F.col("base") + (F.col("rank") <= F.col("spare")).cast("int")).cast("int").alias("quota"))


def schedule(quota: DataFrame, period: int) -> DataFrame:
    """(source, nth, slot, release, due): the slots of a period by earliest due slot first. `quota` is one row for each source, so the fold below is over a fixed number of slots."""
    row = quota.agg(F.sort_array(F.collect_list(F.struct("source", "quota"))).alias("q")).filter(F.size("q") > 0)

    def step(state: Column, t: Column) -> Column:
        done = state["done"]
        due = F.transform(
            F.col("q"),
            lambda q, i: F.when((F.get(done, i) < q["quota"]) & (F.floor(F.get(done, i) * period / q["quota"]) <= t), F.ceil((F.get(done, i) + 1) * period / q["quota"])).otherwise(F.lit(LATE)).cast("int"),
        )
        pick = (F.array_position(due, F.array_min(due)) - 1).cast("int")
        return F.struct(F.transform(done, lambda d, i: (d + (i == pick).cast("int")).cast("int")).alias("done"), F.concat(state["slots"], F.array(pick)).alias("slots"))

    start = F.struct(F.transform("q", lambda q: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("slots"))
    run = row.select("q", F.aggregate(F.sequence(F.lit(0), F.lit(period - 1)), start, step, lambda s: s["slots"]).alias("slots"))
    slots = run.select("q", F.posexplode("slots").alias("slot", "which")).select(F.get("q", F.col("which"))["source"].alias("source"), F.get("q", F.col("which"))["quota"].alias("quota"), "slot")
    nth = (F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1).alias("nth")
    out = slots.select("source", "quota", "slot", nth)
    return out.withColumns({"release": F.floor(F.col("nth") * period / F.col("quota")).cast("int"), "due": F.ceil((F.col("nth") + 1) * period / F.col("quota")).cast("int")})


def block_of(docs: DataFrame, block: int, id_col: str, source_col: str, text_col: str, buckets_hex: int = 4) -> DataFrame:
    """All columns of `docs` with _source, _order, _start (bytes of the source before it) and _block. The order within a source is that of the md5 of the ids, and of the texts where ids are null.

    Running sums are taken within parts of a source (first hex digits of the md5), over the parts with the same first half of these digits, and
    over these halves, so that a source may hold any share of the rows: of the last two no window holds more than 16 ** (buckets_hex / 2) rows.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    rows = docs.withColumns({"_source": F.col(source_col).cast("string"), "_order": key, "_size": size}).withColumn("_part", F.substring("_order", 1, buckets_hex))
    sums = rows.groupBy("_source", "_part").agg(F.sum("_size").alias("_sum"))
    parts = sums.withColumn("_head", F.substring("_part", 1, buckets_hex // 2))
    heads = parts.groupBy("_source", "_head").agg(F.sum("_sum").alias("_all"))
    ahead = heads.select(F.col("_source").alias("_hs"), F.col("_head").alias("_hh"), (F.sum("_all").over(Window.partitionBy("_source").orderBy("_head")) - F.col("_all")).alias("_ahead"))
    within = parts.withColumn("_in", F.sum("_sum").over(Window.partitionBy("_source", "_head").orderBy("_part")) - F.col("_sum"))
    both = within.join(ahead, within["_source"].eqNullSafe(ahead["_hs"]) & (within["_head"] == ahead["_hh"]))
    before = both.select(F.col("_source").alias("_s"), F.col("_part").alias("_p"), (F.col("_ahead") + F.col("_in")).alias("_before"))
    # order and text decide between rows with the same id; rows that are alike may take either place
    inside = Window.partitionBy("_source", "_part").orderBy("_order", F.col(text_col)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_start", F.sum("_size").over(inside) - F.col("_size"))
    joined = placed.join(before, placed["_source"].eqNullSafe(before["_s"]) & (placed["_part"] == before["_p"])).withColumn("_start", F.col("_start") + F.col("_before"))
    return joined.withColumn("_block", F.floor(F.col("_start") / block).cast("long")).drop("_s", "_p", "_before", "_part")


def scheduled(docs: DataFrame, weights: dict[str | None, int] | None = None, block: int = 1 << 16, period: int = 1000, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All columns of `docs` with _source, _block, _start, _release, _due and _slot: the place of each document in the mixture. Sort by _slot and _start to read it.

    `weights` gives a whole number for each source; sources that it lacks get the weight 0, which still means one slot of a period. Without it
    a source weighs the root of its bytes, which draws large and small sources together. Blocks hold `block` bytes of UTF-8; a document
    belongs to the block in which it starts, and the blocks that a longer one runs through stay empty. Every document is placed
    once; when a source ends, the others keep their slots. A null source is a source of its own; null texts have no bytes; rows without
    an id are ordered by their texts; an empty table gives an empty result. `docs` must not have columns of these names.

    With more than `period` sources the period is the smallest multiple of `period` with a slot for each of them; making its schedule takes
    work of sources times slots, in one task.
    """
    blocks = block_of(docs, block, id_col, source_col, text_col)
    source, size = F.col(source_col).cast("string"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    sources = docs.select(source.alias("source")).distinct().count()
    period *= max(1, -(-sources // period))
    if weights is None:
        shares = docs.groupBy(source.alias("source")).agg(F.floor(F.sqrt(F.sum(size))).cast("long").alias("share"))
    else:
        given = F.coalesce(*(F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(v)) for k, v in weights.items()), F.lit(0)).cast("long")
        shares = docs.select(source.alias("source")).distinct().withColumn("share", given)
    plan = schedule(quotas(shares, period), period).select(F.col("source").alias("_of"), F.col("nth").alias("_nth"), F.col("quota").alias("_quota"), F.col("slot").alias("_s"), F.col("release").alias("_r"), F.col("due").alias("_d"))
    # the plan has `period` rows, a number that follows the sources, not the rows
    per_source = F.broadcast(plan.select(F.col("_of").alias("_q"), F.col("_quota").alias("_a")).distinct())
    turned = blocks.join(per_source, blocks["_source"].eqNullSafe(F.col("_q"))).withColumns({"_turn": F.expr("_block div _a"), "_k": F.expr("_block % _a")}).drop("_q", "_a")
    out = turned.join(F.broadcast(plan), turned["_source"].eqNullSafe(F.col("_of")) & (F.col("_k") == F.col("_nth")))
    for name, column in (("_slot", "_s"), ("_release", "_r"), ("_due", "_d")):
        out = out.withColumn(name, (F.col("_turn") * period + F.col(column)).cast("long"))
    return out.drop("_turn", "_k", "_of", "_nth", "_quota", "_s", "_r", "_d", "_size", "_order")


def mix_sources(docs: DataFrame, weights: dict[str | None, int] | None = None, block: int = 1 << 16, period: int = 1000, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, block, start, release, due, slot) of each document; see `scheduled`."""
    needed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    out = scheduled(needed, weights, block, period, "doc_id", "source", "text")
    return out.select("doc_id", "source", F.col("_block").alias("block"), F.col("_start").alias("start"), F.col("_release").alias("release"), F.col("_due").alias("due"), F.col("_slot").alias("slot"))


#: The same for a table without null sources and with unique ids, in DuckDB.
ORACLE = """
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
shares AS (SELECT source, CAST(floor(sqrt(sum(size))) AS BIGINT) AS share FROM rows_ GROUP BY source),
cut AS (SELECT source, (1000 - count(*) OVER ()) AS spare, ((1000 - count(*) OVER ()) * share) // CAST(sum(share) OVER () AS BIGINT) AS base,
  ((1000 - count(*) OVER ()) * share) % CAST(sum(share) OVER () AS BIGINT) AS rest FROM shares),
quotas AS (SELECT source, 1 + base + CASE WHEN row_number() OVER (ORDER BY rest DESC, source) <= spare - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM cut),
q AS (SELECT list(source ORDER BY source) AS names, list(CAST(quota AS BIGINT) ORDER BY source) AS a FROM quotas),
run AS (
  SELECT 0 AS t, list_transform(a, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick, a FROM q
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: d + CASE WHEN i = p THEN 1 ELSE 0 END), p, a FROM (
    SELECT t, done, a, list_position(due, list_min(due)) AS p FROM (
      SELECT t, done, a, list_transform(done, lambda d, i: CASE WHEN d < a[i] AND (d * 1000) // a[i] <= t THEN ((d + 1) * 1000 + a[i] - 1) // a[i] ELSE 2147483647 END) AS due FROM run WHERE t < 1000))),
plan AS (SELECT names[pick] AS source, a[pick] AS quota, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM run, (SELECT names FROM q) WHERE t > 0),
placed AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM rows_),
blocks AS (SELECT doc_id, source, start, start // 65536 AS block FROM placed)
SELECT b.doc_id, b.source, b.block, b.start,
  CAST((b.block // p.quota) * 1000 + (p.nth * 1000) // p.quota AS BIGINT) AS release,
  CAST((b.block // p.quota) * 1000 + ((p.nth + 1) * 1000 + p.quota - 1) // p.quota AS BIGINT) AS due,
  CAST((b.block // p.quota) * 1000 + p.slot AS BIGINT) AS slot
FROM blocks b JOIN plan p ON p.source = b.source AND p.nth = b.block % p.quota
"""
