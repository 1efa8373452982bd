"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, fresh, n_words_of, staged

#: Documents of one seeded sampling group; a source is split into as many groups as its size asks for.
GROUP_DOCS = 2048


def _running(df: DataFrame, order: list, sums: dict, name: str) -> DataFrame:
    """``df`` staged in ``order`` with, for each entry of ``sums``, what the rows before add up to (decimal).

    A range-partitioned sort with per-partition offsets, so no task gathers all rows; one row for each partition comes
    to the driver.
    """
    parts = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), name)
    wide = {k: F.col(v).cast("decimal(38,0)") if isinstance(v, str) else F.lit(v).cast("decimal(38,0)") for k, v in sums.items()}
    per = parts.groupBy("part").agg(*[F.sum(v).alias(k) for k, v in wide.items()]).orderBy("part").collect()
    before, upto = {}, dict.fromkeys(sums, 0)
    for r in per:
        before[r["part"]] = dict(upto)
        upto = {k: upto[k] + int(r[k]) for k in sums}
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for k, v in wide.items():
        offset = F.create_map(*[x for p, at in before.items() for x in (F.lit(p), F.lit(str(at[k])))]) if before else F.create_map(F.lit(0), F.lit("0"))
        parts = parts.withColumn(k, F.coalesce(F.sum(v).over(inside), F.lit(0)).cast("decimal(38,0)") + offset[F.col("part")].cast("decimal(38,0)"))
    return parts.drop("part")


def source_plan(sized: DataFrame, weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Per source: n_docs, source_size, weight, target (double). Sources rank by code point, null last.

    Water-filling on ranked sums: sources fall into order of cap by weight, where a source's cap is ``max_epochs`` times
    its size. A source is clamped when its cap lies below its share, by weight, of what the clamped ones before it
    leave; shares only grow along the order, so one pass finds every clamped source, and the others share the rest by
    weight. Sums are of whole numbers, so the result does not depend on their order.
    """
    src = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    ranked = _running(src, [F.col("source").asc_nulls_last()], {"rank": 1}, "mix-sources")
    cycle = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    ranked = ranked.withColumn("weight", cycle[F.pmod(F.col("rank").cast("long"), F.lit(len(weights))).cast("int")]).withColumn("cap", F.col("source_size") * F.lit(int(max_epochs))).drop("rank")
    filled = _running(ranked, [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()], {"caps_before": "cap", "weight_before": "weight"}, "mix-ranked")
    got = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    clamped = F.col("cap").cast("decimal(19,0)") * (F.lit(got["w"]) - F.col("weight_before")).cast("decimal(18,0)") < (F.lit(got["t"]) - F.col("caps_before")).cast("decimal(19,0)") * F.col("weight").cast("decimal(18,0)")
    held = filled.agg(F.coalesce(F.sum(F.when(clamped, F.col("cap"))), F.lit(0)).alias("c"), F.coalesce(F.sum(F.when(clamped, F.col("weight"))), F.lit(0)).alias("w")).first()
    share, free = got["t"] - held["c"], got["w"] - held["w"]
    level = F.lit(float(share)) * F.col("weight") / F.lit(float(free)) if free else F.col("cap").cast("double")
    return filled.withColumn("target", F.least(F.col("cap").cast("double"), level)).drop("caps_before", "weight_before")


def mix_sources(docs: DataFrame, weights=(1, 2, 3), max_epochs: int = 3, seed: str = "mix-0") -> DataFrame:
    """Add size, source_size, target, taken, whole and extra to every row of ``docs`` (doc_id, text, source, ...).

    A row is taken ``whole`` times in full, and once more for its first ``extra`` words. The share above whole
    repetitions falls on rows in a seeded order (md5 of seed and doc_id): rows come in full until the group's quota
    is met, the last one in part. Groups hold about GROUP_DOCS rows of one source, so a hot source is spread over
    many tasks, and a group's quota is rounded, so a source misses its target by under a word for each group.

    Defined results: a null text has size 0; null sources form one source that ranks last; a null doc_id sorts as
    "null"; rows that repeat are rows of their own; an empty table gives no rows; other columns pass through
    (columns named like an added one are replaced).
    """
    added = ("size", "source_size", "target", "taken", "whole", "extra")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    src, place, groups, group, share, upto, quota = (fresh(docs, x) for x in ("src", "order", "groups", "group", "share", "upto", "quota"))
    sized = docs.withColumn("size", n_words_of(F.col("text")))
    plan = source_plan(sized.select("source", "size"), weights, max_epochs)
    plan = plan.select(
        F.col("source").alias(src), "source_size", "target", F.ceil(F.col("n_docs") / F.lit(GROUP_DOCS)).cast("long").alias(groups),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("whole"),
    ).withColumn(share, F.when(F.col("source_size") > 0, (F.col("target") - F.col("whole") * F.col("source_size")) / F.col("source_size")).otherwise(F.lit(0.0)))
    row = sized.join(bounded(plan), F.col("source").eqNullSafe(F.col(src)))
    row = row.withColumn(place, F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    row = row.withColumn(group, F.pmod(F.conv(F.substring(place, 1, 8), 16, 10).cast("long"), F.col(groups)))
    one = Window.partitionBy("source", group)
    row = row.withColumn(upto, F.sum("size").over(one.orderBy(place, "size").rowsBetween(Window.unboundedPreceding, 0)))
    row = row.withColumn(quota, F.floor(F.sum("size").over(one) * F.col(share) + F.lit(0.5)).cast("long"))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col(quota) - (F.col(upto) - F.col("size")))).cast("long")
    row = row.withColumn("extra", extra).withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))
    return row.select(*[F.col(f"`{c}`") for c in docs.columns], *added)


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "whole", "extra")


def mix_sql(docs: str = "documents", seed: str = "mix-0", group_docs: int = GROUP_DOCS) -> str:
    """DuckDB SQL of op10 over ``docs`` (doc_id, text, source)."""
    return f"""
with recursive sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD_SQL}')), 0)::bigint as size from {docs}
), src as (
  select source, count(*) as n_docs, sum(size)::bigint as source_size,
         1 + (row_number() over (order by source nulls last) - 1) % 3 as weight, 3 * sum(size)::bigint as cap
  from sized group by source
), fill(step, share, free, n) as (
  select 0, sum(source_size)::bigint, sum(weight)::bigint, 0::bigint from src
  union all
  select f.step + 1, (select sum(source_size) from src)::bigint - s.c, s.w, s.n
  from fill f, lateral (select coalesce(sum(cap) filter (cap < f.share::double * weight / f.free), 0)::bigint as c,
                               coalesce(sum(weight) filter (not cap < f.share::double * weight / f.free), 0)::bigint as w,
                               count(*) filter (cap < f.share::double * weight / f.free) as n from src) s
  where s.n > f.n and s.w > 0
), goal as (
  select source, n_docs, source_size,
         least(cap::double, (select share::double from fill order by step desc limit 1) * weight
                            / (select free from fill order by step desc limit 1)) as target from src
), plan as (
  select *, ceil(n_docs / {group_docs}.0)::bigint as groups,
         case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from goal
), row0 as (
  select d.doc_id, d.size, p.source, p.source_size, p.target, p.whole, md5('{seed}|' || coalesce(d.doc_id::varchar, 'null')) as ord, p.groups,
         case when p.source_size > 0 then (p.target - p.whole * p.source_size) / p.source_size else 0.0 end as frac
  from sized d join plan p on d.source is not distinct from p.source
), row1 as (
  select *, ('0x' || substr(ord, 1, 8))::bigint % groups as grp from row0
), row2 as (
  select *, sum(size) over (partition by source, grp order by ord, size rows between unbounded preceding and current row) as upto,
         floor(sum(size) over (partition by source, grp) * frac + 0.5)::bigint as quota from row1
), row3 as (
  select *, greatest(0, least(size, quota - (upto - size)))::bigint as extra from row2
)
select doc_id, size, source_size, target, (whole * size + extra)::bigint as taken, whole, extra from row3
"""


#: The words' pattern in DuckDB's dialect.
WORD_SQL = r"[^\x20\x09-\x0D]+"
