"""Mixing sources to target weights by weighted fair queueing.

Each source plays its documents in a shuffled order, once and then, in another order, once again.
A copy's virtual finish time is the words its source has played with it, divided by the source's
target.  All copies are put in order of finish time and taken until the budget is spent, so every
source comes out within about one document of its target.

Both running sums are taken in two levels: sums of ranges (of the shuffle key, of the finish time),
a running sum over the ranges, and a window within each range.  Ranges get narrower as rows grow,
so neither a hot source nor the global order ends in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import free_name, written

WEIGHTS = (5, 2, 1)
#: The budget over the size of all sources (in halves), and the most often that a document is taken.
BUDGET_HALVES, EPOCHS = 3, 2
RANGE_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, rank, source_size, target) by weights in order of source, null last, capped and reshared."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    sources = sources.withColumn("rank", F.row_number().over(order))
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1))
    # Sources reach their caps in order of size / weight; the first that does not sets the level.
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    whole = Window.partitionBy()
    sources = (
        sources.withColumn("budget", F.sum("source_size").over(whole) * (BUDGET_HALVES / 2))
        .withColumn("cap", F.col("source_size") * EPOCHS)
        .withColumn("capped", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("sharing", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("sharing"))
        .withColumn("place", F.row_number().over(fill))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("from", F.min(F.when(F.col("open"), F.col("place"))).over(whole))
        .withColumn("level", F.max(F.when(F.col("place") == F.col("from"), F.col("level"))).over(whole))
    )
    target = F.when(F.col("from").isNull() | (F.col("place") < F.col("from")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return sources.select("source", "rank", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``.

    A text's size is its number of words, however long it is; null and empty texts have size 0 and
    are never taken.  Null is a source of its own, the last one.  Rows of one id in one source share
    a place in the shuffle and are each taken for themselves; the same input always gives the same
    rows.  An empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return _mix(rows).drop("row")


def _mix(docs: DataFrame) -> DataFrame:
    """``mix`` of (row, doc_id, source, text), with ``row``."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = written(docs.select("row", "doc_id", "source", size.alias("size")), "sized")
    targets = written(source_targets(sized), "targets")
    rows, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    budget = total * BUDGET_HALVES // 2
    digits = max(1, math.ceil(math.log(max(1, rows / RANGE_ROWS), 16)))
    ranges = max(64, rows // RANGE_ROWS)

    placed = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select("row", "doc_id", "size", "rank", "source_size", "target")
    copies = placed.where("size > 0").select("row", "doc_id", "size", "rank", "target", F.explode(F.array(*[F.lit(k) for k in range(EPOCHS)])).alias("epoch"))
    copies = copies.withColumn("key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("epoch").cast("string"))))
    copies = copies.withColumn("part", F.substring("key", 1, digits))
    parts = copies.groupBy("rank", "epoch", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("rank").orderBy("epoch", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("rank", "epoch", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("played"))
    within = Window.partitionBy("rank", "epoch", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    timed = copies.join(parts, ["rank", "epoch", "part"]).withColumn("finish", (F.col("played") + F.sum("size").over(within)) / F.col("target"))
    timed = timed.select("row", "doc_id", "size", "rank", "epoch", "key", "finish", F.least(F.floor(F.col("finish") * ranges), F.lit(4 * ranges)).alias("slot"))
    timed = written(timed, "timed")

    slots = timed.groupBy("slot").agg(F.sum("size").alias("words"))
    slots = slots.withColumn("until", F.sum("words").over(Window.orderBy("slot")))  # one row for each range
    slots = written(slots.select("slot", "until", (F.col("until") - F.col("words")).alias("since")), "slots")
    taken = timed.join(slots.where(F.col("until") <= budget).select("slot"), "slot", "left_semi").select("row", F.col("size").alias("taken"))
    edge = timed.join(slots.where((F.col("until") > budget) & (F.col("since") < budget)), "slot")
    ordered = Window.partitionBy("slot").orderBy("finish", "rank", "epoch", "key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    left = F.lit(budget) - F.col("since") - (F.sum("size").over(ordered) - F.col("size"))
    taken = taken.union(edge.select("row", F.greatest(F.lit(0).cast("long"), F.least("size", left)).alias("taken")))
    taken = taken.groupBy("row").agg(F.sum("taken").alias("taken"))
    out = placed.join(taken, "row", "left")
    return out.select("row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``mix``'s columns as ``mix_*``.

    Each row has its own result, whatever its id: rows are numbered and written once, and meet
    their results by number.  A column of ``docs`` that is named ``mix_*`` already stays, and the
    added one gets an underscore more.  Nulls, empty texts and empty tables are as in ``mix``.
    """
    row = free_name(docs, "__row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = _mix(numbered.select(F.col(row).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")))
    added = {free_name(docs, f"mix_{c}"): F.col(c) for c in ("size", "source_size", "target", "taken")}
    found = found.where("taken > 0").select(F.col("row").alias(row), *[c.alias(n) for n, c in added.items()])
    return numbered.join(found, row).drop(row)


SQL = r"""
with sized as (
  select row_number() over () as row, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (select *, row_number() over (order by source nulls last) as rank from sources),
weighed as (select *, case (rank - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight,
  (sum(source_size) over ())::double * 1.5::double as budget, source_size * 2 as cap from ranked),
filled as (select *, coalesce(sum(cap) over (order by source_size::double / weight, rank rows between unbounded preceding and 1 preceding), 0)::bigint as capped,
  (sum(weight) over (order by source_size::double / weight, rank rows between current row and unbounded following))::bigint as sharing,
  row_number() over (order by source_size::double / weight, rank) as place from weighed),
levels as (select *, (budget - capped)::double / sharing as level from filled),
opened as (select *, min(case when level * weight <= cap then place end) over () as opens from levels),
targets as (select source, rank, source_size, case when opens is null or place < opens then cap::double
  else max(case when place = opens then level end) over () * weight end as target from opened),
copies as (select s.row, s.doc_id, s.size, t.rank, t.target, e.epoch, md5(coalesce(s.doc_id::varchar, '') || ':' || e.epoch::varchar) as key
  from sized s join targets t on s.source is not distinct from t.source, (values (0), (1)) e(epoch) where s.size > 0),
timed as (select *, (sum(size) over (partition by rank order by epoch, key, doc_id, size rows unbounded preceding))::double / target as finish from copies),
queued as (select row, size, (sum(size) over (order by finish, rank, epoch, key, doc_id, size rows unbounded preceding) - size)::bigint as since from timed),
taken as (select row, sum(greatest(0, least(size, (select (sum(size) * 3) // 2 from sized) - since)))::bigint as taken from queued group by row)
select s.doc_id, s.size, t.source_size, t.target, coalesce(k.taken, 0)::bigint as taken
from sized s join targets t on s.source is not distinct from t.source left join taken k on k.row = s.row
"""
