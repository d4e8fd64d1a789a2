"""Mixing sources to target weights by capped water-filling.

Each source's target is its weight's share of the total, but ``max_epochs`` times its size at most; what is cut off goes
to the others by weight until no source is above its cap. Then every document of a source is taken a whole number of
times, and those first in a seeded order once more, up to the words that are left; one more document, the one whose size
fits the remainder best, is added if that comes nearer to the target. Documents are taken whole.

The seeded order is the md5 of seed, id and text. Its running sums are taken in two steps, over 4,096 ranges of the hash and
then inside the one range where the target is reached, so no task holds a source. Only the table of sources, one row
each, is ordered as a whole, by one task: millions of sources are fine, billions are not.

Null text has size 0; null sources are one source, last in order; sources of size 0 have target 0. Rows that repeat id
(or have none) and text share one place in the order and one decision, so a target may be passed by the words of one such
repeated document. Other columns are kept, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.llm.common import carried, materialise, whole_text

WORD = r"[^\x20\x09-\x0D]+"


def size_in_words(name: str = "text") -> Column:
    return F.regexp_count(whole_text(name), F.lit(WORD)).cast("long")


def cycle_weights(sources: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Weights by the sources' place in order of code points, null last, in turn."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle)).cast("int") + 1)
    return sources.withColumn("weight", turn.cast("double"))


def water_fill(sources: DataFrame, max_epochs: float = 3.0, share: float = 1.0) -> DataFrame:
    """(source, source_size, weight) gets target: min(cap, weight x level) with the level at which targets add up to the
    total. With the sources ordered by cap / weight, those at their cap come first."""
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    order = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    level = F.try_divide(left, F.sum("weight").over(after))
    free = sources.withColumn("cap", cap).withColumn("level", F.when(level * F.col("weight") <= cap, level))
    # of the levels that keep the next source below its cap, the first in order is the highest
    level = F.max("level").over(Window.orderBy("cap").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    filled = free.withColumn("level", level)
    return filled.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap"))).drop("cap", "level")


def mark_of(seed: str) -> Column:
    """The seeded place of a row in its source's order: rows of the same id and text share it."""
    return F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(whole_text())))


def mix(docs: DataFrame, weights=cycle_weights, max_epochs: float = 3.0, share: float = 1.0, seed: str = "kinespark") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of each row. ``weights`` adds the column weight to a
    table of sources and their sizes."""
    sized = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_in_words().alias("size"), mark_of(seed).alias("mark")), "sizes")
    sums = sized.groupBy("source", F.substring("mark", 1, 3).alias("range")).agg(F.sum("size").alias("words"))
    sums = materialise(sums, "ranges")
    sources = water_fill(weights(sums.groupBy("source").agg(F.sum("words").alias("source_size"))), max_epochs, share)
    epochs = F.coalesce(F.floor(F.try_divide("target", "source_size") + 1e-12), F.lit(0)).cast("long")
    sources = sources.withColumn("whole", epochs).withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    sources = materialise(sources.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source"), "sources")

    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    ranges = sums.withColumn("key", key).withColumn("reach", F.sum("words").over(Window.partitionBy("key").orderBy("range")))
    edge = ranges.join(sources.select("key", "need"), "key").filter("reach > need").groupBy("key").agg(F.min("range").alias("edge"), F.min_by(F.col("reach") - F.col("words"), "range").alias("before"))
    sources = materialise(sources.join(edge, "key", "left"), "edges")

    placed = sized.withColumn("key", key).join(sources, "key")
    spot = F.substring("mark", 1, 3)
    inside = placed.filter(spot == F.col("edge")).select("key", "mark", "doc_id", "size", "need", "before")
    reach = F.col("before") + F.sum("size").over(Window.partitionBy("key").orderBy("mark", "doc_id", "size"))
    inside = inside.withColumn("reach", reach)
    reached = inside.groupBy("key").agg(F.max(F.when(F.col("reach") <= F.col("need"), F.struct("reach", "mark", "doc_id", "size"))).alias("last"), F.min("before").alias("before"))
    cut = reached.select("key", F.coalesce("last.reach", "before").alias("sum"), F.col("last.mark").alias("last_mark"), F.col("last.doc_id").alias("last_id"), F.col("last.size").alias("last_size"))
    sources = materialise(sources.join(cut, "key", "left").withColumn("rest", F.col("need") - F.col("sum")), "cuts")

    placed = sized.withColumn("key", key).join(sources, "key")
    at = F.struct(F.col("mark"), F.coalesce("doc_id", F.lit(-(2**63))), F.col("size"))
    end = F.struct(F.coalesce("last_mark", F.lit("")), F.coalesce("last_id", F.lit(-(2**63))), F.coalesce("last_size", F.lit(-1).cast("long")))
    first = F.col("edge").isNull() | (spot < F.col("edge")) | ((spot == F.col("edge")) & (at <= end))
    placed = placed.withColumn("first", first & (F.col("need") > 0))
    off = F.abs(F.col("size") - F.col("rest"))
    best = placed.filter(~F.col("first") & (off < F.col("rest"))).groupBy("key").agg(F.min(F.struct(off.alias("off"), F.col("mark"), F.col("doc_id"), F.col("size"))).alias("best"))
    sources = materialise(sources.join(best, "key", "left"), "best")
    best_at = F.struct(F.col("best.mark"), F.coalesce("best.doc_id", F.lit(-(2**63))), F.col("best.size"))
    placed = sized.withColumn("key", key).join(sources, "key").withColumn("first", first & (F.col("need") > 0))
    extra = F.col("first") | F.coalesce(F.col("best").isNotNull() & (at == best_at), F.lit(False))
    copies = (F.col("whole") + extra.cast("long")).alias("copies")
    return placed.select("doc_id", "source", "mark", "size", F.col("source_size").cast("long").alias("source_size"), "target", copies).withColumn("taken", F.col("copies") * F.col("size"))


#: The same in SQL over the table documents: level, seeded order and best fit.
SQL = r"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5('kinespark:' || coalesce(cast(doc_id as varchar), 'null') || ':' || md5(coalesce(text, ''))) as mark
  from documents
), sums as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighed as (
  select *, ([5.0, 2.0, 1.0])[cast((row_number() over (order by source asc nulls last) - 1) % 3 as integer) + 1]::double as weight from sums
), tried as (
  select *, (sum(source_size) over () - coalesce(sum(3.0::double * source_size) over (order by 3.0::double * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
     / sum(weight) over (order by 3.0::double * source_size / weight, source nulls last rows between current row and unbounded following) as level
  from weighed
), leveled as (
  select *, max(case when level * weight <= 3.0::double * source_size then level end) over () as fill from tried
), targets as (
  select source, source_size, coalesce(least(3.0::double * source_size, weight * fill), 3.0::double * source_size) as target from leveled
), needs as (
  select *, case when source_size > 0 then cast(floor(target / source_size + 1e-12) as bigint) else 0 end as whole from targets
), ordered as (
  select s.*, n.source_size, n.target, n.whole, greatest(0, n.target - n.whole * n.source_size) as need,
         sum(s.size) over (partition by s.source order by mark, doc_id, s.size) as reach
  from sized s join needs n on s.source is not distinct from n.source
), firsts as (
  select *, reach <= need and need > 0 as first from ordered
), rests as (
  select source, max(need) - coalesce(sum(size) filter (where first), 0) as rest from firsts group by source
), fits as (
  select f.source, min(row(abs(f.size - r.rest), f.mark, f.doc_id, f.size)) as best
  from firsts f join rests r on f.source is not distinct from r.source
  where not f.first and f.need > 0 and abs(f.size - r.rest) < r.rest group by f.source
)
select f.doc_id, f.size, f.source_size, f.target,
       cast((f.whole + case when f.first or coalesce(f.mark = b.best[2] and f.doc_id = b.best[3] and f.size = b.best[4], false) then 1 else 0 end) * f.size as bigint) as taken
from firsts f left join fits b on f.source is not distinct from b.source
"""


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    plan = mix(docs, **options).filter("copies > 0").select("mark", "source", F.col("copies").cast("int").alias("copies")).distinct()
    own = carried(docs, mark=mark_of(options.get("seed", "kinespark")), kind=F.col("source").cast("string"))
    taken = own.join(plan, (own["mark"] == plan["mark"]) & own["kind"].eqNullSafe(plan["source"]))
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.*")
