"""Mixing sources to target weights, all in DataFrame operations.

Sizes are summed per source; each source's target follows its weight, limited
to a multiple of its own size, with the excess shared again by weight (water
filling in closed form over the short list of sources).  A source's rate is
target over size: each document is taken floor(rate) times, plus once more
with a probability of the fraction, decided by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweft.llm.shared import cut, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 17


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """mix_source, source_size, target, rate of each source of (mix_source, mix_size) rows.

    The windows below run over one row for each source, after aggregation.
    Sources in code-point order, null last, take the weights in turn.
    """
    per = sizes.groupBy("mix_source").agg(F.sum("mix_size").alias("source_size"))
    turn = (F.row_number().over(W.orderBy(F.col("mix_source").asc_nulls_last())) - 1) % len(weights)
    per = per.select("*", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double").alias("w"), (most * F.col("source_size")).cast("double").alias("cap"))
    per = per.withColumn("fill", F.col("cap") / F.col("w"))
    all_ = W.partitionBy(F.lit(0))
    by_fill = all_.orderBy(F.col("fill"), F.col("mix_source").asc_nulls_last())
    before, onward = by_fill.rowsBetween(W.unboundedPreceding, -1), by_fill.rowsBetween(0, W.unboundedFollowing)
    per = per.withColumn("level", (share * F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward))
    per = per.withColumn("full", F.col("level") >= F.col("fill"))
    level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(by_fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    per = per.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("w")))
    return per.select("mix_source", "source_size", "target", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)).alias("rate"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone; 52 bits of MD5, so that SQL can repeat it."""
    name = F.concat(F.lit(f"mix:{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _copies(rate: Column, doc_id: Column, seed: int) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw(doc_id, seed) < rate - whole, 1).otherwise(0)).cast("long")


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of each document.

    Only ids, sources and sizes are kept and moved, never texts; they are
    written once, so the texts are read once.  Null texts have size 0, a null
    source is a source of its own (last in order), repeated rows are drawn
    alike, an empty table gives an empty plan, other columns are not read.
    """
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("mix_source"), word_count(F.col(text_col)).alias("mix_size"))
    sizes = cut(sizes, "mix-sizes")
    t = targets(sizes, **how).withColumnRenamed("mix_source", "of_source")
    joined = sizes.join(t, F.col("mix_source").eqNullSafe(F.col("of_source")), "inner")
    copies = _copies(F.col("rate"), F.col("doc_id"), seed)
    return joined.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("mix_size")).alias("taken"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **how) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as its copies say, columns unchanged.

    Rates are joined to the documents by source (Spark broadcasts them only if
    they are small); copies are made by exploding a short sequence, so no
    text is moved for its own sake.
    """
    sizes = docs.select(F.col(source_col).cast("string").alias("mix_source"), word_count(F.col(text_col)).alias("mix_size"))
    t = cut(targets(sizes, **how).select(F.col("mix_source").alias("_mix_source"), F.col("rate").alias("_mix_rate")), "mix-rates")
    joined = docs.join(t, docs[source_col].cast("string").eqNullSafe(F.col("_mix_source")), "inner")
    copies = _copies(F.col("_mix_rate"), docs[id_col], seed)
    times = F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("_mix_copy")
    return joined.select(*[docs[c] for c in docs.columns], times).drop("_mix_copy")


PLAN_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
         (2 * source_size)::DOUBLE AS cap FROM per),
levels AS (
  SELECT *, cap / w AS fill,
         (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
aimed AS (
  SELECT source, source_size,
         CASE WHEN level >= fill THEN cap
              ELSE (SELECT l.level FROM levels l WHERE l.level < l.fill ORDER BY l.fill, l.source NULLS LAST LIMIT 1) * w END AS target
  FROM levels),
rates AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate FROM aimed)
SELECT s.doc_id, s.size, r.source_size, r.target,
       (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:17:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496
                                < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * s.size AS taken
FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
"""
