"""Mixing sources to target weights: how often each document is emitted, so that every source gets its share.

Method (DataFrame functions only). Tokens are summed by source (partial sums before the shuffle). Weights repeat
in code point order of the sources, null last; targets share `share` times all tokens by weight, stop at `ceiling` times
the source's own, and the excess goes to the others by weight until no target is above: each round is one small sum over
the table of sources. A source's rate is target / tokens; a document is emitted floor(rate) times, plus one copy where
a hash of seed and key, as a number from 0 to 1, is below the fraction.

Defined cases: a null text has size 0; a null source is a source; equal keys draw equally, so repeated rows are
repeated alike; a source without words has target 0 and its documents are not emitted; an empty table gives an empty
result; input columns named like an output column are replaced. The table of sources is joined by size: Spark
broadcasts it only where its file is below the session's limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setflow.llm import common as C
from setflow.llm.ranks import with_rank

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2.0
SEED = 20
OUT = ("source_size", "target", "copies")


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(C.WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, target) from rows (source, size)."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_rank(sums, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = C.materialise(ranked.select("source", "source_size", weight.alias("weight")))
    top = ceiling * F.col("source_size")
    total = share * float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:  # every round stops one source more at least
        above = top < F.lit(level) * F.col("weight")
        n, spent, left = table.agg(F.count_if(above), F.sum(F.when(above, top).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if n == stopped or not left:
            break
        stopped, level = n, (total - spent) / left
    return table.select("source", "source_size", F.when(above, top).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def draw(key: Column, seed: int) -> Column:
    """A number from 0 up to 1 that depends on key and seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def with_copies(df: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", seed: int = SEED) -> DataFrame:
    """df with source_size, target and copies."""
    own = targets.withColumnRenamed("source", "__sf_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    copies = whole + F.when(draw(F.col(f"`{key}`"), seed) < rate - whole, 1).otherwise(0)
    joined = C.without(df, *OUT).join(own, F.col(f"`{source}`").eqNullSafe(F.col("__sf_source")), "left").drop("__sf_source")
    return joined.withColumn("copies", copies.cast("long"))


def mix(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, seed: int = SEED) -> DataFrame:
    """The mixture itself: each row of df as often as it is taken, with df's columns."""
    sized = df.select(F.col(f"`{source}`").alias("source"), n_words(f"`{text}`").alias("size"))
    counted = with_copies(df.select(F.struct("*").alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source")), source_targets(sized, weights, share, ceiling), "key", "source", seed)
    return counted.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = C.materialise(C.documents(spark, sf_dir).select("doc_id", "source", n_words().alias("size")))
    counted = with_copies(sized, source_targets(sized))
    return counted.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op2_source_mix": op2_source_mix}
ORACLE = {
    "op2_source_mix": rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{C.WORD}')) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS top FROM sums
), ordered AS (
  SELECT *, coalesce(sum(top) OVER (ORDER BY top / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
    sum(weight) OVER (ORDER BY top / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed
), leveled AS (
  SELECT max((1.5::DOUBLE * (SELECT sum(source_size) FROM sums) - spent) / rest) AS level FROM ordered
), targets AS (
  SELECT source, source_size, CASE WHEN top < level * weight THEN top ELSE level * weight END AS target FROM weighed, leveled
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
    CAST(CAST('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS drawn
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated"""
}
