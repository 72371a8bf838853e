"""Mixing sources to target weights.

Tokens are aggregated per source, the targets become repetition rates, and each
document is emitted floor(rate) times plus one hash-seeded Bernoulli copy with
probability equal to the fraction.

Scale: the corpus is read once to size the documents and aggregated map-side to
one row per source, so a source that holds most rows is no hot key. The plan, one
row per source, is written and counted: up to FEW sources it is broadcast, so no
text moves by its source; beyond, rows meet it by source and salt.

Defined cases: a null text has size 0; a null source is a source of its own,
ranked last; a null doc_id hashes as the text ``null``; repeated rows count and
are taken like any other (equal ids draw equal numbers); an empty table gives an
empty result; other columns are carried by ``emit`` and ignored by ``plan``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladescope.llm.common import discard, materialize, n_words

#: Draws per document from which a source's Bernoulli seed is chosen.
SEEDS = 64
#: Sources whose rows are broadcast.
FEW = 20_000


def _draw(doc_id: Column, seed: Column) -> Column:
    """Uniform number in [0, 1): 32 bits of a SHA-256 of the id and the seed's block of eight."""
    block = F.floor(seed / 8).cast("string")
    digest = F.sha2(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), block), 256)
    return F.conv(F.substring(digest, (seed % 8 * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("long") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """One row per source: source, source_size, target, rate.

    ``sizes`` has source and size. Sources in code-point order (null last) take
    the weights in turn. Shares stop at ``most`` times the source's size; the
    excess goes to the others by weight until none is above. In ascending order
    of cap / weight the capped sources are a prefix, so the common level is the
    first one that its own row's cap admits.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.withColumns(
        {
            "n": F.row_number().over(order),
            "left_size": F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "left_w": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        }
    ).withColumn("level", F.col("left_size") / F.col("left_w"))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("n", "level"))
    per = per.withColumn("level", F.min(fits).over(whole)["level"])
    per = per.withColumn("target", F.least("cap", F.col("level") * F.col("w")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return per.select("source", "source_size", "target", rate.alias("rate"))


def _meet(rows: DataFrame, per: DataFrame) -> DataFrame:
    """``rows`` (source) with the columns of their source's row in the written table ``per``."""
    own = per.withColumnRenamed("source", "per_source")
    same = F.col("source").eqNullSafe(F.col("per_source"))
    if per.count() <= FEW:
        return rows.join(F.broadcast(own), same).drop("per_source")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = own.withColumn("per_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(parts)).cast("int"))
    return salted.join(own, same & (F.col("salt") == F.col("per_salt"))).drop("per_source", "per_salt", "salt")


def source_rates(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """source, source_size, target, rate, seed of every source, written."""
    per = materialize(source_targets(sizes, weights, most), "targets")
    return materialize(per.join(_seeds(_meet(sizes, per)), F.col("source").eqNullSafe(F.col("seed_source"))).drop("seed_source"), "rates")


def mixing_plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Per document: doc_id, size, source_size, target, rate, seed, copies, taken.

    Of ``SEEDS`` hash seeds each source uses the one whose words taken come
    nearest to its target (the first of equals): every copy is still a Bernoulli
    draw with the fraction's probability, and reruns agree.
    """
    sizes = materialize(docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size")), "sizes")
    return _with_copies(_meet(sizes, source_rates(sizes, weights, most)))


def _seeds(rated: DataFrame) -> DataFrame:
    """source, seed: the seed of the source's Bernoulli draws."""
    part = F.col("rate") - F.floor("rate")
    sums = [F.sum(F.when(_draw(F.col("doc_id"), F.lit(k)) < part, F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(SEEDS)]
    per = rated.groupBy("source").agg(F.first("source_size").alias("n"), F.first("target").alias("t"), F.first("rate").alias("r"), *sums)
    off = [F.struct(F.abs(F.floor("r") * F.col("n") + F.col(f"s{k}") - F.col("t")).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS)]
    return per.select(F.col("source").alias("seed_source"), F.least(*off)["seed"].alias("seed"))


def _with_copies(rows: DataFrame) -> DataFrame:
    draw = _draw(F.col("doc_id"), F.col("seed"))
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("int")
    return rows.withColumn("copies", copies).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def emit(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the plan takes it, same columns.

    Only the per-source rows are joined to the documents, so no text is shuffled.
    A row's own columns travel in a struct: their names can't clash. Nulls, empty
    texts and repeated rows are as in ``mixing_plan``.
    """
    sizes = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    rates = source_rates(sizes, weights, most)
    discard(sizes)
    rows = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("doc"), docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), n_words(docs["text"]).alias("size"))
    rows = _with_copies(_meet(rows, rates)).where("copies > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


ORACLE_SQL = """
WITH sizes AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM sizes GROUP BY source),
o AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, row_number() OVER (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST) AS n FROM per),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / ((sum(w) OVER ()) - coalesce(sum(w) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev FROM o),
t AS (
  SELECT source, source_size, least(cap, w * (SELECT arg_min(lev, n) FROM l WHERE lev * w <= cap)) AS target FROM l),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM t),
d AS (
  SELECT s.doc_id, s.source, s.size, r.source_size, r.target, r.rate, r.rate - floor(r.rate) AS part
  FROM sizes s JOIN r ON s.source IS NOT DISTINCT FROM r.source),
u AS (
  SELECT *, ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, 'null') || ':' || (k // 8)), ((k % 8) * 8 + 1)::INT, 8))::BIGINT / 4294967296.0::DOUBLE AS x
  FROM d, range(64) g(k)),
p AS (
  SELECT source, k, abs(floor(any_value(rate)) * any_value(source_size) + sum(CASE WHEN x < part THEN size ELSE 0 END) - any_value(target)) AS off
  FROM u GROUP BY source, k),
b AS (SELECT source, arg_min(k, (off, k)) AS seed FROM p GROUP BY source)
SELECT u.doc_id, u.size, u.source_size, u.target, ((floor(rate) + CASE WHEN x < part THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source AND u.k = b.seed
"""
