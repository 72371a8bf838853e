"""Ordered neighbourhoods on gene_order(strain, contig, pos, gene)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladescope.operators.numbering import numbered

_CONTIG = ("strain", "contig")


def _along(first: int | None = None, last: int | None = None):
    w = Window.partitionBy(*_CONTIG).orderBy("pos")
    return w if first is None else w.rowsBetween(first, last)


def synteny_neighbours(order: DataFrame, size: int = 8) -> DataFrame:
    """gene, neighbours: half of ``size`` back and one less forward, in order, without the gene."""
    k = size // 2
    return order.select("gene", F.array_remove(F.collect_list("gene").over(_along(-k, k - 1)), F.col("gene")).alias("neighbours"))


def places(order: DataFrame, gap: int = 8) -> DataFrame:
    """gene, place: one row of numbers for all contigs, with ``gap`` free places before each.

    Genes of an unknown contig have no place.
    """
    known = order.select(*_CONTIG, "pos", "gene").where("strain is not null and contig is not null and gene is not null")
    free = known.groupBy(*_CONTIG).agg(F.min("pos").alias("first"))
    free = free.select(*_CONTIG, F.explode(F.sequence(F.col("first") - gap, F.col("first") - 1)).alias("pos"), F.lit(None).cast(known.schema["gene"].dataType).alias("gene"))
    return numbered(known.unionByName(free), [*_CONTIG, "pos"], "place").where("gene is not null").select("gene", "place")


def proximity(order: DataFrame, most: int = 2) -> DataFrame:
    """g1 < g2, distance: genes up to ``most`` places apart on a contig; no join."""
    near = order.withColumn("next", F.collect_list("gene").over(_along(1, most))).select("gene", F.posexplode("next").alias("i", "other"))
    return near.select(F.least("gene", "other").alias("g1"), F.greatest("gene", "other").alias("g2"), (F.col("i") + 1).alias("distance"))


def core_context(order: DataFrame, size: int = 20) -> DataFrame:
    """gene, context: the nearest size/2 core genes forward, then backward, nearest first.

    ``order`` has a column core (the ortholog set of a core gene, else null).
    Core genes are numbered along their contig, so a gene's context is a range of
    numbers that joins by equality.
    """
    k = size // 2
    seen = F.count("core").over(_along(Window.unboundedPreceding, 0))
    ranked = order.withColumn("seen", seen).withColumn("before", F.col("seen") - F.col("core").isNotNull().cast("int"))
    cores = ranked.where("core is not null").select(*_CONTIG, F.col("seen").alias("n"), F.col("core").alias("found"))
    forward = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.struct((F.col("seen") + i).alias("n"), i.alias("turn")))
    backward = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.struct((F.col("before") - i + 1).alias("n"), (i + k).alias("turn")))
    wanted = ranked.select(*_CONTIG, "gene", F.explode(F.concat(forward, backward)).alias("w")).select(*_CONTIG, "gene", "w.n", "w.turn")
    found = wanted.join(cores, [*_CONTIG, "n"]).groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("turn", "found"))).alias("c"))
    none = F.array().cast("array<long>")
    return order.select("gene").join(found, "gene", "left").select("gene", F.coalesce(F.transform("c", lambda x: x["found"].cast("long")), none).alias("context"))


def nearby(order: DataFrame, targets: DataFrame, most: int = 4, wrap: bool = False) -> DataFrame:
    """target, gene: genes within ``most`` places of a target and no target themselves.

    With ``wrap`` a window that would start before the contig is a slice from its
    end instead, which leaves targets near the start mostly without neighbours.
    """
    marked = order.join(targets.select("gene").distinct().withColumn("hit", F.lit(True)), "gene", "left")
    if wrap:
        length = F.count("*").over(Window.partitionBy(*_CONTIG))
        marked = marked.withColumns({"n": length})
        start = F.when(F.col("pos") >= most, F.col("pos") - most).otherwise(F.greatest(F.col("n") + F.col("pos") - most, F.lit(0)))
        hits = marked.where("hit").select(*_CONTIG, F.col("gene").alias("target"), start.alias("a"), (F.col("pos") + most).alias("b"))
        hits = hits.select(*_CONTIG, "target", F.explode(F.filter(F.sequence(F.col("a"), F.greatest("a", "b")), lambda p: p <= F.col("b"))).alias("pos"))
        return hits.join(marked.where("hit is null"), [*_CONTIG, "pos"]).select("target", "gene")
    found = marked.withColumn("around", F.collect_list(F.struct("gene", F.coalesce("hit", F.lit(False)).alias("hit"))).over(_along(-most, most))).where("hit")
    return found.select(F.col("gene").alias("target"), F.explode("around").alias("o")).where("not o.hit").select("target", "o.gene")


def island_neighbourhood(order: DataFrame, islands: DataFrame, around: int) -> DataFrame:
    """island, strain, gene: the first contig that holds all the island's genes of a strain, from
    ``around`` before the first to ``around`` after the last of them. ``islands``: island, gene."""
    own = order.join(islands, "gene")
    size = own.groupBy("island", "strain").agg(F.countDistinct("gene").alias("n"))
    spread = own.groupBy("island", "strain", "contig").agg(F.countDistinct("gene").alias("k"), F.min("pos").alias("a"), F.max("pos").alias("b"))
    full = spread.join(size, ["island", "strain"]).where("k = n").groupBy("island", "strain").agg(F.min(F.struct("contig", "a", "b")).alias("x")).select("island", "strain", "x.*")
    places = full.select("island", "strain", "contig", F.explode(F.sequence(F.greatest(F.col("a") - around, F.lit(0)), F.col("b") + around)).alias("pos"))
    return places.join(order, ["strain", "contig", "pos"]).select("island", "strain", "gene")


def strain_ranges(genes: DataFrame) -> DataFrame:
    """strain, first, last: the range of gene numbers of each strain."""
    return genes.groupBy("strain").agg(F.min("gene").alias("first"), F.max("gene").alias("last"))


def strain_of(numbers: DataFrame, ranges: DataFrame) -> DataFrame:
    """gene, strain by interval; only numbers within a range are kept.

    Ranges are cut at blocks of 2**16 numbers, so that the join has an equality.
    """
    cut = ranges.select("strain", "first", "last", F.explode(F.sequence(F.shiftright("first", 16), F.shiftright("last", 16))).alias("block"))
    asked = numbers.select("gene", F.shiftright("gene", 16).alias("block"))
    return asked.join(cut, (asked["block"] == cut["block"]) & F.col("gene").between(F.col("first"), F.col("last"))).select("gene", "strain")


def fill_headers(lines: DataFrame, header: str = r"^# (.+)$") -> DataFrame:
    """line_no, text, strain: a header line applies to the lines after it. ``lines``: file, line_no, text."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("text").rlike(header), F.regexp_extract("text", header, 1))
    return lines.withColumn("strain", F.last(mark, ignorenulls=True).over(w)).where(~F.col("text").rlike(header))


def same_as_previous(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Per group how many rows have the value of the row before."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("same", (F.col(value) == before).cast("int")).groupBy(group).agg(F.coalesce(F.sum("same"), F.lit(0)).cast("long").alias("n_same"))
