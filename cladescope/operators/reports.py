"""Read-side queries and report files."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def search(rows: DataFrame, fields: list[str], text: str) -> DataFrame:
    """Rows any of whose fields holds ``text``, case-sensitively; each row once."""
    return rows.where(F.exists(F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), lambda x: F.contains(x, F.lit(text))))


def score_matrix(family: DataFrame, edges: DataFrame, score: str) -> DataFrame:
    """fam, g1, g2, value for all pairs of a family's genes; no edge is null. The pairs are a family's own square."""
    a, b = family.select("fam", F.col("gene").alias("g1")), family.select("fam", F.col("gene").alias("g2"))
    both = edges.select("g1", "g2", F.col(score).alias("value"))
    both = both.unionByName(both.where("g1 != g2").select(F.col("g2").alias("g1"), F.col("g1").alias("g2"), "value"))
    return a.join(b, "fam").join(both, ["g1", "g2"], "left").select("fam", "g1", "g2", "value")


def outside_scores(outside: DataFrame, genes: DataFrame) -> DataFrame:
    """Edges out of a family with names, best first by the three-place text of the score."""
    name = genes.select("gene", "name")
    rows = outside.join(name, "gene").join(name.select(F.col("gene").alias("other"), F.col("name").alias("other_name")), "other")
    return rows.withColumn("shown", F.format_string("%.3f", F.bround("raw_sc", 3))).orderBy(F.desc("shown"), "gene", "other")


def strain_lines(order: DataFrame, genes: DataFrame, assigned: DataFrame) -> DataFrame:
    """strain, contig, pos, value: nine columns a gene in order of place."""
    fields = ["name", "class", "history", "island", "ifam", "ofam", "lf", "common_name", "descrip"]
    rows = order.join(genes.drop("strain"), "gene").join(assigned, "gene", "left")
    have = [F.coalesce(F.col(f).cast("string"), F.lit("")) if f in rows.columns else F.lit("") for f in fields]
    return rows.select("strain", "contig", "pos", F.concat_ws("\t", *have).alias("value"))


def write_strain_files(lines: DataFrame, path: str) -> None:
    """A folder per strain with its lines; a ``# contig`` line starts each contig."""
    head = lines.select("strain", "contig").distinct().select("strain", "contig", F.lit(-1).alias("pos"), F.concat(F.lit("# contig "), F.col("contig").cast("string")).alias("value"))
    lines.unionByName(head).repartition("strain").sortWithinPartitions("strain", "contig", "pos").select("strain", "value").write.partitionBy("strain").text(path)


def island_lines(islands: DataFrame, members: DataFrame) -> DataFrame:
    """id, mrca, value: an island's number, node, and its families with their genes."""
    genes = members.groupBy("lf").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("genes"))
    flat = islands.select("id", "mrca", F.posexplode("lfs").alias("i", "lf")).join(genes, "lf", "left")
    per = flat.groupBy("id", "mrca").agg(F.array_sort(F.collect_list(F.struct("i", "lf", "genes"))).alias("p"))
    text = F.transform("p", lambda x: F.concat(x["lf"].cast("string"), F.lit(":"), F.coalesce(x["genes"], F.lit(""))))
    return per.select("id", "mrca", F.concat_ws("\t", F.col("id").cast("string"), "mrca", F.array_join(text, "\t")).alias("value"))


def bed_rows(islands_in_strain: DataFrame, colours: DataFrame) -> DataFrame:
    """Fourteen columns an island of a strain: islands_in_strain has chrom, start, end, island, strand, strain, mrca, n."""
    rows = islands_in_strain.join(colours, ["strain", "island"], "left")
    at = F.col("start").cast("string")
    return rows.select(
        "strain", "chrom", "start",
        F.concat_ws("\t", "chrom", at, F.col("end").cast("string"), F.col("island").cast("string"), F.lit("0"), "strand", at, at, F.coalesce("rgb", F.lit("0,0,0")), F.lit("1"), (F.col("end") - F.col("start")).cast("string"), F.lit("0"), "mrca", F.col("n").cast("string")).alias("value"),
    )


def island_extents(members: DataFrame, genes: DataFrame) -> DataFrame:
    """strain, chrom, island, start, end, n: from an island's first to its last gene on a contig, and half, the
    median of half the genes' lengths. members: island, gene."""
    half = F.percentile((F.col("end") - F.col("start")) / 2, 0.5)
    return members.join(genes, "gene").groupBy("strain", "chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), half.alias("half"))


def colour_islands(order: list, palette: list[str], fixed: dict, tries: int = 100, seed: int = 0) -> dict:
    """Colours of a strain's islands along its contigs so that few neighbours share one; the best of seeded tries."""
    best, least = {}, None
    for t in range(tries):
        draw = random.Random(f"{seed}-{t}")
        now: dict = {}
        for i, island in enumerate(order):
            now.setdefault(island, fixed.get(island) or draw.choice([c for c in palette if i == 0 or c != now.get(order[i - 1])] or palette))
        same = sum(now[a] == now[b] and a != b for a, b in zip(order, order[1:]))
        if least is None or same < least:
            best, least = now, same
        if not same:
            break
    return best


def representatives(members: DataFrame, most: int = 4) -> DataFrame:
    """lf, gene: at most ``most`` genes of a locus family, by a hash; ranked before the shuffle as well."""
    w = Window.partitionBy("lf").orderBy(F.md5(F.col("gene").cast("string")), "gene")
    return members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("lf", "gene")


def greedy_cover(hits: DataFrame, take: int) -> list:
    """Strains by greatest sum of hits, each taking its row and column out. hits: strain, other, n (a strain matrix)."""
    cells = {(r["strain"], r["other"]): r["n"] for r in hits.groupBy("strain", "other").agg(F.sum("n").alias("n")).collect()}
    out: list = []
    for _ in range(take):
        total: dict = {}
        for (a, b), n in cells.items():
            if a not in out and b not in out:
                total[a] = total.get(a, 0) + n
        if not total:
            break
        out.append(max(sorted(total), key=lambda s: total[s]))
    return out


def island_summary(islands: DataFrame) -> DataFrame:
    """mrca, n_islands, n_families, sizes (``size:count`` by size) of every species node."""
    per = islands.groupBy("mrca", F.size("lfs").alias("size")).agg(F.count("*").alias("n"))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("size", "n"))), lambda x: F.concat_ws(":", x["size"].cast("string"), x["n"].cast("string"))), " ")
    return per.groupBy("mrca").agg(F.sum("n").alias("n_islands"), F.sum(F.col("n") * F.col("size")).alias("n_families"), shown.alias("sizes"))


def strain_table(members: DataFrame, family: str, strains: list) -> DataFrame:
    """A row per family with the number of its genes in each strain, ``n_<strain>``. members: family, strain, gene."""
    return members.groupBy(family).agg(*[F.count_if(F.col("strain") == F.lit(s)).alias(f"n_{s}") for s in strains])


def write_bed(rows: DataFrame, path: str, name: str = "islands") -> None:
    """A folder per strain with a track line and its rows (strain, chrom, start, value) by place."""
    head = rows.select("strain").distinct().select("strain", F.lit("").alias("chrom"), F.lit(-1).cast("long").alias("start"), F.concat(F.lit(f'track name="{name} '), F.col("strain").cast("string"), F.lit('" itemRgb="On"')).alias("value"))
    both = rows.select("strain", "chrom", F.col("start").cast("long").alias("start"), "value").unionByName(head)
    both.repartition("strain").sortWithinPartitions("strain", "chrom", "start").select("strain", "value").write.partitionBy("strain").text(path)


def same_table(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
