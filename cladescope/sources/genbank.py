"""GenBank flat files: a record per contig, a gene per CDS with a translation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladescope.functions.sequences import coding_length_fits, gene_name

_PLACE = re.compile(r"[<>]?(\d+)")
_COMPLEMENT = bytes.maketrans(b"acgtACGT", b"tgcaTGCA")


def _features(lines: list[str]):
    """(key, location, qualifiers) of a record's feature table."""
    key, place, qualifiers, current = None, "", {}, None
    for line in lines:
        if line[5:6].strip():
            if key:
                yield key, place, qualifiers
            key, place, qualifiers, current = line[5:21].strip(), line[21:].strip(), {}, None
        elif line[21:22] == "/":
            name, _, value = line[22:].strip().partition("=")
            current = name
            qualifiers.setdefault(current, value.strip('"'))
        elif current is None:
            place += line[21:].strip()
        else:
            text = line[21:].strip().rstrip('"')
            qualifiers[current] += text if current == "translation" else f" {text}"
    if key:
        yield key, place, qualifiers


def _spans(place: str) -> list[tuple[int, int, bool]]:
    """(start from 0, end, reverse) of each part of a location, in reading order."""
    out = []
    for m in re.finditer(r"(complement\()?[<>]?(\d+)(?:\.\.[<>]?(\d+))?", place):
        out.append((int(m[2]) - 1, int(m[3] or m[2]), m[1] is not None or place.startswith("complement(")))
    if place.startswith("complement(join"):
        out.reverse()
    return out


def parse(text: str, dna: bool = False) -> list[dict]:
    """The genes of a file in order: record (contig), feature, and the catalogue's fields."""
    out = []
    for record, body in enumerate(re.split(r"^//\s*$", text, flags=re.M)):
        lines = body.split("\n")
        chrom = next((x.split()[1] for x in lines if x.startswith("VERSION") and len(x.split()) > 1), next((x.split()[1] for x in lines if x.startswith("LOCUS")), None))
        if chrom is None:
            continue
        begin = next((i + 1 for i, x in enumerate(lines) if x.startswith("FEATURES")), len(lines))
        end = next((i for i in range(begin, len(lines)) if lines[i][:1].strip()), len(lines))
        origin = next((i for i, x in enumerate(lines) if x.startswith("ORIGIN")), None)
        sequence = re.sub(r"[\s\d]", "", "\n".join(lines[origin + 1 :])) if dna and origin is not None else ""
        for feature, (key, place, q) in enumerate(_features(lines[begin:end])):
            if key != "CDS" or not q.get("translation"):
                continue
            spans = _spans(place)
            numbers = [int(x) for x in _PLACE.findall(place)]
            strands = {r for *_, r in spans}
            code = "".join((sequence[a:b].encode().translate(_COMPLEMENT)[::-1].decode() if r else sequence[a:b]) for a, b, r in spans)
            product, common = q.get("product", ""), q.get("gene", "")
            out.append(
                {
                    "record": record,
                    "feature": feature,
                    "common_name": common,
                    "locus_tag": q.get("locus_tag", ""),
                    "protein_id": q.get("protein_id", ""),
                    "descrip": f"{common} - {product}" if common else product,
                    "chrom": chrom,
                    "start": min(numbers) - 1,
                    "end": max(numbers),
                    "strand": "?" if len(strands) != 1 else "-" if strands == {True} else "+",
                    "protein": q["translation"],
                    "dna": code if dna else None,
                }
            )
    return out


SCHEMA = "file string, record int, feature int, common_name string, locus_tag string, protein_id string, descrip string, chrom string, start long, `end` long, strand string, protein string, dna string"


def read_genbank(spark: SparkSession, path: str, dna: bool = False) -> DataFrame:
    """Genes of all files, one file a task at a time."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def run(batches):
        for batch in batches:
            for file, text in zip(batch["file"], batch["value"]):
                rows = parse(text, dna)
                frame = pd.DataFrame(rows) if rows else pd.DataFrame(columns=[c.split()[0].strip("`") for c in SCHEMA.split(", ")][1:])
                yield frame.assign(file=file)[[c.split()[0].strip("`") for c in SCHEMA.split(", ")]]

    return files.mapInPandas(run, SCHEMA)


def problems(spark: SparkSession, path: str, genes: DataFrame, dna: bool = False) -> DataFrame:
    """file, problem: files without a translated gene, or (with dna) with a gene whose lengths don't fit."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file")).distinct()
    none = files.join(genes.select("file").distinct(), "file", "left_anti").withColumn("problem", F.lit("no translation"))
    if not dna:
        return none
    misfit = genes.where((F.length("protein") + 1) * 3 != F.length("dna")).select("file").distinct()
    return none.unionByName(misfit.withColumn("problem", F.lit("length of a coding sequence")))


def require_sound(found: DataFrame) -> None:
    bad = [f"{r.file}: {r.problem}" for r in found.orderBy("file").limit(20).collect()]
    if bad:
        raise ValueError("files with problems: " + "; ".join(bad))


def catalogue(genes: DataFrame, names: DataFrame) -> DataFrame:
    """The numbered catalogue: genes counted through files, records and features. ``names``: file, strain, ord.

    A strain's number of genes gives its first number, so numbering sorts within strains only.
    """
    rows = genes.join(names, "file")
    per = rows.groupBy("ord").agg(F.count("*").alias("n"))
    first = per.select("ord", F.coalesce(F.sum("n").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    number = F.col("first") + F.row_number().over(Window.partitionBy("ord").orderBy("record", "feature")) - 1
    rows = rows.join(first, "ord").withColumn("gene", number.cast("long"))
    tag = F.when(F.col("locus_tag") != "", F.col("locus_tag")).otherwise(F.concat_ws("_", F.col("start").cast("string"), F.col("end").cast("string")))
    name = F.concat(F.col("gene").cast("string"), F.lit("_"), F.col("strain"), F.lit("-"), tag)
    return rows.withColumn("name", name).select("gene", "name", "common_name", "locus_tag", "protein_id", "descrip", "chrom", "start", "end", "strand", "strain", "record", "feature", "protein", "dna")


def gene_order(genes: DataFrame) -> DataFrame:
    """strain, contig, pos, gene; contigs without genes don't count."""
    contig = F.dense_rank().over(Window.partitionBy("strain").orderBy("record")) - 1
    pos = F.row_number().over(Window.partitionBy("strain", "record").orderBy("feature")) - 1
    return genes.select("strain", contig.alias("contig"), pos.alias("pos"), "gene")


__all__ = ["catalogue", "coding_length_fits", "gene_name", "gene_order", "parse", "problems", "read_genbank", "require_sound"]
