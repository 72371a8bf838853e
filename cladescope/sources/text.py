"""Line-based formats: FASTA, similarity hits, gene information and order, ortholog sets, islands, name maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F




def _file() -> Column:
    return F.col("_metadata.file_path")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0), text. A file is read whole by one task, files in parallel."""
    whole = spark.read.text(path, wholetext=True).select(_file().alias("file"), F.split("value", "\r?\n").alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("line_no", "text")).withColumn("line_no", F.col("line_no").cast("long"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, header (without the mark), sequence; records split at ``>`` by the text source, white space goes."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(_file().alias("file"), F.regexp_replace("value", "^>", "").alias("v")).where("trim(v) != ''")
    return rows.select("file", F.trim(F.substring_index("v", "\n", 1)).alias("header"), F.regexp_replace(F.regexp_replace("v", r"^[^\n]*\n?", ""), r"\s+", "").alias("sequence"))


def write_fasta(rows: DataFrame, path: str, header: str = "header", sequence: str = "sequence") -> None:
    rows.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(sequence)).alias("value")).write.text(path)


def gene_number(name) -> Column:
    """The number before the first underscore, else null."""
    return F.regexp_extract(name, r"^(\d+)_?", 1).try_cast("long")


def read_hits(spark: SparkSession, path: str, joint: str = "_-VS-_") -> DataFrame:
    """Hits of files named ``<strain><joint><strain>.<ext>``: 11 columns by white space, line numbers kept."""
    rows = numbered_lines(spark, path).where("trim(text) != ''")
    c = F.split(F.trim("text"), r"\s+")
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    pair = F.split(F.url_decode(stem), joint)
    kinds = ["double", "int", "int", "int", "int", "int", "int", "double", "int"]
    names = ["evalue", "qlen", "qstart", "qend", "slen", "sstart", "send", "pident", "score"]
    values = [c[i + 2].cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds))]
    return rows.select(pair[0].alias("strain_q"), pair[1].alias("strain_s"), "line_no", gene_number(c[0]).alias("q"), gene_number(c[1]).alias("s"), *values)


def read_gene_info(spark: SparkSession, path: str, strains: list[str] | None = None) -> DataFrame:
    """Gene catalogue from ``# strain`` blocks of ten tab-separated fields."""
    from cladescope.operators.order import fill_headers

    rows = fill_headers(numbered_lines(spark, path).where("trim(text) != ''"))
    if strains is not None:
        rows = rows.where(F.col("strain").isin(strains))
    c = F.split("text", "\t")
    names = ["gene", "name", "common_name", "locus_tag", "protein_id", "descrip", "chrom", "start", "end", "strand"]
    kinds = {"gene": "long", "start": "long", "end": "long"}
    return rows.select(*[c[i].cast(kinds.get(n, "string")).alias(n) for i, n in enumerate(names)], "strain")


def read_gene_order(spark: SparkSession, path: str, strains: list[str] | None = None) -> DataFrame:
    """strain, contig, pos, gene from ``strain<tab>contig<tab>contig`` lines of blank-separated genes."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).where("trim(value) != ''").select(c[0].alias("strain"), F.slice(c, 2, F.size(c)).alias("contigs"))
    if strains is not None:
        rows = rows.where(F.col("strain").isin(strains))
    contigs = rows.select("strain", F.posexplode("contigs").alias("contig", "genes"))
    return contigs.select("strain", "contig", F.posexplode(F.split(F.trim("genes"), " +")).alias("pos", "g")).select("strain", "contig", "pos", F.col("g").try_cast("long").alias("gene")).where("gene is not null")


def write_gene_order(order: DataFrame, path: str) -> None:
    contigs = order.groupBy("strain", "contig").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "gene"))), lambda x: x["gene"].cast("string")), " ").alias("g"))
    lines = contigs.groupBy("strain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("contig", "g"))), lambda x: x["g"]), "\t").alias("g"))
    lines.select(F.concat_ws("\t", "strain", "g").alias("value")).write.text(path)


def read_orthologs(spark: SparkSession, path: str) -> DataFrame:
    """grp, genes: one tab-separated set a line."""
    rows = numbered_lines(spark, path).where("trim(text) != ''")
    return rows.select(F.col("line_no").cast("int").alias("grp"), F.split(F.trim("text"), "\t").cast("array<long>").alias("genes"))


def write_orthologs(sets: DataFrame, path: str) -> None:
    sets.select(F.array_join(F.col("genes").cast("array<string>"), "\t").alias("value")).write.text(path)


def read_strains(spark: SparkSession, path: str) -> DataFrame:
    c = F.split("value", "\t")
    return spark.read.text(path).where("trim(value) != ''").select(c[0].cast("int").alias("strain_idx"), c[1].alias("strain"))


def read_islands(spark: SparkSession, path: str) -> DataFrame:
    c = F.split("value", "\t")
    return spark.read.text(path).where("trim(value) != ''").select(c[0].cast("long").alias("id"), c[1].alias("mrca"), F.split(c[2], ",").cast("array<long>").alias("lfs"))


def write_islands(islands: DataFrame, path: str) -> None:
    islands.select(F.concat_ws("\t", F.col("id").cast("string"), "mrca", F.array_join(F.col("lfs").cast("array<string>"), ",")).alias("value")).write.text(path)


def read_name_map(spark: SparkSession, path: str) -> DataFrame:
    """file, strain by white space; lines that start blank are skipped."""
    c = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(~F.col("value").rlike(r"^\s") & (F.col("value") != "")).select(c[0].alias("file"), c[1].alias("strain"))


def write_name_map(names: DataFrame, path: str) -> None:
    """The map from downloaded files to strains (file, strain), a line each."""
    names.select(F.concat_ws("\t", "file", "strain").alias("value")).write.text(path)


def read_gene_trees(spark: SparkSession, path: str) -> DataFrame:
    """fam, newick: the family's number is the last one in the file's name."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(_file(), r"(\d+)\.[^./]*$", 1).cast("long").alias("fam"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("newick"))


def tree_file_name(fam, stem: str = "fam") -> Column:
    return F.concat(F.lit(stem), F.lpad(fam.cast("string"), 6, "0"), F.lit(".tre"))


def read_families(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Families (fam, mrca, tree, source_fam) and their locus families, from tab-separated lines of
    fam, mrca, tree, source family and any number of ``lf,mrca,locus,root,gene,...``."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).where("trim(value) != ''").select(c.alias("c"))
    families = rows.select(F.col("c")[0].cast("long").alias("fam"), F.col("c")[1].alias("mrca"), F.col("c")[2].alias("tree"), F.col("c")[3].try_cast("long").alias("source_fam"))
    parts = rows.select(F.col("c")[0].cast("long").alias("fam"), F.explode(F.filter(F.slice("c", 5, F.size("c")), lambda x: x != "")).alias("p")).select("fam", F.split("p", ",").alias("p"))
    lf = parts.select(F.col("p")[0].cast("long").alias("lf"), "fam", F.col("p")[1].alias("lf_mrca"), F.col("p")[2].try_cast("long").alias("locus"), F.col("p")[3].alias("root_node"), F.slice("p", 5, F.size("p")).cast("array<long>").alias("genes"))
    return families, lf


def write_families(families: DataFrame, loci: DataFrame, path: str) -> None:
    text = F.concat_ws(",", F.col("lf").cast("string"), "lf_mrca", F.coalesce(F.col("locus").cast("string"), F.lit("None")), "root_node", F.array_join(F.col("genes").cast("array<string>"), ","))
    parts = loci.groupBy("fam").agg(F.array_sort(F.collect_list(F.struct("lf", text.alias("t")))).alias("p")).select("fam", F.transform("p", lambda x: x["t"]).alias("p"))
    line = F.concat_ws("\t", F.col("fam").cast("string"), "mrca", "tree", F.coalesce(F.col("source_fam").cast("string"), F.lit("None")), F.array_join(F.coalesce("p", F.array().cast("array<string>")), "\t"))
    families.join(parts, "fam", "left").select(F.rtrim(line).alias("value")).write.text(path)


def read_assembly_links(spark: SparkSession, path: str, row_tag: str = "DocumentSummary") -> DataFrame:
    """Download commands from an assembly summary in XML."""
    rows = spark.read.format("xml").option("rowTag", row_tag).load(path)
    return rows.where("FtpPath_GenBank is not null").select(
        F.concat(F.lit("wget "), F.col("FtpPath_GenBank"), F.lit("/"), F.element_at(F.split("FtpPath_GenBank", "/"), -1), F.lit("_genomic.gbff.gz")).alias("command")
    )


