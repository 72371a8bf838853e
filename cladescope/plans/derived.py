"""More registered queries: files written and read again, reports, tree and family operators, SQL functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladescope.functions import sql as sql_functions
from cladescope.operators import families, hits, islands, order, reports, scores, tiles, tree
from cladescope.plans import adapters as A
from cladescope.plans.registry import query
from cladescope.sources import scores as score_files
from cladescope.sources import text
from cladescope.storage import shared_dir


def _place(spark, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _joined(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


# files: what was written is read again


@query("SELECT p_partkey || '_' || p_brand || ' ' || p_type AS header, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS sequence FROM part")
def fasta_scan(spark, d):
    path, p = _place(spark, "fasta"), A.table(spark, d, "part")
    header = F.concat_ws(" ", F.concat_ws("_", F.col("p_partkey").cast("string"), "p_brand"), "p_type")
    text.write_fasta(p.select(header.alias("header"), F.upper(F.regexp_replace("p_name", "[^A-Za-z]", "")).alias("sequence")), path)
    return text.read_fasta(spark, path).select("header", "sequence")


@query("SELECT p_partkey AS gene, p_name AS name, p_brand AS chrom, p_size::BIGINT AS start, (p_size + 100)::BIGINT AS \"end\", 's' || p_partkey % 4 AS strain FROM part")
def gene_info_scan(spark, d):
    path, p = _place(spark, "genes"), A.table(spark, d, "part").withColumn("strain", F.concat(F.lit("s"), F.col("p_partkey") % 4))
    none = F.lit("")
    line = F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name", none, none, none, none, "p_brand", F.col("p_size").cast("string"), (F.col("p_size") + 100).cast("string"), F.lit("+"))
    rows = p.select("strain", F.col("p_partkey").alias("at"), line.alias("value"))
    heads = p.select("strain").distinct().select("strain", F.lit(-1).alias("at"), F.concat(F.lit("# "), F.col("strain")).alias("value"))
    rows.unionByName(heads).repartition("strain").sortWithinPartitions("strain", "at").select("value").write.text(path)
    return text.read_gene_info(spark, path, ["s0", "s1", "s2", "s3"]).select("gene", "name", "chrom", "start", "end", "strain")


@query(f"SELECT strain::VARCHAR AS strain, (dense_rank() OVER (PARTITION BY strain ORDER BY contig) - 1)::INT AS contig, pos::INT AS pos, gene FROM ({A.ORDER_SQL})")
def gene_order_scan(spark, d):
    path = _place(spark, "order")
    text.write_gene_order(A.gene_order(spark, d).withColumn("strain", F.col("strain").cast("string")), path)
    return text.read_gene_order(spark, path)


@query("SELECT string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS genes FROM lineitem GROUP BY l_orderkey")
def ortholog_scan(spark, d):
    path = _place(spark, "sets")
    sets = A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("genes"))
    text.write_orthologs(sets, path)
    return text.read_orthologs(spark, path).select(_joined("genes"))


@query(f"SELECT id, mrca, array_to_string(lfs, ',') AS lfs FROM ({A.ISLANDS_SQL})")
def island_scan(spark, d):
    path = _place(spark, "islands")
    text.write_islands(A.islands(spark, d), path)
    return text.read_islands(spark, path).select("id", "mrca", _joined("lfs"))


@query("SELECT 'f' || p_partkey AS file, 'g' || p_size AS strain FROM part")
def name_map_scan(spark, d):
    path = _place(spark, "names")
    p = A.table(spark, d, "part").select(F.concat(F.lit("f"), "p_partkey").alias("file"), F.concat(F.lit("g"), "p_size").alias("strain"))
    text.write_name_map(p, path)
    return text.read_name_map(spark, path)


_LF_SQL = "SELECT l_suppkey AS fam, l_orderkey % 50 AS k, l_partkey AS gene FROM lineitem GROUP BY ALL"


def _loci(spark, d) -> DataFrame:
    """fam, k, gene: parts by supplier and fifty kinds of orders."""
    return A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("fam"), (F.col("l_orderkey") % 50).alias("k"), F.col("l_partkey").alias("gene")).distinct()


@query(f"""SELECT fam * 50 + k AS lf, fam, 'm' || k AS lf_mrca, CASE WHEN k % 3 > 0 THEN k END AS locus, 'root' || k AS root_node, string_agg(gene::VARCHAR, ',' ORDER BY gene) AS genes
 FROM ({_LF_SQL}) GROUP BY fam, k""")
def family_scan(spark, d):
    path = _place(spark, "families")
    lf = _loci(spark, d).groupBy("fam", "k").agg(F.array_sort(F.collect_list("gene")).alias("genes"))
    named = lambda w: F.concat(F.lit(w), F.col("k").cast("string"))
    lf = lf.select((F.col("fam") * 50 + F.col("k")).alias("lf"), "fam", named("m").alias("lf_mrca"), F.when(F.col("k") % 3 > 0, F.col("k")).alias("locus"), named("root").alias("root_node"), "genes")
    fams = lf.select("fam").distinct().select("fam", F.lit("s0").alias("mrca"), F.lit("(a,b);").alias("tree"), F.lit(None).cast("long").alias("source_fam"))
    text.write_families(fams, lf, path)
    return text.read_families(spark, path)[1].withColumn("genes", _joined("genes"))


_SCORED_SQL = "SELECT l_linenumber::BIGINT AS s1, (l_linenumber + 1)::BIGINT AS s2, l_partkey AS g1, l_suppkey AS g2, l_quantity::DOUBLE / 64 AS raw_sc, l_discount::DOUBLE AS syn_sc, CASE WHEN l_tax > 0.04 THEN l_tax::DOUBLE END AS core_syn_sc FROM lineitem"


def _scored(spark, d) -> DataFrame:
    e = A.table(spark, d, "lineitem")
    return e.select(
        F.col("l_linenumber").cast("long").alias("s1"), (F.col("l_linenumber") + 1).cast("long").alias("s2"), F.col("l_partkey").alias("g1"), F.col("l_suppkey").alias("g2"),
        (F.col("l_quantity").cast("double") / 64).alias("raw_sc"), F.col("l_discount").cast("double").alias("syn_sc"), F.when(F.col("l_tax") > 0.04, F.col("l_tax").cast("double")).alias("core_syn_sc"),
    )


@query(f"SELECT s1, s2, g1, g2, round_even(raw_sc, 6) AS raw_sc, syn_sc, core_syn_sc FROM ({_SCORED_SQL})")
def score_text_scan(spark, d):
    path = _place(spark, "scores")
    score_files.write_text(_scored(spark, d), path)
    return score_files.read_text(spark, path)


@query(f"SELECT s1, s2, g1, g2, raw_sc, syn_sc, coalesce(core_syn_sc, -1) AS core_syn_sc FROM ({_SCORED_SQL})")
def score_binary_scan(spark, d):
    path = _place(spark, "scores")
    score_files.write_binary(_scored(spark, d), path)
    return score_files.read_binary(spark, path).withColumn("core_syn_sc", F.when(F.isnan("core_syn_sc") | F.col("core_syn_sc").isNull(), -1.0).otherwise(F.col("core_syn_sc")))


@query(f"SELECT s1, s2, (sum(n) OVER (ORDER BY s1, s2) - n)::BIGINT AS first, (sum(n) OVER (ORDER BY s1, s2))::BIGINT AS after FROM (SELECT s1, s2, count(*) AS n FROM ({_SCORED_SQL}) GROUP BY ALL)")
def score_ranges(spark, d):
    return score_files.edge_ranges(_scored(spark, d))


# joins, predicates, windows


@query(f"""SELECT i.id AS island, l.fam AS ofam, l.fam % 7 AS ifam, l.fam * 50 + l.k AS lf, l.gene FROM (SELECT id, unnest(lfs) AS lf FROM ({A.ISLANDS_SQL})) i
 JOIN ({_LF_SQL}) l ON l.fam * 50 + l.k = i.lf""")
def island_assignments(spark, d):
    """Genes of all islands, by the equi joins of the assignment table."""
    loci = _loci(spark, d).select((F.col("fam") * 50 + F.col("k")).alias("lf"), "fam", "gene")
    origins = loci.select("fam").distinct().withColumn("source_fam", F.col("fam") % 7)
    return islands.assignments(A.islands(spark, d), loci, origins)


_CLOSURE = f"SELECT * FROM ({A.CLOSURE_SQL})"


@query(f"""WITH c AS ({_CLOSURE}) SELECT s_suppkey AS fam, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c."desc" = 'n3' AND c.depth > 0 AND c.anc = m.mrca) THEN 'C' ELSE 'X' END AS class
 FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'world' WHEN 1 THEN 'r' || s_suppkey % 5 WHEN 2 THEN 'n' || s_nationkey ELSE 's' || s_suppkey END AS mrca FROM supplier) m""")
def core_or_acquired(spark, d):
    s = A.table(spark, d, "supplier")
    node = lambda w, c: F.concat(F.lit(w), c.cast("string"))
    key = F.col("s_suppkey")
    mrca = F.when(key % 4 == 0, "world").when(key % 4 == 1, node("r", key % 5)).when(key % 4 == 2, node("n", F.col("s_nationkey"))).otherwise(node("s", key))
    return families.classify(s.select(key.alias("fam"), mrca.alias("mrca")), tree.closure(A.tree(spark, d)), "n3").select("fam", "class")


@query("SELECT DISTINCT user_id AS fam FROM events WHERE event_type = 'purchase'")
def event_existence(spark, d):
    return families.families_with_event(A.table(spark, d, "events").select(F.col("user_id").alias("fam"), F.col("event_type").alias("event")), "purchase")


@query("SELECT event_type AS event, count(*) AS n FROM (SELECT event_type FROM events) GROUP BY 1")
def events_in_total(spark, d):
    return families.event_counts(A.table(spark, d, "events").select(F.col("event_type").alias("event")))


@query("""SELECT line_no, text, strain FROM (SELECT event_id AS line_no, event_type AS text, last_value(CASE WHEN event_type = 'purchase' THEN event_id::VARCHAR END IGNORE NULLS)
   OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS strain, event_type FROM events) WHERE event_type != 'purchase'""")
def header_fill(spark, d):
    e = A.table(spark, d, "events")
    value = F.when(F.col("event_type") == "purchase", F.concat(F.lit("# "), F.col("event_id").cast("string"))).otherwise(F.col("event_type"))
    return order.fill_headers(e.select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("line_no"), value.alias("text"))).select("line_no", "text", "strain")


@query(f"""WITH n AS (SELECT fam, count(DISTINCT gene) AS n FROM ({_LF_SQL}) GROUP BY fam), s AS (SELECT l_orderkey AS grp, l_partkey AS gene FROM lineitem GROUP BY ALL),
 m AS (SELECT s.grp, f.fam, count(*) AS k FROM s JOIN (SELECT DISTINCT fam, gene FROM ({_LF_SQL})) f USING (gene) GROUP BY ALL), z AS (SELECT grp, count(*) AS n FROM s GROUP BY grp)
 SELECT m.grp, min(m.fam) AS fam FROM m JOIN z USING (grp) WHERE m.k = z.n GROUP BY m.grp""")
def hard_core_families(spark, d):
    sets = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("gene")).distinct()
    return families.first_holding(sets, _loci(spark, d).select("fam", "gene").distinct())


@query(f"""WITH l AS (SELECT fam, fam * 50 + k AS lf FROM ({_LF_SQL}) GROUP BY ALL), s AS (SELECT unnest(lfs) AS lf FROM ({A.ISLANDS_SQL}) WHERE len(lfs) <= 3)
 SELECT DISTINCT fam FROM l WHERE lf IN (SELECT lf FROM s) AND fam % 2 = 0""")
def families_to_refine(spark, d):
    """Families with several solutions (here: of even number) in islands of few locus families: two semi joins."""
    loci = _loci(spark, d).select("fam", (F.col("fam") * 50 + F.col("k")).alias("lf")).distinct()
    solved = loci.select("fam").distinct().withColumn("n_mprs", F.when(F.col("fam") % 2 == 0, "7").otherwise("1"))
    return families.refine_candidates(solved, A.islands(spark, d), loci, 3)


@query("SELECT a, n FROM (SELECT 'same' AS a, TRUE AS n UNION ALL SELECT 'fewer', count(*) FILTER (event_type = 'view') = count(*) FROM events)")
def table_equality(spark, d):
    e = A.table(spark, d, "events").select("event_id", "event_type")
    found = [("same", reports.same_table(e, e.repartition(3))), ("fewer", reports.same_table(e, e.where("event_type = 'view'")))]
    return spark.createDataFrame(found, "a string, n boolean")


@query("SELECT DISTINCT l_partkey AS g1, l_suppkey AS g2 FROM lineitem")
def distinct_pairs(spark, d):
    return hits.distinct_pairs(_scored(spark, d))


# trees


@query(f"""SELECT node, row_number() OVER (ORDER BY path) AS ord FROM (SELECT "desc" AS node, string_agg(anc, chr(1) ORDER BY depth DESC) AS path FROM ({A.CLOSURE_SQL}) GROUP BY 1)""")
def tree_preorder(spark, d):
    return tree.preorder(A.tree(spark, d), tree.closure(A.tree(spark, d)))


_KEEP_SQL = "SELECT 's' || s_suppkey AS node FROM supplier WHERE s_acctbal > 5000"


@query(f"""WITH c AS ({_CLOSURE}), k AS ({_KEEP_SQL}), via AS (SELECT p.anc, p."desc" AS child FROM c p WHERE p.depth = 1 AND EXISTS (SELECT 1 FROM c JOIN k ON k.node = c."desc" WHERE c.anc = p."desc")),
 kept AS (SELECT anc AS node FROM via GROUP BY anc HAVING count(*) > 1 UNION SELECT node FROM k),
 near AS (SELECT c."desc" AS node, arg_min(c.anc, c.depth) AS parent, arg_min(c.dist, c.depth) AS branch_len FROM c JOIN kept a ON a.node = c.anc JOIN kept b ON b.node = c."desc" WHERE c.depth > 0 GROUP BY 1)
 SELECT kept.node, near.parent, near.branch_len FROM kept LEFT JOIN near USING (node)""")
def pruned_tree(spark, d):
    keep = A.table(spark, d, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return tree.prune(A.tree(spark, d), tree.closure(A.tree(spark, d)), keep)


# reports

_EXTENT_SQL = "SELECT p_size % 6 AS strain, p_brand AS chrom, p_partkey % 40 AS island, p_partkey * 10 AS start, p_partkey * 10 + p_size AS \"end\" FROM part"


def _extent_input(spark, d):
    p = A.table(spark, d, "part")
    genes = p.select(F.col("p_partkey").alias("gene"), (F.col("p_size") % 6).cast("long").alias("strain"), F.col("p_brand").alias("chrom"), (F.col("p_partkey") * 10).alias("start"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("end"))
    return p.select((F.col("p_partkey") % 40).alias("island"), F.col("p_partkey").alias("gene")), genes


@query(f"""SELECT strain::BIGINT AS strain, chrom, island, min(start) AS start, max("end") AS "end", count(*) AS n, quantile_cont(("end" - start) / 2.0::DOUBLE, 0.5) AS half FROM ({_EXTENT_SQL}) GROUP BY strain, chrom, island""")
def island_extents(spark, d):
    return reports.island_extents(*_extent_input(spark, d))


@query(f"""WITH e AS (SELECT strain, chrom, island, min(start) AS a, max("end") AS b, count(*) AS n FROM ({_EXTENT_SQL}) GROUP BY ALL)
 SELECT strain::BIGINT AS strain, concat_ws(chr(9), chrom, a, b, island, '0', '+', a, a, '0,0,' || island % 2, '1', b - a, '0', 'n' || island, n) AS value FROM e""")
def bed_lines(spark, d):
    rows = reports.island_extents(*_extent_input(spark, d)).withColumns({"strand": F.lit("+"), "mrca": F.concat(F.lit("n"), F.col("island").cast("string"))})
    colours = rows.select("strain", "island").distinct().withColumn("rgb", F.concat(F.lit("0,0,"), (F.col("island") % 2).cast("string")))
    return reports.bed_rows(rows, colours).select("strain", "value")


@query(f"""WITH g AS (SELECT fam * 50 + k AS lf, string_agg(gene::VARCHAR, ',' ORDER BY gene::VARCHAR) AS genes FROM ({_LF_SQL}) GROUP BY ALL),
 f AS (SELECT id, mrca, unnest(lfs) AS lf, generate_subscripts(lfs, 1) AS i FROM ({A.ISLANDS_SQL}))
 SELECT id, concat_ws(chr(9), id, mrca, string_agg(f.lf || ':' || coalesce(g.genes, ''), chr(9) ORDER BY i)) AS value FROM f LEFT JOIN g USING (lf) GROUP BY id, mrca""")
def island_lines(spark, d):
    members = _loci(spark, d).select((F.col("fam") * 50 + F.col("k")).alias("lf"), F.col("gene").cast("string").alias("name"))
    return reports.island_lines(A.islands(spark, d), members).select("id", "value")


@query(f"""SELECT mrca, sum(n)::BIGINT AS n_islands, sum(n * size)::BIGINT AS n_families, string_agg(size || ':' || n, ' ' ORDER BY size) AS sizes FROM (SELECT mrca, len(lfs) AS size, count(*) AS n FROM ({A.ISLANDS_SQL}) GROUP BY ALL) GROUP BY mrca""")
def island_summary(spark, d):
    return reports.island_summary(A.islands(spark, d))


@query(f"""WITH o AS ({A.ORDER_SQL}) SELECT strain, contig, pos, concat_ws(chr(9), 'g' || gene, CASE WHEN core IS NULL THEN 'X' ELSE 'C' END, '', (gene % 9)::VARCHAR, '', '', (gene % 400)::VARCHAR, '', event_type) AS value FROM o JOIN events ON event_id = gene""")
def strain_lines(spark, d):
    o = A.gene_order(spark, d)
    genes = A.table(spark, d, "events").select(F.col("event_id").alias("gene"), F.concat(F.lit("g"), F.col("event_id").cast("string")).alias("name"), F.col("event_type").alias("descrip"))
    assigned = o.select("gene", F.when(F.col("core").isNull(), "X").otherwise("C").alias("class"), (F.col("gene") % 9).alias("island"), (F.col("gene") % 400).alias("lf"))
    return reports.strain_lines(o.drop("core"), genes, assigned)


@query(f"""WITH f AS (SELECT DISTINCT fam, gene FROM ({_LF_SQL})) SELECT fam, count(*) FILTER (gene % 4 = 0) AS n_0, count(*) FILTER (gene % 4 = 1) AS n_1, count(*) FILTER (gene % 4 = 2) AS n_2, count(*) FILTER (gene % 4 = 3) AS n_3 FROM f GROUP BY fam""")
def family_strain_table(spark, d):
    members = _loci(spark, d).select("fam", "gene").distinct().withColumn("strain", F.col("gene") % 4)
    return reports.strain_table(members, "fam", [0, 1, 2, 3])


@query("SELECT p_partkey FROM part WHERE contains(p_name, '1') OR contains(p_brand, '1') OR contains(p_type, '1') OR contains(p_type, 'T')")
def any_field_search(spark, d):
    p = A.table(spark, d, "part")
    return reports.search(p, ["p_name", "p_brand", "p_type"], "1").select("p_partkey").union(reports.search(p, ["p_type", "p_name"], "T").where(~F.contains("p_name", F.lit("T")) | F.contains("p_type", F.lit("T"))).select("p_partkey")).distinct()


@query(f"""SELECT o.gene, n.name AS name, m.name AS other_name, printf('%.3f', o.raw_sc) AS shown FROM (SELECT l_partkey AS gene, l_suppkey AS other, max(l_quantity::DOUBLE / 64) AS raw_sc FROM lineitem GROUP BY ALL) o
 JOIN (SELECT p_partkey AS gene, p_name AS name FROM part) n ON n.gene = o.gene JOIN (SELECT p_partkey AS gene, p_name AS name FROM part) m ON m.gene = o.other""")
def outside_score_list(spark, d):
    rows = _scored(spark, d).groupBy(F.col("g1").alias("gene"), F.col("g2").alias("other")).agg(F.max("raw_sc").alias("raw_sc"))
    return reports.outside_scores(rows, A.table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_name").alias("name"))).select("gene", "name", "other_name", "shown")


# SQL functions

@query("""SELECT p_partkey, string_agg(CASE WHEN c = '-' THEN '---' ELSE substr(dna, 3 * (k - 1)::INT + 1, 3) END, '' ORDER BY i) AS codons FROM (
  SELECT p_partkey, i, c, dna, sum(CASE WHEN c != '-' THEN 1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY i) AS k FROM (
   SELECT p_partkey, i, substr(prot, i::INT, 1) AS c, dna FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS prot, repeat('ACGTGA', length(p_name)) AS dna FROM part), range(1, 80) g(i) WHERE i <= length(prot))) GROUP BY p_partkey""")
def back_aligned(spark, d):
    sql_functions.register(spark)
    p = A.table(spark, d, "part")
    p.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("-")).alias("prot"), F.expr("repeat('ACGTGA', length(p_name))").alias("dna")).createOrReplaceTempView("aligned_parts")
    return spark.sql("SELECT p_partkey, back_align(prot, dna) AS codons FROM aligned_parts")


_RAW_SQL = """WITH RECURSIVE m AS (SELECT [%s] AS b, '%s' AS a), p AS (SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS seq FROM part),
 c AS (SELECT p_partkey, b, list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN strpos(a, substr(seq, i::INT, 1)) > 0 THEN strpos(a, substr(seq, i::INT, 1)) - 1 ELSE 22 END) AS code FROM p, m),
 q AS (SELECT x.p_partkey AS g1, y.p_partkey AS g2, x.b, x.code AS s, y.code AS t, len(y.code) AS n FROM c x JOIN c y ON y.p_partkey = x.p_partkey + 1 WHERE len(x.code) > 0 AND len(y.code) > 0),
 r AS (SELECT g1, g2, b, s, t, n, 0 AS i, list_prepend(0::BIGINT, list_transform(range(0, n), lambda j: -12 - j)) AS best, list_transform(range(0, n + 1), lambda j: -1099511627776::BIGINT) AS down FROM q
  UNION ALL
  SELECT g1, g2, b, s, t, n, i + 1, list_transform(range(1, n + 2), lambda k: greatest(now[k], coalesce(list_max(list_transform(range(1, k), lambda j: now[j] - 12 - (k - j - 1))), -1099511627776))) AS best, down FROM (
   SELECT g1, g2, b, s, t, n, i, down, list_prepend((-12 - i)::BIGINT, list_transform(range(1, n + 1), lambda j: greatest(best[j] + b[s[i + 1] * 24 + t[j] + 1], down[j + 1]))) AS now FROM (
    SELECT g1, g2, b, s, t, n, i, best, list_transform(range(1, n + 2), lambda j: greatest(best[j] - 12, down[j] - 1)) AS down FROM r WHERE i < len(s)))),
 f AS (SELECT g1, g2, best[n + 1] AS score, -(24 + (len(s) + n - 2))::DOUBLE AS low, list_sum(list_transform(CASE WHEN len(s) < n THEN s ELSE t END, lambda x: b[x * 25 + 1])) AS high FROM r WHERE i = len(s))
 SELECT g1, g2, (score - low) / (high - low) AS raw_sc FROM f""" % (", ".join(scores.BLOSUM62.split()), scores.AMINO)


@query(_RAW_SQL)
def raw_scores(spark, d):
    p = A.table(spark, d, "part").select("p_partkey", F.regexp_replace(F.upper("p_name"), "[^A-Z]", "").alias("seq"))
    pairs = p.select(F.col("p_partkey").alias("g1"), F.col("seq").alias("seq1")).join(p.select((F.col("p_partkey") - 1).alias("g1"), F.col("p_partkey").alias("g2"), F.col("seq").alias("seq2")), "g1")
    return scores.raw_scores(pairs.where("length(seq1) > 0 and length(seq2) > 0"))


_EDGES_SQL = f"SELECT least(q, s) AS g1, greatest(q, s) AS g2, max(score)::DOUBLE AS raw_sc FROM ({A.FILTERED_SQL}) GROUP BY ALL"
_PART_ORDER_SQL = "SELECT p_partkey % 4 AS strain, p_brand AS contig, row_number() OVER (PARTITION BY p_partkey % 4, p_brand ORDER BY p_partkey) - 1 AS pos, p_partkey AS gene FROM part"


def _greedy_sql(take: int) -> str:
    """The best candidate, and again the best of those that share no place with the ones taken."""
    steps = []
    for k in range(1, take + 1):
        steps.append(f"t{k} AS (SELECT g1, g2, arg_min(struct_pack(i, j, raw_sc), struct_pack(a := -raw_sc, b := i, c := j)) AS t FROM c{k - 1} GROUP BY g1, g2)")
        steps.append(f"c{k} AS (SELECT c.* FROM c{k - 1} c JOIN t{k} USING (g1, g2) WHERE c.i != t.i AND c.j != t.j)")
    taken = " UNION ALL ".join(f"SELECT g1, g2, t.raw_sc AS x FROM t{k}" for k in range(1, take + 1))
    return ", ".join(steps) + f", s AS (SELECT g1, g2, sum(x) / {take} AS syn_sc FROM ({taken}) GROUP BY g1, g2)"


@query(f"""WITH e AS ({_EDGES_SQL}), o AS ({_PART_ORDER_SQL}), n AS (SELECT o.gene, p.gene AS x, row_number() OVER (PARTITION BY o.gene ORDER BY p.pos) - 1 AS i
   FROM o JOIN o p ON o.contig = p.contig AND o.strain = p.strain AND p.pos BETWEEN o.pos - 4 AND o.pos + 3 AND p.pos != o.pos),
 b AS (SELECT g1 AS x, g2 AS y, raw_sc FROM e UNION SELECT g2, g1, raw_sc FROM e),
 c0 AS (SELECT e.g1, e.g2, n1.i, n2.i AS j, b.raw_sc FROM e JOIN n n1 ON n1.gene = e.g1 JOIN n n2 ON n2.gene = e.g2 JOIN b ON b.x = n1.x AND b.y = n2.x), {_greedy_sql(3)}
 SELECT e.g1, e.g2, round(coalesce(s.syn_sc, 0.0::DOUBLE), 9) AS syn_sc FROM e LEFT JOIN s USING (g1, g2)""")
def synteny_scores(spark, d):
    # few partitions of the session would make large tasks of many lines
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), A.order_lines(spark, d).rdd.getNumPartitions())
    found = hits.filter_hits(A.placed_hits(spark, d, order.places(A.part_order(spark, d)), parts, 4))
    scored = tiles.synteny_scores(found.withColumnRenamed("score", "raw_sc"), parts, 8)
    return scored.withColumn("syn_sc", F.round("syn_sc", 9))


@query("SELECT lf, gene FROM (SELECT l_suppkey AS lf, l_partkey AS gene, row_number() OVER (PARTITION BY l_suppkey ORDER BY md5(l_partkey::VARCHAR), l_partkey) AS r FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) WHERE r <= 4")
def representatives(spark, d):
    rows = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("lf"), F.col("l_partkey").alias("gene")).distinct()
    return reports.representatives(rows, 4)


@query(f"""WITH c AS ({_CLOSURE}), t AS ({A.TREE_SQL}), l AS (SELECT node FROM t WHERE node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)), v AS (SELECT "desc" AS anc, max(depth) AS lv FROM c GROUP BY 1),
 u AS (SELECT c.anc, c."desc" AS tip, c.dist, lv FROM c JOIN v ON v.anc = c.anc JOIN l ON l.node = c."desc")
 SELECT a.tip AS a, b.tip AS b, arg_max(a.dist + b.dist, a.lv) AS dist FROM u a JOIN u b ON a.anc = b.anc AND a.tip < b.tip GROUP BY ALL""")
def tip_distances(spark, d):
    """All pairs of the tree's tips: the operator's result is that matrix."""
    return tree.tip_distances(tree.closure(A.tree(spark, d)), tree.leaves(A.tree(spark, d)))


@query()
def optimal_histories(spark, d):
    """Events of up to three optimal solutions of every family of three genes or more."""
    from cladescope.plans.registry import SPECIES, _recon_input

    return families.histories(_recon_input(spark, d).where(F.size("genes") > 2), SPECIES, most=3)
