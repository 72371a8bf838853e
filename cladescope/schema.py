"""Schemas of the engine's tables."""

STRAIN = "strain_idx int, strain string"
GENE = "gene long, name string, common_name string, locus_tag string, protein_id string, descrip string, chrom string, start long, `end` long, strand string, strain string"
GENE_ORDER = "strain string, contig int, pos int, gene long"
SEQUENCE = "gene string, sequence string"
HIT = "strain_q string, strain_s string, line_no long, q long, s long, evalue double, qlen int, qstart int, qend int, slen int, sstart int, send int, pident double, score int"
EDGE = "g1 long, g2 long, s1 string, s2 string, raw_sc double, syn_sc double, core_syn_sc double"
ORTHOLOGS = "grp int, genes array<long>"
TREE_NODE = "tree_id string, node string, parent string, child_ord int, branch_len double, preorder int"
LOCUS_FAMILY = "lf long, fam long, lf_mrca string, locus long, root_node string, genes array<long>"
FAMILY = "fam long, mrca string, tree string, source_fam long"
RECON_EVENT = "fam long, gene_node string, nb string, ord int, event string, sp_node string, sp_nb string, locus long"
ISLAND = "id long, mrca string, lfs array<long>"
GENE_ASSIGNMENT = "gene long, island long, ifam long, ofam long, lf long"
