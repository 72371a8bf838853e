"""Functions for SQL: ``register`` makes them known to a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from cladescope.functions.reconcile import Costs, Reconciliation, best_rooting
from cladescope.functions.sequences import back_align
from cladescope.functions.trees import Unrooted, parse_newick
from cladescope.operators.scores import raw_score


def _back_align(alignment: pd.Series, dna: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or x is None else back_align(a, x) for a, x in zip(alignment, dna)])


def _raw_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([raw_score(x, y) if x and y else None for x, y in zip(a, b)], dtype="float64")


def _newick_leaves(newick: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else parse_newick(t, "g").leaves() for t in newick])


def _newick_size(newick: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else len(parse_newick(t, "g").preorder()) for t in newick], dtype="Int32")


class OptimalHistories:
    """Events of the first ``most`` optimal reconciliations of a gene tree; genes: array of (gene, species, locus)."""

    def eval(self, newick: str, genes: list, species_newick: str, most: int):
        species = {g["gene"]: g["species"] for g in genes}
        locus = {g["gene"]: int(g["locus"]) for g in genes}
        tree, above = parse_newick(newick, "g"), parse_newick(species_newick)
        found = Reconciliation(above, tree, species, locus, Costs()) if len(species) < 3 else best_rooting(above, Unrooted.of(tree), species, locus, Costs())
        for k, solution in enumerate(found.solutions(most)):
            for gene_node, part, event, sp_node, sp_part, at in found.events_of(solution):
                yield k, gene_node, part, event, sp_node, sp_part, at


#: Name in SQL -> (function on columns, type of its result).
FUNCTIONS = {"back_align": (_back_align, "string"), "raw_score": (_raw_score, "double"), "newick_leaves": (_newick_leaves, "array<string>"), "newick_size": (_newick_size, "int")}
HISTORY = "solution: int, gene_node: string, nb: string, event: string, sp_node: string, sp_nb: string, locus: bigint"


def register(spark: SparkSession) -> None:
    """``back_align``, ``raw_score``, ``newick_leaves`` and ``newick_size``, and the table function ``optimal_histories``."""
    for name, (f, kind) in FUNCTIONS.items():
        spark.udf.register(name, pandas_udf(f, kind))
    spark.udtf.register("optimal_histories", udtf(OptimalHistories, returnType=HISTORY))
