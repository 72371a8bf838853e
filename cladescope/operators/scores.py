"""Scores of gene pairs: alignment, conserved neighbourhood, core context, thresholds, histograms, peaks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The BLOSUM62 matrix, rows and columns in this order.
AMINO = "ARNDCQEGHILKMFPSTWYVBZX*"
BLOSUM62 = """
 4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0 -2 -1  0 -4
-1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3 -1  0 -1 -4
-2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3  3  0 -1 -4
-2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3  4  1 -1 -4
 0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1 -3 -3 -2 -4
-1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2  0  3 -1 -4
-1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
 0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3 -1 -2 -1 -4
-2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3  0  0 -1 -4
-1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3 -3 -3 -1 -4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1 -4 -3 -1 -4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2  0  1 -1 -4
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1 -3 -1 -1 -4
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1 -3 -3 -1 -4
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2 -2 -1 -2 -4
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2  0  0  0 -4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0 -1 -1  0 -4
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3 -4 -3 -2 -4
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1 -3 -2 -1 -4
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4 -3 -2 -1 -4
-2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4  1 -1 -4
-1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4 -1 -4
 0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1 -1 -1 -1 -4
-4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4  1
"""
_MATRIX = np.array(BLOSUM62.split(), np.int64).reshape(len(AMINO), len(AMINO))
_CODE = np.full(256, AMINO.index("X"), np.int64)
for _i, _c in enumerate(AMINO):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def _codes(sequence: str) -> np.ndarray:
    return _CODE[np.frombuffer(sequence.encode("ascii", "replace"), np.uint8)]


def align_score(a: str, b: str, gap_open: int = 12, gap_extend: int = 1) -> int:
    """Best global alignment score with affine gaps (a gap of n costs open + (n - 1) extend).

    One row of the dynamic programme at a time; gaps along the row are a running
    maximum, so each row is vector arithmetic.
    """
    s, t = _codes(a), _codes(b)
    n = len(t)
    along = np.arange(n + 1) * gap_extend
    best = np.concatenate([[0], -gap_open - along[:-1]]).astype(np.int64)
    down = np.full(n + 1, -(1 << 40), np.int64)
    for i, code in enumerate(s.tolist()):
        down = np.maximum(best - gap_open, down - gap_extend)
        now = np.empty(n + 1, np.int64)
        now[0] = -gap_open - i * gap_extend
        now[1:] = np.maximum(best[:-1] + _MATRIX[code, t], down[1:])
        # opening at j and extending to k: now[j] - open - (k - j - 1) * extend
        reach = np.maximum.accumulate(now + along)[:-1] - gap_open - along[:-1]
        now[1:] = np.maximum(now[1:], reach)
        best = now
    return int(best[-1])


def raw_score(a: str, b: str, gap_open: int = 12, gap_extend: int = 1) -> float:
    """Alignment score scaled from the score of all gaps to the shorter sequence's score with itself.

    Of equally long ones the second is the shorter; the result isn't clamped.
    """
    low = -(2 * gap_open + (len(a) + len(b) - 2) * gap_extend)
    short = _codes(a if len(a) < len(b) else b)
    high = int(_MATRIX[short, short].sum())
    return (align_score(a, b, gap_open, gap_extend) - low) / (high - low)


def raw_scores(pairs: DataFrame) -> DataFrame:
    """g1, g2, raw_sc of pairs (g1, g2, seq1, seq2); Arrow batches, one alignment a row."""

    def run(batches):
        for batch in batches:
            yield batch[["g1", "g2"]].assign(raw_sc=[raw_score(a, b) for a, b in zip(batch["seq1"], batch["seq2"])])

    return pairs.mapInPandas(run, "g1 long, g2 long, raw_sc double")


def greedy_matching(candidates: list[tuple[float, int, int]], take: int) -> float:
    """Mean of the ``take`` best disjoint candidates (score, i, j), zeros filling up; ties by place."""
    used_i, used_j, total, n = set(), set(), 0.0, 0
    for score, i, j in sorted(candidates, key=lambda x: (-x[0], x[1], x[2])):
        if i in used_i or j in used_j:
            continue
        used_i.add(i)
        used_j.add(j)
        total, n = total + score, n + 1
        if n == take:
            break
    return total / take


def synteny_scores(pairs: DataFrame, neighbours: DataFrame, edges: DataFrame, take: int = 3, runs: DataFrame | None = None) -> DataFrame:
    """g1, g2, syn_sc: how well the genes around one match those around the other.

    pairs (g1, g2); neighbours (gene, neighbours); edges (g1, g2, raw_sc). The
    candidates are joined by edge, at most one per pair of neighbours; the greedy
    choice among a pair's few candidates is one small array per row. ``runs`` (gene,
    run) puts every gene into a run; a pair meets the edges between the runs of its
    neighbours, so runs of genes that lie together save rows and change no score.
    Tables of all genes grow with the input, which their windows and arrays hide from
    the planner: they are merged, as a broadcast of them would go through the driver.
    """
    if runs is None:
        runs = neighbours.select(F.explode("neighbours").alias("gene")).distinct().withColumn("run", F.col("gene"))
    there = neighbours.select("gene", "neighbours", F.explode("neighbours").alias("x")).join(runs.select(F.col("gene").alias("x"), "run").hint("merge"), "x")
    there = there.groupBy("gene").agg(F.first("neighbours").alias("near"), F.collect_set("run").alias("runs"))
    a = there.select(F.col("gene").alias("g1"), F.col("near").alias("near1"), F.col("runs").alias("runs1"))
    b = there.select(F.col("gene").alias("g2"), F.col("near").alias("near2"), F.col("runs").alias("runs2"))
    both = edges.select(F.col("g1").alias("x"), F.col("g2").alias("y"), "raw_sc")
    both = both.join(runs.select(F.col("gene").alias("x"), F.col("run").alias("r1")).hint("merge"), "x")
    both = both.join(runs.select(F.col("gene").alias("y"), F.col("run").alias("r2")).hint("merge"), "y")
    both = both.unionByName(both.where("x != y").select(F.col("y").alias("x"), F.col("x").alias("y"), "raw_sc", F.col("r2").alias("r1"), F.col("r1").alias("r2")))
    asked = pairs.select("g1", "g2").join(a.hint("merge"), "g1").join(b.hint("merge"), "g2").withColumn("r1", F.explode("runs1")).withColumn("r2", F.explode("runs2"))
    met = asked.join(both.hint("merge"), ["r1", "r2"]).select("g1", "g2", "raw_sc", (F.array_position("near1", F.col("x")) - 1).alias("i"), (F.array_position("near2", F.col("y")) - 1).alias("j")).where("i >= 0 and j >= 0")
    found = met.groupBy("g1", "g2").agg(F.collect_list(F.struct("raw_sc", "i", "j")).alias("c"))

    def run(batches):
        for batch in batches:
            yield batch[["g1", "g2"]].assign(syn_sc=[greedy_matching([(x["raw_sc"], x["i"], x["j"]) for x in c], take) for c in batch["c"]])

    scored = found.mapInPandas(run, "g1 long, g2 long, syn_sc double")
    return pairs.select("g1", "g2").join(scored.hint("merge"), ["g1", "g2"], "left").fillna(0.0, ["syn_sc"])


def core_synteny(context1: Column, context2: Column) -> Column:
    """Common core genes over the longer context's length; 0 if both are empty."""
    longest = F.greatest(F.size(context1), F.size(context2))
    return F.when(longest > 0, F.size(F.array_intersect(context1, context2)) / longest).otherwise(F.lit(0.0))


def core_synteny_scores(pairs: DataFrame, contexts: DataFrame) -> DataFrame:
    """g1, g2, core_syn_sc from contexts (gene, context)."""
    c1 = contexts.select(F.col("gene").alias("g1"), F.col("context").alias("c1"))
    c2 = contexts.select(F.col("gene").alias("g2"), F.col("context").alias("c2"))
    return pairs.select("g1", "g2").join(c1, "g1").join(c2, "g2").select("g1", "g2", core_synteny(F.col("c1"), F.col("c2")).alias("core_syn_sc"))


def quantile_thresholds(scores: DataFrame, by: list[str], quantile: float = 0.1, times: float = 0.5) -> DataFrame:
    """Per group ``times`` the exact, interpolated quantile of score."""
    return scores.groupBy(*by).agg((F.percentile("score", quantile) * times).alias("threshold"))


def same_locus(edges: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Edges whose synteny scores both reach their strain pair's thresholds (s1, s2, syn_thr, core_thr)."""
    return edges.join(thresholds, ["s1", "s2"]).where("core_syn_sc >= core_thr and syn_sc >= syn_thr").drop("syn_thr", "core_thr")


def summary(scores: DataFrame, by: list[str]) -> DataFrame:
    """n, mean, sample deviation (null below two values) of score per group."""
    return scores.groupBy(*by).agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"))


def histogram(scores: DataFrame, bins: int = 80, low: float | None = 0.0, high: float | None = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """bin (from 0), n, density; the last bin is closed. Without bounds the data's own range is taken."""
    rows = scores
    if low is None or high is None:
        ends = scores.groupBy(*by).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        rows = scores.join(ends, list(by)) if by else scores.crossJoin(F.broadcast(ends))
    else:
        rows = scores.withColumns({"lo": F.lit(float(low)), "hi": F.lit(float(high))})
    place = F.floor((F.col("score") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))
    rows = rows.where("score between lo and hi").withColumn("bin", F.least(F.when(F.col("hi") > F.col("lo"), place).otherwise(0), F.lit(bins - 1)).cast("int"))
    counts = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    total = F.sum("n").over(Window.partitionBy(*by))
    width = (F.col("hi") - F.col("lo")) / bins
    return counts.select(*by, "bin", "n", (F.col("n") / (total * width)).alias("density"))


def peaks(heights: list[float], centres: list[float], bin_width: float, least_width: float, height_share: float, prominence: float, left: float, right: float) -> list[tuple[float, float]]:
    """(centre, prominence) of the peaks between ``left`` and ``right`` with that width and prominence.

    A zero bin closes the right end. A plateau's middle is its peak. Prominence is
    the height above the higher of the lowest points towards higher ground on each
    side; width is measured, with interpolation, ``height_share`` of it down.
    """
    h = np.array([*heights, 0.0])
    out = []
    i = 1
    while i < len(h) - 1:
        j = i
        while j < len(h) - 1 and h[j + 1] == h[i]:
            j += 1
        if h[i] > h[i - 1] and j < len(h) - 1 and h[j + 1] < h[i]:
            p = (i + j) // 2
            a = p
            while a > 0 and h[a - 1] <= h[p]:
                a -= 1
            b = p
            while b < len(h) - 1 and h[b + 1] <= h[p]:
                b += 1
            rise = h[p] - max(h[a : p + 1].min(), h[p : b + 1].min())
            level = h[p] - rise * height_share
            x = p
            while x > a and h[x] > level:
                x -= 1
            x_at = x + (level - h[x]) / (h[x + 1] - h[x]) if h[x] < level else float(x)
            y = p
            while y < b and h[y] > level:
                y += 1
            y_at = y - (level - h[y]) / (h[y - 1] - h[y]) if h[y] < level else float(y)
            if rise >= prominence and (y_at - x_at) * bin_width >= least_width and left <= centres[p] <= right:
                out.append((centres[p], float(rise)))
        i = j + 1
    return out


# The three sets of conditions for a peak of homologous pairs
# (width, prominence, left limit), with the right limit and relative height.
PEAK_CASES = ((0.05, 0.4, 0.65), (0.0, 6.0, 0.90), (0.25, 0.10, 0.65))
PEAK_RIGHT, PEAK_HEIGHT = 1.0, 0.9


def has_homolog_peak(heights: list[float], centres: list[float], bins: int = 80) -> bool:
    """Whether a strain pair's score histogram shows a peak of homologs."""
    return any(peaks(heights, centres, 1 / bins, w, PEAK_HEIGHT, p, left, PEAK_RIGHT) for w, p, left in PEAK_CASES)
