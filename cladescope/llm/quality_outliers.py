"""Quality rules with robust multivariate outliers.

Each text gives a vector of transformed statistics. Per language and source the
minimum covariance determinant estimates centre and scatter: from several starts
concentration steps keep the HALF most central rows until the determinant falls
no more, and the start with the least determinant wins. A vector whose
Mahalanobis distance exceeds a chi-square quantile is rejected, as are texts that
fail the base rules.

A group's estimate is drawn towards its language's, and that one towards the
estimate of all rows, each by as much as SHRINK rows weigh: small groups lean on
the larger one, and no size is a switch. Statistics that most texts share exactly
(no symbols, no line twice) have no variance among the central rows; the variances
of FLOORS stand in, far below the spread of the others.

Scale: one pass over the text writes the statistics (a few numbers a row). A
concentration step is one pass with map-side sums per group and class of the
distance, a few hundred at most, of which the central ones are added up; rows meet
their group's row by broadcast while the groups are few, else by group and salt,
so a source with a third of the rows is no hot task. Nothing is sampled. Vectors
are whole numbers of 1/SCALE, so sums, medians and verdicts are the same however
rows are dealt.

Defined cases: a null text has no words and fails; null language or source is a
group of its own; a corpus without a passing row rejects all; repeated rows count
as rows; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladescope.llm.common import lean, materialize
from cladescope.llm.textscan import mix, odd_numbers, scan_words, slices
from cladescope.storage import shared_dir

LEAST_WORDS, MOST_REPEAT = 50, 50
#: Share of rows in the concentrated subset; most concentration steps; rows that a language's estimate weighs in its groups'; tail of the chi-square law.
HALF, STEPS, SHRINK, TAIL = 0.75, 12, 100, 1e-9
#: Transformed statistics (shares by the arc sine of their root) and the standard deviation that each has at least.
FLOORS = {"x_length": 0.05, "x_word": 0.01, "x_symbol": 0.05, "x_dup": 0.13, "x_repeat": 0.13}
DIMENSIONS = tuple(FLOORS)
#: Parts of one in which vectors are kept; classes of a distance for each doubling; groups that are broadcast.
SCALE, CLASSES, FEW = 2048, 16, 5000

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_PLACE = odd_numbers(7, 4)
_BLANK = " \t\x0b\x0c\r"


def statistics(texts: list[str | None]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each text."""
    found = scan_words(texts)
    bounds = np.concatenate([[0], found.text_ends])
    first = found.first
    n_words = np.diff(first)

    def per_text(flags):
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])

    word_chars = per_text((found.raw & 0xC0 != 0x80) & ~found.gap)
    n_symbols = per_text(_SYMBOL[found.raw])
    h = found.hashes
    owner = np.repeat(np.arange(len(texts)), n_words)
    repeat = np.zeros(len(h), bool)
    if len(h) >= 3:
        window = h[:-2] * _PLACE[0] + h[1:-1] * _PLACE[1] + h[2:] * _PLACE[2]
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        key = mix(mix(window[inside]) + owner[inside].astype(np.uint64) * _PLACE[3])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = inside[twice]
        repeat[at] = repeat[at + 1] = repeat[at + 2] = True
    counts = np.concatenate([[0], np.cumsum(repeat)])
    n_repeat = counts[first[1:]] - counts[first[:-1]]
    n_lines, n_dup = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in (t or "").split("\n") if x.strip(_BLANK)]
        n_lines[i], n_dup[i] = len(lines), len(lines) - len(set(lines))
    return [n_words, word_chars, n_symbols, n_lines, n_dup, n_repeat]


def text_statistics(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, source, the base statistics, base_failed, and the transformed vector; written once."""
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for begin, end in slices(texts):
                cut = batch.slice(begin, end - begin)
                stats = [pa.array(x.astype(np.int64)) for x in statistics(texts[begin:end])]
                yield pa.record_batch([cut.column("doc_id"), cut.column("lang"), cut.column("source"), *stats], names=["doc_id", "lang", "source", *names])

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"), docs["text"].alias("text"))
    rows = slim.mapInArrow(lean(run), "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names))
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    rows = rows.withColumns(
        {
            "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words")),
            "x_length": F.log1p("n_words"),
            "x_word": F.log1p(F.col("word_chars") / words),
            "x_symbol": F.log1p(20 * F.col("n_symbols") / words),
            "x_dup": F.asin(F.sqrt(F.col("n_dup_lines") / lines)),
            "x_repeat": F.asin(F.sqrt(F.col("n_repeat_words") / words)),
        }
    ).withColumns({x: F.round(F.col(x) * SCALE).cast("long") for x in DIMENSIONS})
    return materialize(rows, "statistics")


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while abs(term) > 1e-16 * abs(total):
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi_square_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_p(d / 2, mid / 2) < p else (low, mid)
    return (low + high) / 2


def consistency(half: float, d: int) -> float:
    """Factor that makes the scatter of the ``half`` most central rows right for a normal law."""
    return half / gamma_p(d / 2 + 1, chi_square_quantile(half, d) / 2)


def _distance(centre: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance of the row's vector."""
    d = len(DIMENSIONS)
    gap = [F.col(x) / SCALE - centre[i] for i, x in enumerate(DIMENSIONS)]
    terms = [gap[i] * gap[j] * inverse[i * d + j] * (1 if i == j else 2) for i in range(d) for j in range(i, d)]
    return sum(terms[1:], terms[0])


def _sums() -> list[Column]:
    """n, the sums and the products of the vectors of a group: whole numbers."""
    d = len(DIMENSIONS)
    return [F.count("*").alias("n"), *[F.sum(x).alias(f"s_{i}") for i, x in enumerate(DIMENSIONS)], *[F.sum(F.col(DIMENSIONS[i]) * F.col(DIMENSIONS[j])).alias(f"p_{i}_{j}") for i in range(d) for j in range(i, d)]]


_SUMS = ["n", *[f"s_{i}" for i in range(len(DIMENSIONS))], *[f"p_{i}_{j}" for i in range(len(DIMENSIONS)) for j in range(i, len(DIMENSIONS))]]
_FLOOR = np.diag([f * f for f in FLOORS.values()])
_STATE = "grp string, start int, rows long, centre array<double>, scatter array<double>, inverse array<double>, det double"


def _state(moments: DataFrame, factor: float) -> DataFrame:
    """The estimate of each group and start from its sums; small matrices, a row each."""
    d = len(DIMENSIONS)

    def run(batches):
        for batch in batches:
            sums = batch[_SUMS].to_numpy(float)
            out = {"centre": [], "scatter": [], "inverse": [], "det": []}
            for row in sums:
                centre = row[1 : d + 1] / row[0] / SCALE
                full = np.zeros((d, d))
                full[np.triu_indices(d)] = row[d + 1 :] / row[0] / SCALE**2
                full = factor * (full + np.triu(full, 1).T - np.outer(centre, centre))
                values, vectors = np.linalg.eigh(full)
                full = vectors @ np.diag(np.maximum(values, 0)) @ vectors.T
                for k, v in zip(out, (centre, full.ravel(), np.linalg.inv(full + _FLOOR).ravel(), np.linalg.slogdet(full + _FLOOR)[1])):
                    out[k].append(v.tolist())
            yield batch[["grp", "start", "rows"]].assign(**out)

    return moments.select("grp", "start", "rows", *[F.col(x).cast("double").alias(x) for x in _SUMS]).mapInPandas(lean(run), _STATE)


def _levels() -> Column:
    """The groups of a row, finest first."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in ("lang", "source"))
    return F.array(F.to_json(F.struct(lang.alias("l"), source.alias("s"))), F.to_json(F.struct(lang.alias("l"))), F.lit("*"))


def _meet(rows: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    """``rows`` (grp, salt) with their group's small rows: broadcast if they are few, else a copy for every salt."""
    if few:
        return rows.drop("salt").join(F.broadcast(table), "grp")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), ["grp", "salt"]).drop("salt")


def _salt(spark) -> Column:
    return F.pmod(F.xxhash64("doc_id", *DIMENSIONS), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))).cast("int").alias("salt")


def _step(rows: DataFrame, now: DataFrame, few: bool) -> DataFrame:
    """One concentration step of every group and start."""
    far = _meet(rows, now.select("grp", "start", "rows", "centre", "inverse"), few)
    near = F.floor(CLASSES * F.log2(_distance(F.col("centre"), F.col("inverse")) + 1e-6)).cast("int")
    per = far.groupBy("grp", "start", near.alias("class")).agg(F.first("rows").alias("rows"), *_sums())
    before = Window.partitionBy("grp", "start").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("inside") < HALF * F.col("rows"))
    return _state(per.groupBy("grp", "start").agg(F.first("rows").alias("rows"), *[F.sum(x).alias(x) for x in _SUMS]), consistency(HALF, len(DIMENSIONS)))


def estimates(stats: DataFrame) -> DataFrame:
    """grp, rows, centre, scatter: minimum-covariance-determinant estimates of every group.

    Starts: the medians with the median deviations, and the mean with the
    covariance of all rows.
    """
    spark = stats.sparkSession
    shared_dir(spark)
    d = len(DIMENSIONS)
    rows = stats.where(~F.col("base_failed")).select(F.explode(_levels()).alias("grp"), _salt(spark), *DIMENSIONS)
    # whole numbers: an exact median keeps a count for each of a few thousand values
    size = rows.groupBy("grp").agg(F.count("*").alias("rows"), *[F.percentile(x, 0.5).alias(f"m_{x}") for x in DIMENSIONS]).checkpoint()
    few = size.count() <= FEW
    spread = _meet(rows, size, few).groupBy("grp").agg(*[F.percentile(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5).alias(f"d_{x}") for x in DIMENSIONS])
    variance = [(1.4826 * F.col(f"d_{x}") / SCALE) ** 2 for x in DIMENSIONS]
    diagonal = lambda value: F.array(*[value(i) if i == j else F.lit(0.0) for i in range(d) for j in range(d)])
    medians = size.join(spread, "grp").select(
        "grp", F.lit(0).alias("start"), "rows", F.array(*[F.col(f"m_{x}") / SCALE for x in DIMENSIONS]).alias("centre"), diagonal(lambda i: variance[i]).alias("scatter"),
        diagonal(lambda i: 1 / (variance[i] + list(FLOORS.values())[i] ** 2)).alias("inverse"), F.lit(float("inf")).alias("det"),
    )
    means = _state(rows.groupBy("grp").agg(F.lit(1).alias("start"), F.count("*").alias("rows"), *_sums()), 1.0).withColumn("det", F.lit(float("inf")))
    now = medians.unionByName(means).checkpoint()
    for _ in range(STEPS):
        after = _step(rows, now, few)
        both = now.alias("x").join(after.alias("y"), ["grp", "start"])
        falls = F.col("y.det") < F.col("x.det") - 1e-9
        now = both.select("grp", "start", "x.rows", *[F.when(falls, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")).alias(c) for c in ("centre", "scatter", "inverse", "det")], falls.alias("falls")).checkpoint()
        if not now.agg(F.max("falls")).first()[0]:
            break
    return now.groupBy("grp").agg(F.min_by(F.struct("rows", "centre", "scatter"), F.struct("det", "start")).alias("best")).select("grp", "best.*")


def shrunk(found: DataFrame) -> DataFrame:
    """grp, centre, inverse of every group of language and source, drawn towards the estimates above it."""
    d = len(DIMENSIONS)
    finest = found.where("get_json_object(grp, '$.s') is not null").withColumn("lang", F.get_json_object("grp", "$.l"))
    middle = found.where("grp != '*' and get_json_object(grp, '$.s') is null").select(F.get_json_object("grp", "$.l").alias("lang"), F.struct("rows", "centre", "scatter").alias("upper"))
    top = found.where("grp = '*'").select(F.struct("rows", "centre", "scatter").alias("top"))
    rows = finest.join(middle, "lang").join(F.broadcast(top), F.lit(True)).select("grp", F.struct("rows", "centre", "scatter").alias("own"), "upper", "top")

    def run(batches):
        for batch in batches:
            centres, inverses = [], []
            for own, upper, top in zip(batch["own"], batch["upper"], batch["top"]):
                m, s = np.array(top["centre"]), np.array(top["scatter"])
                for x in (upper, own):
                    n = x["rows"]
                    m, s = ((n * np.array(x[c]) + SHRINK * y) / (n + SHRINK) for c, y in (("centre", m), ("scatter", s)))
                centres.append(m.tolist())
                inverses.append(np.linalg.inv(s.reshape(d, d) + _FLOOR).ravel().tolist())
            yield batch[["grp"]].assign(centre=centres, inverse=inverses)

    return rows.mapInPandas(lean(run), "grp string, centre array<double>, inverse array<double>")


def assess(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the base statistics, base_failed, kept, distance (squared, null if the base rules fail)."""
    stats = text_statistics(docs)
    found = shrunk(estimates(stats)).checkpoint()
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = stats.where(~F.col("base_failed")).withColumn("grp", _levels()[0]).withColumn("salt", _salt(stats.sparkSession))
    cut = chi_square_quantile(1 - TAIL, len(DIMENSIONS))
    judged = _meet(passed, found, found.count() <= FEW).withColumn("distance", _distance(F.col("centre"), F.col("inverse")))
    judged = judged.select(*base, (F.col("distance") <= cut).alias("kept"), "distance")
    failed = stats.where("base_failed").select(*base, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return judged.unionByName(failed)
