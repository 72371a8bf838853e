"""Toxicity by maximum-scoring segments.

Words and their beginnings (inflected forms share one) get log-odds between toxic
and clean documents under Dirichlet priors proportional to their overall
frequency; a word takes those of its longest known beginning, all others cost a
small drift, the log-odds of not being one of them. A linear-time scan finds
every maximal-scoring segment of a text. The best score of a clean text follows
an extreme-value law whose location grows with the log of its length; fitted on
clean training texts it turns segment scores into evidence, and the significant
segments' evidence is summed and mapped to a probability by logistic regression
on training rows that the words weren't learned from.

Learning reads a bounded sample (``per_class`` labelled rows of each class in
expectation, by a hash of the id; one text of near copies, that of the least hash)
- its ids, at most about 2 * ``per_class``, are broadcast to the scan - and the driver receives at most ``LEXICON`` words. Scoring is one pass
over whole texts without a shuffle.

Defined cases: null and empty texts have no segment and get the score of no
evidence; without labelled rows of both classes every score is 0; rows of one id
in the labels count as toxic if any is; ties between words are cut by the word;
a null doc_id is not held out and can't match a label; repeated rows score
alike; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cladescope.llm.common import held_out, lean

PER_CLASS, LEXICON = 8000, 20_000
#: Lengths of beginnings; least documents, z-score and log-odds of one with evidence; strength of the prior; tokens of one document that count.
SHORTEST, LONGEST = 4, 12
#: Least cost of a word without evidence.
LEAST_DRIFT = 0.01
LEAST_DOCS, LEAST_Z, LEAST_ODDS, PRIOR, MOST_TOKENS = 4, 5.0, 1.0, 20.0, 5
#: Segments up to this p-value are significant. Decision threshold of the contract. Words that a process keeps scored.
SIGNIFICANT, THRESHOLD, KNOWN = 0.01, 0.3, 150_000
#: Words and beginnings that a task counts before it hands the counts on.
FLUSH = 150_000
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def beginnings(word: str) -> list[str]:
    """The word, and its beginnings by falling length; a whole word ends with a blank."""
    return [word + " ", *(word[:n] for n in range(min(len(word), LONGEST), SHORTEST - 1, -1))]


class _Scores(dict):
    """word -> score, by the longest known beginning; the drift for all others."""

    def __init__(self, lexicon: dict[str, float], drift: float):
        super().__init__()
        self.lexicon, self.drift = lexicon, drift

    def __missing__(self, word: str) -> float:
        out = next((s for b in beginnings(word) if (s := self.lexicon.get(b)) is not None), -self.drift)
        if len(self) >= KNOWN:
            self.clear()
        self[word] = out
        return out


def maximal_segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in order, in linear time.

    A stack holds candidates with the running totals before and after them; a new
    positive run joins the nearest earlier candidate that starts lower and would
    end higher, else it stands alone.
    """
    total = np.concatenate([[0.0], np.cumsum(values)])
    up = values > 0
    step = np.diff(np.concatenate([[0], up.astype(np.int8), [0]]))
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, before, after, nearest candidate with a lower start
    for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
        start, end, low, high = a, b, total[a], total[b]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((start, end, low, high, j))
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, float(h - l)) for s, e, l, h, _ in stack]


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float] = field(default_factory=dict)
    drift: float = 0.05
    #: Location a + b log(1 + n) and scale of the extreme-value law.
    law: tuple[float, float, float] = (0.0, 0.0, 1.0)
    logistic: tuple[float, float] = (-50.0, 0.0)

    @cached_property
    def scores(self) -> _Scores:
        return _Scores(self.lexicon, self.drift)

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        words = words_of(text)
        values = np.fromiter(map(self.scores.__getitem__, words), np.float64, len(words))
        return len(words), maximal_segments(values) if (values > 0).any() else []

    def evidence(self, n: int, score: float) -> float:
        """-log of the chance that a clean text of n words has a segment of this score."""
        a, b, scale = self.law
        x = np.exp(-np.clip((score - a - b * np.log1p(n)) / scale, -30, 700))
        return float(-np.log(max(-np.expm1(-x), 1e-300)))

    def assess(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of a text, and its significant passages (first word, word after the last, evidence)."""
        n, found = self.segments(text)
        passages = [(s, e, ev) for s, e, score in found if (ev := self.evidence(n, score)) >= -np.log(SIGNIFICANT)]
        return self.probability(sum(ev for *_, ev in passages)), passages

    def probability(self, evidence: float) -> float:
        if self.logistic[1] == 0.0 and self.logistic[0] <= -50:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.logistic[0] + self.logistic[1] * np.log1p(evidence), -40, 40))))


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratio and its z-score of words in so many toxic and clean documents, with a Dirichlet prior."""
    prior = PRIOR * (toxic + clean) / max(n_toxic + n_clean, 1.0)
    odds = lambda k, n: np.log((k + prior) / (n + PRIOR - k - prior + 1e-9))
    delta = odds(toxic, n_toxic) - odds(clean, n_clean)
    return delta, delta / np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))


def choose(rows: list[dict], n1: int, n0: int, tokens1: int, tokens0: int) -> dict[str, float]:
    """Log-odds of the words and beginnings with evidence.

    From long to short: where clean texts hold words of a beginning that no longer
    chosen one covers, only those words count for it, so ``lose`` isn't taken for ``loser``.
    """
    lexicon: dict[str, float] = {}
    covered: dict[str, list[int]] = {}
    one = lambda *x: [np.array([v], float) for v in x]
    for row in sorted(rows, key=lambda r: (-len(r["word"].rstrip(" ")), not r["word"].endswith(" "), r["word"])):
        word = row["word"]
        t_known, c_known = covered.get(word, (0, 0))
        t, c, t_tokens, c_tokens = row["t"], row["c"], row["t_tokens"], row["c_tokens"]
        if c_tokens - c_known >= LEAST_DOCS - 1:
            t_tokens, c_tokens = max(t_tokens - t_known, 0), c_tokens - c_known
            t, c = min(t, t_tokens), min(c, c_tokens)
        _, z = log_odds(*one(t, c), n1, n0)
        odds, _ = log_odds(*one(t_tokens, c_tokens), tokens1, tokens0)
        if t < LEAST_DOCS or z[0] < LEAST_Z or odds[0] < LEAST_ODDS:
            continue
        lexicon[word] = float(odds[0])
        for shorter in beginnings(word.rstrip(" ")):
            if len(shorter.rstrip(" ")) < len(word.rstrip(" ")) or word.endswith(" ") and shorter != word:
                held = covered.setdefault(shorter, [0, 0])
                held[0] += row["t_tokens"] - t_known
                held[1] += row["c_tokens"] - c_known
    return lexicon


def _fit_law(n: np.ndarray, best: np.ndarray) -> tuple[float, float, float]:
    """Moments of an extreme-value law with a location linear in log(1 + n); the scale has a floor."""
    x = np.log1p(n)
    b = max(0.0, float(np.cov(x, best)[0, 1] / x.var())) if len(x) > 2 and x.var() > 0 else 0.0
    rest = best - b * x
    scale = max(0.5, float(rest.std()) * np.sqrt(6) / np.pi) if len(rest) else 1.0
    return float(rest.mean() - 0.5772156649015329 * scale) if len(rest) else 0.0, b, scale


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Two-parameter logistic regression by damped Newton steps, with a weak ridge."""
    design = np.stack([np.ones_like(x), x], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (y - p)) - 1e-2 * beta
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def _sketch(text: Column) -> Column:
    """Least hashes, of two kinds, of the text's three-word windows: most near copies share both, other texts with a common line don't."""

    # the one-element array binds the words, so they are split once a text
    def least(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1)))
        windows = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, 3), " ")))
        return F.struct(F.array_min(windows).alias("a"), F.array_min(F.transform(windows, lambda w: F.xxhash64(w))).alias("b"))

    return F.element_at(F.transform(F.array(F.split(F.lower(text), r"\W+")), least), 1)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """Learn from labelled rows that aren't held out."""
    known = labels.where(~held_out(labels["doc_id"]) & labels["toxic"].isNotNull() & labels["doc_id"].isNotNull())
    known = known.groupBy(known["doc_id"].alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    count = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not count.get(1) or not count.get(0):
        return ToxicityModel()
    draw = F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) / 1_000_000.0
    chance = F.when(F.col("toxic") == 1, min(1.0, per_class / count[1])).otherwise(min(1.0, per_class / count[0]))
    sample = known.where(draw < chance).withColumn("part", F.pmod(F.xxhash64("label_id", F.lit("part")), F.lit(3)).cast("int"))
    # at most about 2 * per_class small rows: a bounded broadcast
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("toxic", "part", "text")
    # copies of one document share their label and would pass for evidence of all their words: of a sketch's texts the
    # one with the least hash teaches, so the choice doesn't hang on the order in which rows come
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "part")).alias("one")
    rows = rows.groupBy(_sketch(F.col("text")).alias("sketch"), "toxic").agg(one).select("toxic", "one.part", "one.text").persist()

    def count_words(batches):
        import pandas as pd
        from collections import Counter

        sums: dict[str, list[int]] = {}

        def found():
            columns = np.array(list(sums.values()), np.int64).reshape(-1, 4).T
            return pd.DataFrame({"word": pd.Series(list(sums), dtype="str"), **dict(zip(("c", "t", "c_tokens", "t_tokens"), columns))})

        for batch in batches:
            for toxic, text in zip(batch["toxic"], batch["text"]):
                own: Counter = Counter()
                for w, n in Counter(words_of(text)).items():
                    for b in beginnings(w):
                        own[b] += n
                for b, n in own.items():
                    row = sums.setdefault(b, [0, 0, 0, 0])
                    row[toxic] += 1
                    row[2 + toxic] += min(n, MOST_TOKENS)
            if len(sums) > FLUSH:
                yield found()
                sums.clear()
        yield found()

    def count_tokens(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "n": [len(words_of(x)) for x in batch["text"]]})

    try:
        teach = rows.where("part > 0")
        sizes = {r["toxic"]: r for r in teach.mapInPandas(lean(count_tokens), "toxic int, n long").groupBy("toxic").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).collect()}
        if len(sizes) < 2:
            return ToxicityModel()
        n1, n0 = sizes[1]["docs"], sizes[0]["docs"]
        names = ("c", "t", "c_tokens", "t_tokens")
        table = teach.mapInPandas(lean(count_words), "word string, c long, t long, c_tokens long, t_tokens long").groupBy("word").agg(*[F.sum(x).alias(x) for x in names])
        # clearly more frequent in toxic documents, and in enough of them; the z-score decides below
        odd = table.where((F.col("t") >= LEAST_DOCS) & (F.col("t") * n0 > 2 * F.col("c") * n1))
        found = odd.orderBy(F.desc(F.col("t") / n1 - F.col("c") / n0), "word").limit(LEXICON).toPandas()
        lexicon = choose(found.to_dict("records"), n1, n0, sizes[1]["tokens"] or 1, sizes[0]["tokens"] or 1)
        first = ToxicityModel(lexicon, 0.0)

        def rate(batches):
            import pandas as pd

            for batch in batches:
                hits = [sum(v > 0 for v in map(first.scores.__getitem__, words_of(x))) for x in batch["text"]]
                yield pd.DataFrame({"toxic": batch["toxic"], "hits": hits})

        # a word outside the lexicon is so much likelier in a clean text
        seen = {r["toxic"]: r["hits"] / max(sizes[r["toxic"]]["tokens"], 1) for r in teach.mapInPandas(lean(rate), "toxic int, hits long").groupBy("toxic").agg(F.sum("hits").alias("hits")).collect()}
        first = replace(first, drift=max(LEAST_DRIFT, 1.5 * (seen[1] - seen[0])))

        def measure(batches):
            import pandas as pd

            for batch in batches:
                out = [(t, *first.segments(x)) for t, x in zip(batch["toxic"], batch["text"])]
                yield pd.DataFrame({"toxic": [t for t, *_ in out], "n": [n for _, n, _ in out], "found": [[s for *_, s in f] for *_, f in out]})

        held = rows.where("part = 0").mapInPandas(lean(measure), "toxic int, n long, found array<double>").toPandas()
    finally:
        rows.unpersist()
    if held["toxic"].nunique() < 2:
        return ToxicityModel()
    clean = held[held["toxic"] == 0]
    best = np.array([max(f, default=0.0) for f in clean["found"]])
    law = _fit_law(clean["n"].to_numpy(float), best)
    model = replace(first, law=law)
    cut = -np.log(SIGNIFICANT)
    total = np.array([sum(e for s in f if (e := model.evidence(n, s)) >= cut) for n, f in zip(held["n"], held["found"])])
    toxic = held["toxic"].to_numpy(float)
    # undo the sample's balance
    weight = np.where(toxic == 1, count[1] / max(toxic.sum(), 1), count[0] / max((1 - toxic).sum(), 1))
    return replace(model, logistic=_fit_logistic(np.log1p(total), toxic, weight / weight.mean()))


def score(docs: DataFrame, model: ToxicityModel, keep: bool = False) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, n_passages, passages (word ranges).

    With ``keep`` the rows of ``docs`` follow in a struct ``doc`` for filters.
    """

    def run(batches):
        for batch in batches:
            found = [model.assess(t or "") for t in batch.column("text").to_pylist()]
            passages = [[{"first": s, "after": e, "evidence": v} for s, e, v in p] for _, p in found]
            columns = {
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "score": pa.array([s for s, _ in found], pa.float64()),
                "predicted": pa.array([int(s >= THRESHOLD) for s, _ in found], pa.int32()),
                "n_passages": pa.array([len(p) for p in passages], pa.int32()),
                "passages": pa.array(passages, pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64()), ("evidence", pa.float64())]))),
            }
            if keep:
                columns["doc"] = batch.column("doc")
            yield pa.record_batch(list(columns.values()), names=list(columns))

    slim = [docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"].alias("text")]
    schema = StructType.fromDDL("doc_id long, held_out boolean, score double, predicted int, n_passages int, passages array<struct<first:long,after:long,evidence:double>>")
    if keep:
        slim.append(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("doc"))
        schema = schema.add(docs.select(slim[-1]).schema["doc"])
    return docs.select(*slim).mapInArrow(lean(run), schema)


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that are predicted toxic; same columns."""
    return score(docs, learn(docs, labels), keep=True).where("predicted = 0").select("doc.*")
