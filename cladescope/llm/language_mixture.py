"""Language identification by mixtures of languages.

A language is a distribution over hashed byte trigrams of lower-cased letters.
A document is a mixture of languages: expectation-maximisation estimates its
proportions, and languages enter the set one by one while the gain in likelihood
exceeds a penalty that grows with the document's length. The score is the
proportion of the leading language, shrunk towards even for very short texts.

Learning reads a bounded sample (``per_language`` documents of each label in
expectation, chosen by a hash of the id); its counts are summed in Spark and the
driver receives at most GRAMS rows a language. Prediction is one pass without a
shuffle over the whole texts, vectorised over slices of about SLICE bytes.

Defined cases: a null text or one without a letter is ``und`` with score 0, and
so is every text when nothing was learned; null labels teach nothing; ties go to
the label that comes first in code-point order; a null doc_id is not held out;
repeated rows are predicted alike; an empty table gives an empty one; extra
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladescope.llm.common import held_out, lean
from cladescope.llm.textscan import slices

#: Hash values of trigrams; documents of a label in the sample; bytes handled at once.
GRAM_BITS = 16
GRAMS = 1 << GRAM_BITS
PER_LANGUAGE = 3000
SLICE = 1 << 19
#: Trigrams overlap: so many neighbours share a letter, and likelihood counts it as often.
OVERLAP = 3
ROUNDS = 40

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def has_letter(text: str) -> bool:
    hit = _LETTER.search(text)
    return hit is not None and (hit[0].isalpha() or any(map(str.isalpha, text)))


def gram_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram ids of all texts in one array, and where each text's begin (and the end)."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    joined = _FOLD[np.frombuffer(b" " + b"  ".join(raw) + b" ", np.uint8)]
    a = joined.astype(np.uint32)
    x = a[:-2] | a[1:-1] << np.uint32(8) | a[2:] << np.uint32(16)
    ids = (x * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)
    letter = joined[1:-1] != 32
    begins = np.cumsum([0, *(len(r) + 2 for r in raw)])[:-1]  # middle position of each text's first byte
    counts = np.concatenate([[0], np.cumsum(letter)])
    edges = np.append(counts[np.minimum(begins, len(letter))], counts[-1])
    return ids[letter], edges


@dataclass(frozen=True)
class LanguageModel:
    """labels in order; p[gram, label]: probability of a trigram in a language."""

    labels: tuple[str, ...]
    p: np.ndarray

    @staticmethod
    def learn(counts: dict[str, np.ndarray]) -> "LanguageModel":
        labels = tuple(sorted(counts))
        p = np.stack([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * GRAMS) for x in labels], 1) if labels else np.zeros((GRAMS, 0))
        return LanguageModel(labels, np.ascontiguousarray(p, np.float32))

    def mixtures(self, texts: list[str]) -> list[tuple[np.ndarray, int]]:
        """Per text: the proportions of the languages, and the number of trigrams."""
        ids, edges = gram_ids(texts)
        sizes = np.diff(edges)
        if not len(ids) or not self.labels:
            return [(np.zeros(len(self.labels)), 0)] * len(texts)
        p = self.p.take(ids, axis=0)
        full = sizes > 0
        at = edges[:-1][full]
        leading = np.add.reduceat(np.log(self.p).take(ids, axis=0), at, axis=0, dtype=np.float64).argmax(1)
        ratio = p / p[np.arange(len(ids)), np.repeat(leading, sizes[full])][:, None]
        gain = np.add.reduceat(ratio, at, axis=0, dtype=np.float64).max(1) - sizes[full]
        out, k = [], 0
        for n, begin in zip(sizes.tolist(), edges.tolist()):
            if not n:
                out.append((np.zeros(len(self.labels)), 0))
                continue
            share = np.zeros(len(self.labels))
            share[leading[k]] = 1.0
            # log x <= x - 1: no mixture can gain more than this
            if gain[k] > self.penalty(n):
                share = self._grow(p[begin : begin + n], int(leading[k]))
            out.append((share, n))
            k += 1
        return out

    @staticmethod
    def penalty(n: int) -> float:
        return OVERLAP * 0.5 * np.log(n + 1.0)

    def _grow(self, p: np.ndarray, leading: int) -> np.ndarray:
        """Add languages while the penalised likelihood rises."""
        n, used = len(p), [leading]
        share = np.ones(1)
        mixed = p[:, leading].astype(np.float64)
        best = np.log(mixed).sum()
        while len(used) < p.shape[1]:
            slope = (p / mixed[:, None]).sum(0) - n
            slope[used] = -np.inf
            new = int(slope.argmax())
            if slope[new] <= self.penalty(n):
                break
            q = p[:, [*used, new]].astype(np.float64)
            trial = np.append(share * 0.8, 0.2)
            for _ in range(ROUNDS):
                total = q @ trial
                moved = trial * (q / total[:, None]).sum(0) / n
                done = np.abs(moved - trial).max() < 1e-3
                trial = moved
                if done:
                    break
            total = q @ trial
            now = np.log(total).sum()
            if now - best <= self.penalty(n):
                break
            used, share, best, mixed = [*used, new], trial, now, total
        out = np.zeros(p.shape[1])
        out[used] = share
        return out


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from the rows that aren't held out and have a label."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), docs["lang"].alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not known:
        return LanguageModel.learn({})
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000.0
    chance = F.coalesce(*[F.when(F.col("lang") == k, min(1.0, per_language / n)) for k, n in sorted(known.items())])
    sample = rows.where(draw < chance).select("lang", "text")

    def count(batches):
        import pandas as pd

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                texts = list(texts)
                for begin, end in slices(texts, SLICE):
                    ids, _ = gram_ids(texts[begin:end])
                    sums[lang] = sums.get(lang, 0) + np.bincount(ids, minlength=GRAMS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "gram": at.astype("int32"), "n": n[at]})

    table = sample.mapInPandas(lean(count), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = {}
    for lang, part in table.groupby("lang"):
        counts[lang] = np.bincount(part["gram"], part["n"], GRAMS)
    return LanguageModel.learn(counts)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, langs and shares of the mixture."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # GRAMS floats a language

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for begin, end in slices(texts, SLICE):
                part = [t if t is not None and has_letter(t) else "" for t in texts[begin:end]]
                names, scores, langs, shares = [], [], [], []
                for share, n in model.mixtures(part):
                    if not n:
                        names.append("und"), scores.append(0.0), langs.append([]), shares.append([])
                        continue
                    order = [k for k in np.argsort(-share, kind="stable").tolist() if share[k] > 0]
                    names.append(model.labels[order[0]])
                    scores.append(float((share[order[0]] * n + 1 / len(share)) / (n + 1)))
                    langs.append([model.labels[k] for k in order])
                    shares.append([float(share[k]) for k in order])
                cut = batch.slice(begin, end - begin)
                yield pa.record_batch(
                    [cut.column("doc_id"), cut.column("held_out"), pa.array(names), pa.array(scores, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                    names=["doc_id", "held_out", "lang_pred", "score", "langs", "shares"],
                )

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"].alias("text"))
    return slim.mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double, langs array<string>, shares array<double>")
