"""Toxicity by non-negative positive-unlabelled learning.

Numpy classifiers learn from confirmed toxic texts and from unlabelled texts, whose risk as negatives is
corrected by the class prior p: risk = p R+(P) + max(0, R-(U) - p R-(P)). When the corrected part turns
negative, the step goes against it, so the fit cannot run it down by memorising. The positives, the unlabelled
texts and the prior come from bounded samples; the label of an unlabelled text is never looked at.

Terms are counted by Spark and chosen there; the driver gets ``TERMS`` term numbers and, for each sampled text, one
bit a term: some 600 KB for 9,000 texts, however long they are.

Terms are hashed lower-cased words, their first ``STEM`` bytes, and stems that 2, 3 or 4 different words of the
text share, ASCII punctuation apart, present or not. Those that set positives apart from unlabelled texts are
kept, ``TERMS`` at most; a few classifiers on different draws are averaged. Scoring is one pass without a shuffle; the model broadcast is ``TERMS`` numbers.

Defined results: a null or empty text has no terms and gets the bias' score; without positives every score
is 0; an id with conflicting labels counts as toxic; repeated texts get equal scores; rows without an id are scored but
never learnt from; an empty table gives no rows. A column named like the score is replaced, others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import words
from loomgraph.sessions import cut, drop_table

MAX_POSITIVES = 3000
MAX_UNLABELLED = 6000
SPACE = 1 << 20
TERMS = 512
CLASSIFIERS = 3
STEPS = 250
STEM = 6
FAMILIES = (2, 3, 4)
_STRIPPED = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def plain(text: Column) -> Column:
    """ASCII punctuation as spaces, so that a word is the same at the end of a sentence."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _STRIPPED, " ")


def document_terms(part: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term numbers of each document, one after the other, and where each document begins."""
    doc = part.doc_of_word().astype(np.int64)
    spread = lambda x: (x % np.uint64(SPACE)).astype(np.int64)
    single, at = np.unique(doc * SPACE + spread(part.hashes), return_index=True)
    at = at[part.ends[at] - part.starts[at] >= STEM]
    stems = np.zeros(len(at), np.uint64)
    for k in range(STEM):
        byte = part.data[part.starts[at] + k].astype(np.uint64)
        stems = stems << np.uint64(8) | np.where((byte > 64) & (byte < 91), byte + np.uint64(32), byte)
    stemmed, first, count = np.unique(doc[at] * SPACE + spread(words.mix(stems ^ np.uint64(0x57E4))), return_index=True, return_counts=True)
    found = [single, stemmed]
    for least in FAMILIES:  # stems that several words of the document share are terms of their own
        some = first[count >= least]
        found.append(doc[at[some]] * SPACE + spread(words.mix(stems[some] ^ np.uint64(0x57E4 + least))))
    every = np.unique(np.concatenate(found))
    return every % SPACE, np.searchsorted(every, np.arange(part.docs + 1) * SPACE)


@dataclass
class Model:
    """Weights by term number, zero for most, and a bias; one row for each classifier."""

    terms: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def score(self, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
        docs = len(first) - 1
        if not len(self.bias):
            return np.zeros(docs)
        at = np.searchsorted(self.terms, numbers)
        at[at == len(self.terms)] = 0
        doc = np.repeat(np.arange(docs), np.diff(first))
        hit = self.terms[at] == numbers if len(self.terms) else np.zeros(len(numbers), bool)
        out = np.zeros(docs)
        for w, b in zip(self.weights, self.bias, strict=True):
            out += 1 / (1 + np.exp(-np.clip(np.bincount(doc[hit], w[at[hit]], docs) + b, -30, 30)))
        return out / len(self.bias)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int, steps: int = STEPS, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative risk with the sigmoid loss, by Adam."""
    positive, unlabelled = positive.astype(np.float64), unlabelled.astype(np.float64)  # once, not in every product
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 0.01, positive.shape[1])
    b = -1.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    slope = lambda z: z * (1 - z)
    for t in range(1, steps + 1):
        zp = 1 / (1 + np.exp(-np.clip(positive @ w + b, -30, 30)))
        zu = 1 / (1 + np.exp(-np.clip(unlabelled @ w + b, -30, 30)))
        gp, gu = slope(zp) / len(zp), slope(zu) / len(zu)
        as_negative = zu.mean() - prior * zp.mean()
        if as_negative >= 0:
            dp, du = -2 * prior * gp, gu
        else:
            dp, du = prior * gp, -gu
        g = np.append(positive.T @ dp + unlabelled.T @ du + decay * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit_matrix(positive: np.ndarray, unlabelled: np.ndarray, prior: float, terms: np.ndarray) -> Model:
    """Train the classifiers on 0/1 rows over ``terms``."""
    if not len(positive) or not len(unlabelled) or not len(terms):
        return Model(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0))
    weights, bias = [], []
    for seed in range(CLASSIFIERS):
        rng = np.random.default_rng(seed)
        own = positive[rng.random(len(positive)) < 0.85] if len(positive) > 20 else positive
        w, c = fit_nnpu(own, unlabelled[rng.random(len(unlabelled)) < 0.85], prior, seed)
        weights.append(w)
        bias.append(c)
    return Model(terms, np.array(weights), np.array(bias))


def chosen_terms(found: DataFrame, n_positive: int, n_unlabelled: int, terms: int = TERMS) -> np.ndarray:
    """Term numbers that set positives apart, by log odds weighed by how sure they are; counted in Spark."""
    flags = found.select("positive", F.explode("numbers").alias("term"))
    counts = flags.groupBy("term").agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u"))
    share_p, share_u = (F.col("p") + 0.5) / (n_positive + 1), (F.col("u") + 0.5) / (n_unlabelled + 1)
    spread = F.sqrt(share_u * (1 - F.least(share_u, F.lit(0.999))) / n_positive + 1e-9)
    sure = F.when(F.col("p") >= 3, (share_p - share_u) / spread).otherwise(0.0)
    best = counts.select("term", sure.alias("sure")).orderBy(F.desc("sure"), "term").limit(terms).collect()  # the model's size
    chosen = [r["term"] for r in best if r["sure"] > 4] or [r["term"] for r in best[:8]]
    return np.sort(np.array(chosen, np.int64))


def _packed(found: DataFrame, terms: np.ndarray) -> DataFrame:
    """(positive, bits): which of the terms each sampled text holds."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own in batch.column("numbers"):
                bits = np.zeros(len(terms), bool)
                numbers = own.values.to_numpy()
                at = np.minimum(np.searchsorted(terms, numbers), len(terms) - 1)
                bits[at[terms[at] == numbers]] = True
                rows.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(rows, pa.binary())], names=["positive", "bits"])

    return found.mapInArrow(pack, "positive int, bits binary")


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.chunks(batch.column("_text")):
            numbers, first = document_terms(part)
            lists = [numbers[a:b].astype(np.int32) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_positive").slice(part.lo, part.docs), pa.array(lists, pa.list_(pa.int32()))], names=["positive", "numbers"])


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", fit_on: Column | None = None, prior: float | None = None, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED, id: str = "doc_id", text: str = "text") -> Model:
    """Learn from confirmed positives and unlabelled texts, both bounded; only bits of the chosen terms reach the driver.

    ``prior`` defaults to the share of positives among the labels that ``fit_on`` keeps.
    """
    usable = labels.filter((F.lit(True) if fit_on is None else fit_on) & F.col(label).isNotNull() & F.col(id).isNotNull())
    share = usable.agg(F.avg(F.col(label).cast("double"))).first()[0]
    prior = min(max(share or 0.0, 1e-3), 0.5) if prior is None else prior
    order = F.xxhash64(F.col(id), F.lit(29))
    confirmed = usable.filter(F.col(label) == 1).select(id).distinct().orderBy(order, id).limit(max_positives).withColumn("_positive", F.lit(1))
    anyone = documents.filter(F.col(id).isNotNull()).select(id).distinct().orderBy(order, id).limit(max_unlabelled).withColumn("_positive", F.lit(0))
    chosen = confirmed.unionByName(anyone)  # both limits are documented parameters, so this may be broadcast
    rows = documents.select(id, plain(F.col(text)).alias("_text")).join(F.broadcast(chosen), id)
    rows = rows.groupBy(id, "_positive").agg(F.min("_text").alias("_text")).select("_text", "_positive")  # rows may repeat an id
    found = cut(rows.mapInArrow(_numbers, "positive int, numbers array<int>"), "terms")
    sizes = {r["positive"]: r["n"] for r in found.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return fit_matrix(np.zeros((0, 0)), np.zeros((0, 0)), prior, np.zeros(0, np.int64))
    terms = chosen_terms(found, sizes[1], sizes[0])
    bits = _packed(found, terms).toPandas().sort_values(["positive", "bits"])
    drop_table(found)
    dense = np.unpackbits(np.frombuffer(b"".join(bits["bits"]), np.uint8).reshape(len(bits), -1), axis=1)[:, : len(terms)]
    flag = bits["positive"].to_numpy()
    return fit_matrix(dense[flag == 1], dense[flag == 0], prior, terms)


def score(documents: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Every row with the mean of the classifiers' estimates that it is toxic."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for texts in batches:
            parts = [known.score(*document_terms(part)) for part in words.chunks(pa.array(texts, pa.large_string()))]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return documents.withColumn(into, judge(plain(F.col(text))))
