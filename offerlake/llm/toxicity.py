"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words is trained in numpy from confirmed toxic texts (positive) and texts of unknown label
(unlabelled). With class prior p, the risk is

    p R+(positive)  +  max(0, R-(unlabelled) - p R-(positive)),

the last bracket being the negative risk corrected for the positives among the unlabelled; where it turns negative, the
step goes the other way (Kiryo et al., 2017). The prior is the share of confirmed toxic rows among labelled training rows.

A text's features are its distinct words, by their 64-bit hashes, out of those that are clearly more frequent in positive texts;
all others weigh nothing, so that the length of a text doesn't drown its few telling words. Scoring reads whole texts and needs
no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import discard, durable, text_batches, unused
from .textblocks import ALPHANUMERIC, blocks, distinct_within, word_hashes

#: Texts that the classifier is fitted on, at most about: a bounded sample by hash of doc_id.
POSITIVES, UNLABELLED = 6_000, 24_000


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of doc_id as text is divisible by folds; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def words_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashes of the distinct words of the texts, offsets), block by block."""
    for lo, hi, data, at in blocks(column):
        yield lo, hi, *distinct_within(*word_hashes(data, at, ALPHANUMERIC))


@dataclass
class LinearModel:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def margins(self, found: np.ndarray, of: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(of) - 1, self.bias)
        place = np.minimum(np.searchsorted(self.words, found), len(self.words) - 1)
        worth = np.where(self.words[place] == found, self.weights[place], 0.0)
        sums = np.concatenate([[0.0], np.cumsum(worth)])
        return sums[of[1:]] - sums[of[:-1]] + self.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def telling(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, least_z: float = 10.0, least_texts: int = 5) -> np.ndarray:
    """Whether words, given in how many of n_p positive and n_u unlabelled texts they are, have a share of the positive ones that lies above
    their share of the others by least_z standard errors. Where positives are few, a third of them is enough instead of least_texts."""
    share = (in_p + in_u + 1) / (n_p + n_u + 2)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    return (z >= least_z) & (in_p >= min(least_texts, n_p / 3))


def risk(w: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk's logistic loss, and the direction of descent for it (its gradient; where the corrected negative risk is
    below zero, the opposite of that part's gradient). w: weights of columns, the bias last; texts are lists of columns."""
    n_p, n_u = len(positive), len(unlabelled)
    texts = [*positive, *unlabelled]
    sizes = np.array([len(d) for d in texts])
    of = np.concatenate([[0], np.cumsum(sizes)])
    found = np.concatenate(texts).astype(np.int64)
    sums = np.concatenate([[0.0], np.cumsum(w[found])])
    z = sums[of[1:]] - sums[of[:-1]] + w[-1]
    s = _sigmoid(z)
    # d/dz of log(1 + e^-z) is s - 1, and of log(1 + e^z) is s.
    negative = float(np.mean(np.logaddexp(0, z[n_p:])) - prior * np.mean(np.logaddexp(0, z[:n_p])))
    pull = np.concatenate([-prior * s[:n_p] / n_p, s[n_p:] / n_u])
    if negative >= 0:
        pull[:n_p] += prior * (s[:n_p] - 1) / n_p
    else:
        pull = -pull
    value = prior * float(np.mean(np.logaddexp(0, -z[:n_p]))) + max(0.0, negative)
    return value, np.append(np.bincount(found, weights=np.repeat(pull, sizes), minlength=len(w) - 1), pull.sum())


def fit_nnpu(words: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 200, batches: int = 2, rate: float = 0.05, decay: float = 1e-4, seed: int = 5) -> LinearModel:
    """Minimise the non-negative risk with the logistic loss by Adam.

    words: sorted hashes of the telling words; positive and unlabelled: which of them each text holds. No positives: every margin
    is the prior's log odds.
    """
    prior = min(max(prior, 1e-3), 0.999)
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return LinearModel(np.zeros(0, np.uint64), np.zeros(0, np.float32), bias)
    rng = np.random.default_rng(seed)
    w = np.zeros(len(words) + 1)  # the last is the bias
    w[-1] = bias
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(epochs):
        order_p, order_u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for part_p, part_u in zip(np.array_split(order_p, batches), np.array_split(order_u, batches), strict=True):
            if not len(part_p) or not len(part_u):
                continue
            t += 1
            _, g = risk(w, [positive[i] for i in part_p], [unlabelled[i] for i in part_u], prior)
            g[:-1] += decay * w[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return LinearModel(words, w[:-1].astype(np.float32), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, train: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> LinearModel:
    """Fit on the rows of docs where train holds, labels giving (doc_id, toxic).

    Confirmed toxic rows are the positives, all others are unlabelled; rows of either kind beyond the bounds are sampled by
    a hash of doc_id, and rows that repeat a doc_id count once. The class prior is taken from all labelled training rows. Null
    labels count as none; of repeated labels for one doc_id the highest counts.
    """
    text_batches(docs.sparkSession)
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    known = docs.where(train).select("doc_id").join(marks, F.col("doc_id") == F.col("_id"), "left")
    n = known.agg(F.count(F.when(F.col("_toxic") == 1, 1)), F.count("_toxic"), F.count(F.lit(1))).first()
    n_pos, n_known, n_all = (int(x or 0) for x in n)
    if not n_pos or n_pos == n_all:
        return fit_nnpu(np.zeros(0, np.uint64), [], [], n_pos / (n_known + 1))
    unit = F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    shares = {1: min(1.0, positives / n_pos), 0: min(1.0, unlabelled / (n_all - n_pos))}
    picked = known.withColumn("p", F.coalesce((F.col("_toxic") == 1).cast("int"), F.lit(0)))
    picked = picked.where(unit < F.when(F.col("p") == 1, F.lit(shares[1])).otherwise(F.lit(shares[0]))).select(F.col("doc_id").alias("_id"), "p").distinct()
    # The sample is bounded by its parameters, so its ids go to the texts, not the texts to them.
    rows = docs.where(train).select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", "p", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, found, of in words_of(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("p").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(found.view(np.int64)))], names=["doc_id", "p", "words"])

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("p", T.IntegerType()), T.StructField("words", T.ArrayType(T.LongType()))])
    sample = rows.mapInArrow(features, schema).groupBy("doc_id").agg(F.min(F.struct("p", "words")).alias("t")).select("doc_id", "t.*")
    sample = durable(sample, "toxicity-sample")
    # Words are counted and chosen where they are; what comes to the driver are the telling ones, then their places in the sample's texts.
    n_p, n_u = (int(x or 0) for x in sample.agg(F.sum("p"), F.sum(1 - F.col("p"))).first())
    counts = sample.select("p", F.explode("words").alias("word")).groupBy("word").agg(F.sum("p").alias("in_p"), F.sum(1 - F.col("p")).alias("in_u"))
    counts = counts.where(F.col("in_p") >= F.least(F.lit(5), F.lit(n_p / 3))).toArrow()
    in_p, in_u = counts.column("in_p").to_numpy(), counts.column("in_u").to_numpy()
    words = np.sort(counts.column("word").to_numpy().view(np.uint64)[telling(in_p, in_u, max(1, n_p), max(1, n_u))])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            flat = lists.values.to_numpy().view(np.uint64)
            place = np.minimum(np.searchsorted(words, flat), max(0, len(words) - 1)).astype(np.int32)
            good = words[place] == flat if len(words) else np.zeros(len(flat), dtype=bool)
            of = np.concatenate([[0], np.cumsum(good)])[lists.offsets.to_numpy()].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("p"), pa.ListArray.from_arrays(pa.array(of - of[0]), pa.array(place[good][of[0] : of[-1]]))], names=["doc_id", "p", "words"])

    schema = T.StructType([*schema.fields[:2], T.StructField("words", T.ArrayType(T.IntegerType()))])
    got = sample.mapInArrow(places, schema).toArrow().sort_by([("doc_id", "ascending")])
    discard(sample)
    lists = [x.values.to_numpy() if x.values is not None else np.zeros(0, np.int32) for x in got.column("words")]
    p = got.column("p").to_numpy()
    return fit_nnpu(words, [lists[i] for i in np.flatnonzero(p == 1)], [lists[i] for i in np.flatnonzero(p == 0)], n_pos / n_known)


def score(docs: DataFrame, model: LinearModel, name: str = "_score") -> DataFrame:
    """docs with one more column: the probability of label 1 for the whole text; null and empty texts have the score of no words.

    Rows stay one for one, with all columns as they were (a column of that name is replaced).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 12 bytes for each telling word of the bounded sample
    docs = docs.drop(name)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [shared.value.margins(found, of) for _, _, found, of in words_of(batch.column("text"))]
            scores = _sigmoid(np.concatenate(margins)) if margins else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, name])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs, learned from the rows that aren't held out."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below threshold, all columns as they were; learned as in toxicity_report."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    name = unused(docs, "score")
    return score(docs, model, name).where(F.col(name) < threshold).drop(name)
