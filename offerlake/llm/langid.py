"""Language identification by a byte convolutional network, trained and applied in numpy.

A text is cut into windows of WINDOW bytes (A-Z as a-z, the last one padded with zero bytes), all of them scored in
batches: byte embeddings, filters of several widths, the maximum over positions, softmax. A text's probabilities are the mean
of its windows', weighted by their bytes; its language is the largest. Every window of every text counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import text_batches
from .textblocks import blocks
from .toxicity import held_out

WINDOW = 128
WIDTHS = (2, 3, 5)
#: Texts that the network is fitted on, of each language, at most about; and windows of one text, spread over it.
TEXTS_PER_LANGUAGE, WINDOWS_PER_TEXT = 1500, 6
#: Texts of all languages that the driver fits on, at most about; every language has at least one, so that there can't be more languages.
TEXTS = 60_000
#: Adam's first step length; it falls to nothing over the steps.
RATE = 1e-2
_AT_ONCE = 512
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def windows_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of the texts of a block, the text that each is of, and the bytes that each holds."""
    sizes = np.diff(at)
    n = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), n)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = at[:-1][doc] + place * WINDOW
    held = np.minimum(WINDOW, at[1:][doc] - start)
    reach = start[:, None] + np.arange(WINDOW)
    padded = np.where(np.arange(WINDOW) < held[:, None], _lower[data[np.minimum(reach, max(0, len(data) - 1))]] if len(data) else 0, 0)
    return padded.astype(np.uint8), doc, held


@dataclass
class ByteNetwork:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray] = field(default_factory=list)  # (width * e, f) for each width
    offsets: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    out_offset: np.ndarray | None = None

    @staticmethod
    def new(languages: list[str], e: int = 8, f: int = 16, seed: int = 11) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        embedding = (rng.standard_normal((256, e)) * 0.5).astype(np.float32)
        return ByteNetwork(languages, embedding, [draw(w * e, f) for w in WIDTHS], [np.zeros(f, np.float32) for _ in WIDTHS], draw(f * len(WIDTHS), len(languages)), np.zeros(len(languages), np.float32))

    def _pooled(self, windows: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        x = self.embedding[windows]
        n, _, e = x.shape
        flat, pooled, kept = x.reshape(n, -1), [], []
        for width, w, b in zip(WIDTHS, self.filters, self.offsets, strict=True):
            spans = np.lib.stride_tricks.as_strided(flat, (n, WINDOW - width + 1, width * e), (flat.strides[0], e * flat.itemsize, flat.itemsize))
            y = np.ascontiguousarray(spans).reshape(-1, width * e) @ w
            y = y.reshape(n, WINDOW - width + 1, -1)
            if keep:
                best = y.argmax(axis=1)
                kept.append((spans, best))
                top = np.take_along_axis(y, best[:, None, :], axis=1)[:, 0]
            else:
                top = y.max(axis=1)
            pooled.append(np.maximum(0, top + b))
        return np.concatenate(pooled, axis=1), kept

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(windows), _AT_ONCE):
            z = self._pooled(windows[i : i + _AT_ONCE])[0] @ self.out + self.out_offset
            z = np.exp(z - z.max(axis=1, keepdims=True))
            parts.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray]]]:
        """The mean cross-entropy of windows of languages target, and each parameter with its gradient."""
        n, e = len(windows), self.embedding.shape[1]
        hidden, kept = self._pooled(windows, keep=True)
        z = hidden @ self.out + self.out_offset
        z -= z.max(axis=1, keepdims=True)
        log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        d = np.exp(log_p)
        d[np.arange(n), target] -= 1
        d /= n
        back = (d @ self.out.T) * (hidden > 0)
        found = [(self.out, hidden.T @ d), (self.out_offset, d.sum(axis=0))]
        to_bytes = np.zeros_like(self.embedding)
        at = 0
        for width, w, b, (spans, best) in zip(WIDTHS, self.filters, self.offsets, kept, strict=True):
            g = back[:, at : at + w.shape[1]]
            at += w.shape[1]
            picked = spans[np.arange(n)[:, None], best]  # n x f x width*e
            found += [(w, np.einsum("nfk,nf->kf", picked, g)), (b, g.sum(axis=0))]
            to_x = (w.T[None] * g[:, :, None]).reshape(n, -1, width, e)
            hit = windows[np.arange(n)[:, None, None], best[:, :, None] + np.arange(width)]
            np.add.at(to_bytes, hit, to_x)
        return float(-log_p[np.arange(n), target].mean()), [*found, (self.embedding, to_bytes)]

    def fit(self, windows: np.ndarray, target: np.ndarray, steps: int = 600, batch: int = 128, rate: float = RATE, seed: int = 3) -> None:
        """Minimise the cross-entropy by Adam, each language being drawn equally often."""
        rng = np.random.default_rng(seed)
        by_class = [np.flatnonzero(target == c) for c in range(len(self.languages))]
        state: dict[int, list[np.ndarray]] = {}
        for t in range(1, steps + 1):
            rows = np.array([rng.choice(by_class[c]) for c in rng.integers(0, len(by_class), batch)])
            _, found = self.gradients(windows[rows], target[rows])
            pace = rate * (1 - t / (steps + 1))
            for p, g in found:
                m, v = state.setdefault(id(p), [np.zeros_like(p), np.zeros_like(p)])
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p -= (pace * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)).astype(p.dtype)


def fit(docs: DataFrame, train: Column, texts: int = TEXTS_PER_LANGUAGE) -> ByteNetwork | None:
    """A network for the non-null lang values of the rows where train holds; None if there are no such rows.

    Every value is learned; over TEXTS of them raise an error. A language of more rows than texts is sampled by a hash of doc_id and text, rows
    that repeat both counting once, and each text gives about WINDOWS_PER_TEXT windows. The sample is bounded, however rows repeat.
    """
    text_batches(docs.sparkSession)
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64(F.lit(31), "doc_id", "text").alias("_place"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(TEXTS + 1)
    known = sorted((r[0], r[1]) for r in counts.collect())
    if not known:
        return None
    if len(known) > TEXTS:
        raise ValueError(f"over {TEXTS} languages")
    texts = max(1, min(texts, TEXTS // len(known)))
    # One row for each language, at most TEXTS.
    shares = docs.sparkSession.createDataFrame([(language, min(1.0, 2 * texts / n)) for language, n in known], "lang string, share double")
    unit = F.pmod(F.col("_place"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.join(F.broadcast(shares), "lang").where(unit < F.col("share")).drop("share").dropDuplicates(["lang", "_place"])
    first = Window.partitionBy("lang").orderBy("_place")
    drawn = drawn.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= texts).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in blocks(batch.column("text")):
                w, doc, _ = windows_of(data, at)
                n = np.bincount(doc, minlength=hi - lo)
                place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                spread = -(-np.repeat(n, n) // WINDOWS_PER_TEXT)
                pick = place % np.maximum(1, spread) == 0
                yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(lo + doc[pick])), pa.array([x.tobytes() for x in w[pick]], pa.binary())], names=["lang", "window"])

    got = drawn.mapInArrow(cut, T.StructType([T.StructField("lang", T.StringType()), T.StructField("window", T.BinaryType())])).toArrow()
    got = got.sort_by([("lang", "ascending"), ("window", "ascending")])
    languages = [x for x, _ in known if x in set(got.column("lang").to_pylist())]
    if not languages:
        return None
    network = ByteNetwork.new(languages)
    windows = np.frombuffer(b"".join(got.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
    target = np.array([languages.index(x) for x in got.column("lang").to_pylist()])
    if len(languages) > 1:
        network.fit(windows, target)
    return network


def identify(docs: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """docs with _lang and _lang_score. A null text, or one without any letter, is `und` with score 0; so is all without a network.

    Rows stay one for one, with all columns as they were (columns of those two names are replaced).
    """
    docs = docs.drop("_lang", "_lang_score")
    if network is None:
        return docs.withColumn("_lang", F.lit("und")).withColumn("_lang_score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(network)  # some tens of KB

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            text = batch.column("text")
            best, scores = [], []
            for lo, hi, data, at in blocks(text):
                w, doc, held = windows_of(data, at)
                p = model.probabilities(w) * held[:, None]
                sums = np.zeros((hi - lo, len(model.languages)))
                np.add.at(sums, doc, p)
                total = np.maximum(1, np.bincount(doc, weights=held, minlength=hi - lo))
                sums /= total[:, None]
                best.append(sums.argmax(axis=1))
                scores.append(np.clip(sums.max(axis=1), 0, 1))
            lettered = np.asarray(pc.match_substring_regex(text.fill_null(""), r"\p{L}"))
            names = np.array(model.languages, dtype=object)[np.concatenate(best)] if best else np.zeros(0, object)
            names = np.where(lettered, names, "und")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names.tolist(), pa.string()), pa.array(np.where(lettered, np.concatenate(scores), 0.0) if best else [], pa.float64())], names=[*batch.schema.names, "_lang", "_lang_score"]
            )

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField("_lang", T.StringType()), T.StructField("_lang_score", T.DoubleType())]))


def language_report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs, learned from the rows that aren't held out."""
    network = fit(docs, ~held_out(F.col("doc_id")))
    return identify(docs.select("doc_id", "text"), network).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_lang_score").alias("score"))
