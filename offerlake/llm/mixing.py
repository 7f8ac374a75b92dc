"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture; a document's mean repetition rate is target rows of its source over
rows of its source. A hash of (seed, doc_id) gives a uniform number, which is put through the inverse Poisson
distribution with that mean; the document is repeated so often, and all copies are shuffled by another hash.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import durable, unused

BROADCAST_SOURCES = 100_000


def hashed_uniform(seed: int, *columns: str) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 of the seed and the columns' text (null: the word null)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_inverse(u: np.ndarray, mean: float) -> np.ndarray:
    """Smallest k with P(X <= k) >= u, for X Poisson with the given mean."""
    if not mean > 0:
        return np.zeros(len(u), dtype=np.int64)
    width = 12 * np.sqrt(mean) + 60
    low = max(0, int(mean - width))
    ks = np.arange(low, int(mean + width) + 1)
    start = low * np.log(mean) - mean - sum(np.log(np.arange(1, low + 1))) if low else -mean
    logs = start + np.concatenate([[0.0], np.cumsum(np.log(mean) - np.log(ks[1:]))])
    return low + np.minimum(np.searchsorted(np.cumsum(np.exp(logs)), u, side="left"), len(ks) - 1)


@F.pandas_udf(T.IntegerType())
def poisson_count(u: pd.Series, mean: pd.Series) -> pd.Series:
    out = np.zeros(len(u), dtype=np.int32)
    for rate in mean.dropna().unique():
        mine = (mean == rate).to_numpy()
        out[mine] = poisson_inverse(u.to_numpy()[mine], float(rate))
    return pd.Series(out)


def repetition_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, size: float = 1.0, temperature: float = 0.5, source_col: str = "source") -> DataFrame:
    """(source, rate): the mean number of copies of a document of each source, null being a source like others.

    weights: target shares by source (rescaled to sum 1; an unnamed source gets none). Without weights the share of a source
    is its own share to the power temperature, rescaled. size: rows of the mixture over rows of docs.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        wanted = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        if any(not w >= 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(share)
        wanted = counts.withColumn("w", share)
    wanted = durable(wanted, "mixing-sources")
    # Decimals, so that the total doesn't depend on the order in which sources are summed.
    total, rows = wanted.agg(F.sum(F.col("w").cast("decimal(38,9)")).cast("double"), F.sum("n")).first()
    scale = float(size) * rows / total if total else 0.0
    return wanted.select("source", (F.col("w") * F.lit(scale) / F.col("n")).alias("rate"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, size: float = 1.0, temperature: float = 0.5, seed: int = 17, partitions: int | None = None, source_col: str = "source") -> DataFrame:
    """docs with each row repeated Poisson-many times, plus copy (from 0), shuffled globally.

    The columns of docs stay as they are, other names included; a column named copy is replaced. Rows that repeat a doc_id get
    equal counts; null doc_ids share one count, and their texts place them. No rows, or no weight on any source there: no rows. The
    result depends on data and seed alone. The rates, one row per source, are broadcast up to BROADCAST_SOURCES of them, and
    joined by shuffle beyond.
    """
    docs = docs.drop("copy")
    source, rate, count, place = (unused(docs, x) for x in ("mixed_source", "rate", "count", "place"))
    rates = repetition_rates(docs, weights, size, temperature, source_col).select(F.col("source").alias(source), F.col("rate").alias(rate))
    rates = F.broadcast(rates) if rates.count() <= BROADCAST_SOURCES else rates
    counted = docs.join(rates, F.col(f"`{source_col}`").eqNullSafe(F.col(source))).withColumn(count, poisson_count(hashed_uniform(seed, "doc_id"), F.col(rate)))
    copies = counted.where(F.col(count) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(count) - 1))).drop(source, rate, count)
    told = [F.col("doc_id"), F.col("copy"), *([F.col("text")] if "text" in docs.columns else [])]
    copies = copies.withColumn(place, F.xxhash64(F.lit(seed), *told))
    dealt = copies.repartition(place) if partitions is None else copies.repartition(partitions, place)
    return dealt.sortWithinPartitions(place, "doc_id", "copy").drop(place)
