"""Periodic runs of words by probing harmonic grids.

A run of period p and at least 4*p words holds at least four neighbouring multiples of p, and the words there are equal. So for
each p only the words at j*p and (j+1)*p are compared: n/p probes, n*log(n) over all periods. Three equal probes in a row survive
and are extended both ways by comparing chunks of words with the words p further. Probes inside a run that has been found already
are skipped: by Fine and Wilf, a stretch of three periods inside a run of smaller period q either is that run, or isn't periodic.

Texts never meet; a corpus is searched without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import text_batches

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words compared at once when a run is extended: the first and the largest chunk.
CHUNK, LARGEST_CHUNK = 16, 1 << 16
WORD = re.compile("[^\x20\x09-\x0d]+")


def word_numbers(words: list[str]) -> np.ndarray:
    """Equal numbers for equal words, compared as they are written."""
    seen: dict[str, int] = {}
    fresh = count()
    return np.fromiter((seen[w] if w in seen else seen.setdefault(w, next(fresh)) for w in words), np.int32, len(words))


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many places from the first on a and b agree; compared in growing chunks."""
    n, at, step = min(len(a), len(b)), 0, CHUNK
    a, b = a[:n], b[:n]
    while at < n:
        differ = a[at : at + step] != b[at : at + step]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + len(differ), min(2 * step, LARGEST_CHUNK)
    return n


def _probes(w: np.ndarray, reach: np.ndarray, found) -> None:
    """Give found(p, places j*p) the survivors of each period, ascending in p as far as runs of it may be inside each other."""
    n = len(w)
    top = n // LEAST_PERIODS
    turn = min(top, int(n**0.5))
    for p in range(1, turn + 1):
        grid = w[::p]
        same = grid[1:] == grid[:-1]
        at = np.flatnonzero(same[2:] & same[1:-1] & same[:-2]) * p
        if len(at):
            at = at[reach[at] <= at + 3 * p]
            if len(at):
                found(p, at)
    if top <= turn:
        return
    # Of the larger periods there are many, with few probes each: all periods at once for each j.
    left: list[tuple[np.ndarray, np.ndarray]] = []
    one = two = np.zeros(0, bool)
    for j in range(n // (turn + 1)):
        p = np.arange(turn + 1, min(top, (n - 1) // (j + 1)) + 1)
        if not len(p):
            break
        same = w[j * p] == w[(j + 1) * p]
        if j >= 2:
            hit = p[one[: len(p)] & two[: len(p)] & same]
            at = (j - 2) * hit
            kept = reach[at] <= at + 3 * hit
            left.append((hit[kept], at[kept]))
        one, two = two, same
    if left:
        p, at = (np.concatenate(x) for x in zip(*left, strict=True))
        order = np.lexsort((at, p))
        p, at = p[order], at[order]
        ends = np.flatnonzero(np.diff(p, append=-1)) + 1
        for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False):
            found(int(p[a]), at[a:b])


def find_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in an array of word numbers, by start, then period."""
    n = len(w)
    runs: list[tuple[int, int, int]] = []
    if n < LEAST_WORDS:
        return runs
    #: reach[i]: the end of the longest-reaching run found so far that holds i.
    reach = np.zeros(n, np.int64)

    def found(p: int, at: np.ndarray) -> None:
        beyond = -1
        for i in at.tolist():
            if i < beyond or reach[i] > i + 3 * p:
                continue
            start = i - _agree(w[:i][::-1], w[p : i + p][::-1])
            end = i + p + _agree(w[i:], w[i + p :])
            beyond = end - p
            if end - start < max(LEAST_WORDS, LEAST_PERIODS * p):
                continue
            if reach[start] >= end:
                continue  # all of it lies in a run of smaller period
            runs.append((start, end - start, p))
            np.maximum(reach[start:end], end, out=reach[start:end])

    _probes(w, reach, found)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for each of n words that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def foremost(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length/period, compared exactly; of equals that of the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or (gain := run[1] * best[2] - best[1] * run[2]) > 0 or (gain == 0 and (run[0], run[2]) < (best[0], best[2])):
            best = run
    return best


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed) for each row of docs (doc_id, text).

    Words are what stands between ASCII white space, compared as written. collapsed has the words that kept_words keeps, joined by one
    space. A null text, an empty one and one without words have no runs and collapse to "". Rows stay one for one, repeated and null
    doc_ids included; other columns of docs aren't read. Texts of any length are searched whole.
    """
    text_batches(docs.sparkSession)
    run = T.StructType([T.StructField(x, T.LongType(), False) for x in ("start", "length", "period")])
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run, False)), T.StructField("collapsed", T.StringType())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends, flat, left = [], [0], [], []
            for text in batch.column("text"):
                words = WORD.findall(text.as_py() or "")
                runs = find_runs(word_numbers(words))
                sizes.append(len(words))
                flat += runs
                ends.append(len(flat))
                left.append(" ".join([w for w, k in zip(words, kept_words(len(words), runs).tolist(), strict=True) if k] if runs else words))
            table = np.array(flat, np.int64).reshape(-1, 3)
            parts = [pa.array(np.ascontiguousarray(table[:, k])) for k in range(3)]
            structs = pa.StructArray.from_arrays(parts, fields=[pa.field(x, pa.int64(), False) for x in ("start", "length", "period")])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), listed, pa.array(left, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(scan, T.StructType(fields))


def _best(runs: Column) -> Column:
    """foremost as a Column: of structs, null without runs."""
    better = lambda a, b: (b["length"] * a["period"] > a["length"] * b["period"]) | (
        (b["length"] * a["period"] == a["length"] * b["period"]) & ((b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["period"] < a["period"])))
    )
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))


def run_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) from what periodic_runs returns."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = periodic_runs(docs).withColumn("best", _best(F.col("runs")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[x].alias(x) for x in ("start", "length", "period")),
        F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with a periodic tail in every tenth text, chosen by h = crc32(doc_id as text): known runs to find.

    Where h % 10 = 0 and a text has n > 0 words, with g = floor(h / 10), a = g % n and p = 1 + floor((n - a) / (3 + g % 8)), each word
    i >= a becomes word a + (i - a) % p, and the words are joined by one space. All other texts, and those of null doc_ids, stay.
    """
    text_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")).alias("_h"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for row, h in enumerate(batch.column("_h").to_pylist()):
                if h is None or h % 10 or not texts[row] or not (words := WORD.findall(texts[row])):
                    continue
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                period = words[a : a + p]
                texts[row] = " ".join(words[:a] + (period * ((n - a) // p + 1))[: n - a])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(scan, docs.select("doc_id", "text").schema)
