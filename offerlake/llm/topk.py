"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights by dimension ("term"). Queries are taken in blocks of bounded size, one pass over the
candidates for each: the block's postings are broadcast, and a task takes its candidates in runs of bounded size. For each run the
postings of each term are scattered, weighted, into a dense score array; a partition selection keeps k for each query. A task hands
on its k best for each query, and the partial lists of all tasks are merged in a window. Candidates aren't shuffled or repeated.
"""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import durable

#: Queries of one pass, about, and candidates whose scores a task holds at once.
QUERY_BLOCK = 16384
CANDIDATE_BLOCK = 4096
_QUERIES_AT_ONCE = 512
_SCHEMA = "query_id long, vec_id long, score long"


def quantise(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Rows (vec_id, weights array<long>), each component x becoming floor(scale * x).

    Null vectors, and vectors that hold a null, NaN or infinite component, and rows with a null id take no part. An
    empty vector takes part and scores 0 with every other.
    """
    x = F.col(vector_col)
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(math.inf)))
    return df.where(F.col(id_col).isNotNull() & F.coalesce(sound, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("weights")
    )


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, and the row, term and weight of each nonzero entry."""
    ids = table.column("vec_id").to_numpy()
    lists = table.column("weights").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy()
    rows = np.repeat(np.arange(len(ids)), sizes)
    terms = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = values != 0
    return ids, rows[keep], terms[keep], values[keep]


def best_in_block(q: tuple, c: tuple, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query that has a partner: its id, and the ids and scores of its k best candidates in this block.

    Sums are exact: in doubles while they stay below 2**53, else in Python integers.
    """
    q_ids, q_rows, q_terms, q_weights = q
    c_ids, c_rows, c_terms, c_weights = c
    n = len(c_ids)
    top = lambda w: int(np.abs(w.astype(object)).max()) if len(w) else 0
    terms = np.unique(c_terms)
    exact = top(q_weights) * top(c_weights) * max(1, len(terms)) < 1 << 53
    kind = np.float64 if exact else object
    by_term = np.argsort(c_terms, kind="stable")
    edges = np.searchsorted(c_terms[by_term], [*terms, terms[-1] + 1 if len(terms) else 0])
    out = []
    for lo in range(0, len(q_ids), _QUERIES_AT_ONCE):
        ids = q_ids[lo : lo + _QUERIES_AT_ONCE]
        mine = (q_rows >= lo) & (q_rows < lo + len(ids))
        rows_of, terms_of, weights_of = q_rows[mine] - lo, q_terms[mine], q_weights[mine]
        scores = np.zeros((n, len(ids)), dtype=kind)
        for i, term in enumerate(terms):
            has = terms_of == term
            if not has.any():
                continue
            wanted = np.zeros(len(ids), dtype=kind)
            wanted[rows_of[has]] = weights_of[has].astype(kind)
            posting = by_term[edges[i] : edges[i + 1]]
            rows, weights = c_rows[posting], c_weights[posting].astype(kind)
            for a in range(0, len(rows), 256):
                part = rows[a : a + 256]
                added = weights[a : a + 256, None] * wanted[None, :]
                if part[-1] - part[0] + 1 == len(part):
                    scores[part[0] : part[-1] + 1] += added
                else:
                    scores[part] += added
        for j, query in enumerate(ids.tolist()):
            column = scores[:, j]
            others = np.flatnonzero(c_ids != query)
            if not len(others):
                continue
            column = column[others]
            if exact and len(others) > k:
                bar = np.partition(column, len(others) - k)[len(others) - k]
                others, column = others[column >= bar], column[column >= bar]
            order = sorted(range(len(others)), key=lambda x: (-column[x], c_ids[others[x]]))[:k] if len(others) <= 4 * k or not exact else np.lexsort((c_ids[others], -column))[:k]
            out.append((np.full(len(order), query), c_ids[others[order]], column[order]))
    return out


def _as_long(x: np.ndarray) -> np.ndarray:
    """As 64-bit integers; what doesn't fit is held at the nearest one."""
    return np.array([min(max(int(v), -(1 << 63)), (1 << 63) - 1) for v in x], dtype=np.int64) if x.dtype == object else x.astype(np.int64)


def _best(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query out of partial lists."""
    query, vec, score = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((vec, -score, query)) if score.dtype != object else np.array(sorted(range(len(query)), key=lambda i: (query[i], -score[i], vec[i])), np.int64)
    query = query[order]
    start = np.ones(len(query), dtype=bool)
    start[1:] = query[1:] != query[:-1]
    first = np.flatnonzero(start)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    order = order[place < k]
    return query[place < k], vec[order], score[order]


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of highest integer inner product for each query.

    Both inputs have vec_id and weights (see quantise). A candidate with the query's own id is left out. Ties go to the
    smaller vec_id; a missing dimension counts as 0; fewer than k candidates give fewer rows; repeated rows with one id
    are candidates each. A repeated query id is answered once, by the smallest of its vectors. Either input empty: no rows.
    """
    spark = queries.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("weights").alias("weights"))
    n_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    partial = None
    for i in range(n_blocks):
        block = queries if n_blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == i)
        shared = spark.sparkContext.broadcast(_rows(block.orderBy("vec_id").toArrow()))  # about QUERY_BLOCK vectors

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best: list = []
            for batch in batches:
                for at in range(0, len(batch), CANDIDATE_BLOCK):
                    best += best_in_block(shared.value, _rows(pa.Table.from_batches([batch.slice(at, CANDIDATE_BLOCK)])), k)
                    best = [_best(best, k)] if best else []
            if best:
                query, vec, score = best[0]
                yield pa.RecordBatch.from_arrays([pa.array(_as_long(x)) for x in (query, vec, score)], names=["query_id", "vec_id", "score"])

        found = candidates.select("vec_id", "weights").mapInArrow(scan, _SCHEMA)
        if n_blocks > 1:
            found = durable(found, "topk-partial")
            shared.destroy()
        partial = found if partial is None else partial.union(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
