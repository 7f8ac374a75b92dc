"""Benchmark decontamination with suffix arrays over shards of the training text.

Every shard (a run of whole documents of about half a MB) gets a sparse suffix array over its words: the suffixes whose first
words begin some test window, sorted by their first words. Every test suffix, as far as a window reaches, is binary-searched
there, which gives all verbatim occurrences; runs of them along one item are the longest matches. Suffixes that can't begin
a match are left out of the sort: it doesn't change what is found.

The benchmark goes to the shards in blocks of bounded size, one pass over the documents for each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import durable, text_batches, unused
from .textblocks import ALPHANUMERIC, blocks, mix, word_hashes

WINDOW = 10
#: Bytes of benchmark text that are broadcast at once.
BENCHMARK_BLOCK_BYTES = 8 << 20
_SHARD_BYTES = 1 << 19
_TABLE_BITS = 20
_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))

_RANGES = T.ArrayType(T.ArrayType(T.LongType()))
_MATCHES = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "doc_word", "item_word", "n_words")]))


def _start_hash(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each position; it wraps round at the end."""
    out = words.copy()
    with np.errstate(over="ignore"):
        for j in range(1, n):
            out = mix(out + np.roll(words, -j))
    return out


@dataclass
class TestWindows:
    """Distinct windows of one benchmark block, sorted, with the (item, place) pairs that each stands at."""

    keys: np.ndarray  # window words as big-endian bytes
    lengths: np.ndarray
    of: np.ndarray  # offsets into item and place
    item: np.ndarray
    place: np.ndarray
    starts: dict[int, np.ndarray]  # n -> table of the hashes of first n words
    width: int

    @staticmethod
    def build(item_ids: np.ndarray, texts: pa.Array, width: int) -> TestWindows:
        rows, lengths, items, places = [], [], [], []
        starts = {n: np.zeros(1 << _TABLE_BITS, dtype=bool) for n in (1, 2, 3)}
        for lo, _, data, at in blocks(texts):
            words, of = word_hashes(data, at, ALPHANUMERIC)
            for i, (a, b) in enumerate(zip(of[:-1].tolist(), of[1:].tolist(), strict=True)):
                if a == b:
                    continue
                size = min(width, b - a)
                n = b - a - size + 1
                windows = np.zeros((n, width), np.uint64)
                windows[:, :size] = np.lib.stride_tricks.sliding_window_view(words[a:b], size)
                rows.append(windows)
                lengths.append(np.full(n, size))
                items.append(np.full(n, item_ids[lo + i]))
                places.append(np.arange(n))
                k = min(3, size)
                starts[k][_start_hash(words[a:b], k)[:n] >> np.uint64(64 - _TABLE_BITS)] = True
        if not rows:
            return TestWindows(np.zeros(0, f"S{8 * width}"), *[np.zeros(0, np.int64)] * 4, {}, width)
        keys = _keys(np.concatenate(rows))
        # A short item's window and a longer one that only differs by padding are told apart by length.
        order = np.lexsort((np.concatenate(lengths), keys))
        keys, lengths = keys[order], np.concatenate(lengths)[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (lengths[1:] != lengths[:-1])
        first = np.flatnonzero(new)
        return TestWindows(keys[first], lengths[first], np.append(first, len(keys)), np.concatenate(items)[order], np.concatenate(places)[order], {k: t for k, t in starts.items() if t.any()}, width)


def _keys(windows: np.ndarray) -> np.ndarray:
    """Rows of words as byte strings that sort like the rows."""
    return np.ascontiguousarray(windows.astype(">u8")).view(f"S{8 * windows.shape[1]}").ravel()


def _occurrences(words: np.ndarray, of: np.ndarray, test: TestWindows) -> tuple[np.ndarray, np.ndarray]:
    """(window number, word position in the shard) of every occurrence, by binary search in the shard's suffix array."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(words) or not len(test.keys):
        return none
    begins = np.zeros(len(words), dtype=bool)
    for n, table in test.starts.items():
        begins |= table[_start_hash(words, n) >> np.uint64(64 - _TABLE_BITS)]
    suffixes = np.flatnonzero(begins)
    if not len(suffixes):
        return none
    ends = of[np.searchsorted(of, suffixes, side="right")]
    reach = suffixes[:, None] + np.arange(test.width)
    inside = reach < ends[:, None]
    sorted_by = _keys(np.where(inside, words[np.minimum(reach, len(words) - 1)], np.uint64(0)))
    order = np.argsort(sorted_by, kind="stable")
    array, suffixes = sorted_by[order], suffixes[order]
    low = np.searchsorted(array, test.keys, side="left")
    top = test.keys.copy()
    short = np.flatnonzero(test.lengths < test.width)
    if len(short):
        raw = np.frombuffer(top.tobytes(), np.uint8).reshape(len(top), -1).copy()
        for i in short:
            raw[i, 8 * test.lengths[i] :] = 255
        top = np.ascontiguousarray(raw).view(top.dtype).ravel()
    n = np.searchsorted(array, top, side="right") - low
    hit = np.flatnonzero(n > 0)
    sizes = n[hit]
    at = np.repeat(low[hit], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(hit, sizes), suffixes[at]


def find_matches(texts: pa.Array, test: TestWindows) -> tuple[list, list, list]:
    """For each text: its number of words, hit [start, end) word ranges, and longest matches."""
    n_words, ranges, matches = [], [], []
    for _, _, data, at in blocks(texts, _SHARD_BYTES):
        words, of = word_hashes(data, at, ALPHANUMERIC)
        n_words += np.diff(of).tolist()
        window, where = _occurrences(words, of, test)
        of_doc: dict[int, tuple[list, list]] = {}
        if len(window):
            doc = np.searchsorted(of, where, side="right") - 1
            # Hit words: the union of all occurrences.
            order = np.argsort(where, kind="stable")
            a, b, d = where[order], (where + test.lengths[window])[order], doc[order]
            reached = np.maximum.accumulate(b)
            new = np.ones(len(a), dtype=bool)
            new[1:] = (d[1:] != d[:-1]) | (a[1:] > reached[:-1])
            first = np.flatnonzero(new)
            for x, y, e in zip(a[first].tolist(), np.maximum.reduceat(b, first).tolist(), d[first].tolist(), strict=True):
                of_doc.setdefault(e, ([], []))[0].append([x - int(of[e]), y - int(of[e])])
            # Longest matches: windows that follow each other both in the document and in an item.
            copies = test.of[window + 1] - test.of[window]
            pick = np.repeat(test.of[window], copies) + np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)
            item, place, pos = test.item[pick], test.place[pick], np.repeat(where, copies)
            length, doc = np.repeat(test.lengths[window], copies), np.repeat(doc, copies)
            order = np.lexsort((pos, pos - place, item, doc))
            item, place, pos, length, doc = item[order], place[order], pos[order], length[order], doc[order]
            new = np.ones(len(item), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - place[1:] != pos[:-1] - place[:-1]) | (pos[1:] != pos[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(item)) - 1
            for f, t in zip(first.tolist(), last.tolist(), strict=True):
                e = int(doc[f])
                of_doc.setdefault(e, ([], []))[1].append({"item_id": int(item[f]), "doc_word": int(pos[f] - of[e]), "item_word": int(place[f]), "n_words": int(pos[t] + length[t] - pos[f])})
        for e in range(len(of) - 1):
            hit, found = of_doc.get(e, ([], []))
            ranges.append(hit)
            matches.append(found)
    return n_words, ranges, matches


def _merged_size(ranges: list) -> int:
    """Words in the union of ranges."""
    size, reached = 0, 0
    for a, b in sorted(ranges):
        size += max(0, b - max(a, reached))
        reached = max(reached, b)
    return size


def _windows_of(items: DataFrame, window: int) -> TestWindows:
    rows = items.orderBy("item_id", "text").collect()  # at most about BENCHMARK_BLOCK_BYTES
    return TestWindows.build(np.array([r[0] for r in rows], np.int64), pa.array([r[1] for r in rows], pa.large_string()), window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, names: tuple[str, str, str] = ("_n_words", "_n_hit", "_matches")) -> DataFrame:
    """docs with three columns: the words, the words hit, and array<struct<item_id, doc_word, item_word, n_words>> of longest matches.

    A window is `window` words in a row of an item, or the whole of a shorter one; words are compared as in
    textblocks.ALPHANUMERIC, lower-cased. A null or empty text has no words; an item without words has no window; items with a
    null item_id are left out; items that repeat an id count as one id. Rows of docs stay one for one, whatever their ids;
    columns of docs with those names are replaced. An empty benchmark: no hits.

    A benchmark beyond BENCHMARK_BLOCK_BYTES is taken in blocks, one pass over the texts for each; a pass writes its hits only.
    """
    spark = docs.sparkSession
    text_batches(spark)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / BENCHMARK_BLOCK_BYTES))
    out = docs.drop(*names)
    added = [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], _MATCHES)]
    if n_blocks == 1:
        test = spark.sparkContext.broadcast(_windows_of(items, window))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, ranges, matches = find_matches(batch.column("text"), test.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), pa.array(map(_merged_size, ranges), pa.int64()), pa.array(matches, _MATCH)], names=[*batch.schema.names, *names])

        return out.mapInArrow(scan, T.StructType([*out.schema.fields, *added]))
    row, ranges_of = unused(out, "row"), unused(out, "ranges")
    numbered = durable(out.withColumn(row, F.monotonically_increasing_id()), "decontam-rows")
    hits = None
    for i in range(n_blocks):
        test = spark.sparkContext.broadcast(_windows_of(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == i), window))

        def find(batches: Iterator[pa.RecordBatch], test=test, first=i == 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, ranges, matches = find_matches(batch.column("text"), test.value)
                keep = pa.array([first or bool(r) for r in ranges], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(row), pa.array([n if first else 0 for n in n_words], pa.int64()), pa.array(ranges, pa.list_(pa.list_(pa.int64()))), pa.array(matches, _MATCH)], names=[row, names[0], ranges_of, names[2]]).filter(keep)

        found = T.StructType([T.StructField(row, T.LongType()), added[0], T.StructField(ranges_of, _RANGES), added[2]])
        part = durable(numbered.select(row, "text").mapInArrow(find, found), "decontam-hits")
        test.destroy()
        hits = part if hits is None else hits.union(part)
    # A text's hits are bounded by its own length and the items that share its words.
    gathered = hits.groupBy(row).agg(F.sum(names[0]).alias(names[0]), F.flatten(F.collect_list(ranges_of)).alias(ranges_of), F.flatten(F.collect_list(names[2])).alias(names[2]))
    reached = F.aggregate(
        F.array_sort(ranges_of),
        F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("end")),
        lambda s, r: F.struct((s["size"] + F.greatest(F.lit(0).cast("long"), r[1] - F.greatest(r[0], s["end"]))).alias("size"), F.greatest(s["end"], r[1]).alias("end")),
        lambda s: s["size"],
    )
    return numbered.join(gathered.select(row, names[0], reached.alias(names[1]), names[2]), row).drop(row)


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs."""
    found = contamination(docs.select("doc_id", "text"), benchmark, window)
    items = F.sort_array(F.transform(F.array_distinct(F.transform("_matches", lambda m: m["item_id"])), lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("_n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without any hit, all columns as they were, whatever their names."""
    names = tuple(unused(docs, n) for n in ("n_words", "n_hit", "matches"))
    return contamination(docs, benchmark, window, names).where(F.col(names[1]) == 0).drop(*names)
