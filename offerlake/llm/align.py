"""Alignment of two tokenizers over the same bytes by byte-owner arrays.

Both tokenizers cover the bytes of a space and the text. np.repeat of token numbers over token lengths names the owner of every byte
under A and under B. Where both owners change at once, both have a token end: a cut. Cuts part the tokens into groups; neighbouring
bytes with the same two owners are one overlap. All texts of a batch lie in one array, since every text begins with a cut.

Counts of linked id pairs are aggregated before they are shuffled. Rows meet the counts twice: the most frequent pairs, a checked
number, are looked up in place; the other pairs, each in few documents, are joined by shuffle.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import LATIN_DIGIT, LATIN_LETTER, REMEMBERED_CHARS, WHITE, ForcedBpe, Remember, byte_letters
from .store import durable, text_batches

#: Pairs that are looked up in place: 13 bytes each in every worker.
FREQUENT_PAIRS = 1 << 20
#: Texts are aligned in runs of about so many bytes; a longer one is a run of its own.
RUN_BYTES = 1 << 20
#: Segments of each tokenizer that a worker remembers, at most.
SEGMENTS = 1 << 19
#: Links of larger groups are counted from their distinct ids.
LARGE_GROUP = 1 << 12
#: Where no token of A or B holds both sides: from a character that isn't white space to a space.
SEGMENT = re.compile(f" [{WHITE}]*(?:[^{WHITE}]+(?:[\\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000][{WHITE}]*)?)*")
#: Texts in which some space doesn't stand behind a character that isn't white space (the one that is put before a text counts as none).
UNEVEN = r"(?:^|[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]) "
#: How byte-level vocabularies of this kind split a text, for characters of Latin scripts; other segments are split by the library.
LATIN = re.compile("[\t-\r -~\xa0-\u017f]*")
LATIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN_LETTER}]+| ?[{LATIN_DIGIT}]+| ?[^\s{LATIN_LETTER}{LATIN_DIGIT}]+|\s+(?!\S)|\s+")
#: Stands for the ids of a segment that a tokenizer doesn't give back byte for byte.
UNLIKE = (-1,)


class SpacedBpe:
    """A byte-level vocabulary file whose splitter keeps the space before a word; special tokens in texts are plain text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        letters = {letter: b for b, letter in enumerate(byte_letters())}
        self.byte = letters
        self.bpe = ForcedBpe(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.lengths = np.zeros(1 + max(model["vocab"].values()), np.int64)
        self.bytes: list[bytes] = [b""] * len(self.lengths)
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes([letters[c] for c in token])
            self.lengths[i] = len(self.bytes[i])
        self.segment = Remember(self._segment, SEGMENTS)

    def _segment(self, rest: str) -> tuple[int, ...]:
        """The ids of the segment of a space and rest."""
        segment, word = " " + rest, self.bpe.word
        if LATIN.fullmatch(segment):
            words = LATIN_WORDS.findall(segment)
            # A segment of one word is remembered as a segment.
            return self.bpe.encode_word(segment.encode()) if len(words) == 1 else tuple(chain.from_iterable([word[w.encode()] for w in words]))
        byte = self.byte
        ids = tuple(chain.from_iterable([word[bytes([byte[c] for c in w])] for w, _ in self.split(segment)]))
        return ids if b"".join([self.bytes[i] for i in ids]) == segment.encode() else UNLIKE


class SpacedPieces:
    """A SentencePiece model; pieces that hold a space hold it at their start, so that text is cut before every run of spaces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in piece.lstrip("▁") for piece in pieces):
            raise ValueError("a piece of this model holds a space behind another character")
        self.bytes = [bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode() for i, piece in enumerate(pieces)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.space = self.model.piece_to_id("▁")
        self.segment = Remember(lambda rest: self._checked([rest])[0], SEGMENTS)

    def _checked(self, rests: list[str]) -> list[tuple[int, ...]]:
        """The ids of the segments of a space and each of rests."""
        # The model puts a space before what it encodes; before nothing it puts none.
        of = self.bytes
        found = [ids if rest else [self.space] for rest, ids in zip(rests, self.model.encode(rests, num_threads=1), strict=True)]
        return [tuple(ids) if b"".join([of[i] for i in ids]) == b" " + rest.encode() else UNLIKE for rest, ids in zip(rests, found, strict=True)]

    def prepare(self, rests: list[str]) -> None:
        """Encode what isn't known of rests, which are distinct, in one call, so that each is quick to look up."""
        known, older = self.segment, self.segment.older
        new = [s for s in rests if s not in known and s not in older and len(s) <= REMEMBERED_CHARS]
        for rest, ids in zip(new, self._checked(new), strict=True):
            known.store(rest, ids)


class Aligner:
    """Both tokenizers of a worker, and what is written for their ids."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = SpacedBpe(path_a), SpacedPieces(path_b)
        self.ids_a = {mark: pa.array([f"{i}{mark}" for i in range(len(self.a.lengths))], pa.large_string()) for mark in ",|"}
        self.ids_b = {mark: pa.array([f"{i}{mark}" for i in range(len(self.b.lengths))], pa.large_string()) for mark in ",;"}

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of a space and each text under A and B, none where their bytes aren't those, and the n+1 offsets of each text in them."""
        n = len(texts)
        texts = texts.fill_null("")
        listed = pc.split_pattern(texts, " ")
        if pc.any(pc.match_substring_regex(texts, UNEVEN)).as_py():
            uneven = pc.match_substring_regex(texts, UNEVEN).to_pylist()
            listed = pa.array([[x[1:] for x in SEGMENT.findall(" " + text)] if odd else text.split(" ") for text, odd in zip(texts.to_pylist(), uneven, strict=True)], pa.list_(texts.type))
        coded = pc.list_flatten(listed).dictionary_encode()
        rests, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(n), pc.list_value_length(listed).to_numpy(zero_copy_only=False))
        self.b.prepare(rests)
        known = [list(map(x.segment.__getitem__, rests)) for x in (self.a, self.b)]
        unlike = np.array([a is UNLIKE or b is UNLIKE for a, b in zip(*known, strict=True)], bool)
        good = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        good[row[unlike[code]]] = False
        row, code = row[good[row]], code[good[row]]
        out, ends = [], []
        for lists in known:
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat, first = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), np.cumsum(sizes) - sizes
            mine = sizes[code]
            out.append(flat[np.arange(int(mine.sum())) - np.repeat(np.cumsum(mine) - mine - first[code], mine)])
            ends.append(np.concatenate([[0], np.cumsum(np.bincount(row, weights=mine, minlength=n).astype(np.int64))]))
        return out[0], out[1], ends[0], ends[1]


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker and pair of paths."""
    return Aligner(path_a, path_b)


def owners(lengths: np.ndarray) -> np.ndarray:
    """The number of the token that owns each byte."""
    return np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)


def groups_of(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n+1 offsets of the groups in A's tokens and in B's tokens, of equal total length."""
    of_a, of_b = owners(lengths_a), owners(lengths_b)
    cuts = np.flatnonzero((of_a[1:] != of_a[:-1]) & (of_b[1:] != of_b[:-1])) + 1
    if not len(of_a):
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    return np.concatenate([[0], of_a[cuts], [len(lengths_a)]]).astype(np.int64), np.concatenate([[0], of_b[cuts], [len(lengths_b)]]).astype(np.int64)


def overlaps_of(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of every pair that shares a byte, in order of bytes: the distinct neighbours among the owner pairs."""
    of_a, of_b = owners(lengths_a), owners(lengths_b)
    first = np.ones(len(of_a), bool)
    first[1:] = (of_a[1:] != of_a[:-1]) | (of_b[1:] != of_b[:-1])
    return of_a[first], of_b[first]


def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 32) | b


def linked_pairs(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, text_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct id pairs that each of n texts links, how many links each has, and the n+1 offsets of the texts.

    at_a, at_b: offsets of groups in the ids a and b; text_of: the text of each group. All pairs of a group are links.
    """
    size_a, size_b = np.diff(at_a), np.diff(at_b)
    links = size_a * size_b
    small = links <= LARGE_GROUP
    texts, keys, times = [], [], []
    # Each A token of a small group meets all B tokens of it.
    rows = np.repeat(np.flatnonzero(small), size_a[small])  # group of each such A token
    places = np.arange(len(rows)) - np.repeat(np.cumsum(size_a[small]) - size_a[small], size_a[small]) + at_a[rows]
    widths = size_b[rows]
    other = np.arange(int(widths.sum())) - np.repeat(np.cumsum(widths) - widths, widths) + np.repeat(at_b[rows], widths)
    keys.append(_keys(np.repeat(a[places], widths), b[other]))
    texts.append(np.repeat(text_of[rows], widths))
    times.append(np.ones(len(other), np.int64))
    for g in np.flatnonzero(~small).tolist():
        ids_a, n_a = np.unique(a[at_a[g] : at_a[g + 1]], return_counts=True)
        ids_b, n_b = np.unique(b[at_b[g] : at_b[g + 1]], return_counts=True)
        keys.append(_keys(np.repeat(ids_a, len(ids_b)), np.tile(ids_b, len(ids_a))))
        times.append(np.outer(n_a, n_b).ravel())
        texts.append(np.full(len(keys[-1]), text_of[g]))
    text, key, count = np.concatenate(texts), np.concatenate(keys), np.concatenate(times)
    order = np.lexsort((key, text))
    text, key, count = text[order], key[order], count[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(new)
    summed = np.add.reduceat(count, starts) if len(starts) else count[:0]
    return key[starts], summed, np.searchsorted(text[starts], np.arange(n + 1))


def _written(model: Aligner, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, text_of: np.ndarray, n: int) -> pa.Array:
    """For each of n texts its groups: ids of A joined by commas, a bar, ids of B joined by commas; groups joined by semicolons."""
    n_a, n_b = np.diff(at_a), np.diff(at_b)
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[at_a[1:] - 1] = True
    last_b[at_b[1:] - 1] = True
    # A's token stands behind the tokens of A before it and the tokens of B in groups before its own; likewise B's.
    place = np.empty(len(a) + len(b), np.int64)
    place[np.arange(len(a)) + np.repeat(at_b[:-1], n_a)] = np.where(last_a, len(self_a := model.a.lengths), 0) + a
    base = 2 * len(self_a)
    place[np.arange(len(b)) + np.repeat(at_a[1:], n_b)] = base + np.where(last_b, len(model.b.lengths), 0) + b
    table = pa.concat_arrays([model.ids_a[","], model.ids_a["|"], model.ids_b[","], model.ids_b[";"]])
    sizes = np.bincount(text_of, weights=n_a + n_b, minlength=n).astype(np.int64)
    listed = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), table.take(pa.array(place)))
    return pc.utf8_rtrim(pc.binary_join(listed, pa.scalar("", pa.large_string())), ";")


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))])
    row, n = 0, len(texts)
    while row < n:
        to = max(row + 1, int(np.searchsorted(sizes, sizes[row] + RUN_BYTES, side="right")) - 1)
        yield row, to
        row = to


def align_texts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, keys, times) for each row of docs (doc_id, text).

    A is a byte-level vocabulary file of the tokenizers library, encoding a space and the text; B is a SentencePiece model, encoding the
    text. groups has the ids as `a1,a2|b1;a3|b2,b3`. keys has the distinct linked id pairs (A's id * 2**32 + B's id), times how many links
    each has. A null or empty text, or one that A or B doesn't give back byte for byte after its space, has no tokens: zeros, "" and empty
    arrays. Rows stay one for one, repeated and null doc_ids included; other columns aren't read. Texts of any length are aligned whole.
    """
    text_batches(docs.sparkSession)
    numbers = ("n_a", "n_b", "n_groups", "n_links")
    listed = T.ArrayType(T.LongType(), False)
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(x, T.LongType()) for x in numbers), T.StructField("groups", T.StringType()), T.StructField("keys", listed), T.StructField("times", listed)]
    names = [f.name for f in fields]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = aligner(path_a, path_b)
        for batch in batches:
            column = batch.column("text")
            for lo, hi in _runs(column):
                n = hi - lo
                a, b, ends_a, ends_b = model.batch(column.slice(lo, n))
                at_a, at_b = groups_of(model.a.lengths[a], model.b.lengths[b])
                text_of = np.searchsorted(ends_a, at_a[:-1], side="right") - 1
                keys, times, of = linked_pairs(a, b, at_a, at_b, text_of, n)
                links = np.bincount(text_of, weights=np.diff(at_a) * np.diff(at_b), minlength=n) if len(a) else np.zeros(n)
                offsets = pa.array(of, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, n), pa.array(np.diff(ends_a), pa.int64()), pa.array(np.diff(ends_b), pa.int64()),
                        pa.array(np.bincount(text_of, minlength=n) if len(a) else np.zeros(n, np.int64), pa.int64()), pa.array(links.astype(np.int64)), (_written(model, a, b, at_a, at_b, text_of, n) if len(a) else pa.array([""] * n)).cast(pa.string()),
                        pa.ListArray.from_arrays(offsets, pa.array(keys, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                    ],
                    names=names,
                )

    return docs.select("doc_id", "text").mapInArrow(scan, T.StructType(fields))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(key, docs, best): how many rows of aligned link each id pair, and whether that is the highest count of the pair's A id."""
    counts = aligned.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("docs")).withColumn("a", F.shiftright("key", 32))
    # At most one row for each id of A: the vocabulary bounds what is broadcast.
    highest = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(F.broadcast(highest), "a").select("key", "docs", (F.col("docs") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """aligned, written rows with a distinct rid, with n_best (links whose pair is best) and count_sum (docs over all links).

    Up to frequent of the most frequent pairs are broadcast and looked up in place; only the other pairs are shuffled.
    """
    spark = aligned.sparkSession
    top = counts.orderBy(F.desc("docs"), "key").limit(frequent).toArrow().sort_by("key")
    if not len(top):
        return aligned.withColumn("n_best", F.lit(0).cast("long")).withColumn("count_sum", F.lit(0).cast("long"))
    shared = spark.sparkContext.broadcast(tuple(top.column(x).to_numpy() for x in ("key", "docs", "best")))
    kept = [f for f in aligned.schema.fields if f.name not in ("keys", "times")]
    listed = T.ArrayType(T.LongType(), False)
    new = [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("rest", listed), T.StructField("rest_times", listed)]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, best = shared.value
        for batch in batches:
            keys, times = (pc.list_flatten(batch.column(x)).to_numpy() for x in ("keys", "times"))
            sizes = pc.list_value_length(batch.column("keys")).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[at] == keys
            sums = [np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)]
            np.add.at(sums[0], row[hit], (times * best[at])[hit])
            np.add.at(sums[1], row[hit], (times * docs[at])[hit])
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=len(sizes)))]), pa.int32())
            left = [pa.ListArray.from_arrays(offsets, pa.array(x[~hit], pa.int64())) for x in (keys, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *map(pa.array, sums), *left], names=[f.name for f in [*kept, *new]])

    found = aligned.mapInArrow(look_up, T.StructType([*kept, *new]))
    if len(top) < frequent:
        return found.drop("rest", "rest_times")
    found = durable(found, "align-found")
    rest = found.select("rid", F.explode(F.arrays_zip(F.col("rest").alias("key"), F.col("rest_times").alias("times"))).alias("x")).select("rid", "x.key", "x.times")
    sums = rest.join(counts, "key").groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("docs")).alias("c"))
    both = found.drop("rest", "rest_times").join(sums, "rid", "left")
    return both.withColumn("n_best", F.col("n_best") + F.coalesce("b", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("c", F.lit(0))).drop("b", "c")


def alignment_report(docs: DataFrame, path_a: str, path_b: str, frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs; sha of "" is ""."""
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = align_texts(docs, path_a, path_b).withColumn("groups_sha256", sha).drop("groups").withColumn("rid", F.monotonically_increasing_id())
    aligned = durable(aligned, "align-texts")
    counts = durable(pair_counts(aligned), "align-counts")
    scored = score_links(aligned, counts, frequent)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
