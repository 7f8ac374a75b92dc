"""Language-model scoring by context-tree weighting over bytes, beside an add-one unigram baseline.

Each next byte is eight binary decisions (the nodes of a 255-node prefix tree); each decision has a context tree over the
previous DEPTH bytes. Krichevsky-Trofimov estimates of all depths are mixed with the context-tree weights, which follow from
the block probabilities of the training counts:

    P_w(s) = 1/2 P_e(s) + 1/2 prod_c P_w(cs)      (P_w = P_e at full depth)

and P(bit) runs from the root to the deepest context that occurs, each depth weighing in with 1/2 P_e(s) / P_w(s); beyond it a
decision is a half. A text begins after DEPTH start bytes and ends with an end byte, neither of which occurs in UTF-8, so the
model is a probability over texts.

All of it is tables that grow with the corpus. A gram is a byte with its DEPTH previous ones. Grams are counted; a level of the tree
is aggregated from the level below it, from the deepest to the root; mixing goes down again by joins; then each distinct gram
of the corpus has its probability. Texts meet them in one scan: the most frequent grams are broadcast, a fixed number at most, and
the others are joined by shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import discard, durable
from .textblocks import blocks, word_hashes

#: Bytes of context, six at most: a gram is one 64-bit number.
DEPTH = 5
START_BYTE, END_BYTE = 0xFE, 0xFF
#: The most frequent words and grams are broadcast: at most so many of them, 16 bytes each.
HEAVY, HEAVY_GRAMS = 1 << 20, 1 << 20
END_TOKEN = np.uint64(0x5EED)
_TEXT, _WORD, _GRAM = 0, 1, 2
#: Distinct keys that a task gathers before it hands on their counts.
_TALLY = 1 << 20


def training_fold(doc_id: Column, folds: int = 7, held: int = 2) -> Column:
    """Whether a document is for training; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) != held


def grams_of(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram at each position of the texts, end bytes included (the byte in the lowest 8 bits, then the previous ones), and offsets."""
    n, docs = len(data), len(at) - 1
    begin = at[:-1] + (depth + 1) * np.arange(docs)
    end = begin + depth + np.diff(at)
    out = np.full(n + (depth + 1) * docs, END_BYTE, np.uint8)
    body = np.ones(len(out), dtype=bool)
    body[end] = False
    for j in range(depth):
        out[begin + j] = START_BYTE
        body[begin + j] = False
    out[body] = data
    body[end] = True
    where = np.flatnonzero(body)
    grams = np.zeros(len(where), np.uint64)
    for j in range(depth + 1):
        grams |= out[where - j].astype(np.uint64) << np.uint64(8 * j)
    return grams, at + np.arange(docs + 1)


class _Tally:
    """Counts of keys, in training and in all, held as sorted arrays that are merged now and then."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, trained: np.ndarray) -> None:
        """Count keys; trained says which of them stand in training texts."""
        for part, times in ((keys[trained], (1, 1)), (keys[~trained], (0, 1))):
            if len(part):
                part, n = np.unique(part, return_counts=True)
                self.parts.append((part, n[:, None] * np.array(times)))
                self.held += len(part)
        if self.held > 2 * _TALLY and len(self.parts) > 1:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")  # parts are sorted runs
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.parts, self.held = [(keys[first], np.add.reduceat(counts[order], first, axis=0))], len(first)
        return self.parts[0]


def _count(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Partial counts (kind, key, n, times) of words and grams: in training texts and in all texts."""
    tallies = {_WORD: _Tally(), _GRAM: _Tally()}

    def flush(kind: int) -> pa.RecordBatch:
        keys, n = tallies[kind].merge()
        tallies[kind] = _Tally()
        counts = [pa.array(np.ascontiguousarray(n[:, k])) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.uint64).view(np.int64)), *counts], names=["kind", "key", "n", "times"])

    for batch in batches:
        trained = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, data, at in blocks(batch.column("text")):
            mine = trained[lo:hi]
            words, of = word_hashes(data, at)
            tallies[_WORD].add(np.concatenate([words, np.full(hi - lo, END_TOKEN)]), np.concatenate([np.repeat(mine, np.diff(of)), mine]))
            grams, of = grams_of(data, at, depth)
            tallies[_GRAM].add(grams, np.repeat(mine, np.diff(of)))
            for kind, tally in tallies.items():
                if tally.held > _TALLY and len(tally.merge()[0]) > _TALLY:
                    yield flush(kind)
    for kind, tally in tallies.items():
        if tally.parts:
            yield flush(kind)


def corpus_counts(docs: DataFrame, train: Column, depth: int = DEPTH) -> DataFrame:
    """(kind, key, n, times): how often each word (kind 1, by hash; the end token included) and gram (kind 2) occurs in training texts and in all."""
    partial = docs.select("text", F.coalesce(train, F.lit(False)).alias("train")).mapInArrow(lambda b: _count(b, depth), "kind int, key long, n long, times long")
    return partial.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))


def _log_kt(zeros: Column, ones: Column) -> Column:
    """Logarithm of the Krichevsky-Trofimov block probability: of B(zeros + 1/2, ones + 1/2) / pi, B being the beta function.

    Stirling's series at arguments raised by 8, with the large terms taken together, so that what is left is as exact as its own size allows
    for counts of any size.
    """
    a, b = zeros + 0.5, ones + 0.5
    n = a + b

    def risen(x: Column) -> Column:
        out = x
        for i in range(1, 8):
            out = out * (x + i)
        return out

    def series(x: Column) -> Column:
        r = 1 / (x + 8)
        r2 = r * r
        return r * (1 / 12 - r2 * (1 / 360 - r2 * (1 / 1260 - r2 * (1 / 1680 - r2 / 1188))))

    share = lambda x, other: F.when(2 * (x + 8) < n + 8, F.log((x + 8) / (n + 8))).otherwise(F.log1p(-other / (n + 8)))
    large = (a + 7.5) * share(a, b) + (b + 7.5) * share(b, a) + 7.5 * F.log(n + 8) - 8 + 0.5 * math.log(2 * math.pi)
    return large + series(a) + series(b) - series(n) + F.log(risen(n)) - F.log(risen(a)) - F.log(risen(b)) - math.log(math.pi)


def _path(byte: Column) -> Column:
    """array<struct<node, bit>> of a byte's eight decisions."""
    return F.array(*[F.struct((F.shiftright(byte, 8 - i) + (1 << i)).cast("int").alias("node"), F.shiftright(byte, 7 - i).bitwiseAND(1).cast("int").alias("bit")) for i in range(8)])


def _suffix(context: Column, depth: int) -> Column:
    """The newest `depth` bytes of a context."""
    return context.bitwiseAND(F.lit((1 << (8 * depth)) - 1))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def context_levels(grams: DataFrame, depth: int) -> list[DataFrame]:
    """(context, node, zero, one) for each depth from 0: the probabilities of a 0 and of a 1 at a node where that is the deepest known context.

    grams: (key, n) with n > 0. Both probabilities come from counts and weights, neither from the other: where one is a millionth of a
    millionth, it has as many digits as the other.
    """
    # Grams of a context come together first, so that the eight rows of each aren't shuffled.
    together = grams.select(F.shiftright("key", 8).alias("context"), F.col("key").bitwiseAND(255).alias("byte"), "n").repartition("context")
    spread = together.select("context", "n", F.inline(_path(F.col("byte"))))
    level = spread.groupBy("context", "node").agg(F.sum(F.col("n") * (1 - F.col("bit"))).alias("zeros"), F.sum(F.col("n") * F.col("bit")).alias("ones"))
    log_e = _log_kt(F.col("zeros"), F.col("ones"))
    kt = lambda c: (F.col(c) + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    # gain: by how much (in logarithms) a node's own estimate is better than all its longer contexts; at full depth there are none.
    levels = [durable(level.select("context", "node", "zeros", "ones", log_e.alias("log_w"), F.lit(math.inf).alias("gain")), "ctw-level")]
    for d in range(depth - 1, -1, -1):
        summed = levels[0].groupBy(_suffix(F.col("context"), d).alias("context"), "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_w").alias("below"))
        gain = summed.withColumn("log_e", log_e).withColumn("gain", F.col("log_e") - F.col("below"))
        log_w = math.log(0.5) + F.greatest("log_e", "below") + F.log1p(F.exp(-F.abs("gain")))
        levels.insert(0, durable(gain.select("context", "node", "zeros", "ones", log_w.alias("log_w"), "gain"), "ctw-level"))
    # Down again: `zero` and `one` are what the depths so far give, `rest` the weight that is left for deeper ones.
    tables = []
    for d, level in enumerate(levels):
        if d:
            above = tables[-1].select(F.col("context").alias("parent"), "node", F.col("zero").alias("zero_so_far"), F.col("one").alias("one_so_far"), F.col("rest").alias("share"))
            down = level.withColumn("parent", _suffix(F.col("context"), d - 1)).join(above, ["parent", "node"])
        else:
            down = level.withColumns({"zero_so_far": F.lit(0.0), "one_so_far": F.lit(0.0), "share": F.lit(1.0)})
        part = F.col("share") * _sigmoid(F.col("gain"))
        down = down.select(
            "context", "node", (F.col("zero_so_far") + part * kt("zeros")).alias("zero"), (F.col("one_so_far") + part * kt("ones")).alias("one"), (F.col("share") * _sigmoid(-F.col("gain"))).alias("rest")
        )
        tables.append(durable(down, "ctw-mixed"))
        discard(level)
    return tables


def gram_logs(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """grams (key, n, ...) with log: log10 of the probability of each gram's byte after its context, learned from the counts n.

    Grams with n = 0 take no part in learning. Of a gram's eight decisions, those that its longest context knows come first, and those that
    are left go to its next shorter one; what no context knows is a half. Only grams with decisions left go on to the next join.
    """
    levels = context_levels(grams.where("n > 0"), depth)
    likely = lambda p: F.when(p > 0, F.log10(p)).otherwise(F.raise_error(F.lit("a probability has to be positive")).cast("double"))
    steps = F.transform(_path(F.col("key").bitwiseAND(255)), lambda s, i: F.struct(i.alias("i"), s["node"].alias("node"), s["bit"].alias("bit")))
    start = F.struct(F.col("decided"), F.col("log"))
    pending, parts = grams.withColumns({"decided": F.lit(0), "log": F.lit(0.0)}), []
    for d in range(depth, -1, -1):
        # At most 255 nodes a context; a probability here counts the weight of deeper contexts, which aren't known, at a half.
        half = lambda c: F.col(c) + 0.5 * F.col("rest")
        nodes = levels[d].groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct(half("zero").alias("zero"), half("one").alias("one"))))).alias("nodes"))
        if d < 2:
            nodes = F.broadcast(nodes)  # at most 256 contexts

        def decide(so_far: Column, s: Column) -> Column:
            p = F.element_at("nodes", s["node"])
            here = (s["i"] == so_far["decided"]) & p.isNotNull()
            return F.when(here, F.struct((so_far["decided"] + 1).alias("decided"), (so_far["log"] + likely(F.when(s["bit"] == 1, p["one"]).otherwise(p["zero"]))).alias("log"))).otherwise(so_far)

        met = pending.withColumn("context", _suffix(F.shiftright("key", 8), d)).join(nodes, "context", "left")
        met = met.withColumn("_step", F.when(F.col("nodes").isNull(), start).otherwise(F.aggregate(steps, start, decide))).select(*grams.columns, "_step.decided", "_step.log")
        met = durable(met, "ctw-grams")
        parts.append(met.where("decided = 8"))
        pending = met.where("decided < 8")
    parts.append(pending.withColumn("log", F.col("log") + (8 - F.col("decided")) * math.log10(0.5)))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    discard(*levels)
    return out.drop("decided")


def _heavy(table: DataFrame, most: int, *values: str) -> list[np.ndarray]:
    """key (as uint64, sorted) and values of the rows of largest `times`: at most `most` of them, those of a power of 2 together.

    What is frequent in any text counts, in training or not, so that no frequent key is left for the join.
    """
    size = F.floor(F.log2(F.col("times") + 1)).cast("int")
    least, held = None, 0
    # At most 64 sizes.
    for bucket, count in sorted(map(tuple, table.groupBy(size).agg(F.count(F.lit(1))).collect()), reverse=True):
        held += count
        if held > most:
            break
        least = bucket
    rows = (table.where(size >= least) if least is not None else table.limit(0)).select("key", *values).toArrow()
    key = rows.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return [key[order], *[rows.column(v).to_numpy()[order] for v in values]]


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key stands in the sorted keys, and whether it is there."""
    place = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return place, keys[place] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)


def _rare_rows(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, times) of the distinct keys of each text."""
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
    first = np.flatnonzero(new)
    return doc[first], keys[first], np.diff(np.append(first, len(keys)))


def lm_scores(docs: DataFrame, train: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """For each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_bytes, code_length (bits per byte).

    train: which rows to learn from (training_fold of doc_id if None). Counts cover every training row. Null texts are empty;
    an empty text has the end alone. base_score: unigram words with add-one smoothing, log10; score: the context tree's log10.
    Rows that repeat are scored one by one. An empty table: no rows; no training rows: every probability is uniform.
    code_length is null for an empty text.
    """
    spark = docs.sparkSession
    train = F.coalesce(training_fold(F.col("doc_id")) if train is None else train, F.lit(True))
    counts = durable(corpus_counts(docs, train, depth), "ctw-counts")
    words = counts.where(f"kind = {_WORD}").select("key", "n", "times")
    total, distinct = words.where("n > 0").agg(F.sum("n"), F.count(F.lit(1))).first()
    total, distinct = int(total or 0), int(distinct)
    grams = gram_logs(counts.where(f"kind = {_GRAM}").select("key", "n", "times"), depth)
    heavy = _heavy(words, HEAVY, "n")
    model = spark.sparkContext.broadcast((*heavy, *_heavy(grams, HEAVY_GRAMS, "log")))
    end_count = int((words.where(F.col("key") == int(END_TOKEN)).first() or {"n": 0})["n"])
    kinds = [docs.schema["doc_id"].dataType, *[T.BooleanType(), T.LongType(), T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.LongType()]]
    names = ["doc_id", "held_out", "rid", "kind", "key", "times", "known", "base", "score", "n_bytes"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with what the broadcast keys give; a row for each of its distinct words and grams that aren't among them."""
        keys, ns, grams, gram_log = model.value
        logs = np.log10(ns + 1.0)
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, data, at in blocks(batch.column("text")):
                n = hi - lo
                hashes, of = word_hashes(data, at)
                doc = np.repeat(np.arange(n), np.diff(of))
                place, known = _found(keys, hashes)
                base = np.bincount(doc[known], weights=logs[place[known]], minlength=n)
                n_known = np.bincount(doc[known], weights=ns[place[known]] > 0, minlength=n).astype(np.int64)
                rare = [(_WORD, *_rare_rows(doc[~known], hashes[~known]))]
                mine, gram_of = grams_of(data, at, depth)
                one, where = np.unique(mine, return_inverse=True)
                place, there = _found(grams, one)
                log = np.zeros(len(one))
                log[there] = gram_log[place[there]]
                score = np.add.reduceat(log[where], gram_of[:-1])
                doc = np.repeat(np.arange(n), np.diff(gram_of))
                left = ~there[where]
                rare.append((_GRAM, *_rare_rows(doc[left], mine[left])))
                rids = rid + np.arange(n)
                rid += n
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, n), batch.column("held_out").slice(lo, n), pa.array(rids), pa.array(np.full(n, _TEXT, np.int32)), pa.nulls(n, pa.int64()), pa.array(np.diff(of) + 1),
                        pa.array(n_known + (1 if end_count else 0)), pa.array(base + math.log10(end_count + 1)), pa.array(score), pa.array(np.diff(at)),
                    ],
                    names=names,
                )
                for kind, of_text, key, times in rare:
                    if m := len(key):
                        none = [pa.nulls(m, batch.column("doc_id").type), pa.nulls(m, pa.bool_())]
                        yield pa.RecordBatch.from_arrays([*none, pa.array(rids[of_text]), pa.array(np.full(m, kind, np.int32)), pa.array(key.view(np.int64)), pa.array(times), *[pa.nulls(m, t) for t in (pa.int64(), pa.float64(), pa.float64(), pa.int64())]], names=names)

    rows = docs.select("doc_id", "text", (~train).alias("held_out"))
    seen = durable(rows.mapInArrow(scan, T.StructType([T.StructField(n, t) for n, t in zip(names, kinds, strict=True)])), "ctw-scan")
    known = words.where("n > 0").select(F.lit(_WORD).alias("kind"), "key", F.log10(F.col("n") + 1.0).alias("value")).union(grams.select(F.lit(_GRAM), "key", "log"))
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, c)), F.lit(0))
    worth = F.col("times") * F.col("value")
    rare = seen.where(f"kind <> {_TEXT}").select("rid", "kind", "key", "times").join(known, ["kind", "key"]).groupBy("rid").agg(of(_WORD, F.col("times")).alias("more"), of(_WORD, worth).alias("more_base"), of(_GRAM, worth).alias("more_score"))
    whole = seen.where(f"kind = {_TEXT}").join(rare, "rid", "left")
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return whole.select(
        "doc_id",
        "held_out",
        F.col("times").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("times") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        score.alias("score"),
        "n_bytes",
        F.when(F.col("n_bytes") > 0, -score * math.log2(10) / F.col("n_bytes")).alias("code_length"),
    )
