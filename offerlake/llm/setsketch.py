"""Near-duplicate documents by SetSketch registers (Ertl, 2021).

1. Each document becomes its set of distinct k-word shingles. Documents of equal sets form a class; its smallest id stands
   for it from here on.
2. A set's SetSketch has REGISTERS registers, each the truncated logarithm (base BASE) of the least of exponentially spaced
   values over its elements. Registers of a union are the maxima of registers, and two sets agree on a register about as
   often as their Jaccard similarity.
3. Runs of ROWS registers make band keys. The members of a bucket are paired with its leader, whose links settle most buckets
   (see _pairs). What is left are buckets that hold several components: their members are dealt into tiles of bounded bytes, and
   pairs of tiles that share a bucket are compared member by member inside a task (see _remainder), so that no pair of a bucket
   stays untried, and no more rows come out than links that join something.
4. The joint likelihood of two sketches estimates the similarity; pairs far below the bound are dropped.
5. The rest is verified on full sets, and connected components give the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .store import discard, durable, keep_ids
from .textblocks import blocks, distinct_within, mix, shingles, word_hashes

REGISTERS, ROWS = 300, 6
BASE = 1.001
#: Turns of pairing with leaders, before the remainder is compared in full.
TURNS = 1
#: Bytes of sketches and sets of one tile, about (one set may be larger); a task of the remainder holds two tiles.
TILE_BYTES = 8 << 20
#: Standard errors of an estimate below the similarity at which a pair is dropped unverified.
ERRORS = 6
_TOP = (1 << 16) - 2
_SEED = np.uint64(0x2545F4914F6CDD1D)


def _uniform(keys: np.ndarray) -> np.ndarray:
    return ((keys >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def sketch(elements: np.ndarray, of: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Registers (sets x m, uint16) of sets of 64-bit elements, elements[of[i]:of[i+1]] being set i; empty sets get zeros.

    An element throws a Poisson stream of points (rate m) at random registers; a register keeps its least point x, stored as
    1 - log_BASE(x), truncated. A stream is followed until it passes the time by which the set's registers are likely all hit;
    sets with a register still bare go on with twice that time. Only the least points count, so the outcome doesn't depend
    on where streams are cut.
    """
    n_sets = len(of) - 1
    sizes = np.diff(of)
    least = np.full((n_sets, m), np.inf)
    todo = np.flatnonzero(sizes)
    horizon = (math.log(m) + 5) / np.maximum(1, sizes)
    while len(todo):
        # Bound the points that are held at once.
        spent = np.cumsum(sizes[todo] + m * 12)
        for part in np.split(todo, np.flatnonzero(np.diff(spent // 200_000)) + 1):
            owner = np.repeat(part, sizes[part])
            place = np.repeat(of[:-1][part], sizes[part]) + np.arange(len(owner)) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part])
            key = elements[place]
            time = np.zeros(len(key))
            step = 0
            while len(key):
                # Several steps of a stream at once where few streams are left; times add up in the same order whatever the run.
                run = min(256, max(1, 16384 // len(key)))
                steps = np.arange(step + 1, step + run + 1, dtype=np.uint64) * _SEED
                step += run
                draw = mix(key[:, None] + steps)
                times = np.cumsum(np.concatenate([time[:, None], -np.log(_uniform(draw)) / m], axis=1), axis=1)[:, 1:]
                live = times <= horizon[owner][:, None]
                where = (owner[:, None] * m + (mix(draw) % np.uint64(m)).astype(np.int64))[live]
                np.minimum.at(least.ravel(), where, times[live])
                on = live[:, -1]
                key, time, owner = key[on], times[on, -1], owner[on]
        todo = todo[np.isinf(least[todo]).any(axis=1)]
        horizon[todo] *= 2
        least[todo] = np.inf
    with np.errstate(divide="ignore"):
        registers = np.floor(1 - np.log(least) / math.log(BASE)) + _TOP // 2
    return np.where(np.isinf(least), 0, np.clip(registers, 1, _TOP)).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def joint_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches (rows), the cardinalities being known.

    The likelihood of the counts of registers that are larger, smaller and equal is maximised over the feasible similarities by
    bisection of its derivative (it is concave there).
    """
    lo, hi = np.zeros(len(a)), np.minimum(n_a / n_b, n_b / n_a)
    for _ in range(40):
        mid = (lo + hi) / 2
        up = _slope(a, b, n_a, n_b, mid) > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def _slope(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, j: np.ndarray | float) -> np.ndarray:
    """The derivative at j of the log likelihood of pairs of sketches."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - above - below
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    c = (BASE - 1) / BASE
    x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
    p, q = -np.log1p(-x * c) / math.log(BASE), -np.log1p(-y * c) / math.log(BASE)
    dp, dq = -v * c / (1 - x * c) / math.log(BASE), -u * c / (1 - y * c) / math.log(BASE)
    return above * dp / np.maximum(p, 1e-12) + below * dq / np.maximum(q, 1e-12) - equal * (dp + dq) / np.maximum(1 - p - q, 1e-12)


def may_reach(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sizes of pairs allow the similarity and their estimate (see joint_jaccard) isn't ERRORS standard errors below it.

    The likelihood being concave, its maximum lies above the floor where it still rises there.
    """
    floor = similarity - ERRORS * math.sqrt(similarity * (1 - similarity) / a.shape[1])
    return (np.minimum(n_a, n_b) >= np.maximum(n_a, n_b) * (similarity - 1e-9)) & (_slope(a, b, n_a, n_b, floor) > 0)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for lo, hi, data, at in blocks(batch.column("text")):
            elements, of = distinct_within(*shingles(*word_hashes(data, at), k))
            yield batch, lo, hi, elements, of


def _sum_within(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return sums[of[1:]] - sums[of[:-1]]


def sketched_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, registers): the size of each document's shingle set, a 128-bit digest of the set, its sketch."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, elements, of in _sets(batches, k):
            sums = [_sum_within(mix(elements ^ np.uint64(salt)), of).view(np.int64) for salt in (0x1234567, 0x89ABCDEF)]
            registers = pa.array([r.tobytes() for r in sketch(elements, of)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(of).astype(np.int64)), *map(pa.array, sums), registers], names=["doc_id", "n_shingles", "d1", "d2", "registers"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, n_shingles long, d1 long, d2 long, registers binary")


def band_keys(sketches: DataFrame) -> DataFrame:
    """(doc_id, band): a key for each run of ROWS registers."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            registers = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(len(batch), -1)
            bands = registers.reshape(len(batch), -1, ROWS).astype(np.uint64)
            keys = np.zeros(bands.shape[:2], np.uint64)
            with np.errstate(over="ignore"):
                for j in range(ROWS):
                    keys = mix(keys + bands[:, :, j])
                keys = mix(keys + np.arange(keys.shape[1], dtype=np.uint64) * _SEED)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("doc_id").to_numpy(), keys.shape[1])), pa.array(keys.ravel().view(np.int64))], names=["doc_id", "band"])

    return sketches.select("doc_id", "registers").mapInArrow(make, "doc_id long, band long")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _likely(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sizes allow the similarity and whose estimate isn't far below it."""
    wanted = durable(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "setsketch-ids")
    few = keep_ids(sketches, wanted)
    one = few.select(F.col("doc_id").alias("u"), F.col("n").alias("n_u"), F.col("registers").alias("r_u"))
    two = few.select(F.col("doc_id").alias("v"), F.col("n").alias("n_v"), F.col("registers").alias("r_v"))
    # Sizes and sketches that can't reach the similarity go before any set is read.
    joined = pairs.join(one, "u").join(two, "v").where(F.least("n_u", "n_v") >= F.greatest("n_u", "n_v") * F.lit(similarity - 1e-9))

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(c).to_numpy().astype(float) for c in ("n_u", "n_v")]
            good = may_reach(_registers(batch.column("r_u")), _registers(batch.column("r_v")), *sizes, similarity)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("u", "v")], names=["u", "v"])

    return joined.select("u", "v", "n_u", "n_v", "r_u", "r_v").mapInArrow(estimate, "u long, v long")


def _full_sets(texts: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, s): the sorted shingle hashes of the texts whose ids are in ids, as bytes."""
    kept = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("s", T.BinaryType())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, elements, of in _sets(batches, k):
            cut = zip(of[:-1].tolist(), of[1:].tolist(), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([elements[a:b].tobytes() for a, b in cut], pa.binary())], names=["doc_id", "s"])

    return durable(keep_ids(texts, ids).select("doc_id", "text").mapInArrow(sets, kept), "setsketch-full")


def common_elements(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of the sorted set a with each of the others, which aren't empty."""
    flat = np.concatenate(others)
    place = np.minimum(np.searchsorted(a, flat), len(a) - 1)
    return np.add.reduceat(a[place] == flat, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets hold 100 * intersection >= percent * union.

    Each text is hashed to its sorted set once; pairs then meet their two sets by joins, and are compared in bounded batches.
    """
    wanted = durable(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "setsketch-ids")
    full = _full_sets(texts, wanted, k)
    joined = pairs.join(full.select(F.col("doc_id").alias("u"), F.col("s").alias("s_u")), "u").join(full.select(F.col("doc_id").alias("v"), F.col("s").alias("s_v")), "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("s_u"), batch.column("s_v"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = int(common_elements(a, [b])[0])
                good.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good, pa.bool_())) for c in ("u", "v")], names=["u", "v"])

    return joined.select("u", "v", "s_u", "s_v").mapInArrow(compare, "u long, v long")


def _mixed(buckets: DataFrame, parts: DataFrame | None) -> DataFrame:
    """buckets with part (the component so far), of those buckets that no single component fills."""
    if parts is None:
        return buckets.withColumn("part", F.col("doc_id"))
    tagged = buckets.join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id")).drop("component")
    mixed = tagged.groupBy("band").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("band")
    return tagged.join(mixed, "band", "left_semi")


def _pairs(buckets: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Pairs (u, v), u < v, of each bucket's members with its leader, where they are in different components so far.

    In a group of variants of one text, the text itself shares most bucket places over all bands, and all others link with it,
    though not with each other. So the leader is the member of the largest such weight.
    """
    mixed = _mixed(buckets, parts)
    leaders = mixed.groupBy("band").agg(F.max_by(F.struct("doc_id", "part"), F.struct("weight", -F.col("doc_id"))).alias("leader"))
    pairs = mixed.join(leaders, "band").where(F.col("part") != F.col("leader.part"))
    return pairs.select(F.least("doc_id", "leader.doc_id").alias("u"), F.greatest("doc_id", "leader.doc_id").alias("v")).distinct()


def joining_links(ids: np.ndarray, part: np.ndarray, registers: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the parts of two tiles (side 1 and 2; all members on side 1: of one tile) as far as verified links between them do.

    Every pair across the sides that is in different parts still, and whose sketches don't rule it out, is verified on full sets.
    """
    part = np.unique(part, return_inverse=True)[1]
    n = np.array([len(s) for s in sets])
    first, second = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    links = []
    for at, i in enumerate(first.tolist()):
        others = second if len(second) else first[at + 1 :]
        others = others[part[others] != part[i]]
        if not len(others):
            continue
        others = others[100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])]
        near = [may_reach(registers[x], registers[i][None], n[x].astype(float), np.full(len(x), float(n[i])), percent / 100) for x in np.split(others, range(1024, len(others), 1024))]
        others = others[np.concatenate(near)]
        while len(others):
            some = others[:64]
            common = common_elements(sets[i], [sets[j] for j in some])
            for j in some[100 * common >= percent * (n[some] + n[i] - common)].tolist():
                if part[j] != part[i]:
                    links.append((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))))
                    part[part == part[j]] = part[i]
            others = others[64:]
            others = others[part[others] != part[i]]
    return links


def _remainder(buckets: DataFrame, parts: DataFrame, sketches: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links (u, v) that join the components of mixed buckets, all pairs of which are tried.

    Each member gets a label, the largest bucket among those of its buckets' members, so that members of overlapping buckets stand
    together; a label's members are dealt by hash into tiles of about TILE_BYTES. Two tiles meet in a task if a bucket has members
    in both. The tiles of a bucket, and not its members, are paired before that, and only joining links come out.
    """
    mixed = durable(_mixed(buckets, parts).select("band", "doc_id", "part"), "setsketch-mixed")
    held = mixed.groupBy("band").agg(F.count(F.lit(1)).alias("held"))
    widest = mixed.join(held, "band").groupBy("doc_id").agg(F.max(F.struct("held", "band")).alias("label"))
    reach = mixed.join(widest, "doc_id").groupBy("band").agg(F.max("label").alias("label"))
    labels = mixed.join(reach, "band").groupBy("doc_id").agg(F.max("label.band").alias("label"), F.min("part").alias("part"))
    labels = durable(labels, "setsketch-labels")
    ids = labels.select("doc_id")
    members = keep_ids(sketches, ids).join(_full_sets(texts, ids, k).dropDuplicates(["doc_id"]), "doc_id").join(labels, "doc_id")
    weight = labels.join(keep_ids(sketches.select("doc_id", "n"), ids), "doc_id").groupBy("label").agg((1 + F.sum(2 * REGISTERS + 8 * F.col("n")) / TILE_BYTES).cast("long").alias("tiles"))
    # Written before the joins below, so that AQE can split what many rows share.
    placed = labels.join(weight, "label").select("doc_id", F.xxhash64("label", F.pmod(F.xxhash64("doc_id"), F.col("tiles"))).alias("tile"))
    placed = durable(placed, "setsketch-tiles")
    members = durable(members.drop("label").join(placed, "doc_id"), "setsketch-members")
    spread = durable(mixed.join(placed, "doc_id").select("band", "tile").distinct(), "setsketch-spread")
    cells = spread.join(spread.withColumnRenamed("tile", "other"), "band").where("tile <= other").select("tile", "other").distinct()
    cells = durable(cells.withColumn("cell", F.xxhash64("tile", "other")), "setsketch-cells")
    sides = cells.select("cell", "tile", F.lit(1).alias("side")).union(cells.where("tile < other").select("cell", "other", F.lit(2)))

    def compare(_: tuple, cell: pa.Table) -> pa.Table:
        column = lambda name: cell.column(name).to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in cell.column("s")]
        links = joining_links(column("doc_id"), column("part"), _registers(cell.column("registers")), sets, column("side"), percent)
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    links = sides.join(members, "tile").select("cell", "side", "doc_id", "part", "registers", "s").groupBy("cell").applyInArrow(lambda key, cell: compare(key, cell), "u long, v long")
    links = durable(links, "setsketch-links")
    discard(mixed, labels, placed, members, spread, cells)
    return links


def near_duplicate_links(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, links, parts): classes (doc_id, n_shingles, rep) for each row of docs; verified links (u, v) between class
    representatives, at least as many as join each component; parts (id, component) of the representatives that have links."""
    sets = durable(sketched_sets(docs, k), "setsketch-sets")
    digests = sets.select("doc_id", "n_shingles", "d1", "d2")
    reps = digests.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = durable(reps, "setsketch-reps")
    classes = digests.join(reps, ["d1", "d2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    only = reps.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct()
    sketches = keep_ids(sets.where("n_shingles > 0").select("doc_id", F.col("n_shingles").alias("n"), "registers"), only)
    bands = durable(band_keys(sketches), "setsketch-bands")
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = durable(bands.join(sizes, "band"), "setsketch-buckets")
    weights = shared.groupBy("doc_id").agg(F.sum("members").alias("weight"))
    buckets = durable(shared.drop("members").join(weights, "doc_id"), "setsketch-buckets")
    discard(bands, shared)
    links, parts = None, None
    for _ in range(TURNS):
        pairs = durable(_pairs(buckets, parts), "setsketch-pairs")
        likely = durable(_likely(pairs, sketches, percent / 100), "setsketch-likely")
        found = durable(_verified(likely, texts, k, percent), "setsketch-links")
        links = found if links is None else links.union(found)
        parts = connected_components(links)
    found = _remainder(buckets, parts, sketches, texts, k, percent)
    if found.limit(1).count():
        links = links.union(found)
        parts = connected_components(links)
    return classes, links, parts


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs: component_id is the smallest doc_id reachable over links.

    A document links with another if 100 * intersection >= percent * union of their sets of distinct k-word shingles, words
    being textblocks.BLANK_SEPARATED, lower-cased; fewer words than k, but some, are one shingle. Null and blank texts have
    empty sets and no links. Rows that repeat a doc_id with the same text come out each, alike. Ids must be unique otherwise:
    one text stands for all rows of an id. A null doc_id is linked with nothing and kept. Empty table: no rows.
    """
    classes, _, parts = near_duplicate_links(docs, k, percent)
    return (
        classes.join(parts, F.col("rep") == F.col("id"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; all columns as they were.

    Of rows with one id the one of the smallest hash over all columns stays. Columns that can't be hashed (maps) aren't allowed.
    """
    gone = durable(near_duplicates(docs, k, percent).where("not kept").select("doc_id").distinct(), "setsketch-gone")
    twice = durable(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "setsketch-twice")
    # Only rows whose id repeats, if there are any, are shuffled to find one of each.
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.col("text"))
    again = keep_ids(docs, twice)
    place = "_place" + "_" * max(map(len, docs.columns))
    again = again.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
    once = keep_ids(docs, twice, how="left_anti").unionByName(again)
    return keep_ids(once, gone, how="left_anti").select(*docs.columns)
