"""The operators against brute force, on small inputs with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offerlake.llm import chat, compact_windows, components, ctw, decontam, html_diff, langid, mixing, setsketch, textblocks, topk, toxicity

WORDS = [a + b for a in "ka be ti so mu ra".split() for b in "l n r st mp x".split()]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# Word hashing


def test_word_hashes_are_words():
    texts = ["", None, "  ", "Ab aB\tab", "é x y", "a b", "x" * 5000 + " a"]
    data, at = textblocks.utf8(pa.array(texts))
    got, of = textblocks.word_hashes(data, at)
    ids = {}
    words = [(x or "").lower().replace("É", "é") for x in texts]
    import re

    for i, x in enumerate(words):
        split = re.findall(r"[^\x20\x09-\x0D]+", x)
        mine = got[of[i] : of[i + 1]].tolist()
        assert len(mine) == len(split)
        for w, h in zip(split, mine, strict=True):
            assert ids.setdefault(w, h) == h
    assert len(set(ids.values())) == len(ids)


@pytest.mark.parametrize("k", [1, 2, 5])
def test_shingles(k):
    texts = ["a b a b c", "b a", "a", "", "c b a b a"]
    data, at = textblocks.utf8(pa.array(texts))
    got, of = textblocks.shingles(*textblocks.word_hashes(data, at), k)
    seen = {}
    for i, x in enumerate(texts):
        w = x.split()
        want = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)] if len(w) >= k else ([tuple(w)] if w else [])
        assert of[i + 1] - of[i] == len(want)
        for s, h in zip(want, got[of[i] : of[i + 1]].tolist(), strict=True):
            assert seen.setdefault(s, h) == h
    assert len(set(seen.values())) == len(seen)


# Chat formatting


def test_chat_round_trip(spark):
    rng = random.Random(1)
    bits = ["<s>", "</s>", "[INST]", " [/INST]", "[ROLE]", "[/ROLE]", "\\", "<", "[", "x", "\n", "é", "<\\s>", "<\\\\/s>", "", " "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "to[ROLE]ol", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))])) for c in range(30) for t in range(rng.randint(1, 5))]
    rows += [(99, 0, "user", "same"), (99, 0, "user", "same"), (98, None, "user", "no turn"), (97, 3, "user", "later"), (97, None, None, None), (97, None, "assistant", "first"), (None, 1, "user", "no id")]
    turns = chat.to_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")))
    formatted = chat.format_chats(turns)
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in formatted.select("conv_id", chat.parse_chat(F.col("formatted")).alias("turns")).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "") if r[0] is not None else (False, 0, r[1] is not None, r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert back == want
    for r in formatted.collect():
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    digest = {r["conv_id"]: r for r in chat.chat_digest(formatted).collect()}
    for c, said in want.items():
        loss = "".join(x for role, x in said if role == "assistant")
        assert digest[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert digest[c]["loss_chars"] == len(loss)
        assert digest[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()


def test_no_chats(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(chat.to_turns(none)).count() == 0
    assert chat.unmatched(none).count() == 0


def test_layouts(spark):
    rows = [
        '{"id":1,"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}',
        '{"id":2,"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":null}]}',
        '{"id":3,"instruction":"i","input":"more","output":"o"}',
        '{"id":4,"prompt":"p","response":"r","system":"s"}',
        '{"id":5,"question":"q","answer":"a"}',
        '{"id":6,"prompt":"p","completion":"c"}',
        '{"id":7,"other":"x"}',
    ]
    schema = "id long, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, instruction string, input string, output string, prompt string, response string, system string, question string, answer string, completion string, other string"
    df = spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")
    got = {}
    for r in chat.to_turns(df, "id").orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {
        1: [("user", "a"), ("assistant", "b")],
        2: [("user", "a"), ("assistant", "")],
        3: [("user", "i\n\nmore"), ("assistant", "o")],
        4: [("system", "s"), ("user", "p"), ("assistant", "r")],
        5: [("user", "q"), ("assistant", "a")],
        6: [("user", "p"), ("assistant", "c")],
    }
    assert [r["id"] for r in chat.unmatched(df).collect()] == [7]


# Exact top-k


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 256]) for i in range(120)] + [(7, [1.0]), (500, None), (501, [1.0, None]), (502, [float("nan")]), (503, [float("inf")]), (504, []), (None, [1.0])]
    v = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("weights", F.lit("clash")).withColumn("score", F.lit(1)))
    got = {}
    for r in topk.exact_top_k(v.where("vec_id % 50 = 0"), v, 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and i < 500 or i == 504]
    for q, w in ((i, w) for i, w in kept if i % 50 == 0):
        best = sorted(((-sum(a * b for a, b in zip(w, e, strict=False)), i) for i, e in kept if i != q))[:5]
        assert got[q] == {n + 1: (i, -s) for n, (s, i) in enumerate(best)}
    twice = v.union(v.where("vec_id = 50").withColumn("weights", F.expr("transform(weights, x -> -1000L)")))
    again = {r["rank"]: r["vec_id"] for r in topk.exact_top_k(twice.where("vec_id = 50"), v, 5).collect()}
    assert again == {r["rank"]: r["vec_id"] for r in topk.exact_top_k(twice.where("vec_id = 50 and weights[0] = -1000"), v, 5).collect()}
    assert topk.exact_top_k(v.limit(0), v).count() == 0
    assert topk.exact_top_k(v, v.limit(0)).count() == 0


def test_top_k_in_passes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = topk.quantise(spark.createDataFrame([(i, [float(x) for x in rng.integers(-9, 9, 5) / 256]) for i in range(300)], "vec_id long, embedding array<double>"))
    want = sorted(map(tuple, topk.exact_top_k(v, v, 3).collect()))
    monkeypatch.setattr(topk, "QUERY_BLOCK", 70)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    assert sorted(map(tuple, topk.exact_top_k(v, v, 3).collect())) == want and len(want) == 900


def test_top_k_beyond_doubles():
    big = (np.array([1, 2]), np.array([0, 1]), np.array([0, 0]), np.array([1 << 40, 3], dtype=np.int64))
    found = topk.best_in_block(big, big, 2)
    assert [(int(a[0]), int(b[0]), int(c[0])) for a, b, c in found] == [(1, 2, 3 << 40), (2, 1, 3 << 40)]


# Mixing


def test_poisson_inverse():
    u = np.linspace(0.0001, 0.9999, 999)
    for mean in (0.05, 1.0, 7.5, 900.0):
        got = mixing.poisson_inverse(u, mean)
        cdf, k, p, want = 0.0, 0, math.exp(-mean) if mean < 700 else None, []
        if p is not None:
            cdf = p
            for x in u:
                while cdf < x:
                    k += 1
                    p *= mean / k
                    cdf += p
                want.append(k)
            assert got.tolist() == want
        assert abs(got.mean() - mean) < 0.05 * mean + 0.02
    assert mixing.poisson_inverse(u, 0.0).sum() == 0


def test_mixing(spark):
    rows = [(i, "t", "a" if i % 3 else None) for i in range(900)] + [(5, "t", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copy", F.lit("clash")).withColumn("rate", F.lit("x"))
    for clash in ("count", "place", "mixed_source", "_count", "_place", "_source"):
        d = d.withColumn(clash, F.lit("kept"))
    assert mixing.mix_sources(d, {"a": 1.0}).columns == [*d.drop("copy").columns, "copy"]
    by_other = mixing.mix_sources(d.withColumn("kind", F.col("source")).withColumn("source", F.lit(7)), {"a": 1.0}, source_col="kind").collect()
    got = mixing.mix_sources(d, {"a": 1.0}).collect()
    assert sorted(r["doc_id"] for r in by_other) == sorted(r["doc_id"] for r in got)
    assert {(r["rate"], r["_count"], r["place"]) for r in got} == {("x", "kept", "kept")}
    no_ids = mixing.mix_sources(d.withColumn("doc_id", F.lit(None).cast("long")), size=3.0).collect()
    sizes = Counter("a" if i % 3 else None for i in range(900)) + Counter("a")
    assert all(n % sizes[source] == 0 for source, n in Counter(r["source"] for r in no_ids).items())
    counts = Counter(r["doc_id"] for r in got)
    assert {r["source"] for r in got} == {"a"}
    assert 800 < len(got) < 1000
    assert counts[5] % 2 == 0
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in mixing.mix_sources(d, {"a": 1.0}).collect()]
    assert mixing.mix_sources(d.limit(0)).count() == 0
    assert mixing.mix_sources(d, {"none": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(d, {"a": -1.0})


# Decontamination


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(i, text_of(rng, rng.choice([1, 3, 9, 10, 11, 30]))) for i in range(20)] + [(50, None), (51, ""), (3, text_of(rng, 12)), (None, "x")]
    rows = []
    for i in range(60):
        words = text_of(rng, rng.randint(0, 60)).split()
        if i % 2:
            item = (rng.choice(items)[1] or "").split()
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + "," for w in item[: rng.randint(0, len(item))]]
        rows.append((i, "-".join(words)))
    rows += [(5, rows[5][1]), (100, None), (101, "")]
    d = docs(spark, rows).withColumn("_n_hit", F.lit("clash")).withColumn("item_id", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")

    def brute(text):
        import re

        split = lambda x: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", x.lower())
        words, hit, ids = split(text or ""), set(), set()
        for i, x in items:
            w = split(x or "")
            n = min(10, len(w))
            if i is None or not n:
                continue
            for j in range(len(w) - n + 1):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == w[j : j + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(i))
        return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)

    want = Counter((i, *brute(x)) for i, x in rows)
    assert Counter(tuple(r) for r in decontam.contamination_report(d, b).collect()) == want
    old = decontam.BENCHMARK_BLOCK_BYTES
    decontam.BENCHMARK_BLOCK_BYTES = 300
    try:
        assert Counter(tuple(r) for r in decontam.contamination_report(d, b).collect()) == want
    finally:
        decontam.BENCHMARK_BLOCK_BYTES = old
    for clash in ("_ranges", "_matches", "_n_words", "n_hit"):
        d = d.withColumn(clash, F.lit("kept"))
    clean = decontam.decontaminate(d, b)
    assert clean.columns == d.columns
    assert {(r["_ranges"], r["_matches"], r["_n_words"], r["n_hit"], r["_n_hit"]) for r in clean.collect()} == {("kept", "kept", "kept", "kept", "clash")}
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(i for i, x in rows if not brute(x)[-1])
    assert decontam.decontaminate(d, b.limit(0)).count() == len(rows)
    assert decontam.contamination_report(d.limit(0), b).count() == 0


def test_longest_match(spark):
    item = " ".join(f"w{i}" for i in range(30))
    d = docs(spark, [(1, "a b " + " ".join(f"w{i}" for i in range(5, 27)) + " c")])
    m = decontam.contamination(d, spark.createDataFrame([(4, item)], "item_id long, text string")).first()["_matches"]
    assert [(x["item_id"], x["doc_word"], x["item_word"], x["n_words"]) for x in m] == [(4, 2, 5, 22)]


# LM scoring


def ctw_brute(train, text, depth):
    """log10 probability of text by the definition, contexts as tuples of previous bytes (nearest last)."""
    counts = {}
    for x in train:
        seq = [0xFE] * depth + [*x.encode(), 0xFF]
        for i in range(depth, len(seq)):
            node = 1
            for bit in range(7, -1, -1):
                b = seq[i] >> bit & 1
                for d in range(depth + 1):
                    c = counts.setdefault((tuple(seq[i - d : i]), node), [0, 0])
                    c[b] += 1
                node = 2 * node + b
    log_e = lambda c: math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(c[0] + c[1] + 1) - math.log(math.pi)
    weights, longer = {}, {}
    for t, n in counts:
        if t:
            longer.setdefault((t[1:], n), set()).add(t[0])

    def log_w(s, node):
        c = counts.get((s, node))
        if c is None:
            return 0.0
        if len(s) == depth:
            return log_e(c)
        below = sum(log_w((b, *s), node) for b in longer.get((s, node), ()))
        a, b = math.log(0.5) + log_e(c), math.log(0.5) + below
        top = max(a, b)
        out = top + math.log(math.exp(a - top) + math.exp(b - top))
        weights[s, node] = math.exp(a - out)
        return out

    for node in {n for _, n in counts}:
        log_w((), node)

    def p_one(s, node, history):
        c = counts.get((s, node), [0, 0])
        kt = (c[1] + 0.5) / (sum(c) + 1)
        if len(s) == depth:
            return kt if (s, node) in counts else 0.5
        deeper = p_one((history[-len(s) - 1], *s), node, history)
        w = weights.get((s, node))
        return (deeper if not s and w is None else w * kt + (1 - w) * deeper) if w is not None else 0.5

    total, seq = 0.0, [0xFE] * depth + [*text.encode(), 0xFF]
    for i in range(depth, len(seq)):
        node = 1
        for bit in range(7, -1, -1):
            b, p = seq[i] >> bit & 1, p_one((), node, seq[:i])
            total += math.log10(p if b else 1 - p)
            node = 2 * node + b
    return total


def test_lm_scores(spark):
    rng = random.Random(5)
    rows = [(i, text_of(rng, rng.randint(0, 9))) for i in range(40)] + [(40, None), (41, "Unseen éx"), (3, "again again")]
    d = docs(spark, rows).withColumn("score", F.lit("clash")).withColumn("word", F.lit("clash"))
    got = ctw.lm_scores(d).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [(x or "") for i, x in rows if not held(i)]
    import re

    tokens = lambda x: re.findall(r"[^\x20\x09-\x0D]+", (x or "").lower()) + [None]
    c = Counter(t for x in train for t in tokens(x))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, x in rows:
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x))
        want[(i, held(i), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, round(base, 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    for depth, found in ((ctw.DEPTH, got), (2, ctw.lm_scores(d, depth=2).collect())):
        for i, x in (rows[0], rows[7], rows[41], rows[40]):
            mine = [r["score"] for r in found if r["doc_id"] == i and r["n_bytes"] == len((x or "").encode())]
            assert abs(mine[0] - ctw_brute(train, x or "", depth)) < 1e-9
    assert ctw.lm_scores(d.limit(0)).count() == 0


def test_rare_words_and_grams_join(spark, monkeypatch):
    rows = [(i, f"common w{i} w{i}") for i in range(30)]
    seen = lambda: {r["doc_id"]: (r["n_known"], round(r["base_score"], 9), round(r["score"], 4)) for r in ctw.lm_scores(docs(spark, rows)).collect()}
    want = seen()
    monkeypatch.setattr(ctw, "HEAVY", 2)
    monkeypatch.setattr(ctw, "HEAVY_GRAMS", 2)
    assert seen() == want


def test_context_tree_is_a_distribution(spark):
    """After contexts that occur in full, in part and not at all, the probabilities of all bytes sum to 1."""
    known = {0x41424361: 5, 0x41424362: 2, 0x58424361: 9, 0x41424461: 1}
    contexts = (0x414243, 0x584243, 0x7A4243, 0x7A7A43, 0x7A7A7A)
    grams = [(c << 8 | b, known.get(c << 8 | b, 0)) for c in contexts for b in range(256)] + [(0x41424461, 1)]
    got = {r["key"]: r["log"] for r in ctw.gram_logs(spark.createDataFrame(grams, "key long, n long"), 3).collect()}
    assert len(got) == len(grams)
    for c in contexts:
        assert abs(sum(10.0 ** got[c << 8 | b] for b in range(256)) - 1) < 1e-9


@pytest.mark.parametrize("power", range(4, 13, 2))
def test_context_tree_with_counts_of_any_size(spark, power):
    """After 10**power sightings of a byte, the one that differs in its last bit has the estimate 1/2 : n + 1, at every depth alike; all bytes sum to 1."""
    n = 10**power
    contexts = (0x6161, 0x7A61, 0x7A7A)
    grams = [(c << 8 | b, n if (c, b) == (0x6161, 0x61) else 3 if (c, b) == (0x7A61, 0x62) else 0) for c in contexts for b in range(256)]
    got = {r["key"]: r["log"] for r in ctw.gram_logs(spark.createDataFrame(grams, "key long, n long"), 2).collect()}
    for c in contexts:
        assert abs(sum(10.0 ** got[c << 8 | b] for b in range(256)) - 1) < 1e-9
    alone = {r["key"]: r["log"] for r in ctw.gram_logs(spark.createDataFrame([(0x616161, n), (0x616160, 0)], "key long, n long"), 2).collect()}
    assert abs(alone[0x616160] - (7 * math.log10((n + 0.5) / (n + 1)) + math.log10(0.5 / (n + 1)))) < 1e-9
    assert abs(alone[0x616161] - 8 * math.log10((n + 0.5) / (n + 1))) < 1e-9


def test_texts_without_training_rows(spark):
    d = docs(spark, [(1, "ab"), (2, None)])
    got = {r["doc_id"]: r for r in ctw.lm_scores(d, F.lit(False)).collect()}
    assert got[1]["train_tokens"] == 0 and got[1]["n_known"] == 0
    assert abs(got[1]["score"] + 3 * math.log10(256)) < 1e-9
    assert abs(got[2]["score"] + math.log10(256)) < 1e-9


# Toxicity and language


def test_nnpu_learns(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 8 == 0
        words = text_of(rng, 30).split()
        if bad:
            words[3:3] = [rng.choice(["vile", "foul", "grim"]) for _ in range(3)]
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(bad)))
    rows += [(2000, None), (2001, "")]
    d = docs(spark, rows).withColumn("_score", F.lit("clash")).withColumn("p", F.lit("clash")).withColumn("toxic", F.lit(0))
    table = spark.createDataFrame([*labels, (None, 1), (3, None), (8, 0)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_report(d, table).collect()}
    assert len(got) == 1502
    held = [i for i in range(1500) if got[i]["held_out"]]
    right = sum(got[i]["predicted"] == (i % 8 == 0) for i in held) / len(held)
    assert right > 0.97
    assert got[2000]["score"] == got[2001]["score"] < 0.5
    assert toxicity.drop_toxic(d, table).columns == d.columns
    assert toxicity.toxicity_report(d, table.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.toxicity_report(d.limit(0), table).count() == 0


def test_risk_and_its_gradient():
    """The non-negative risk by its definition, and its gradient by differences; the step turns where the corrected part is negative."""
    rng = np.random.default_rng(3)
    texts = lambda n: [np.unique(rng.integers(0, 6, rng.integers(0, 5))) for _ in range(n)]
    positive, unlabelled = texts(9), texts(14)
    w = rng.standard_normal(7)
    loss = lambda text, sign: math.log1p(math.exp(-sign * (w[text].sum() + w[-1])))
    for prior in (0.05, 0.999):
        if prior > 0.9:
            w, unlabelled = np.append(np.abs(w[:-1]) * 5, -4.0), [np.zeros(0, np.int64)] * 14
        up = prior * np.mean([loss(x, 1) for x in positive])
        rest = np.mean([loss(x, -1) for x in unlabelled]) - prior * np.mean([loss(x, -1) for x in positive])
        value, gradient = toxicity.risk(w, positive, unlabelled, prior)
        assert abs(value - (up + max(0.0, rest))) < 1e-9
        part = (lambda: toxicity.risk(w, positive, unlabelled, prior)[0]) if rest >= 0 else (lambda: -(np.mean([loss(x, -1) for x in unlabelled]) - prior * np.mean([loss(x, -1) for x in positive])))
        for i in range(len(w)):
            w[i] += 1e-6
            above = part()
            w[i] -= 2e-6
            below = part()
            w[i] += 1e-6
            assert abs((above - below) / 2e-6 - gradient[i]) < 1e-5
    assert rest < 0


def test_few_toxic_examples(spark):
    rng = random.Random(15)
    rows = [(i, text_of(rng, 30) + (" vile" if i in (1, 2, 3) else "")) for i in range(300)]
    table = spark.createDataFrame([(i, int(i in (1, 2, 3))) for i in range(0, 200)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_report(docs(spark, [*rows, (400, "so vile")]), table).collect()}
    assert [i for i, p in got.items() if p] == [1, 2, 3, 400]


def test_language(spark):
    rng = random.Random(8)
    words = {"aa": ["kala", "mana", "tila", "sora"], "bb": ["stöß", "größ", "übel", "weiß"]}
    rows = [(i, " ".join(rng.choice(words["aa" if i % 2 else "bb"]) for _ in range(rng.randint(1, 60))), "aa" if i % 2 else "bb") for i in range(400)]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "12 34 !", "bb"), (1003, "kala mana tila", None)]
    rows += [(5, rows[5][1], "aa")] * 50 + [(None, "kala mana", "aa")] * 50
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_lang", F.lit("clash"))
    assert langid.language_report(d).count() == len(rows)
    got = {r["doc_id"]: r for r in langid.language_report(d).collect()}
    assert sum(got[i]["lang_pred"] == ("aa" if i % 2 else "bb") for i in range(400)) > 395
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.language_report(d.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0
    assert langid.language_report(d.limit(0)).count() == 0


def test_network_learns_what_it_is_shown():
    """Fitting lowers the cross-entropy of the windows it is fitted on."""
    rng = np.random.default_rng(9)
    windows, target = rng.integers(1, 256, (12, langid.WINDOW)).astype(np.uint8), np.arange(12) % 3
    network = langid.ByteNetwork.new(["a", "b", "c"], e=2, f=3)

    def loss() -> float:
        return float(-np.log(network.probabilities(windows)[np.arange(12), target]).mean())

    before = loss()
    network.fit(windows, target, steps=60, batch=12)
    assert loss() < 0.5 * before


def test_network_gradient():
    """Every parameter's gradient against differences: embedding, filters, their offsets, output and its offset."""
    rng = np.random.default_rng(4)
    network = langid.ByteNetwork.new(["a", "b", "c"], e=2, f=3)
    network.embedding = network.embedding.astype(float)
    network.filters = [w.astype(float) for w in network.filters]
    network.offsets = [rng.standard_normal(3) * 0.1 for _ in network.offsets]
    network.out, network.out_offset = network.out.astype(float), rng.standard_normal(3)
    windows, target = rng.integers(1, 256, (7, langid.WINDOW)).astype(np.uint8), np.arange(7) % 3
    _, found = network.gradients(windows, target)
    assert len(found) == 2 + 2 * len(langid.WIDTHS) + 1
    for parameter, gradient in found:
        flat, want = parameter.reshape(-1), gradient.reshape(-1)
        places = np.flatnonzero(want)[:40].tolist() + np.flatnonzero(want == 0)[:5].tolist()
        assert np.any(want)
        for i in places:
            at, flat[i] = flat[i], flat[i] + 1e-6
            above, flat[i] = network.gradients(windows, target)[0], at - 1e-6
            below, flat[i] = network.gradients(windows, target)[0], at
            assert abs((above - below) / 2e-6 - want[i]) < 1e-6


@pytest.mark.parametrize("seed", range(5))
def test_network_fits_other_windows(seed):
    rng = np.random.default_rng(seed)
    windows, target = rng.integers(1, 256, (12, langid.WINDOW)).astype(np.uint8), np.arange(12) % 3
    network = langid.ByteNetwork.new(["a", "b", "c"], e=2, f=3)
    before = network.gradients(windows, target)[0]
    network.fit(windows, target, steps=60, batch=12)
    assert network.gradients(windows, target)[0] < 0.5 * before


def test_every_language_is_learned(spark):
    """Over 200 languages, each of one word of its own."""
    rows = [(i, f"w{i % 210:03d} " * 3, f"l{i % 210:03d}") for i in range(840)]
    network = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len(network.languages) == 210


def test_windows_hold_all_bytes():
    data, at = textblocks.utf8(pa.array(["x" * 300, "", "ab"]))
    w, doc, held = langid.windows_of(data, at)
    assert doc.tolist() == [0, 0, 0, 2]
    assert held.tolist() == [128, 128, 44, 2]
    assert bytes(w[3][:3]) == b"ab\0"


# Components and near-duplicates


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(1, None), (5, 5)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    assert got | {x: x for x in parent if x == find(x)} == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    for n in (1, 3, 40, 900, 5000):
        a, b = rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(0, 1 << 63, max(1, n // 9)).astype(np.uint64)
        one, two, both = (setsketch.sketch(x, np.array([0, len(x)])) for x in (a, b, np.concatenate([a, b])))
        assert (setsketch.merge(one, two) == both).all()
        j = len(a) / (len(a) + len(b))
        got = setsketch.joint_jaccard(one, both, np.array([len(a)]), np.array([len(a) + len(b)]))[0]
        assert abs(got - j) < 0.12
        assert abs((one == both).mean() - j) < 0.12


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rng = random.Random(10 + k)
    rows = []
    for g in range(25):
        base = text_of(rng, rng.choice([1, 2, 6, 40, 120])).split()
        for _ in range(rng.choice([1, 2, 6, 25])):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((len(rows), (" " if g % 2 else "\n").join(w).upper() if g % 3 else " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (2, rows[2][1])]
    d = docs(spark, rows).withColumn("rep", F.lit("clash")).withColumn("band", F.lit("x"))
    sets = {}
    for i, x in rows:
        w = (x or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    got = setsketch.near_duplicates(d, k).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == Counter((i, len(sets[i]), find(i), find(i) == i) for i, _ in rows)
    left = setsketch.drop_near_duplicates(d, k)
    assert left.columns == d.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [i for i in ids if find(i) == i]
    assert setsketch.near_duplicates(d.limit(0), k).count() == 0


def test_partners_that_never_lead(spark, monkeypatch):
    """Variants of one text, too far apart to link but for pairs: one turn of leaders is not enough."""
    monkeypatch.setattr(setsketch, "TURNS", 1)
    rng, rows, n = random.Random(31), [], 300
    for g in range(60):
        variant = [f"b{i}" for i in range(n)]
        for p in rng.sample(range(n), 8):
            variant[p] = f"g{g}x{p}"
        for copy in range(2):
            words = list(variant)
            for p in rng.sample(range(n), 15):
                words[p] = f"d{g}x{copy}x{p}"
            rows.append((len(rows), " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in setsketch.near_duplicates(docs(spark, rows), k=1).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}


# Passages


def test_compact_windows():
    rng = np.random.default_rng(4)
    for width in (1, 3, 7):
        values = rng.integers(0, 12, 60).astype(np.uint64)
        of = np.array([0, 25, 25, 60])
        got = set(zip(*(x.tolist() for x in compact_windows.compact_windows(values, of, width)), strict=True))
        want = set()
        for a, b in ((0, 25), (25, 60)):
            for c in range(a, b):
                left = c
                while left > a and values[left - 1] > values[c]:
                    left -= 1
                right = c
                while right < b - 1 and values[right + 1] >= values[c]:
                    right += 1
                if right - left + 1 >= width:
                    want.add((left, c, right))
        assert got == want


def test_repeated_passages(spark):
    rng = random.Random(11)
    shared, own = text_of(rng, 60).split(), lambda n: text_of(rng, n).split()
    edited = list(shared)
    edited[30] = "zzz"
    plan = [own(30) + shared + own(20), own(50), own(10) + shared, shared + own(5), own(40) + edited + own(40), shared[:49] + own(60), own(200)]
    plan.append(plan[-1])
    rows = [(i, " ".join(w)) for i, w in enumerate(plan)] + [(50, None), (51, ""), (None, " ".join(shared))]
    d = docs(spark, rows).withColumn("n_chars", F.length("text").cast("long")).withColumn("span", F.lit("clash"))
    found = {(r["doc_id"], r["start"], r["end"], r["of_doc_id"]) for r in compact_windows.passage_pairs(d).collect()}
    assert {(2, 10, 70, 0), (3, 0, 60, 0), (7, 0, 200, 6)} <= found
    assert {x[0] for x in found} == {2, 3, 4, 7}
    left = compact_windows.drop_repeated_passages(d)
    assert left.columns == d.columns
    texts = {r["doc_id"]: r for r in left.collect()}
    assert set(texts) == {0, 1, 2, 3, 4, 5, 6, 50, 51, None}
    assert texts[2]["text"].split() == plan[2][:10]
    assert texts[2]["n_chars"] == len(texts[2]["text"])
    assert texts[0]["text"] == rows[0][1]
    assert texts[5]["text"] == rows[5][1]
    assert texts[None]["text"] == " ".join(shared)
    assert compact_windows.passage_pairs(d.limit(0)).count() == 0


def test_recall_of_near_duplicate_passages(spark):
    """Of passages planted between strange words, with word edits, those whose shingle sets are 0.8 or more alike are found."""
    rng = random.Random(21)
    fresh = iter(f"u{i}" for i in range(10**6))
    own = lambda n: [next(fresh) for _ in range(n)]
    rows, planted, shingle = [], [], lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    common = own(12)
    for g in range(150):
        base = own(rng.choice([60, 80, 150]))
        other = list(base)
        for p in rng.sample(range(len(base)), rng.randint(0, len(base) // 60 + 1)):
            other[p] = next(fresh)
        # A line that all documents hold makes strangers lead some buckets.
        rows += [(2 * g, own(30) + base + common + own(30)), (2 * g + 1, own(9) + common + own(20) + other + own(25))]
        x, y = shingle(base), shingle(other)
        if len(x & y) >= 0.8 * len(x | y):
            planted.append((2 * g + 1, 9 + 12 + 20, len(other)))
    found = {}
    for r in compact_windows.passage_pairs(docs(spark, [(i, " ".join(w)) for i, w in rows])).collect():
        assert r["of_doc_id"] == r["doc_id"] - 1
        found.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    hit = sum(len(found.get(d, set()) & set(range(a, a + n))) >= 0.8 * n for d, a, n in planted)
    assert len(planted) > 80 and hit >= 0.95 * len(planted)


def test_variant_before_base(spark):
    """The first of three is too far from the third, which repeats the second word for word."""
    rng = random.Random(22)
    fresh = iter(f"u{i}" for i in range(10**6))
    own = lambda n: [next(fresh) for _ in range(n)]
    rows = []
    for g in range(60):
        base = own(60)
        one, two = list(base), list(base)
        one[20], two[40] = next(fresh), next(fresh)
        rows += [(3 * g + i, " ".join(own(15) + w + own(15))) for i, w in enumerate((one, two, two))]
    found = {(r["doc_id"], r["of_doc_id"]) for r in compact_windows.passage_pairs(docs(spark, rows)).collect() if r["end"] - r["start"] >= 58}
    assert sum((3 * g + 2, 3 * g + 1) in found for g in range(60)) >= 57


@pytest.mark.parametrize("families", [60, 250])
def test_families_of_one_template(spark, families):
    """Pairs of variants, whose texts are all made from one template: more strangers share a signature than there are rounds at first."""
    rng = random.Random(3)
    fresh = iter(f"u{i}" for i in range(10**6))
    template = [next(fresh) for _ in range(150)]
    rows = []
    for g in range(families):
        base = list(template)
        for p in rng.sample(range(150), 14):
            base[p] = next(fresh)
        other = list(base)
        for p in rng.sample(range(150), 2):
            other[p] = next(fresh)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    found = {(r["doc_id"], r["of_doc_id"]) for r in compact_windows.passage_pairs(docs(spark, rows)).collect() if r["end"] - r["start"] >= 120}
    assert sum((2 * g + 1, 2 * g) in found for g in range(families)) >= 0.95 * families


@pytest.mark.parametrize("tile", [4, 512])
def test_a_pair_behind_many_strangers(spark, monkeypatch, tile):
    """A signature whose first twelve places are strangers, each of the others and of the one pair behind them."""
    monkeypatch.setattr(compact_windows, "TILE", tile, raising=False)
    rng = random.Random(31)
    rows = [(i, text_of(rng, 80)) for i in range(12)]
    last = text_of(rng, 80)
    rows += [(12, last), (13, last.rsplit(" ", 1)[0] + " other")]
    d = docs(spark, rows)
    # Both functions' spans are the whole text, and all texts meet in one key of each.
    places = spark.createDataFrame([(4 * 7 + f, i, 20 + f, 0, 75) for i, _ in rows for f in (0, 1)], "key long, doc_id long, c int, l int, r int")
    none = spark.createDataFrame([], "doc_id long, start int, end int, of_id long, of_start int, of_end int, similarity double")
    found = compact_windows._rest(places, none, d, 5, 50, 80, 4)
    assert {(r["doc_id"], r["of_id"]) for r in found.collect()} == {(13, 12)}


def test_spans_that_may_be_alike():
    """Spans that hold passages alike enough are never ruled out, strangers are, whether tokens repeat or not."""
    rng = np.random.default_rng(32)
    texts, fresh = [], iter(range(10**6))
    for i in range(60):
        base = [f"w{next(fresh)}" for _ in range(int(rng.integers(60, 400)))] if i % 3 else [f"r{j % int(rng.integers(2, 9))}" for j in range(70)]
        other = list(base)
        for at in rng.integers(0, len(base), len(base) // 60):
            other[at] = f"w{next(fresh)}"
        texts += [" ".join(base), " ".join(other)]
    wanted = [[{"key": 1, "c": 0, "l": 0, "r": len(t.split()) - 5}] for t in texts]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(120)), "text": texts, "wanted": wanted}, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("wanted", pa.list_(pa.struct([("key", pa.int64()), ("c", pa.int32()), ("l", pa.int32()), ("r", pa.int32())])))]))
    rows = pa.Table.from_batches(compact_windows._mark_spans([batch], 5, 46)).to_pydict()
    bits = np.frombuffer(b"".join(rows["bits"]), np.uint64).reshape(120, -1)
    x, y = np.triu_indices(120, 1)
    may = compact_windows.likely_pairs(np.array(rows["n"]), np.array(rows["least"]), bits, x, y, 80)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    assert rows["n"] == [len(s) for s in sets]
    alike = np.array([len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i, j in zip(x, y, strict=True)])
    assert alike.sum() > 20 and may[alike].all() and may.mean() < 0.5


def test_wide_spans_that_may_be_alike():
    """Spans of hundreds of words, which the small map can't tell apart: the wide one rules strangers out, and none that are alike."""
    rng = np.random.default_rng(33)
    texts = []
    for i in range(40):
        base = [f"w{i}x{j}" for j in range(int(rng.integers(90, 500)))]
        other = list(base)
        for at in rng.integers(0, len(base), len(base) // 40):
            other[at] = f"q{i}x{at}"
        texts += [" ".join(base), " ".join(other)]
    wanted = [[{"key": 1, "c": 0, "l": 0, "r": len(t.split()) - 5}] for t in texts]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(80)), "text": texts, "wanted": wanted}, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("wanted", pa.list_(pa.struct([("key", pa.int64()), ("c", pa.int32()), ("l", pa.int32()), ("r", pa.int32())])))]))
    rows = pa.Table.from_batches(compact_windows._mark_spans([batch], 5, 46))
    x, y = np.triu_indices(80, 1)
    may = compact_windows.likely_wide_pairs(rows["n"].to_numpy(), rows["least"].to_numpy(), rows["slots"], x, y, 80)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    alike = np.array([len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i, j in zip(x, y, strict=True)])
    assert alike.sum() > 10 and may[alike].all() and may.mean() < 0.02


def test_words_that_repeat_on_end():
    """Both sides repeat one word, or one phrase in another phase; their sets are equal, so they are passages, and a shorter one isn't."""
    word, phrase = np.full(57, 7, np.uint64), np.tile(np.arange(30, dtype=np.uint64), 5)
    assert [x[:2] + x[4:] for x in compact_windows.verify_region(word, np.full(563, 7, np.uint64), 5, 50, 80)] == [(0, 57, 1.0)]
    assert [x[:2] + x[4:] for x in compact_windows.verify_region(phrase[:50], phrase[13:63], 5, 50, 80)] == [(0, 50, 1.0)]
    assert compact_windows.verify_region(word, word[:45], 5, 50, 80) == []


def test_fewest_distinct_in_windows():
    rng = np.random.default_rng(34)
    values, last = rng.integers(0, 9, 200).tolist(), {}
    before = np.full(200, -1)
    for i, x in enumerate(values):
        before[i], last[x] = last.get(x, -1), i
    for width in (1, 3, 10, 46):
        got = compact_windows._distinct_in_windows(before, width)[: 200 - width + 1]
        assert got.tolist() == [len(set(values[p : p + width])) for p in range(200 - width + 1)]


def test_places_left_out_lie_in_kept_ones():
    """Every span lies in a kept one of its function and value, whose centre is at most _SLACK tokens away."""
    rng = random.Random(35)
    texts = [" ".join(rng.choice("abc") for _ in range(150)) for _ in range(40)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": texts})
    (rows,) = list(compact_windows._windows([batch], 12, 2, 4))
    kept = {}
    for key, doc, c, left, right in zip(*(rows.column(n).to_pylist() for n in ("key", "doc_id", "c", "l", "r")), strict=True):
        kept.setdefault((doc, key), []).append((c, left, right))
    for doc, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        tokens, of = textblocks.shingles(*textblocks.word_hashes(data, np.array([0, len(data)])), 2)
        for i in range(4):
            values = textblocks.mix(tokens ^ textblocks.mix(np.array([i + 1], np.uint64)))
            key = textblocks.mix(values + np.uint64(i)).view(np.int64)
            key = key - key % 4 + i
            for left, c, right in zip(*(x.tolist() for x in compact_windows.compact_windows(values, of, 11)), strict=True):
                assert any(0 <= c - at < compact_windows._SLACK and a <= left and b >= right for at, a, b in kept[(doc, int(key[c]))])


def test_long_texts(spark):
    """Beyond 65 535 tokens and one block: a passage at the end of one long text that another begins with."""
    words = [f"w{i}" for i in range(90_000)]
    found = compact_windows.passage_pairs(docs(spark, [(1, " ".join(words)), (2, " ".join(words[-300:] + ["z"] * 20))])).collect()
    covered = set().union(*[range(r["start"], r["end"]) for r in found if r["doc_id"] == 2])
    assert covered == set(range(300))


def test_crashes_of_old(spark):
    """A doc_id with several texts and a null one, clashing columns, one word on end."""
    rng = random.Random(23)
    passage = text_of(rng, 60)
    rows = [(1, passage), (2, passage + " " + text_of(rng, 9)), (2, None), (2, "short"), (2, passage + " " + text_of(rng, 9)), (3, "for " * 900), (4, passage), (4, passage)]
    d = docs(spark, rows)
    for clash in ("_passages", "ranges", "text_hash", "doc", "_hash", "wanted"):
        d = d.withColumn(clash, F.lit("kept"))
    left = compact_windows.drop_repeated_passages(d)
    assert left.columns == d.columns
    got = left.collect()
    assert {(r["_passages"], r["ranges"]) for r in got} == {("kept", "kept")}
    texts = Counter((r["doc_id"], r["text"]) for r in got)
    assert texts[(1, passage)] == 1 and texts[(2, None)] == 1 and texts[(2, "short")] == 1 and not any(i == 4 for i, _ in texts)
    assert all(len(x.split()) < 300 for i, x in texts if i == 3)


def test_repeats_within_a_document(spark):
    rng = random.Random(12)
    passage = text_of(rng, 70)
    d = docs(spark, [(1, f"{passage} {text_of(rng, 80)} {passage}")])
    found = compact_windows.passage_pairs(d).collect()
    assert {(r["start"], r["end"], r["of_doc_id"]) for r in found} == {(150, 220, 1)}
    assert compact_windows.drop_repeated_passages(d).first()["text"].split() == d.first()["text"].split()[:150]


# HTML


def test_html_lines():
    page = "<html><head><title>T</title></head><body><nav><a>menu</a></nav><header>top</header><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one<b> two<br><p>three <i>4</i>\n5<script>x</script></p><div id=comments>no</div></article><aside>s</aside><footer>f</footer>"
    lines = html_diff.lines_of(page)
    assert html_diff.main_text(lines, None) == "A & B\none two\nthree 4 5"
    assert html_diff.lines_of(None) == []
    assert html_diff.main_text(html_diff.lines_of("plain <b>text"), None) == "plain text"


def test_html_attributes():
    page = '<p title="5" tall">Hello world</p><p class="x">b</p><p title=\'a>b\' data-x="<i>">c</p>'
    assert html_diff.main_text(html_diff.lines_of(page), None) == "Hello world\nb\nc"
    # An article is main text whatever its own classes, and inside a page-wide form.
    for open_, close in (('<article class="post related-x">', "</article>"), ('<form class="widget"><main>', "</main></form>")):
        assert html_diff.main_text(html_diff.lines_of(f"<div>menu</div>{open_}<p>text</p><div class=share>no</div>{close}"), None) == "text"
    assert html_diff.lines_of("<div hidden><article>no</article></div>") == [html_diff.Line("no", False, True)]


@pytest.mark.parametrize("row_bits", [1 << 28, 40])
def test_common_lines(monkeypatch, row_bits):
    monkeypatch.setattr(html_diff, "_ROW_BITS", row_bits)
    assert html_diff.common_lines(list("abcbd"), list("bcdb")) in ({1, 2, 4}, {1, 2, 3})
    assert html_diff.common_lines([], ["a"]) == set()
    rng = random.Random(14)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                length[i + 1][j + 1] = length[i][j] + 1 if x == y else max(length[i][j + 1], length[i + 1][j])
        got = [a[i] for i in sorted(html_diff.common_lines(a, b))]
        rest = iter(b)
        assert len(got) == length[-1][-1] and all(x in rest for x in got)


def test_many_equal_lines():
    a, b = ["x"] * 20_000 + ["a"], ["y"] + ["x"] * 19_000 + ["b", "x"]
    assert len(html_diff.common_lines(a, b)) == 19_001


def test_page_differencing(spark):
    page = lambda x: f"<div>Site</div><p>{x}</p><p>Same line</p>"
    rows = [(1, "http://a.example/x/1", page("first")), (2, "http://a.example/x/2", page("second")), (3, "http://b.example/x/2", page("third")), (4, None, None), (5, "http://a.example/y", ""), (6, "http://c.example/1", page("z")), (7, "http://c.example/1", page("z"))]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("_host", F.lit("clash"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_diff.extract_main_text(d).collect()}
    assert got[1] == ("first", 5)
    assert got[2] == ("second", 6)
    assert got[3][0] == "Site\nthird\nSame line"
    assert got[4] == got[5] == ("", 0)
    assert got[6] == got[7] == ("Site\nz\nSame line", 16)
    assert html_diff.extract_main_text(d.limit(0)).count() == 0


def test_neighbours_in_a_large_host(spark):
    """Pages of one section share a line with each other only; the nearest URL is found whatever the host's size and the ranges."""
    page = lambda i: f"<div>Section {i // 2}</div><p>own {i}</p>"
    rows = [(i, f"http://a.example/s{i // 2:04d}/{i}", page(i)) for i in range(1400)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    for partitions in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {r["page_id"]: r["text"] for r in html_diff.extract_main_text(d).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert got == {i: f"own {i}" for i, _, _ in rows}


def test_names_inside_an_article():
    page = "<div class='share-price'>menu</div><article><div class='share-price'><p>Shares rose</p></div><div class='share-buttons ad'>x</div><div class='price related'>y</div></article>"
    assert html_diff.main_text(html_diff.lines_of(page), None) == "Shares rose"


def test_copies_are_no_partners(spark):
    """A page's text is the same however often it and its neighbours are repeated, in whatever ranges its copies lie."""
    page = lambda x: f"<div>Home</div><div>Shop</div><p>{x}</p>"
    rng = random.Random(21)
    one = [(f"http://{h}.example/{p}", page(f"{h} {p} {v}")) for h in "ab" for p in ("x", "x/1", "x/2", "y") for v in range(rng.randint(1, 2))]
    rows = [(i, *row) for i, row in enumerate(row for row in one for _ in range(rng.choice((1, 2, 40))))] + [(999, *one[0]), (999, *one[0]), (None, *one[0])]
    rng.shuffle(rows)
    want = {(u, x): x.split("<p>")[1].split("</p>")[0] for u, x in one}
    html_of = {i: x for i, _, x in rows}
    for partitions in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got = [(r["page_id"], r["url"], r["text"]) for r in html_diff.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sorted(got, key=str) == sorted(((i, u, want[u, html_of[i]]) for i, u, _ in rows), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_neighbours_of_ranges(seed):
    """Each range gets the nearest pages of another run than its first and last one."""
    rng = random.Random(seed)
    for _ in range(200):
        keys = sorted(f"{rng.randint(0, 4)}/{i:03d}" for i in range(rng.randint(1, 30)))
        bounds = sorted(rng.sample(keys, min(len(keys), 6)))
        ranges: dict[int, list[str]] = {}
        for k in keys:
            ranges.setdefault(sum(k >= b for b in bounds), []).append(k)
        run = lambda k: k[0]
        ends = [(n, run(r[0]), run(r[-1]), max((k for k in r if run(k) != run(r[-1])), default=None), min((k for k in r if run(k) != run(r[0])), default=None), r[0], r[-1]) for n, r in ranges.items()]
        got: dict[int, set[str]] = {}
        for key, n in html_diff._beside(ends):
            got.setdefault(n, set()).add(run(key))
        for n, r in ranges.items():
            before = [run(k) for k in keys if k < r[0] and run(k) != run(r[0])][-1:]
            after = [run(k) for k in keys if k > r[-1] and run(k) != run(r[-1])][:1]
            assert got.get(n, set()) == set(before + after)
