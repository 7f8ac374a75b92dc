"""BPE by forced boundaries, tokenizer alignment and periodic runs against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from offerlake.llm import align, bpe, runs
from offerlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS, A, B = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = (
    "<|endoftext|> <|startoftext|> <s> </s> <unk> <0x41> 's 'S 'sam ’s \xc0\xc9 é ́x İ ı Σς ﬁ ｶﾞ \x1c \x1f a\x1db \x85 \xa0 日本語 "
    "๑๒ 12 \xbd \xb2\xb3 ... --- \U0001f642\U0001f44d\U0001f3fd कि å Å Ω ǅ ŉ \xdf ẞ ​ ᠎ ﻿ ｅ ９ \x00 \x7f \xad ▁ ▁a \r ) { ; aaa ==== 　 Hello World"
).split(" ")


def odd_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) + rnd.choice(["", " ", "\n", "  ", "\t", "    ", "\r\n", "\n\n "]) for _ in range(rnd.randrange(14))) for _ in range(n)]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


CASES = [None, "", " ", "  \n ", "a", "the cat's 12 hats", "a" * 30_000, "qz" * 5_000, "日本" * 3_000, "x " * 20_000, " " * 3_000, "==== " * 200, *odd_texts(400, 5)]


def table(spark, texts, ids=None, **more):
    rows = [(i if ids is None else ids[i], t, 1, "x", 2.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string, key double")


def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def plain_encoding(text):
    t = plain_encoding.__dict__.setdefault("t", Tokenizer.from_file(WORDS))
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_encoding_equals_the_library(spark):
    """Nulls, empty, long, odd and repeated texts; columns of clashing names."""
    ids = [None, 7, 7, *range(3, len(CASES))]
    got = bpe.encode_texts(table(spark, CASES, ids), WORDS, decoded=True).collect()
    assert len(got) == len(CASES)
    assert [r["doc_id"] for r in got] == ids
    for r, text in zip(got, CASES, strict=True):
        assert (r["ids"], r["decoded"]) == plain_encoding(text), text
    again = bpe.decode_ids(spark.createDataFrame([(1, None), (2, []), (3, got[5]["ids"])], "doc_id int, ids array<int>"), WORDS).orderBy("doc_id").collect()
    assert [r["decoded"] for r in again] == ["", "", got[5]["decoded"]]


def test_op11_equals_the_library_on_the_whole_table(spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_bpe"](spark, SF).collect()}
    want = documents(spark)
    assert got.keys() == want.keys()
    for d, text in want.items():
        ids, decoded = plain_encoding(text)
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))


def test_fragments_are_independent():
    """Cuts are where no token holds both sides; a word's ids are those of its fragments; long fragments merge as short ones."""
    t = bpe.word_tokenizer(WORDS)
    word = "qzxjkthemqvq".encode()
    at = t.bpe.cuts(word)
    assert at[0] == 0 and at[-1] == len(word) and len(at) > 2
    tokens = [x.as_py() for x in t.tokens]
    for i in at[1:-1]:
        pair = word[i - 1 : i + 1].decode()
        inner = [x[:-5] if x.endswith("</w>") else x for x in tokens]  # without the symbol that ends a word
        assert not any(pair in x for x in inner) if i + 1 < len(word) else pair + "</w>" not in {x[-6:] for x in tokens}
    rnd = random.Random(2)
    for _ in range(300):
        ids = [t.bpe.first[rnd.choice(b"theandingou")] for _ in range(rnd.randrange(1, 60))]
        assert t.bpe._merge_few(list(ids)) == t.bpe._merge_many(list(ids))


def test_memory_of_a_worker_is_bounded():
    seen = bpe.Remember(len, most=3)
    assert [seen["a" * n] for n in (1, 2, 3, 4, 5)] == [1, 2, 3, 4, 5]
    assert len(seen) <= 3
    assert seen["x" * 1000] == 1000 and "x" * 1000 not in seen


def plain_alignment(texts):
    """The report by sets and loops."""
    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    letters = {c: i for i, c in enumerate(bpe.byte_letters())}
    vocabulary = {i: bytes(letters[c] for c in t) for t, i in ta.get_vocab().items() if all(c in letters for c in t)}
    piece = lambda i: bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode()
    rows, held = [], Counter()
    for text in texts:
        data = (" " + (text or "")).encode()
        a = ta.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tb.encode(text) if text else []
        if b"".join(vocabulary[x] for x in a) != data or b"".join(piece(x) for x in b) != data:
            rows.append([])
            continue
        groups, i, j, at_a, at_b, ids_a, ids_b = [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                ids_a.append(a[i])
                at_a += len(vocabulary[a[i]])
                i += 1
            else:
                ids_b.append(b[j])
                at_b += len(piece(b[j]))
                j += 1
            if at_a == at_b:
                groups.append((ids_a, ids_b))
                ids_a, ids_b = [], []
        rows.append(groups)
        held.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for groups in rows:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), sha(text) if groups else ""))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("frequent", [align.FREQUENT_PAIRS, 40])
def test_alignment_equals_plain_version(spark, frequent):
    """Pairs looked up in place, and nearly all pairs joined by shuffle."""
    texts = [*CASES, "a b a b", "a b a b"]
    got = align.alignment_report(table(spark, texts), A, B, frequent=frequent).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == plain_alignment(texts)


def test_alignment_of_nothing(spark):
    assert align.alignment_report(table(spark, []), A, B).count() == 0
    got = align.alignment_report(table(spark, [None, ""], [None, 3]), A, B).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_op12_equals_plain_version_on_the_whole_table(spark):
    docs = documents(spark)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_tokenizer_alignment"](spark, SF).collect()}
    assert got == dict(zip(docs, plain_alignment(docs.values()), strict=True))


def test_owners_give_overlaps_and_large_groups():
    a, b = np.array([2, 3, 1]), np.array([1, 4, 1])
    assert [x.tolist() for x in align.groups_of(a, b)] == [[0, 2, 3], [0, 2, 3]]
    assert list(zip(*(x.tolist() for x in align.overlaps_of(a, b)), strict=True)) == [(0, 0), (0, 1), (1, 1), (2, 2)]
    ids = np.arange(200, dtype=np.int32) % 3
    keys, times, of = align.linked_pairs(ids, ids + 5, np.array([0, 200]), np.array([0, 200]), np.array([0]), 1)
    assert len(keys) == 9 and times.sum() == 200 * 200 and of.tolist() == [0, 9]


def plain_runs(w):
    out, n = set(), len(w)
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            s, e = i, j + p
            if e - s >= max(6, 4 * p) and not any(all(w[k] == w[k + q] for k in range(s, e - q)) for q in range(1, p)):
                out.add((s, e - s, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rnd):
    w = []
    while len(w) < rnd.randrange(1, 150):
        if rnd.randrange(3) == 0:
            w += [rnd.randrange(3) for _ in range(rnd.randrange(1, 8))]
        else:
            unit = [rnd.randrange(rnd.choice([1, 2, 3, 50])) for _ in range(rnd.randrange(1, 16))]
            w += (unit * 8)[: rnd.randrange(1, 6 * len(unit))]
    return w


def test_runs_equal_plain_version():
    rnd = random.Random(3)
    for _ in range(1500):
        w = random_words(rnd)
        assert runs.find_runs(np.array(w, np.int32)) == plain_runs(w), w


def plain_report(words):
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r[1] * 10**9 // r[2], r[0], r[2])) if found else None
    kept = [x for i, x in enumerate(words) if not any(s + p <= i < s + n for s, n, p in found)]
    return (len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(kept)))


REPORT = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_run_report_equals_plain_version(spark):
    """Nulls, white space, ties, repeats, long texts and columns of clashing names."""
    rnd = random.Random(8)
    texts = [None, "", " \t\n", "a", "a " * 6, "a b " * 4 + "x " + "b a " * 4, "A a " * 9, "a b\x0bc " * 5, "x\xa0y " * 7, *(" ".join(f"w{x}" for x in random_words(rnd)) for _ in range(60))]
    rows = [(i, t, 5, "r") for i, t in enumerate(texts)] + [(None, texts[4], 5, "r"), (3, texts[4], 5, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string")
    got = runs.run_report(docs).collect()
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    for r, (_, text, *_) in zip(got, rows, strict=True):
        assert tuple(r[c] for c in REPORT) == plain_report(runs.WORD.findall(text or "")), text
    assert runs.run_report(docs.limit(0)).count() == 0
    long = runs.periodic_runs(spark.createDataFrame([(1, "a b c " * 200_000)], "doc_id int, text string")).first()
    assert [tuple(x) for x in long["runs"]] == [(0, 600_000, 3)] and long["collapsed"] == "a b c"


def test_op13_on_the_whole_table(spark):
    got = {r["doc_id"]: tuple(r[c] for c in REPORT) for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    docs = documents(spark)
    assert got.keys() == docs.keys()
    changed = 0
    for d, text in docs.items():
        w, h = runs.WORD.findall(text), zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            changed += 1
        if len(w) < 1200:
            assert got[d] == plain_report(w)
    assert changed > 5
