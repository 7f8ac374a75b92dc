"""Byte-pair encoding by forced boundaries, and decoding.

Two neighbouring symbols that stand side by side in no token of a vocabulary can't be merged over, whatever the ranks of the
merges are: a token that spans both would hold the pair. Such a pair is a certain cut. Each word is cut at all of them, the
fragments are encoded independently (lowest rank first, leftmost among equals) and their ids are concatenated. A symbol is a
byte; with a vocabulary that marks word ends, a word's last byte is a symbol of its own.

Texts never meet, so a corpus is encoded without a shuffle; each worker remembers a bounded number of words and fragments.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import text_batches

#: A worker remembers at most so many results for strings of at most so many characters.
REMEMBERED, REMEMBERED_CHARS = 1 << 18, 48
#: Fragments of more symbols are merged with a heap.
SHORT = 24
#: Characters that Python splits words at and the tokenizers' \s doesn't match.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: White space of Unicode.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of characters for which NFC is the identity, lower-casing is one to one and letters and digits are as old as Unicode: Latin.
LATIN = re.compile("[!-~\xa1-\u012f\u0131-\u017f]*")
LATIN_LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
LATIN_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"


class Remember(dict):
    """The results of a function of short strings: at most `most`, in two generations.

    When the younger one is full it becomes the older one, whose place it takes; what is asked for again moves back, so that frequent
    strings stay.
    """

    def __init__(self, function: Callable, most: int = REMEMBERED) -> None:
        super().__init__()
        self.function, self.most, self.older = function, most, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        self.store(key, value)
        return value

    def store(self, key: str, value: object) -> None:
        if len(key) <= REMEMBERED_CHARS:
            if 2 * len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, the rest from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class ForcedBpe:
    """Merges of a byte-level vocabulary, with the table of symbol pairs that some token holds.

    tokens: id -> token in byte letters; merges: pairs of tokens, most urgent first; end: what a word's last token ends in, "" if nothing.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str = "") -> None:
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        self.first = [vocabulary.get(letter) for letter in byte]
        self.last = [vocabulary.get(letter + end) for letter in byte]
        if None in self.first or None in self.last:
            raise ValueError("a vocabulary has to hold every byte, within words and at their end")
        #: pair of ids -> rank, and rank -> id of what the pair becomes
        self.rank = {(vocabulary[a], vocabulary[b]): rank for rank, (a, b) in enumerate(merges)}
        self.made = [vocabulary[a + b] for a, b in merges]
        #: held[512 * x + y]: some token has byte x just before symbol y; y is 256 more for a byte that ends a word.
        self.held = bytearray(256 * 512)
        for token in vocabulary:
            ends = bool(end) and token.endswith(end)
            symbols = [byte.get(c) for c in (token[: -len(end)] if ends else token)]
            if None in symbols:
                continue
            if ends and symbols:
                symbols[-1] += 256
            for x, y in zip(symbols, symbols[1:], strict=False):
                self.held[512 * x + y] = 1
        self.ends = bool(end)
        self.fragment = Remember(self._fragment, 1 << 16)
        self.word = Remember(self.encode_word)

    def cuts(self, word: bytes) -> list[int]:
        """Positions of word before which a token has to begin: its start, every forced boundary and its length."""
        held, to = self.held, len(word)
        inner = [i for i, (x, y) in enumerate(zip(word, word[1:], strict=False), 1) if not held[x << 9 | y]]
        if self.ends and to > 1:
            # The last byte is another symbol.
            if inner and inner[-1] == to - 1:
                inner.pop()
            if not held[word[-2] << 9 | 256 | word[-1]]:
                inner.append(to - 1)
        return [0, *inner, to]

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The ids of a word that the splitter hands over in one piece."""
        if not word:
            return ()
        at = self.cuts(word)
        if len(at) == 2:
            return self._fragment((word, True))
        # A fragment inside a word and one that ends it are different strings of symbols.
        pieces = [self.fragment[word[a:b], b == len(word)] for a, b in zip(at, at[1:], strict=False)]
        return tuple(chain.from_iterable(pieces))

    def _fragment(self, key: tuple[bytes, bool]) -> tuple[int, ...]:
        fragment, ends_word = key
        ids = [self.first[b] for b in fragment]
        if ends_word:
            ids[-1] = self.last[fragment[-1]]
        return tuple(self._merge_few(ids) if len(ids) <= SHORT else self._merge_many(ids))

    def _merge_few(self, ids: list[int]) -> list[int]:
        rank, made, none = self.rank.get, self.made, len(self.made)
        found = [rank(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while found and (best := min(found)) < none:
            i = found.index(best)
            ids[i] = made[best]
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = rank((ids[i], ids[i + 1]), none)
        return ids

    def _merge_many(self, ids: list[int]) -> list[int]:
        """The same with a heap of (rank, place) over a linked list: n log n."""
        rank, n = self.rank.get, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank((ids[i], ids[j])) != best:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = self.made[best], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (r := rank((ids[a], ids[after[a]]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [x for x in ids if x >= 0]


class WordTokenizer:
    """A vocabulary file in the tokenizers library's format whose splitter drops white space, so that texts are encoded chunk by chunk.

    Special tokens are found in the raw text first, as the library does. The library's own normaliser and splitter say what the words of
    a chunk are, except for Latin chunks, where a pattern does; all merging is ForcedBpe's.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.bpe = ForcedBpe(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.normalise, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.byte = {letter: b for b, letter in enumerate(byte_letters())}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        by_length = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None
        size = 1 + max(chain(model["vocab"].values(), self.special.values()))
        tokens = [""] * size
        for token, i in chain(model["vocab"].items(), self.special.items()):
            tokens[i] = token
        #: id -> token as it is written when decoded
        self.tokens = pa.array(tokens, pa.large_string())
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        for name, chars in (("\\p{L}", LATIN_LETTER), ("\\p{N}", LATIN_DIGIT), ("\\s", WHITE)):
            pattern = pattern.replace(f"[{name}]", f"[{chars}]").replace(name, chars)
        self.latin_words = re.compile(pattern).findall
        self.chunk = Remember(self._chunk, 2 * REMEMBERED)

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """The ids of a string without white space and special tokens."""
        if LATIN.fullmatch(chunk):
            words = [w.encode() for w in self.latin_words(chunk.lower())]
        else:
            byte = self.byte
            words = [bytes([byte[c] for c in w]) for w, _ in self.split(self.normalise(chunk))]
        word = self.bpe.word
        return word[words[0]] if len(words) == 1 else tuple(chain.from_iterable([word[w] for w in words]))

    def _plain(self, text: str) -> Iterator[tuple[int, ...]]:
        chunks = re.findall(f"[^{WHITE}]+", text) if SEPARATORS.search(text) else text.split()
        return map(self.chunk.__getitem__, chunks)

    def encode(self, text: str) -> Iterator[tuple[int, ...]]:
        """The ids of a text, a tuple for each chunk of it."""
        if not self.marks or not self.marks.search(text):
            return self._plain(text)
        parts = self.marks.split(text)
        return chain.from_iterable(((self.special[x],),) if i % 2 else self._plain(x) for i, x in enumerate(parts))

    def decode(self, ids: pa.Array) -> pa.Array:
        """A text for each list of ids: its tokens joined by one space, as a vocabulary without a decoder writes them."""
        joined = pc.binary_join(pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), self.tokens.take(ids.values)), pa.scalar(" ", pa.large_string()))
        return joined.fill_null("")


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker and path."""
    return WordTokenizer(path)


def encode_texts(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>[, decoded string]) for each row of docs, encoded with the vocabulary file at path.

    A null or empty text, or one of white space alone, has no ids and decodes to "". Rows stay one for one, repeated and null doc_ids
    included; other columns of docs, whatever their names, aren't read. Texts of any length are encoded whole.
    """
    text_batches(docs.sparkSession)
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        for batch in batches:
            flat, ends = array("i"), [0]
            for text in batch.column("text"):
                value = text.as_py()
                if value:
                    flat.extend(chain.from_iterable(tokenizer.encode(value)))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
            columns = [batch.column("doc_id"), ids]
            if decoded:
                columns.append(tokenizer.decode(ids).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    if decoded:
        fields.append(T.StructField("decoded", T.StringType()))
    return docs.select("doc_id", "text").mapInArrow(scan, T.StructType(fields))


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids array<int>) with decoded: the tokens of each row's ids joined by one space; null or empty ids give ""."""
    text_batches(encoded.sparkSession)
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        for batch in batches:
            ids = batch.column("ids")
            whole = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(ids))]), pa.int32()), pc.list_flatten(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, tokenizer.decode(whole).cast(pa.string())], names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(scan, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def encoding_report(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs: digests of what encode_texts returns."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encode_texts(docs, path, decoded=True).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
