"""Byte-level BPE encoding and decoding over a compiled lexicon of frequent words.

The corpus's most frequent words (over all documents) are encoded once on the
driver and compiled into a minimal acyclic transducer, which workers map into
memory. A word that it lacks is merged exactly, by the tokenizer's own ranks.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Callable, Iterator
from hashlib import sha256
from uuid import uuid4

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollgrid.llm.common import checkpointed, once, ship_code
from rollgrid.llm.lexicon import Lexicon, compile_lexicon, mapped
from rollgrid.llm.topk import kth_largest

#: The public pattern by which byte-level BPE parts a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words of the lexicon, and words whose ids a worker remembers at a time.
LEXICON_WORDS = 32_768
#: Occurrences that make a word frequent, at least.
AT_LEAST = 4
MEMORY = 150_000
#: Ids that are decoded at a time, and characters that are parted into words at a time.
CHUNK, SECTION = 1 << 16, 1 << 20
#: Where a text can be cut: no special token of a ByteBpe holds a blank.
BETWEEN = regex.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, to its byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE tokenizer from its definition in the tokenizers library's JSON."""

    def __init__(self, definition: str) -> None:
        told = json.loads(definition)
        pre, model = told["pre_tokenizer"], told["model"]
        if told["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["type"] != "BPE":
            raise ValueError("not a plain byte-level BPE tokenizer")
        other = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        other += [t["content"] for t in told["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"]]
        if other or (told["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError(f"not supported in a byte-level BPE tokenizer: {other or told['decoder']}")
        letters = byte_letters()

        def to_bytes(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        self.definition = definition
        self.vocabulary = {to_bytes(t): i for t, i in model["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(to_bytes(a), to_bytes(b)): rank for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        if any(" " in t for t in self.special):
            raise ValueError("special tokens with blanks are not supported")
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        size = max([*self.vocabulary.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for token, i in self.vocabulary.items():
            self.pieces[i] = token
        for token, i in self.special.items():
            self.pieces[i] = token.encode("utf-8")
        self.pattern = regex.compile(PATTERN)

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word: the pair of least rank is merged, leftmost first, until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks, far = self.ranks, len(self.ranks)
        if len(parts) > 256:
            return self._merge_long(parts)
        while len(parts) > 1:
            best = min(zip(map(ranks.get, zip(parts, parts[1:]), [far] * len(parts)), range(len(parts))))
            if best[0] == far:
                break
            pair = (parts[best[1]], parts[best[1] + 1])
            whole, out, i, n = pair[0] + pair[1], [], 0, len(parts)
            while i < n:
                if i < n - 1 and parts[i] == pair[0] and parts[i + 1] == pair[1]:
                    out.append(whole)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.vocabulary[p] for p in parts]

    def merger(self) -> Callable[[str], list[int]]:
        """Merges a word as merge() does, in native code where the ids follow the ranks."""
        made = [self.vocabulary[a + b] for a, b in self.ranks]
        if made != sorted(made) or max(self.vocabulary[x] for x in self.vocabulary if len(x) == 1) > made[0]:
            return lambda word: self.merge(word.encode("utf-8"))
        import tiktoken

        return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=self.vocabulary, special_tokens={}).encode_ordinary

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """The same with a heap over a linked list: n log n for words without end."""
        from heapq import heapify, heappop, heappush

        n, ranks = len(parts), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        alive = [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = a + b, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := ranks.get((parts[x], parts[y]))) is not None:
                    heappush(heap, (r, x, parts[x], parts[y]))
        return [self.vocabulary[p] for p, live in zip(parts, alive) if live]


class UnsureError(Exception):
    """A word has a letter of a newer Unicode version."""


def sections(text: str, size: int = SECTION) -> Iterator[str]:
    """A text in parts of about size characters, so that few words are held at a time.

    Cut before a blank between two others that are none: no word holds both sides. A word
    without end stays whole.
    """
    at = 0
    while len(text) - at > size and (cut := BETWEEN.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Encodes and decodes whole texts; words come from the lexicon or are merged."""

    def __init__(self, definition: str, lexicon: Lexicon) -> None:
        self.bpe = bpe = ByteBpe(definition)
        self.lexicon = lexicon
        outer = self

        class Remembered(dict):
            def __missing__(self, word: str) -> bytes:
                if not (word.isascii() or outer.unsure.isdisjoint(word)):
                    raise UnsureError
                packed = outer.word(word)
                if len(word) <= 64:
                    if len(self) >= MEMORY:
                        self.clear()
                    self[word] = packed
                return packed

        self.known = Remembered()
        self.merge = bpe.merger()
        self.find = bpe.pattern.findall
        self.unsure = _newer_letters()
        self.library = None

    def word(self, word: str) -> bytes:
        raw = word.encode("utf-8")
        found = self.lexicon.get(raw)
        return bytes(found) if found is not None else pack(self.merge(word))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        try:
            return self._encode(text)
        except UnsureError:
            return self._by_library(text)

    def _encode(self, text: str) -> bytes:
        return b"".join(map(self._encode_section, sections(text)))

    def _encode_section(self, text: str) -> bytes:
        if self.bpe.special_pattern is None or not any(s in text for s in self.bpe.special):
            return b"".join(map(self.known.__getitem__, self.find(text)))
        out = []
        for part in self.bpe.special_pattern.split(text):
            if part in self.bpe.special:
                out.append(self.bpe.special[part].to_bytes(4, "little"))
            else:
                out.append(b"".join(map(self.known.__getitem__, self.find(part))))
        return b"".join(out)

    def _by_library(self, text: str) -> bytes:
        """For letters of newer Unicode versions, which the library may class in another way."""
        from tokenizers import Tokenizer

        if self.library is None:
            self.library = Tokenizer.from_str(self.bpe.definition)
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, dtype="<u4")
        piece = self.bpe.pieces.__getitem__
        raw = b"".join(b"".join(map(piece, ids[i : i + CHUNK].tolist())) for i in range(0, len(ids), CHUNK))
        return raw.decode("utf-8", "replace")


def _newer_letters() -> frozenset[str]:
    """Characters that the regex module knows as letters or numbers and Python doesn't yet."""
    known = regex.compile(r"[\p{L}\p{N}]")
    return frozenset(c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) == "Cn" and known.match(c))


def frequent_words(docs: DataFrame, n: int = LEXICON_WORDS, at_least: int = AT_LEAST) -> list[str]:
    """The n most frequent words of all texts, with a leading blank if they have one.

    Words of fewer than at_least occurrences are not frequent; words that tie for
    the last places are left out, so no more than n rows ever reach the driver.
    """
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r" ?\p{L}+"), F.lit(0))).alias("word"))
    counts = checkpointed(words.groupBy("word").count().where(F.col("count") >= at_least))
    least = kth_largest(counts, "count", n)
    held = counts.where(F.col("count") >= F.lit(least))
    if held.count() > n:
        held = counts.where(F.col("count") > F.lit(least))
    return [r["word"] for r in held.orderBy(F.desc("count"), "word").collect()]  # at most n rows


def build_lexicon(docs: DataFrame, definition: str, n: int = LEXICON_WORDS) -> bytes:
    bpe = ByteBpe(definition)
    return compile_lexicon({w: bpe.merge(w.encode("utf-8")) for w in frequent_words(docs, n)})


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_sha256", pa.string()), ("decoded", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(docs: DataFrame, tokenizer_path: str, outputs: tuple[str, ...] = ("ids",), lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens and the outputs, for each row of docs (doc_id, text).

    outputs: any of ids (little-endian unsigned 32-bit integers), ids_sha256,
    decoded (the ids decoded again) and decoded_sha256. A null text counts as
    empty; repeated rows each return; an empty table gives none. A very long text is
    encoded whole, its words a section at a time. Words that tie for the lexicon's
    last places are merged when met. Other columns are not read.
    What is broadcast has a fixed bound: the tokenizer's file and lexicon_words words.
    """
    spark = docs.sparkSession
    ship_code(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        text = file.read()
    definition = spark.sparkContext.broadcast(text)
    compiled = spark.sparkContext.broadcast(build_lexicon(docs, text, lexicon_words))
    key = f"encoder {uuid4()}"
    wanted = ["doc_id", "n_tokens", *outputs]
    schema = pa.schema([_SCHEMA.field(c) for c in wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(key, lambda: Encoder(definition.value, mapped(compiled.value)))
        for batch in batches:
            columns: dict[str, list] = {c: [] for c in wanted}
            columns["doc_id"] = batch.column("doc_id")
            for x in batch.column("text"):
                ids = encoder.encode(x.as_py())
                columns["n_tokens"].append(len(ids) // 4)
                if "ids" in columns:
                    columns["ids"].append(ids)
                if "ids_sha256" in columns:
                    columns["ids_sha256"].append(sha256(ids).hexdigest())
                if "decoded" in columns or "decoded_sha256" in columns:
                    decoded = encoder.decode(ids)
                    if "decoded" in columns:
                        columns["decoded"].append(decoded)
                    if "decoded_sha256" in columns:
                        columns["decoded_sha256"].append(sha256(decoded.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(k).type) for k, c in columns.items()], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = {"ids": "binary"}
    return rows.mapInArrow(run, ", ".join(["doc_id long", "n_tokens long", *(f"{c} {kinds.get(c, 'string')}" for c in outputs)]))
