import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from rollgrid.llm import bpe, lexicon, token_counts
from rollgrid.llm.catalog import BYTE_BPE, WORD_BPE, vocabulary
from tests.llm.helpers import ODD_DOCS, no_docs, odd_docs

rng = random.Random(1)
ALPHABET = " \n\t\r\x0b\x0c\x1c\x85  abcXYZéÉ'’s1²٣漢́ͅ<|>endoftext!?​﻿😀\U00010400İK՘"
FUZZ = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(500)]
FUZZ += ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "x" * 3000, "ab" * 700 + "é" * 400, "I'm you'LL it's", "<|startoftext|>hi"]


def plain(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_lexicon_is_minimal_and_exact():
    words = ["tap", "taps", "top", "tops", "trip", "trips", "étape", "", "zap"]
    built = lexicon.Lexicon(lexicon.compile_lexicon({w: [i, i * i] for i, w in enumerate(words)}))
    assert [list(built.get(w.encode())) for w in words] == [[i, i * i] for i in range(len(words))]
    assert all(built.get(w) is None for w in (b"ta", b"tapss", b"q", "é".encode()))
    raw = [w.encode() for w in words]
    prefixes = {w[:i] for w in raw for i in range(len(w) + 1)}
    futures = {frozenset(w[len(p) :] for w in raw if w.startswith(p)) for p in prefixes}
    assert built.states == len(futures)
    assert lexicon.Lexicon(lexicon.compile_lexicon({})).get(b"a") is None


def test_encoder_equals_library():
    path = vocabulary(BYTE_BPE)
    definition = open(path, encoding="utf-8").read()
    own = bpe.ByteBpe(definition)
    words = ["the", " the", " étape", "漢"]
    encoder = bpe.Encoder(definition, lexicon.mapped(lexicon.compile_lexicon({w: own.merge(w.encode()) for w in words})))
    library = plain(path)
    for text in FUZZ + [r[1] or "" for r in ODD_DOCS]:
        ids = library.encode(text, add_special_tokens=False).ids
        packed = encoder.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert encoder.decode(packed) == library.decode(ids, skip_special_tokens=False)
    merger = own.merger()
    for word in (w for text in FUZZ[:100] for w in own.pattern.findall(text)):
        assert own.merge(word.encode()) == merger(word) == own._merge_long([bytes([b]) for b in word.encode()])


def test_sections_do_not_change_results(monkeypatch):
    monkeypatch.setattr(bpe, "SECTION", 7)
    monkeypatch.setattr(token_counts, "SECTION", 7)
    monkeypatch.setattr(bpe.sections, "__defaults__", (7,))
    monkeypatch.setattr(token_counts.sections, "__defaults__", (7,))
    definition = open(vocabulary(BYTE_BPE), encoding="utf-8").read()
    encoder, library = bpe.Encoder(definition, lexicon.mapped(lexicon.compile_lexicon({}))), plain(vocabulary(BYTE_BPE))
    counter, words = token_counts.Counter(open(vocabulary(WORD_BPE), encoding="utf-8").read(), True), plain(vocabulary(WORD_BPE))
    for text in FUZZ + ["one two  three\n four <|endoftext|> five", "a" * 50 + " b"]:
        assert "".join(bpe.sections(text)) == text
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert counter.count([text]) == [len(words.encode(text, add_special_tokens=False).ids)]


def test_encode_documents(spark):
    library = plain(vocabulary(BYTE_BPE))
    rows = bpe.encode_documents(odd_docs(spark), vocabulary(BYTE_BPE), ("ids", "ids_sha256", "decoded", "decoded_sha256")).collect()
    assert len(rows) == len(ODD_DOCS)
    wanted = {(r[0], r[1] or "") for r in ODD_DOCS}
    assert {(r["doc_id"], r["decoded"]) for r in rows} == wanted
    for r in rows:
        ids = library.encode(r["decoded"], add_special_tokens=False).ids
        assert bytes(r["ids"]) == np.array(ids, "<u4").tobytes() and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(bytes(r["ids"])).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.encode_documents(no_docs(spark), vocabulary(BYTE_BPE)).count() == 0


def test_frequent_words_count_everything(spark):
    docs = spark.createDataFrame([(i, "aa bb" + " cc" * (i % 3)) for i in range(10)], "doc_id long, text string")
    assert bpe.frequent_words(docs, 2) == [" bb", "aa"]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.ByteBpe(open(vocabulary(WORD_BPE), encoding="utf-8").read())


@pytest.mark.parametrize("name", [WORD_BPE, BYTE_BPE])
def test_counts_equal_library(name, monkeypatch):
    monkeypatch.setattr(token_counts, "LONG_TEXT", 50)
    definition = open(vocabulary(name), encoding="utf-8").read()
    safe = token_counts.drops_blanks(definition)
    assert safe == (name == WORD_BPE)
    counter, library = token_counts.Counter(definition, safe), plain(vocabulary(name))
    texts = FUZZ + [r[1] or "" for r in ODD_DOCS]
    wanted = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter.count(texts) == wanted and counter.count(texts) == wanted


def test_count_tokens(spark):
    library = plain(vocabulary(WORD_BPE))
    rows = token_counts.count_tokens(odd_docs(spark), vocabulary(WORD_BPE)).collect()
    wanted = sorted((r[0] or 0, len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in ODD_DOCS)
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in rows) == wanted
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)
    assert token_counts.count_tokens(no_docs(spark), vocabulary(WORD_BPE)).count() == 0


def test_batches_by_bytes():
    got = list(token_counts.batches_by_bytes(["aaa", "bb", "c" * 9, "d"], 5))
    assert got == [["aaa", "bb"], ["c" * 9], ["d"]]
    assert list(token_counts.batches_by_bytes(["漢", "字", "a", "é", "b"], 4)) == [["漢"], ["字", "a"], ["é", "b"]]
    assert list(token_counts.batches_by_bytes([], 5)) == []
