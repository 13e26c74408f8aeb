import gc
import hashlib
from array import array

import numpy as np
from tokenizers import Tokenizer

from mailsieve.llm import bpe

from .conftest import corpus, prose


def test_encoding_equals_the_library(spark, docs):
    path = bpe.default_vocabulary()
    lib = Tokenizer.from_file(path)
    rows = bpe.encode_decode(docs, path, keep_ids=True).collect()
    assert len(rows) == len(corpus()) + 1
    texts = dict(corpus())
    for r in rows:
        ids = lib.encode(texts[r.doc_id] or "" if r.doc_id is not None else "no id at all", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert r.decoded == decoded and r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_awkward_texts():
    lib, enc = Tokenizer.from_file(bpe.default_vocabulary()), bpe.TrieEncoder(bpe.default_vocabulary())
    texts = ["it's we'll 1234 ½² a<|endoftext|>B <|startoftext|>x<|endoftext|", "ΣΑΣ Ångström å İstanbul", "中文字 \U0001f600!!",
             "\x1cq\x1f a\x85b c", "aaaaaaaa" * 700, "abab" * 2000, "....,,,,''''s'st", "\u0000 �", "é é"]
    for text, raw in zip(texts, enc.encode_many(texts)):
        assert array("I", raw).tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_memory_may_be_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_BYTES", 5000)
    monkeypatch.setattr(bpe, "BATCH_CHARS", 100)
    enc = bpe.TrieEncoder(bpe.default_vocabulary())
    texts = [prose(i, 40) for i in range(5)] * 2 + ["longer" * 90, "longer" * 91 + " " + "longer" * 90]
    assert list(enc.encode_many(texts)) == list(bpe.encoder(bpe.default_vocabulary()).encode_many(texts))


def test_empty_table(empty):
    assert bpe.encode_decode(empty, bpe.default_vocabulary()).count() == 0


def test_words_are_learnt_without_collecting_between(monkeypatch):
    """Garbage collection rests while a batch is split and learnt, and goes on as it was."""
    enc, seen, learn = bpe.TrieEncoder(bpe.default_vocabulary()), [], bpe.TrieEncoder._learn
    monkeypatch.setattr(bpe.TrieEncoder, "_learn", lambda self, c: seen.append(gc.isenabled()) or learn(self, c))
    assert len(list(enc.encode_many(["some words, and more"]))) == 1
    assert seen == [False] and gc.isenabled()
    gc.disable()
    try:
        list(enc.encode_many(["others"]))
        assert not gc.isenabled()
    finally:
        gc.enable()


def test_a_word_is_looked_up_once_however_often_it_stands_there():
    class Counted(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    lib, enc = Tokenizer.from_file(bpe.default_vocabulary()), bpe.TrieEncoder(bpe.default_vocabulary())
    enc.words = Counted()
    texts = ["some words, and more\n" * 500, "and more words " * 500]
    for text, raw in zip(texts, enc.encode_many(texts)):
        assert array("I", raw).tolist() == lib.encode(text, add_special_tokens=False).ids
    assert 0 < enc.words.asked < 50


def test_plain_and_odd_texts_together():
    """Each text gets its own ids, whatever way its neighbours are split."""
    lib, enc = Tokenizer.from_file(bpe.default_vocabulary()), bpe.TrieEncoder(bpe.default_vocabulary())
    spaces = "".join(c for c in map(chr, range(0x500)) if c.isspace() and not "\x1c" <= c <= "\x1f")
    texts = ["", " ", "plain words", "中文 plain", "", "a<|endoftext|>plain words", f"{spaces}x{spaces}yz{spaces}", "a < b", "q\x1fr words",
             "\t\n", "É é ÅNGSTRÖM don't 'tis", "plain"] + [f"a{c}b" for c in spaces] + ["lang " * 300 + "e" * 400, "中"]
    for many in texts, texts[::-1], texts[3:4], texts[:1], []:
        got = [array("I", raw).tolist() for raw in enc.encode_many(many)]
        assert got == [lib.encode(t, add_special_tokens=False).ids for t in many]
