"""Counts of all prefixes against the public library's own encoding of each of them."""

import random
import unicodedata

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import counts

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["it's", "we'll", "'re", "''ve", "Hello", "WORLD", "naïve", "東京タワー", "한국어", "Ελλάς ΣΑΣ", "привет", "été", "🙂👍🏽", "<|endoftext|>", "!!<|startoftext|>", "<|end", " ", "\n\n\t", "123", "½", "don't", "ﬁn", "x" * 40, "각", "\x1c", "​", "　", "क़", "'", "''", "'l", "'L", "'LL", "ſ", " "]
JOINED = ["été", "İstanbul", "한", "ą́"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def own():
    return counts.PrefixCounter(PATH)


def test_every_prefix(own, library):
    rng = random.Random(5)
    for _ in range(800):
        text = "".join(rng.choice(PIECES) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 6)))
        got = own.counts(text)
        assert got[-1] == library(text)
        if unicodedata.is_normalized("NFC", text):
            assert got.tolist() == [library(text[:i]) for i in range(len(text) + 1)], text


def test_joined_characters(own, library):
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(PIECES + JOINED * 6) for _ in range(rng.randint(1, 5)))
        got = own.counts(text)
        assert len(got) == len(text) + 1 and got[-1] == library(text), text
        for i in range(len(text)):
            if text[i] == " " or unicodedata.is_normalized("NFC", text[: i + 1]) and not unicodedata.combining(text[i]) and text[i].isascii():
                assert got[i] == library(text[:i]), (text, i)


def test_every_code_point(own, library):
    for lo in range(0, 0x30000, 64):
        some = [chr(c) for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}b{c}{c} 1" for c in some)
        assert own.counts(text)[-1] == library(text), hex(lo)


def test_batches_and_forgetting(own, library, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh'é. ") for _ in range(rng.randint(0, 300))) for _ in range(60)] + [" ".join(PIECES), ""]
    want = [library(t) for t in texts]
    assert [int(c[-1]) for c in own.batch(texts)] == want
    monkeypatch.setattr(counts, "CACHE_BYTES", 1)
    monkeypatch.setattr(counts, "CACHE_PAIRS", 10)
    fresh = counts.PrefixCounter(PATH)
    assert [int(c[-1]) for half in (texts[:30], texts[30:]) for c in fresh.batch(half)] == want


def test_long_words(own, library):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdeéz") for _ in range(30_000))
    got = own.counts(text)
    assert got[-1] == library(text) and got[20_000] == library(text[:20_000])


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))


def test_spark(spark, library, monkeypatch):
    texts = [None, "", "Hello, world! it's <|endoftext|>", "naïve été", "word " * 3000, "x" * 5000]
    rows = [(i, t, "a", "b", "c") for i, t in enumerate(texts)] + [(None, "no id", "", "", ""), (2, texts[2], "", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, counts string, n_bytes string, _text string").repartition(2)
    monkeypatch.setattr(counts, "SLICE_BYTES", 1000)
    found = counts.prefix_counts(docs, PATH)
    c = F.col("counts")
    got = sorted((tuple(r) for r in found.select("doc_id", "n_bytes", counts.total(c), counts.fitting(c, 5), counts.at(c, F.lit(4)), F.size(c)).collect()), key=repr)
    def cut(t):
        return max(i for i in range(min(len(t), 200) + 1) if library(t[:i]) <= 5) if library(t) > 5 else len(t)

    want = [(i, len((t or "").encode()), library(t or ""), cut(t or ""), library((t or "")[:4]), len(t or "") + 1) for i, t, *_ in rows]
    assert got == sorted(want, key=repr)
    assert counts.prefix_counts(docs.limit(0), PATH).count() == 0
