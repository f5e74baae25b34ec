"""Token counts at every prefix of a text, by dynamic programming.

Each distinct word is read byte by byte. The encoding of its first j bytes ends with the one token t
for which the encoding of the first j - |t| bytes ends with a token u such that the bytes of u and t
together encode to just u, t. So the last token and the count of every prefix follow from those of
shorter prefixes, and no prefix is encoded again. A word's end is a variant of its last token. Counts of
a text's prefixes are its words' counts one after the other, so the array of a text answers
how many tokens a cut leaves and where to cut for a budget (``at``, ``fitting``) without the
vocabulary.

The vocabulary is one of lower-cased words with an end mark, as its JSON file describes; another
kind is refused. ``counts[i]`` belongs to the text's first i code points. White space adds nothing.
Where the normaliser joins code points (a letter and its accents), a prefix that ends inside them
has the count of their end: nobody should cut there.

Defined cases: a null text counts as empty, with counts [0]; a very long text's array is as long as
the text, and texts are taken in slices of about SLICE_BYTES bytes; repeated rows give repeated rows; a null id
stays null; an empty table gives an empty result; columns other than the two named are ignored. The
literal text of an added token counts as one token, as the public library has it by default.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm.common import importable

#: The vocabulary's way of splitting normalised text into words; fixed by its file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Scripts whose letters, numbers, spaces and cases all libraries agree on: Latin, Greek and Cyrillic in one
#: code point, general punctuation. Texts with other code points are split and normalised by the library itself.
PLAIN = re.compile("[\x00-įı-ȳΑ-ΡΤ-Ωα-ωА-яЁё‐-‧]*")
_L, _N, _S = "a-zA-ZªµºÀ-ÖØ-öø-ȳΑ-ΡΣ-Ωα-ωА-яЁё", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
WORDS = re.compile(f"[{_L}]+|[{_S}]+|[{_N}]|'(?:s|t|re|ve|m|ll|d)|[^{_S}{_L}{_N}]+")
SPACES = re.compile(f"[{_S}]")
#: What stands before a word's first token; a pair that doesn't merge, and a symbol that no merge made, by rank.
START, _NONE, _BYTE = -1, (1 << 30, 0), (-1, 0, 0)
#: Tokens that a document may have, for the question of what goes beyond.
LIMIT = 2048
#: Tokens are looked up by so many last bytes.
TAIL = 4
#: A worker forgets its words when they and their counts take more than so many bytes, and its verdicts on pairs beyond so many.
CACHE_BYTES, CACHE_PAIRS = 96_000_000, 1_000_000
#: Bytes of texts that a task takes at one time, or else a single text.
SLICE_BYTES = 2_000_000


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: printable Latin-1 characters stand
    for themselves, the other bytes, in order, for the code points from 256 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """The vocabulary file at ``path`` (the tokenizers library's JSON form)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pieces = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        if (spec["normalizer"] or {}).get("normalizers") != NORMAL or pieces[0].get("pattern", {}).get("Regex") != SPLIT or not model["end_of_word_suffix"]:
            raise ValueError("not a vocabulary of lower-cased words with an end mark")
        library = Tokenizer.from_file(path)
        self.normalise, self.pieces = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        mark, chars = model["end_of_word_suffix"], _byte_of_char()
        # A symbol is (bytes, whether it ends a word).
        symbol = lambda s: (bytes(chars[c] for c in s.removesuffix(mark)), s.endswith(mark))
        self.ids = {symbol(s): i for s, i in model["vocab"].items()}
        self.inner = {b: i for (b, end), i in self.ids.items() if not end}
        self.final = {b: i for (b, end), i in self.ids.items() if end}
        self.symbols = {i: symbol for symbol, i in self.ids.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = map(symbol, pair if isinstance(pair, list) else pair.split(" "))
            self.merges.setdefault((self.ids[left], self.ids[right]), (rank, self.ids[left[0] + right[0], right[1]]))
        self.made = {new: (rank, *pair) for pair, (rank, new) in reversed(self.merges.items())}
        # The longest tokens with given last TAIL bytes: no longer ones need be tried before a word's byte.
        self.reach: dict[bytes, int] = {}
        self.reach_final: dict[bytes, int] = {}
        for b, ends in self.ids:
            table = self.reach_final if ends else self.reach
            table[b[-TAIL:]] = max(len(b), table.get(b[-TAIL:], 0))
        self.added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.split = re.compile(f"({'|'.join(map(re.escape, self.added))})") if self.added else None
        self.verdicts: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.starts, self.sizes = array("i"), array("i"), array("i")
        self.held = 0

    def merge(self, body: bytes, ends: bool) -> list[int]:
        """The encoding of some bytes: the applicable merge of lowest rank, leftmost first, until none applies."""
        ids = [self.inner[body[i : i + 1]] for i in range(len(body))]
        if ends:
            ids[-1] = self.final[body[-1:]]
        while len(ids) > 1:
            rank, i = min((self.merges.get(pair, _NONE)[0], i) for i, pair in enumerate(pairwise(ids)))
            if rank == _NONE[0]:
                break
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def fits(self, left: int, right: int) -> bool:
        """Whether the token ``right`` can follow ``left`` in an encoding, or, if that is START, begin one."""
        known = self.verdicts.get((left, right))
        if known is None:
            if len(self.verdicts) >= CACHE_PAIRS:
                self.verdicts.clear()
            known = self.merge(*self.symbols[right]) == [right] if left == START else self.fits(START, left) and self.fits(START, right) and self.stay(left, right)
            self.verdicts[left, right] = known
        return known

    def stay(self, left: int, right: int) -> bool:
        """Whether no merge joins what stands on both sides of the border of two tokens.

        Both tokens' merges are undone at the border, the latest one first. Before each was done, the
        symbols at the border could have been merged instead, if that merge had a lower rank, or the
        same one and a place further left."""
        limit = _NONE[0]
        while self.merges.get((left, right), _NONE)[0] >= limit:
            a, b = self.made.get(left, _BYTE), self.made.get(right, _BYTE)
            if a[0] == b[0] == _BYTE[0]:
                return True
            if a[0] > b[0]:
                limit, left = a[0], a[2]
            else:
                limit, right = b[0] + 1, b[1]
        return False

    def read(self, body: bytes, state: tuple[list[int], list[int], list[int]]) -> None:
        """Reads on, from what the state holds, to the end of a word: for each prefix the last token
        and the count while the word goes on, and the count if it ended there (the last of these
        lists has 0 for prefixes that end inside a code point)."""
        last, count, ended = state
        inner, final, verdict, fits, reach, reach_final = self.inner.get, self.final.get, self.verdicts.get, self.fits, self.reach.get, self.reach_final.get
        for j in range(len(last), len(body) + 1):
            tail = body[max(0, j - TAIL) : j]
            for i in range(max(0, j - reach(tail, TAIL)), j):  # the longest token first
                t = inner(body[i:j])
                if t is not None and (fits(last[i], t) if (known := verdict((last[i], t))) is None else known):
                    last.append(t)
                    count.append(count[i] + 1)
                    break
            whole = 0
            if j == len(body) or body[j] & 0xC0 != 0x80:
                for i in range(max(0, j - reach_final(tail, TAIL)), j):
                    t = final(body[i:j])
                    if t is not None and (fits(last[i], t) if (known := verdict((last[i], t))) is None else known):
                        whole = count[i] + 1
                        break
            ended.append(whole)

    def learn(self, words: set[str]) -> None:
        """Puts words into the table of known words. In order, each goes on from what it shares with the one before."""
        start = lambda: ([START], [0], [0])
        state, before = start(), b""
        for word in sorted(words):
            body = word.encode()
            if SPACES.match(word):
                counts = [0] * len(word)
            else:
                same = next((k for k, (a, b) in enumerate(zip(body, before, strict=False)) if a != b), min(len(body), len(before)))
                for part in state:
                    del part[same + 1 :]
                self.read(body, state)
                before = body
                counts = [c for c in state[2] if c]
                if len(word) > 1 and word[0] == "'" and word[1].isalpha():  # its parts, while it isn't whole
                    rest = start()
                    self.read(body[1:], rest)
                    counts[1:-1] = [counts[0] + c for c in rest[2][1:-1]]
            self.place[word] = len(self.starts)
            self.starts.append(len(self.flat))
            self.sizes.append(len(counts))
            self.flat.extend(counts)
            self.held += 120 + 5 * len(word) + 4 * len(counts)

    def words(self, text: str, plain: bool) -> list[str]:
        """All of a normalised text, as words and runs of white space."""
        if plain:
            return WORDS.findall(text)
        out, at = [], 0
        for _, (a, b) in self.pieces(text):
            if a > at:
                out.append(" " * (a - at))
            out.append(text[a:b])
            at = b
        return [*out, " " * (len(text) - at)] if at < len(text) else out

    def of_words(self, words: list[str], chars: int) -> np.ndarray:
        """Counts of all prefixes, from the empty one on, of a normalised text of so many code points."""
        out = np.zeros(chars + 1, np.int32)
        ids = list(map(self.place.get, words))
        if None in ids:
            self.learn({w for w, i in zip(words, ids, strict=True) if i is None})
            ids = list(map(self.place.get, words))
        if ids:
            ids = np.array(ids)
            flat, starts, sizes = np.frombuffer(self.flat, np.int32), np.frombuffer(self.starts, np.int32), np.frombuffer(self.sizes, np.int32)
            n, begin = sizes[ids], starts[ids]
            stops = np.cumsum(n, dtype=np.int32)
            totals = flat[begin + n - 1]
            at = np.repeat(begin + n - stops, n)
            at += np.arange(stops[-1], dtype=np.int32)
            np.add(flat[at], np.repeat(np.cumsum(totals, dtype=np.int32) - totals, n), out=out[1:])
        return out

    def section(self, text: str) -> tuple[np.ndarray, str, bool]:
        """Counts of all prefixes of a text without added tokens; its normal form; whether that is plain."""
        if PLAIN.fullmatch(text):
            normal = text.lower()
            return self.of_words(WORDS.findall(normal), len(normal)), normal, True
        normal = self.clean(text)
        counts = self.of_words(self.words(normal, False), len(normal))
        if len(normal) == len(text) and unicodedata.is_normalized("NFC", text):
            return counts, normal, False
        raw = regex.findall(r"\X", text)
        parts = [self.clean(x) for x in raw]
        if "".join(parts) != normal:  # something is joined across these: take what white space parts
            raw = re.findall(r"\s+|\S+", text)
            parts = [self.clean(x) for x in raw]
        ends = np.cumsum([0, *map(len, parts)])
        at = np.concatenate([[0], *(np.minimum(ends[k] + np.arange(1, len(r) + 1), ends[k + 1]) if len(r) == len(parts[k]) else np.full(len(r), ends[k + 1]) for k, r in enumerate(raw))])
        return counts[at], normal, False

    def clean(self, text: str) -> str:
        """Normalised, but with white space as long as it was."""
        return "".join(x if not x.strip() and x.isspace() else self.normalise(x) for x in re.split(r"(\s+)", text) if x)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """``counts`` of many texts. New words of plain ones are learnt together, which is faster."""
        if self.held > CACHE_BYTES:
            self.forget()
        easy = [PLAIN.fullmatch(t) is not None and not (self.split and self.split.search(t)) for t in texts]
        words = [WORDS.findall(t.lower()) if e else [] for e, t in zip(easy, texts, strict=True)]
        self.learn(set().union(*words) - self.place.keys())
        return [self.of_words(w, len(t)) if e else self.counts(t) for e, w, t in zip(easy, words, texts, strict=True)]

    def counts(self, text: str) -> np.ndarray:
        """Tokens of the text's first 0, 1, 2, ... code points."""
        parts = self.split.split(text) if self.split else [text]
        out, base = [np.zeros(1, np.int32)], 0
        for k in range(0, len(parts), 2):
            found, normal, plain = self.section(parts[k])
            out.append(found[1:] + base)
            base += int(found[-1])
            if k + 1 < len(parts):  # an added token; while it isn't whole it is text that goes on from the last words
                tail, token = "".join(self.words(normal, plain)[-2:]), parts[k + 1]
                count = lambda t: int(self.of_words(self.words(t, plain), len(t))[-1])  # noqa: B023, E731
                out.append(np.array([*(base - count(tail) + count(tail + token[:i].lower()) for i in range(1, len(token))), base + 1], np.int32))
                base += 1
        return np.concatenate(out)


@lru_cache(maxsize=1)
def counter(path: str) -> PrefixCounter:
    """One for each worker process."""
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, counts) of every row: ``counts[i]`` tokens in the text's first i code points."""
    importable(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)

        def batch_of(ids: pa.Array, sizes: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
            return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))], names=[id_column, "n_bytes", "counts"])

        for batch in batches:
            keys, lo, held = batch.column(0), 0, 0
            lengths = pc.binary_length(batch.column(1)).to_pylist()
            for hi, size in enumerate(lengths, 1):
                held += size
                if held >= SLICE_BYTES or hi == len(lengths):
                    texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                    yield batch_of(keys.slice(lo, hi - lo), lengths[lo:hi], own.batch(texts))
                    lo, held = hi, 0

    return rows.mapInArrow(run, f"`{id_column}` {kind}, n_bytes long, counts array<int>")


def total(counts: Column) -> Column:
    """Tokens of the whole text."""
    return F.element_at(counts, -1).cast("long")


def at(counts: Column, chars: Column) -> Column:
    """Tokens of the text's first ``chars`` code points, or of all of it if it has fewer."""
    return F.get(counts, F.least(chars, F.size(counts) - 1)).cast("long")


def fitting(counts: Column, budget: int) -> Column:
    """How many code points, at most, a prefix of no more than ``budget`` tokens has."""
    last = F.aggregate(counts, F.struct(F.lit(0).alias("i"), F.lit(0).alias("last")), lambda s, c: F.struct((s["i"] + 1).alias("i"), F.when(c <= budget, s["i"]).otherwise(s["last"]).alias("last")), lambda s: s["last"])
    return F.when(total(counts) <= budget, F.size(counts) - 1).otherwise(last).cast("long")
