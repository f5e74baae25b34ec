"""Byte-level BPE by speculation and verification.

Greedy longest match proposes tokens for every distinct word of a batch. A proposal is the exact
result if each adjacent pair of its tokens is what merging yields for the pair's own bytes, so the
pairs of all proposals are put into one array, made unique, and looked up in a sorted table of
pairs with known verdicts. Only words with a failing pair are merged step by step.

Defined cases: a null text counts as empty and has no tokens; repeated rows give repeated rows; a
null id stays null; an empty table gives an empty result; columns other than the two named are
ignored. The literal text of the vocabulary's added token encodes to that token's id, as the
public library does by default. A vocabulary of more than 65,536 ids is refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from siltstone.llm.common import map_slices

#: Splits text before merging; fixed by the vocabulary.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII and the Latin letters up to U+024F, which the re module splits faster.
_L, _S = "A-Za-zÀ-ÖØ-öø-ɏ", "\\t-\\r "
LATIN_WORDS = rf" ?[{_L}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}0-9]+|[{_S}]+(?![^{_S}])|[{_S}]+"
NOT_LATIN = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ɏ]")
#: Words of up to so many bytes are merged by scanning, longer ones with a heap; no pair's rank is NEVER.
SHORT, NEVER = 40, 1 << 30
#: Distinct words that a worker remembers before it starts anew.
CACHE_WORDS = 600_000


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: printable Latin-1 characters stand
    for themselves, the other bytes, in order, for the code points from 256 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpeculativeBPE:
    """The vocabulary file at ``path`` (the tokenizers library's JSON form)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_of_char()
        raw = lambda token: bytes(chars[c] for c in token)
        self.ids = {raw(token): i for token, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        if max(self.bytes) >= 1 << 16:
            raise ValueError("pairs of ids are packed into 32 bits: a vocabulary may have 65,536 ids")
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(raw, pair if isinstance(pair, list) else pair.split(" "))
            self.merges.setdefault((self.ids[left], self.ids[right]), (rank, self.ids[left + right]))
        self.rank = {a << 16 | b: rank for (a, b), (rank, _) in self.merges.items()}
        self.made = {rank: new for rank, new in self.merges.values()}
        self.longest: dict[bytes, int] = {}
        for b in self.ids:
            if len(b) >= 4:
                self.longest[b[:4]] = max(self.longest.get(b[:4], 4), len(b))
        self.lengths = np.zeros(max(self.bytes) + 1, np.int64)
        for i, b in self.bytes.items():
            self.lengths[i] = len(b)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(len(self.lengths))), np.uint8)
        self.words, self.latin = regex.compile(WORDS).findall, re.compile(LATIN_WORDS).findall
        self.split = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.known, self.fits = np.empty(0, np.int64), np.empty(0, bool)
        self.alone: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.merged = 0  # words that had to be merged step by step

    def merge(self, word: bytes) -> list[int]:
        """Exact: the applicable merge of lowest rank, leftmost first, until none applies."""
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        if n <= SHORT:
            rank = self.rank
            ranks = [rank.get(ids[i] << 16 | ids[i + 1], NEVER) for i in range(n - 1)]
            while ranks and (least := min(ranks)) != NEVER:
                i = ranks.index(least)
                ids[i] = self.made[least]
                del ids[i + 1], ranks[i]
                if i < len(ranks):
                    ranks[i] = rank.get(ids[i] << 16 | ids[i + 1], NEVER)
                if i:
                    ranks[i - 1] = rank.get(ids[i - 1] << 16 | ids[i], NEVER)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merges[a, b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merges.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n = [], 0, len(word)
        while at < n:
            end = min(n, at + self.longest.get(word[at : at + 4], 3))
            while (token := self.ids.get(word[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def _compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For each pair (left * 65536 + right): whether merging its bytes gives back that pair."""
        unique, where = np.unique(pairs, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        new = unique[self.known[np.minimum(at, max(len(self.known) - 1, 0))] != unique] if len(self.known) else unique
        if len(new):
            fits = [self.merge(self.bytes[p >> 16] + self.bytes[p & 0xFFFF]) == [p >> 16, p & 0xFFFF] for p in new.tolist()]
            known, fit = np.concatenate([self.known, new]), np.concatenate([self.fits, fits])
            order = np.argsort(known, kind="stable")
            self.known, self.fits = known[order], fit[order].astype(bool)
        return self.fits[np.searchsorted(self.known, unique)][where]

    def learn(self, words: list[str]) -> None:
        """Puts the packed ids of new distinct words into the cache."""
        raw = [w.encode() for w in words]
        proposals = [self.propose(b) for b in raw]
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        inner = np.ones(max(len(flat) - 1, 0), bool)
        inner[ends[:-1][ends[:-1] < len(flat)] - 1] = False  # pairs across two words
        ok = np.ones(len(flat) + 1, bool)
        at = np.flatnonzero(inner)
        ok[at] = self._compatible(flat[at] << 16 | flat[at + 1]) if len(at) else True
        failing = np.add.reduceat(~ok[:-1], np.concatenate([[0], ends[:-1]])) if len(flat) else np.zeros(0)
        for word, b, ids, bad in zip(words, raw, proposals, failing.tolist(), strict=True):
            if len(ids) == 1 and (single := self.alone.get(ids[0])) is None:
                single = self.alone[ids[0]] = self.merge(b) == ids
            if bad or len(ids) == 1 and not single:
                ids = self.merge(b)
                self.merged += 1
            self.cache[word] = np.asarray(ids, "<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        out: list[bytes] = []
        pieces = [self.split.split(t) if self.split and any(a in t for a in self.added) else [t] for t in texts]
        found = [p if p in self.added else (self.words if NOT_LATIN.search(p) else self.latin)(p) for ps in pieces for p in ps if p]
        if new := list({w for f in found if isinstance(f, list) for w in f} - self.cache.keys()):
            self.learn(new)
        it = iter(found)
        get = self.cache.__getitem__
        for ps in pieces:
            out.append(b"".join(b"".join(map(get, f)) if isinstance(f, list) else np.uint32(self.added[f]).astype("<u4").tobytes() for f in (next(it) for p in ps if p)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> SpeculativeBPE:
    """One a Python worker; workers serve many tasks."""
    return SpeculativeBPE(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) for every row of ``docs``."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        bpe = tokenizer(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = bpe.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=[id_col, "ids"])

        return work

    return map_slices(docs.select(id_col, text_col), make, f"`{id_col}` {id_type}, ids array<int>")


def _lists(column: pa.ListArray):
    """Each list as a numpy view; a null list as an empty one."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids, text) for every row of (id_col, ids); null ids give an empty text."""
    id_type = tokens.schema[id_col].dataType.simpleString()

    def make():
        bpe = tokenizer(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = pa.array([bpe.decode(x) for x in _lists(batch.column(1))], pa.string())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=[id_col, "ids", "text"])

        return work

    return map_slices(tokens.select(id_col, "ids"), make, f"`{id_col}` {id_type}, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256[, ids]): every text encoded, and its ids decoded.
    One worker does both, so that a task holds the vocabulary and the remembered words once."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        bpe = tokenizer(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = bpe.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            sizes = np.array([len(p) // 4 for p in packed], np.int64)
            columns = [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(np.frombuffer(p, "<u4")).encode()).hexdigest() for p in packed], pa.string()),
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

        return work

    return map_slices(docs.select(id_col, text_col), make, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, rows=256)
