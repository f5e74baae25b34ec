"""Fuzzy search for short license notices.

A text is lower-cased (A-Z) and reduced to its words joined by single spaces. A notice that may
differ in k edits is split into k + 1 pieces, one of which must occur unchanged in any match
(pigeonhole). One Aho-Corasick pass over the words finds the pieces of all notices; at each word that
a hit lets a match begin with, the regex library's bounded-error matching decides, and reports the
words of the match and its edits (characters; matches begin and end with words). Of places of one
notice that overlap the one with fewest edits is taken, the first of equal ones. A word is tried once
for a notice, so time is in proportion to the text however dense the notices are. Places where a base
phrase's words stand unchanged are told from the hits of its first piece.

Defined cases: a null text counts as empty and has no places; score is 0 without a match; repeated
rows give repeated rows; null ids stay; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from siltstone.llm.common import map_slices

#: Phrases whose unchanged places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices that are searched with edits besides the base phrases.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "boost",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: One edit is allowed for so many characters of a notice, and so many in all.
CHARS_PER_EDIT, MOST_EDITS = 10, 6

#: Bytes that belong to words stay, A-Z become a-z, all others become spaces.
_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    base: bool

    @property
    def edits(self) -> int:
        return min(MOST_EDITS, len(self.phrase) // CHARS_PER_EDIT)

    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece): edits + 1 pieces of nearly equal length."""
        cuts = [len(self.phrase) * i // (self.edits + 1) for i in range(self.edits + 2)]
        return [(a, self.phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass(frozen=True)
class Match:
    """Words [first, last] of a text match a notice with so many edits."""

    first: int
    last: int
    label: str
    edits: int
    score: float


class Finder:
    def __init__(self, base: dict[str, str], notices: dict[str, str]) -> None:
        self.notices = [Notice(p, x, True) for p, x in base.items()] + [Notice(p, x, False) for p, x in notices.items()]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.notices):
            for offset, piece in n.pieces():
                seeds.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n.phrase)}){{e<={n.edits}}}(?= )") for n in self.notices]

    def find(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[Match]]:
        """The number of words, the places (word, label) of base phrases, and all matches."""
        words = (text or "").encode().translate(_TABLE).split()
        line = f" {b' '.join(words).decode()} "
        starts: list[tuple[int, str]] = []
        begins: dict[int, set[int]] = {}
        for end, (size, uses) in self.automaton.iter(line):
            for i, offset in uses:
                notice = self.notices[i]
                at = end + 1 - size - offset
                if offset == 0 and notice.base and line[at - 1 : at + len(notice.phrase) + 1] == f" {notice.phrase} ":
                    starts.append((at, notice.label))
                k = notice.edits  # so many characters at most may be missing, or be too many, before the piece
                begins.setdefault(i, set()).update(s for s in range(max(1, at - k), at + k + 1) if line[s - 1 : s] == " ")
        found = []
        for i, tried in begins.items():
            notice, pattern = self.notices[i], self.patterns[i]
            longest = len(notice.phrase) + notice.edits + 1  # with the space behind it
            near = sorted((sum(m.fuzzy_counts), s, m.end()) for s in tried if (m := pattern.match(line, s, min(s + longest, len(line)))) and m.end() > s)
            taken: list[tuple[int, int]] = []
            for edits, a, b in near:
                at = bisect_left(taken, (a, b))
                if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
                    taken.insert(at, (a, b))
                    found.append((a, b, notice.label, edits, 1 - edits / len(notice.phrase)))
        if not found:
            return len(words), [], []
        # Word numbers: spaces before each place, counted once from left to right.
        order = sorted({p for p, _ in starts} | {x for a, b, *_ in found for x in (a, b - 1)})
        number, spaces, done = {}, 0, 0
        for p in order:
            spaces += line.count(" ", done, p)
            done, number[p] = p, spaces
        word = lambda p: number[p] - 1
        places = sorted((word(p), label) for p, label in starts)
        return len(words), places, sorted({Match(word(a), word(b - 1), label, e, s) for a, b, label, e, s in found}, key=lambda m: (m.first, m.last, m.label, m.edits))


@lru_cache(maxsize=2)
def _finder(base: tuple, notices: tuple) -> Finder:
    return Finder(dict(base), dict(notices))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(id_col, n_words, places, matches) for every row: base places (word, label), and matches
    (first word, last word, label, edits, score) of every notice."""
    id_type = docs.schema[id_col].dataType.simpleString()
    key = (tuple(base.items()), tuple(notices.items()))
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    match = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("edits", pa.int32()), ("score", pa.float64())]))

    def make():
        finder = _finder(*key)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, places, matches = [], [], []
            for text in batch.column(1).to_pylist():
                size, base_places, found = finder.find(text)
                n.append(size)
                places.append([{"word": w, "label": x} for w, x in base_places])
                matches.append([{"first": m.first, "last": m.last, "label": m.label, "edits": m.edits, "score": m.score} for m in found])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(places, place), pa.array(matches, match)], names=[id_col, "n_words", "places", "matches"])

        return work

    schema = f"`{id_col}` {id_type}, n_words long, places array<struct<word: long, label: string>>, matches array<struct<first: long, last: long, label: string, edits: int, score: double>>"
    return map_slices(docs.select(id_col, text_col), make, schema)
