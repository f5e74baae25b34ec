"""Secret scans by grammar inference.

Fixed patterns find labelled credentials in every text. A credential is a string over the classes of
its characters (digits, letters a-f and g-z in either case, each separator by itself). The labelled
strings of each kind form a prefix tree whose statistically compatible states are merged (Hoeffding's
bound on end and transition frequencies) into a probabilistic automaton; loops stand for lengths. All
other runs of credential characters, and all parts of them that begin and end beside separators, are
then scored: the logarithm of their likelihood under the best automaton, less that under the pairs of
classes that the whole corpus has outside labelled credentials. What is likelier by PRIOR nats at
least is added to the spans found by pattern.

Automata are fitted to at most TRAIN_STRINGS distinct labelled strings of a kind, the first by their
hashes, of which the first TRAIN_SYMBOLS symbols are read; the pairs' counts cover all texts.

Defined cases: a null text counts as empty and has no spans; without labelled credentials nothing is
added; of parts that overlap the likeliest is taken, the first of equal ones; repeated rows give
repeated rows; null ids stay; empty tables give empty results; other columns are ignored (``redact``
keeps them). A run of any length takes time in proportion to it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import importable, map_slices, stored

#: Kinds found by pattern, in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: The labelled sample that automata are fitted to: distinct strings of a kind, and symbols of a string.
TRAIN_STRINGS, TRAIN_SYMBOLS = 2000, 128
#: Confidence of the merge test; what an automaton's likelihood must exceed that of the corpus by, in nats; least score.
ALPHA, PRIOR, LEAST_SCORE = 0.05, 25.0, 0.5
#: The share of the background that takes any class after any other: a pair that a corpus hasn't shows little by itself.
ANY = 0.1
#: Runs whose verdicts a worker remembers, and their longest.
CACHE_RUNS, CACHE_SYMBOLS = 300_000, 80

SEPARATORS = b"+/_.=-"
#: Classes by character; all other characters are spaces, which end a run.
SYMBOLS = b" 0agAG" + SEPARATORS
_CLASS = bytes(b"0"[0] if chr(c).isdigit() else (b"a" if chr(c) in "abcdef" else b"g" if chr(c).islower() else b"A" if chr(c) in "ABCDEF" else b"G")[0] if chr(c).isalpha() else c if c in SEPARATORS else 32 for c in range(128)) + b" " * 128
_NUMBER = bytes(SYMBOLS.index(c) if c in SYMBOLS else 0 for c in range(256))


def classes(text: str) -> bytes:
    """The class of each character."""
    return text.encode("latin-1", "replace").translate(_CLASS)


def pattern_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind's position, credential), leftmost and without overlap within a kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def outside(text: str, spans: list[tuple[int, int, int, str]]) -> bytes:
    """The classes of a text, with spaces in place of the spans."""
    found = bytearray(classes(text))
    for a, b, *_ in spans:
        found[a:b] = b" " * (b - a)
    return bytes(found)


class Automaton:
    """A frequency automaton: ``ends[q]`` strings end in state q, ``steps[q][a] = [target, count]``."""

    def __init__(self) -> None:
        self.ends: list[int] = [0]
        self.steps: list[dict[int, list[int]]] = [{}]

    def add(self, string: bytes, count: int = 1) -> None:
        q = 0
        for a in string:
            if a not in self.steps[q]:
                self.ends.append(0)
                self.steps.append({})
                self.steps[q][a] = [len(self.ends) - 1, 0]
            self.steps[q][a][1] += count
            q = self.steps[q][a][0]
        self.ends[q] += count

    def total(self, q: int) -> int:
        return self.ends[q] + sum(n for _, n in self.steps[q].values())

    def compatible(self, p: int, q: int) -> bool:
        """Whether the strings from p and those of the tree below q may have one distribution."""
        bound, todo = math.sqrt(0.5 * math.log(2 / ALPHA)), [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self.total(p), self.total(q)
            far = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m)) if n and m else 1.0
            if far >= 1:  # so few strings differ from none, nor do those that go on from them
                continue
            if abs(self.ends[p] / n - self.ends[q] / m) > far:
                return False
            for a in {*self.steps[p], *self.steps[q]}:
                x, y = self.steps[p].get(a, (-1, 0)), self.steps[q].get(a, (-1, 0))
                if abs(x[1] / n - y[1] / m) > far:
                    return False
                if x[0] >= 0 and y[0] >= 0:
                    todo.append((x[0], y[0]))
        return True

    def fold(self, p: int, q: int) -> None:
        """Adds the tree below q to p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.ends[p] += self.ends[q]
            for a, (target, n) in self.steps[q].items():
                if a in self.steps[p]:
                    self.steps[p][a][1] += n
                    todo.append((self.steps[p][a][0], target))
                else:
                    self.steps[p][a] = [target, n]

    def generalise(self) -> Automaton:
        """Merges compatible states: red states are final, the states next to them are tried against each."""
        red, blue = [0], deque((0, a) for a in sorted(self.steps[0]))
        while blue:
            p, a = blue.popleft()
            q = self.steps[p][a][0]
            if q in red:
                continue
            for r in red:
                if self.compatible(r, q):
                    self.steps[p][a][0] = r
                    self.fold(r, q)
                    # What was folded in brought new states next to red ones.
                    blue.extend((x, b) for x in red for b in sorted(self.steps[x]) if self.steps[x][b][0] not in red and (x, b) not in blue)
                    break
            else:
                red.append(q)
                blue.extend((q, b) for b in sorted(self.steps[q]))
        return self

    def likelihood(self, string: bytes) -> float:
        """The logarithm of the probability of a string."""
        q, log = 0, 0.0
        for a in string:
            if a not in self.steps[q]:
                return -math.inf
            log += math.log(self.steps[q][a][1] / self.total(q))
            q = self.steps[q][a][0]
        return log + self.end(q)

    def end(self, q: int) -> float:
        """The logarithm of the probability of an end in q: one more end is added to all seen."""
        return math.log((self.ends[q] + 1) / (self.total(q) + 1))


def background(pairs: np.ndarray) -> np.ndarray:
    """Logarithms of the probabilities of a class after another, from the counts of pairs."""
    counts = pairs.reshape(len(SYMBOLS), len(SYMBOLS)) + 1.0
    return np.log((1 - ANY) * counts / counts.sum(axis=1, keepdims=True) + ANY / len(SYMBOLS))


def pairs(found: bytes) -> np.ndarray:
    """The counts of pairs of neighbouring classes; a text begins and ends with spaces."""
    c = np.frombuffer((b" " + found + b" ").translate(_NUMBER), np.uint8).astype(np.int32)
    return np.bincount(c[:-1] * len(SYMBOLS) + c[1:], minlength=len(SYMBOLS) ** 2)


class Grammar:
    """Automata of all kinds against the background."""

    def __init__(self, automata: dict[str, Automaton], plain: np.ndarray) -> None:
        self.automata = automata
        self.plain = {(a, b): float(plain[i, j]) for i, a in enumerate(SYMBOLS) for j, b in enumerate(SYMBOLS)}
        # By kind and state: the next state and the logarithm of a step's probability; of an end's.
        self.steps = {(k, q): {a: ((k, t), math.log(n / x.total(q))) for a, (t, n) in x.steps[q].items()} for k, x in automata.items() for q in range(len(x.ends)) if x.total(q)}
        self.ends = {(k, q): x.end(q) for k, x in automata.items() for q in range(len(x.ends)) if x.total(q)}
        self.cache: dict[bytes, tuple] = {}

    def ratio(self, string: bytes) -> tuple[float, str]:
        """The best automaton's log-likelihood less the background's, and its kind."""
        plain = sum(self.plain[a, b] for a, b in zip(b" " + string, string + b" ", strict=True))
        return max((x.likelihood(string) - plain, k) for k, x in self.automata.items())

    def find(self, run: bytes) -> tuple[tuple[int, int, str, float], ...]:
        """(start, stop, kind, ratio) of the parts of a run that exceed PRIOR.

        All parts are scored at once: of those that have come to one state the best one is followed,
        as what comes after adds the same to each."""
        if run in self.cache:
            return self.cache[run]
        out, best, live, i, n = [], None, {}, 0, len(run)
        while True:
            if i == n or i == 0 or run[i] in SEPARATORS or run[i - 1] in SEPARATORS:  # parts may end and begin here
                for (kind, q), (score, start) in live.items():
                    if start < i:
                        total = score + self.ends[kind, q] - self.plain[run[i - 1], 32]
                        if total >= PRIOR and (best is None or total > best[3]):
                            best = (start, i, kind, total)
                if i < n:
                    for kind in self.automata:
                        if live.get((kind, 0), (-math.inf,))[0] < 0:
                            live[kind, 0] = (0.0, i)
            if best is not None and (i == n or not any(s < best[1] and x > best[3] - PRIOR for x, s in live.values())):
                out.append(best)
                i, best, live = best[1], None, {}
                if i < n:
                    for kind in self.automata:
                        live[kind, 0] = (0.0, i)
            if i == n:
                break
            now, c = {}, run[i]
            for state, (score, start) in live.items():
                if step := self.steps.get(state, {}).get(c):
                    new = score + step[1] - self.plain[run[i - 1] if start < i else 32, c]
                    if step[0] not in now or new > now[step[0]][0]:
                        now[step[0]] = (new, start)
            live = now
            i += 1
        found = tuple(out)
        if n <= CACHE_SYMBOLS:
            if len(self.cache) >= CACHE_RUNS:
                self.cache.clear()
            self.cache[run] = found
        return found

    def added(self, text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str, float]]:
        """(start, stop, kind, score) of what the automata find outside the spans."""
        if not self.automata:
            return []
        found = outside(text, spans)
        hits = {run: parts for run in {*found.split()} if (parts := self.find(run))}
        if not hits:
            return []
        return [(m.start() + a, m.start() + b, kind, 1 / (1 + math.exp(min(700.0, PRIOR - x)))) for m in _RUN.finditer(found) for a, b, kind, x in hits.get(m[0], ())]


_RUN = re.compile(rb"[^ ]+")


def learn(labelled: Iterable[tuple[str, bytes]]) -> dict[str, Automaton]:
    """An automaton for each kind of the distinct (kind, classes), in any order."""
    out: dict[str, Automaton] = {}
    for kind, string in sorted({*labelled}):
        out.setdefault(kind, Automaton()).add(string)
    return {kind: a.generalise() for kind, a in out.items()}


def train(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> Grammar:
    """The grammar of a corpus. Tasks pass on the distinct labelled strings and the counts of pairs of
    each slice; the driver reads TRAIN_STRINGS strings of each kind and a count for each pair."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            labelled: set[tuple[int, str]] = set()
            counts = np.zeros(len(SYMBOLS) ** 2, np.int64)
            for text in batch.column(0).to_pylist():
                spans = pattern_spans(text or "")
                labelled |= {(k, classes(v[:TRAIN_SYMBOLS]).decode()) for _, _, k, v in spans}
                counts += pairs(outside(text or "", spans))
            seen = np.flatnonzero(counts)
            rows = [*((k, v, 1) for k, v in sorted(labelled)), *((-1, str(i), int(counts[i])) for i in seen)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int64()), strict=True)], names=["kind", "string", "n"])

        return work

    rows = map_slices(docs.select(text_col), make, "kind int, string string, n long")
    counted = stored(spark, rows.groupBy("kind", "string").agg(F.sum("n").alias("n")), "labelled")
    plain = np.zeros(len(SYMBOLS) ** 2)
    for r in counted.where("kind = -1").collect():  # a row for each pair of classes
        plain[int(r["string"])] = r["n"]
    sample = [r for k in range(len(KINDS)) for r in counted.where(F.col("kind") == k).orderBy(F.xxhash64("string"), "string").limit(TRAIN_STRINGS).collect()]
    return Grammar(learn((KINDS[r["kind"]], r["string"].encode()) for r in sample), background(plain))


def spans(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """(id_col, spans) for every row: (start, stop, kind, score) in code points, end exclusive.

    Pattern spans have score 1. Spans that the automata add have the kind "<kind>-like" and as score
    the probability that their ratio gives where a secret is e^-PRIOR as likely as any other run."""
    importable(spark)
    grammar = train(spark, docs, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    item = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text in batch.column(1).to_pylist():
                found = pattern_spans(text or "")
                row = [(a, k, b, KINDS[k], 1.0) for a, b, k, _ in found]
                row += [(a, len(KINDS), b, f"{kind}-like", score) for a, b, kind, score in grammar.added(text or "", found) if score >= least]
                out.append([{"start": a, "stop": b, "kind": k, "score": s} for a, _, b, k, s in sorted(row)])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, item)], names=[id_col, "spans"])

        return work

    return map_slices(docs.select(id_col, text_col), make, f"`{id_col}` {id_type}, spans array<struct<start: int, stop: int, kind: string, score: double>>")


def redact(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]", least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` with every secret's characters replaced by ``mask``; overlapping spans count as one.
    All columns and rows stay; a null text stays null; ``n_chars``, where present, is counted anew."""
    importable(spark)
    grammar = train(spark, docs, text_col)
    names = docs.columns
    at, size_at = names.index(text_col), names.index("n_chars") if "n_chars" in names else -1

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        found = pattern_spans(text)
        cut = [(a, b) for a, b, _, _ in found] + [(a, b) for a, b, _, score in grammar.added(text, found) if score >= least]
        out, done = [], 0
        for a, b in sorted(cut):
            if a >= done:
                out += [text[done:a], mask]
            done = max(done, b)
        return "".join([*out, text[done:]]) if cut else text

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = list(batch.columns)
            texts = [clean(t) for t in columns[at].to_pylist()]
            columns[at] = pa.array(texts, columns[at].type)
            if size_at >= 0:
                columns[size_at] = pa.array([None if t is None else len(t) for t in texts]).cast(columns[size_at].type)
            return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return work

    return map_slices(docs, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def listing(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the digest of the pattern spans, and all spans as kind:start:stop."""
    id_type = found.schema[id_col].dataType.simpleString()

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = batch.column(1).to_pylist()
            show = lambda row: ",".join(f"{s['kind']}:{s['start']}:{s['stop']}" for s in row)
            return pa.RecordBatch.from_arrays(
                [batch.column(0)]
                + [pa.array([sum(s["kind"] == k for s in row) for row in rows], pa.int64()) for k in KINDS]
                + [pa.array([hashlib.sha256(show([s for s in row if s["kind"] in KINDS]).encode()).hexdigest() for row in rows], pa.string()), pa.array(map(show, rows), pa.string())],
                names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

        return work

    return map_slices(found, make, f"`{id_col}` {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
