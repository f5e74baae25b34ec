"""The prefix trie, against one built node by node, over nulls, ties, repeats, turnless and long conversations."""

import hashlib
import random
import zlib

import pytest

from siltstone.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, digest string, rank string, owner string"


def slow(rows):
    """{(turns): (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)}."""
    key = lambda t: (t[0] is not None, t[0] or 0, hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).hexdigest())
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(turns, key=key)] for c, turns in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = {n for n in below if len(n) == len(node) + 1}
        leaf = lambda n: not any(len(m) == len(n) + 1 and m[:-1] == n for m in members)
        ends = ",".join(str(c) for c in sorted(convs) if whole[c] == node)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), sum(map(leaf, below)), sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in trie.build(spark, df).select(*columns).collect()), key=repr)


def conversations():
    rng = random.Random(4)
    out = []
    for c in range(60):
        for turn in range(rng.randint(1, 7)):
            out.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "é", "hello", ""])))
    out += [(100 + c, t, "user", "same") for c in range(40) for t in range(3)]  # copies of one conversation
    out += [(200, t, "user", str(t % 3)) for t in range(40)]  # a long one
    out += [(201, None, None, None), (201, None, None, None), (201, 0, "user", None), (None, 0, "user", "nobody"), (203, 5, "b", "tie"), (203, 5, "a", "tie"), (203, 5, "a", "tie")]
    out += [(-7, 0, "user", "negative"), (1003, 0, "user", "turnless where the family's first is absent")]
    return out


def test_trie_equals_slow(spark, monkeypatch):
    rows = conversations()
    want = slow(rows)
    assert found(spark, rows) == want and max(r[1] for r in want) == 40
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in want)  # a turnless one ends at the root
    monkeypatch.setattr(trie, "BLOCK", 3)
    monkeypatch.setattr(trie, "PIECE", 40)
    assert found(spark, rows) == want


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.build(spark, empty).count() == 0
    assert trie.build(spark, spark.createDataFrame([(None, 0, "user", "x", "", "", "", "")], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_chains_of_branches(spark, seed):
    """Every conversation goes one turn further than the one before it, or leaves it somewhere."""
    rng = random.Random(seed)
    rows, last = [], []
    for c in range(0, 150, 5):  # the first of their families, so nothing is taken from others
        last = last[: rng.randint(0, len(last))] if rng.random() < 0.3 else last
        last = [*last, f"turn {c if rng.random() < 0.8 else 0}"]
        rows += [(c, t, "user", x) for t, x in enumerate(last)]
    rng.shuffle(rows)
    assert found(spark, rows) == slow(rows)
