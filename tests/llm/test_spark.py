"""The operators as Spark jobs, on rows with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import bpe, chat, html, licenses, media, mixing, quality, rules, secrets, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, copies string, host string, w string"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def rows():
    rng = random.Random(3)
    words = [f"k{i}" for i in range(300)]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts = [None, "", " \n\t ", "one", "a b c", LONG, LONG + " tail", *prose, *prose[:9], *(p + " more" for p in prose[:9]), 'token = "0123456789abcdef0123456789abcdef"', "Licensed under the MIT License.\nMIT license", "###%%% |" * 30]
    out = [(i, t, "en", f"s{i % 4}" if i % 9 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[3], out[8], (None, prose[1], None, None, 1), (None, prose[2], None, "s1", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def keyed(*values):
    return sorted(values, key=repr)


def test_bpe(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = []
    for i, t, *_ in rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert collected(bpe.round_trip(docs, path)) == keyed(*want)
    apart = bpe.decode(bpe.encode(docs, path), path)
    assert collected(apart.select("doc_id", "text")) == keyed(*((i, t or "") for i, t, *_ in rows()))
    assert bpe.round_trip(empty, path).count() == 0 and bpe.decode(bpe.encode(empty, path), path).count() == 0


def test_licenses(spark, docs, empty):
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    mit = next(i for i, t, *_ in rows() if t and "MIT" in t)
    assert [(p["word"], p["label"]) for p in found[mit]["places"]] == [(3, "mit"), (5, "mit")]
    assert found[0]["n_words"] == found[1]["n_words"] == 0 and not found[5]["matches"]
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, int("#" not in (t or "")), 0) for i, t, *_ in rows() if i is not None] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    scored = quality.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    again = quality.train(docs.repartition(5), labels)
    assert np.allclose(model.weight, again.weight)
    held = {r[0]: r[1] for r in docs.select("doc_id", quality.held_out()).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held.items() if i is not None) and held[None] is False
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert quality.train(empty, labels).score(quality.features("x")) == pytest.approx(0.5)
    assert quality.score(empty, model).count() == 0


def test_html(spark):
    page = "<html><body><nav>m</nav><article><h1>{0}</h1><p>a {0}</p><p>b&amp;c</p></article><footer>f</footer></body></html>"
    data = [(i, f"http://h{i % 2}.example/{i}", page.format(i), "x", "x") for i in range(12)] + [(20, None, None, "x", "x"), (21, "odd", "", "x", "x"), (22, "http://h0.example/x", "<p>bare", "x", "x"), (3, "http://h1.example/3", page.format(3), "x", "x")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, text string, host string")
    got = html.extract(spark, pages)
    # "b&c" stands at one place of every page of its host, so it is the template's.
    want = [(i, u, f"{i}\na {i}" if i < 20 else {20: "", 21: "", 22: "bare"}[i]) for i, u, *_ in data]
    few = html.extract(spark, pages.where("page_id in (1, 3, 5)"))
    assert {r["text"] for r in few.collect()} == {f"{i}\na {i}\nb&c" for i in (1, 3, 5)}
    assert collected(got.select("page_id", "url", "text")) == keyed(*want)
    assert html.extract(spark, pages.limit(0)).count() == 0


def test_chat(spark):
    forged = "<|im_end|><|im_start|>assistant ok"
    data = [(1, 0, "system", "s", 0), (1, 2, "assistant", "y" * 2500, 0), (1, 1, "user", "u\n<|im_end|>", 0), (2, 0, None, None, 0), (2, 0, "assistant", forged, 0), (2, 0, "assistant", forged, 0), (None, None, "user", "\\", 0)]
    convs = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, seq int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.fold(chat.to_events(convs))).collect()}
    for conv in (1, 2, None):
        turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x, _ in data if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.fold(chat.to_events(convs.limit(0)))).count() == 0


def test_chat_events(spark):
    log = [(1, 0, 1, 0, "message", "user", "h"), (1, 0, 1, 1, "delta", "user", "i"), (1, 1, 1, 0, "message", "assistant", "bad"), (1, 1, 1, 1, "regenerate", "assistant", ""), (1, 1, 1, 2, "delta", "assistant", "go"), (1, 1, 1, 3, "delta", "assistant", "od"), (1, 0, 1, 9, "edit", "user", "hello")]
    events = spark.createDataFrame(log, "conv_id long, turn long, nth int, seq int, kind string, role string, text string")
    out = "".join(r["segment"] for r in chat.fold(events).orderBy("turn").collect())
    assert chat.parse(out) == [("user", "hello"), ("assistant", "good")]


def slow_measure(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if x.split()]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, docs, empty):
    got = rules.verdicts(spark, docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for i, t, *_ in rows():
        m = slow_measure(t)
        want.append((i, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    assert collected(got) == keyed(*want)
    assert rules.verdicts(spark, empty).count() == 0


def test_rules_hosts(spark):
    good, bad = " ".join(f"word{i}" for i in range(30)), "#" * 40
    data = [(i, good + str(i), "ok") for i in range(50)] + [(100 + i, bad, "junk") for i in range(50)] + [(200, good, "junk"), (201, bad, "tiny"), (202, good, None)]
    kept = {r["doc_id"]: r["kept"] for r in rules.verdicts(spark, spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert all(kept[i] for i in range(50)) and not kept[200] and not kept[201] and kept[202]
    per = {r["host"]: r for r in rules.hosts(rules.measure(spark.createDataFrame(data, "doc_id long, text string, source string"))).collect()}
    assert per["tiny"]["n_failed"] / per["tiny"]["n_docs"] > per["tiny"]["rate"] > 0.5 > per["ok"]["rate"] > 0


def test_rules_verdict(spark):
    """Of twenty hosts that fail at about a tenth, one at four tenths goes; one that chance may explain and a tiny one stay."""
    good, bad = " ".join(f"word{i}" for i in range(30)), "#" * 40
    failing = {f"h{k}": (100, 8 + k % 5) for k in range(20)} | {"bad": (100, 40), "unlucky": (100, 18), "tiny": (2, 1), "hot": (3000, 300)}
    data = [(h, bad if i < f else f"{good} {h} {i}") for h, (n, f) in failing.items() for i in range(n)]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(data)], "doc_id long, text string, source string")
    per = {r["host"]: r for r in rules.hosts(rules.measure(docs)).collect()}
    assert [h for h, r in per.items() if not r["host_ok"]] == ["bad"] and per["bad"]["rate"] < 0.6
    assert all(r["low_rate"] < r["rate"] for r in per.values())
    kept = rules.verdicts(spark, docs).groupBy("host").agg(F.count_if("kept").alias("n")).collect()
    assert {r["host"]: r["n"] for r in kept} == {h: 0 if h == "bad" else n - f for h, (n, f) in failing.items()}


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 100), (None, 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(spark, sizes).collect()}
    # 315 words by 5 : 2 : 1 : 5; a stops at 20, the source without words at 0, then b at 200 (196.67 doesn't reach it).
    assert got["a"] == 20 and got[None] == 0
    assert got["b"] == pytest.approx(295 * 2 / 3) and got["c"] == pytest.approx(295 / 3)


def test_mixing(spark, docs, empty):
    found = mixing.copies(spark, docs).collect()
    assert len(found) == docs.count()
    assert all(0 <= r["copies"] <= 2 for r in found)
    again = mixing.copies(spark, docs.repartition(7)).collect()
    key = lambda r: (repr(r["doc_id"]), repr(r["source"]), r["size"], r["copies"])
    assert sorted(map(key, found)) == sorted(map(key, again))
    mixed = mixing.mix(spark, docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in found)
    assert mixing.copies(spark, empty).count() == 0 and mixing.mix(spark, empty).count() == 0


def test_mixing_words(spark):
    rng = random.Random(4)
    data = [(i, " ".join("w" * rng.randint(1, 400)), f"s{int(rng.random() ** 2 * 6)}") for i in range(3000)]
    found = mixing.copies(spark, spark.createDataFrame(data, "doc_id long, text string, source string"))
    for r in found.groupBy("source").agg(F.sum("size").alias("s"), F.max("source_size").alias("ss"), F.max("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("k")).collect():
        assert r["s"] == r["ss"] and abs(r["k"] - r["t"]) <= max(50, 0.002 * r["t"])
    shares = found.where("target < 2 * source_size").groupBy("source", (F.col("size") > 200).alias("big")).agg((F.sum("copies") / F.count("*")).alias("c"), F.max(F.col("target") / F.col("source_size")).alias("p")).collect()
    assert shares and all(abs(r["c"] - r["p"]) < 0.12 for r in shares)  # large and small documents alike


def test_mixing_long_document(spark):
    rng = random.Random(9)
    data = [(i, "w " * rng.randint(1, 40), "c") for i in range(2000)]
    for source, n in (("a", 60), ("b", 700)):
        data += [(10_000 + i, "w " * rng.randint(500, 2999), source) for i in range(n)] + [(20_000, "w " * 20_020, source)]
    found = mixing.copies(spark, spark.createDataFrame(data, "doc_id long, text string, source string"), weights=(1, 20, 1), share=0.6)
    per = {r["source"]: r for r in found.groupBy("source").agg(F.max("target").alias("t"), F.max("source_size").alias("s"), F.count("*").alias("n"), F.sum(F.col("copies") * F.col("size")).alias("k")).collect()}
    assert {k: r["n"] for k, r in per.items()} == {"a": 61, "b": 701, "c": 2000}
    assert 0 < per["a"]["t"] < per["a"]["s"] and all(abs(r["k"] - r["t"]) <= 0.01 * r["t"] for r in per.values())


@pytest.mark.parametrize(("head", "chunk", "fan"), [(256, 256, 64), (3, 4, 3), (1, 6, 2)])
def test_mixing_expectations(spark, monkeypatch, head, chunk, fan):
    """Over many sources of equal documents, the mean of a document's copies is what its target says;
    and each source's words come near the target. Few large ones, small chunks and only chunks."""
    for name, value in (("HEAD", head), ("CHUNK", chunk), ("FAN", fan)):
        monkeypatch.setattr(mixing, name, value)
    sizes = [1500, 700, 650, 300, *(range(20, 220, 10))]
    data = [(1000 * k + i, "w " * n, f"s{k}") for k in range(400) for i, n in enumerate(sizes)]
    found = mixing.copies(spark, spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4), weights=(1,), share=1.3).collect()
    mean = np.zeros(len(sizes))
    taken = Counter()
    for r in found:
        mean[r["doc_id"] % 1000] += r["copies"] / 400
        taken[r["source"]] += r["copies"] * r["size"]
        assert r["copies"] in (1, 2) and r["target"] == pytest.approx(1.3 * sum(sizes))
    assert np.abs(mean - 1.3).max() < 4.5 * (0.3 * 0.7 / 400) ** 0.5
    miss = np.array([taken[f"s{k}"] - 1.3 * sum(sizes) for k in range(400)])
    assert abs(miss.mean()) < 4.5 * max(1, miss.std()) / 20
    assert np.abs(miss).max() < 1500 and (np.abs(miss) < 300).mean() > (0.9 if head > 1 else 0.6)


def test_mixing_alone_and_beside(spark):
    """A source with the same target is treated alike whatever stands beside it."""
    rng = random.Random(11)
    own = [(i, "w " * rng.choice([5, 40, 900]), "a") for i in range(400)] + [(9999, "w " * 12_000, "a")]
    words = sum(len(t) // 2 for _, t, _ in own)
    other = [(20_000 + i, "w " * (words // 1500), "b") for i in range(1500)]
    other[0] = (20_000, "w " * (words - 1499 * (words // 1500)), "b")
    of = lambda rows: {r["doc_id"]: (r["target"], r["copies"]) for r in mixing.copies(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1,), share=0.5).where("source = 'a'").collect()}
    alone = of(own)
    assert alone == of(own + other) and len(alone) == 401


def test_mixing_order(spark):
    """Weights follow the order of thousands of sources, and targets add up."""
    names = [f"h{i * 7919 % 3001:04}" for i in range(3000)]
    sizes = [(n, (i * 31) % 50 + (i % 7 == 0) * 2000) for i, n in enumerate(names)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark, spark.createDataFrame(sizes, "source string, size long").repartition(5)).collect()}
    total, level = 1.5 * sum(n for _, n in sizes), 0.0
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(sorted(names))}
    low, high = 0.0, 1e6
    for _ in range(100):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * n, level * weight[s]) for s, n in sizes) < total else (low, level)
    assert all(got[s] == pytest.approx(min(2 * n, level * weight[s])) for s, n in sizes)


def test_secrets(spark, docs, empty):
    out = {r["doc_id"]: r for r in secrets.listing(secrets.spans(spark, docs)).collect()}
    at = next(i for i, t, *_ in rows() if t and "token" in t)
    assert (out[at]["n_assign"], out[at]["n_hex"], out[at]["spans"]) == (1, 1, "assign:0:41,hex:9:41")
    assert out[at]["base_sha256"] == hashlib.sha256(b"assign:0:41,hex:9:41").hexdigest()
    assert out[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = secrets.redact(spark, docs)
    assert clean.columns == docs.columns
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean.collect()}
    assert texts[at] == ('[secret]"', 9) and texts[0] == (None, None) and texts[5][0] == LONG
    assert secrets.spans(spark, empty).count() == 0 and secrets.redact(spark, empty).count() == 0


def test_media(spark, docs, empty, tmp_path):
    catalogue, folder = media.pack(spark, docs, folder=f"file://{tmp_path}/shards")
    got = {r["doc_id"]: r for r in media.read_back(catalogue, folder).collect()}
    for i, t, *_ in rows():
        if i is not None:
            data, n = media.payload(t)
            r = got[i]
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    assert got[0]["media_sha256"] == got[1]["media_sha256"] and got[0]["feature"] == got[1]["feature"]
    assert {r["height"] for r in media.metadata(catalogue, folder).where("doc_id = 5").collect()} == {got[5]["payload_bytes"] // 64}
    assert media.places(catalogue).count() == len({hashlib.sha256(media.payload(t)[0]).digest() for _, t, *_ in rows()})
    (tmp_path / "shards" / "stray.tar").write_bytes(b"x")
    assert media.vacuum(catalogue, folder) == 1 and media.read_back(catalogue, folder).count() == docs.count()
    none, where = media.pack(spark, empty)
    assert media.read_back(none, where).count() == 0


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, empty):
    data = [(i, slow_fingerprint(t)) for i, t, *_ in rows()]
    group = list(range(len(data)))
    for a in range(len(data)):
        for b in range(a):
            if (data[a][1] ^ data[b][1]).bit_count() <= 4 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((i for (i, _), h in zip(data, group, strict=True) if h == g and i is not None), default=None) for g in set(group)}
    found = simhash.components(spark, docs)
    got = collected(found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id"))
    assert got == keyed(*((i, f"{f:016x}", least[g]) for (i, f), g in zip(data, group, strict=True)))
    kept = simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert simhash.components(spark, empty).count() == 0 and simhash.keep_one(spark, empty).count() == 0


def test_simhash_similar(spark):
    rng = random.Random(8)
    base = [[f"v{rng.randrange(5000)}" for _ in range(rng.randint(40, 160))] for _ in range(60)]
    texts = [None, "", "a b", "A  B"]
    for words in base:
        texts.append(" ".join(words))
        for changes in (1, 2, 3, 6):
            other = list(words)
            for _ in range(changes):
                other[rng.randrange(len(other))] = "changed"
            texts.append(" ".join(other))
    data = [*enumerate(texts), (None, texts[4]), (5, texts[9])]
    shingles = [(lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})((t or "").lower().split()) for _, t in data]
    prints = [slow_fingerprint(t) for _, t in data]
    group, beyond = list(range(len(data))), 0
    for a in range(len(data)):
        for b in range(a):
            alike = len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
            close = (prints[a] ^ prints[b]).bit_count() <= 4
            beyond += alike and not close
            if (alike or close) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # bands run over batches
    try:
        kept = simhash.keep_one(spark, df, similar=True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    first = {}
    for (i, t), g in zip(data, group, strict=True):
        first[g] = min(first.get(g, (True, 0)), (i is None, i or 0))
    assert beyond > 50 and sorted(r["doc_id"] for r in kept) == sorted(i for _, i in first.values())
    assert simhash.keep_one(spark, df.limit(0), similar=True).count() == 0


def test_simhash_similar_turns(spark, monkeypatch):
    """Groups of near copies whose members often aren't similar to each other, met by one pivot, then two, and so on."""
    monkeypatch.setattr(simhash, "PIVOTS", 1)
    monkeypatch.setattr(simhash, "MORE_PIVOTS", 2)
    rng = random.Random(11)
    texts = []
    for group in range(3):
        base = [f"g{group}w{rng.randrange(10_000)}" for _ in range(200)]
        texts.append(" ".join(base))
        for _ in range(30):
            copy = list(base)
            for _ in range(rng.choice((1, 2, 4, 5, 7))):
                copy[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    sets = [shingle_set(t) for t in texts]
    prints = [slow_fingerprint(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if ((prints[i] ^ prints[j]).bit_count() <= 4 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    kept = simhash.keep_one(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), similar=True)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({*group}) and 3 < len({*group}) < 60


def test_simhash_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {tuple(r) for r in simhash.connected(spark, edges).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_simhash_stream(spark):
    rng = random.Random(6)
    centres = [rng.getrandbits(64) for _ in range(5)]
    prints = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centres for _ in range(400)})
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # buckets run over batches
    try:
        nodes = simhash.connected(spark, simhash.bucket_edges(spark.createDataFrame(signed, "fp long"))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    roots = {r["node"] & (1 << 64) - 1: r["root"] for r in nodes}
    by = {}
    for p in prints:
        by.setdefault(next(k for k, c in enumerate(centres) if (p ^ c).bit_count() <= 3), []).append(p)
    for members in by.values():
        assert len({roots[m] for m in members}) == 1
    assert len({roots[m[0]] for m in by.values()}) == len(by)


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_pipeline(spark, tmp_path):
    """Each stage against what a brute-force version of it keeps."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    outputs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        outputs.append({} if k == 4 else [r.asDict() for r in docs.collect()])
        assert k == 4 or docs.columns == columns
    good, distinct, clean, mixed, _ = outputs
    assert 150 < len(good) < 200
    # One document of each group stays, the first; groups are what either kind of link connects.
    of = {r["doc_id"]: (slow_fingerprint(r["text"]), shingle_set(r["text"])) for r in good}
    group = {i: i for i in of}
    for i, (f, s) in of.items():
        for j, (g, t) in of.items():
            if j < i and ((f ^ g).bit_count() <= 4 or len(s & t) >= 0.8 * len(s | t)) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if v == old else v for k, v in group.items()}
    assert {r["doc_id"] for r in distinct} == {*group.values()} and len(distinct) < len(good)
    assert len(clean) == len(distinct) and not any(secrets.pattern_spans(r["text"]) for r in clean)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in clean} and max(Counter(r["doc_id"] for r in mixed).values()) == 2
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r["doc_id"]: r["text"] for r in mixed}
    final = docs.collect()
    assert len(final) == len(mixed)
    for r in final[:50]:
        assert r["ids"] == library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


CLASHING = ("_score", "__score", "_id", "_source", "_copies", "_nth", "_fp", "_keep_id", "_keep_fp", "label", "found", "chunk", "of")


def test_pipeline_stages_of_odd_tables(spark, docs, empty, tmp_path):
    """Nulls, repeats, empty tables, and columns named like any helper."""
    import corpus_pipeline

    odd = docs.drop("host", "w", "copies").withColumns({n: F.lit("x") for n in CLASHING})
    spark.createDataFrame([(i, int("#" not in (t or "")), 0) for i, t, *_ in rows() if i is not None], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = odd
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert now.columns == odd.columns and now.where("_score = 'x' and of = 'x'").count() == now.count() > 0
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0


def test_quality_sample_bounds(spark, monkeypatch):
    """Rows of one id many times over, and long texts, stay within the sample's bounds."""
    data = [(3, f"good text {i} of many") for i in range(600)] + [(i, f"junk junk {i}") for i in range(10, 60)] + [(7, " ".join(f"w{i}" for i in range(20_000)))]
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(60)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda found, y, **_: seen.append((len(found), sum(map(len, found)), sorted({*y}))))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    quality.train(docs, labels, rows=100)
    monkeypatch.setattr(quality, "SAMPLE_FEATURES", 500)
    quality.train(docs, labels, rows=100)
    assert seen[0][0] == 100 and 0 < seen[1][0] < 100 and seen[1][1] <= 500


def test_chat_ties(spark):
    """Rows of one turn are ordered by role and text, where nulls count as empty."""
    data = [(1, 0, None, "b"), (1, 0, "", "a"), (1, 0, "", None), (1, 0, None, None)]
    got = chat.read_back(chat.fold(chat.to_events(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")))).collect()[0]
    assert got["turns_sha256"] == hashlib.sha256("".join(f"\n{t}\n" for t in ("", "", "a", "b")).encode()).hexdigest()
