"""Every registered query of the subpackage, on all documents of a small table, against plain computations."""

import collections
import hashlib
import math
import zlib

import duckdb
import numpy as np
import pytest
from odd import bag, prose
from test_operators import crc, ids
from test_pii import plain

from vecloom.llm import common, pii, quality_cnn, toxicity
from vecloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def run(spark, name):
    return QUERIES[name](spark, SF).toArrow().to_pylist()


def fold(i, mod):
    return zlib.crc32(str(i).encode()) % mod


@pytest.mark.parametrize("name, mod, out, limit", [("op1_toxicity", 5, 0, 0.5), ("op4_quality_classifier", 4, 2, 0.7)])
def test_scores(spark, docs, name, mod, out, limit):
    rows = run(spark, name)
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert r["held_out"] == (fold(r["doc_id"], mod) == out) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= limit)
    by = collections.defaultdict(set)
    for r in rows:
        by[docs[r["doc_id"]]].add(r["score"])
    assert all(len(s) == 1 for s in by.values())


@pytest.mark.parametrize("name, label, mod, out", [("op1_toxicity", "toxic", 5, 0), ("op4_quality_classifier", "quality", 4, 2)])
def test_labels_that_are_held_out_change_nothing(spark, tmp_path, name, label, mod, out):
    import shutil

    def scores(flip):
        at = tmp_path / f"{name}{flip}"
        at.mkdir()
        shutil.copy(f"{SF}/documents.parquet", at)
        held = f"list_contains({[i for i in range(400) if fold(i, mod) == out]}, doc_id)"
        duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN {held} AND {flip} THEN 1 - {label} ELSE {label} END AS {label}) FROM '{SF}/labels.parquet') TO '{at}/labels.parquet'")
        return {r["doc_id"]: r["score"] for r in QUERIES[name](spark, str(at)).collect()}

    assert scores(0) == scores(1)


def test_token_counts(spark, docs):
    lengths = [len(ids(t)) for t in docs.values()]
    for r in run(spark, "op2_token_counts"):
        n = r["length"]
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"], r["truncated_total"]) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n), sum(min(x, n) for x in lengths))


def test_packing(spark, docs):
    rows, own = run(spark, "op5_packing"), {i: [*ids(t), 1] for i, t in docs.items()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        part = own[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(part) > 0 and r["ids_crc32"] == crc(part) and r["doc_tokens"] == len(own[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans, size in [*((pieces[i], len(x)) for i, x in own.items()), *((s, None) for s in sequences.values())]:
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at == size if size else at <= 2048
    assert sum(2048 - sum(n for _, n in s) for s in sequences.values()) < 0.02 * 2048 * len(sequences) + 2048


def test_decontamination(spark, docs):
    """Each hit is where it says, and each passage that stands in a text as it is, is found."""
    from test_decontaminate import brute

    items = dict(duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall())
    rows = run(spark, "op6_decontamination")
    for r in rows:
        assert brute(items[r["item_id"]], docs[r["doc_id"]][r["start"] : r["end"]]) == r["edits"] <= 0.08 * len(items[r["item_id"]])
    flat = lambda t: "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (t or "").lower())
    exact = {(d, i) for d, t in docs.items() for i, p in items.items() if flat(p) in flat(t)}
    assert exact and exact <= {(r["doc_id"], r["item_id"]) for r in rows}


def test_sharding(spark, docs):
    rows = run(spark, "op7_sharding")
    slots = collections.defaultdict(list)
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert sorted(r["doc_id"] for r in rows) == sorted(docs) and set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_token_output(spark, docs):
    at = 0
    rows = sorted(run(spark, "op9_token_output"), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in rows] == sorted(docs)
    for r in rows:
        own = [*ids(docs[r["doc_id"]]), 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own), crc(own))
        at += len(own)


def naive_find(text, model, limits):
    """Base spans, then candidates one by one: likeliest first, then by place, where no character is taken."""
    spans = [(*s, True) for s in plain(text)]
    taken = {(a, b) for _, a, b, _ in spans}
    scored = [(-float(model.predict(np.array([pii.features(text, c)]))[0]), c) for c in pii.candidates(text) if c[1:] not in taken]
    for p, c in sorted(scored):
        if -p >= limits[c[0]] and all(c[2] <= a or c[1] >= b for _, a, b, _ in spans):
            spans.append((*c, False))
    return sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2]))


@pytest.fixture(scope="module")
def model():
    return pii.fit()


def test_pii(spark, docs, model):
    said = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)
    rows = run(spark, "op10_pii")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        text = docs[r["doc_id"]] or ""
        base = plain(text)
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(s[0] == k for s in base) for k in pii.KINDS[:4]]
        assert r["base_sha256"] == hashlib.sha256(said(base).encode()).hexdigest()
        if len(text) < 20_000:
            assert r["spans"] == said(naive_find(text, *model))


def test_selection_as_by_hand(model):
    texts = [t + " " + u for (t, _, _), (u, _) in zip(pii.examples(120, seed=77), pii.lists(120, seed=78))]
    for text, got in zip(texts, pii.find([t.encode() for t in texts], *model)):
        assert got == naive_find(text, *model)


@pytest.mark.parametrize("n", [201, 300, 100_000])
def test_secrets_of_any_length_go_whole(model, n):
    import random

    value = "".join(random.Random(n).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    for text in (f"set api_key={value} now", f"the token {value} is mine"):
        new = pii.redacted(text, pii.find([text.encode()], *model)[0])
        assert value[-8:] not in new and value[:8] not in new and "[SECRET]" in new


def test_long_logs_take_linear_time(model):
    import time

    seconds = []
    for n in (1500, 6000):
        text = "".join(f"10.1.{i % 256}.{i % 199} user{i}@mail.example.com GET /x/{i * 7919 % 1000003} +1 555 01{i % 90 + 10} 99{i % 90 + 10}\n" for i in range(n))
        start = time.process_time()
        assert len(pii.find([text.encode()], *model)[0]) >= 2 * n
        seconds.append(time.process_time() - start)
    assert seconds[1] < 9 * seconds[0] + 1, seconds


def test_addresses_in_words_end_where_the_sentence_does(model):
    for text, span in (("mail jo (at) acme (dot) com. Thanks", "jo (at) acme (dot) com"), ("j" * 200 + " [at] acme.net and more", "j" * 200 + " [at] acme.net")):
        assert [text[a:b] for k, a, b, _ in pii.find([text.encode()], *model)[0]] == [span]


# --- Learners against plain versions -------------------------------------------------------------------------------


def plain_ftrl(rows, epochs, seed, alpha=0.7, beta=1.0, l1=10.0):
    """FTRL-proximal in plain Python: (place to weight, intercept)."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k):
        bound = 0.0 if k == "bias" else l1
        return 0.0 if abs(z[k]) <= bound else -(z[k] - math.copysign(bound, z[k])) / ((beta + math.sqrt(n[k])) / alpha)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            places, y = rows[i]
            keys = [*places.tolist(), "bias"]
            w = [weight(k) for k in keys]
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w))))) - y
            for k, x in zip(keys, w):
                sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha
                z[k] += g - sigma * x
                n[k] += g * g
    return {k: weight(k) for k in list(z) if k != "bias" and weight(k)}, weight("bias")


def plain_features(text, bits):
    """Words of ASCII letters, digits and other characters in lower case; words, pairs, and pairs around a word."""
    words = "".join(c.lower() if c.isascii() and c.isalpha() else c if ord(c) > 127 or c.isdigit() else " " for c in text).encode().split(b" ")
    h = [zlib.crc32(w) for w in words if w]
    one, two, three, m = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 1 << 64
    out = [x * one % m for x in h] + [(x * one * 3 + y * two) % m for x, y in zip(h, h[1:])] + [(x * one * 5 + y * two + three) % m for x, y in zip(h, h[2:])]
    return {x >> 64 - bits for x in out}


def test_ftrl_as_written():
    rows = []
    for i in range(160):
        text = prose(1000 + i, 30) + (" you awful rotten lot" if i % 3 == 0 else " how very kind of you")
        at = np.unique(toxicity.features(text.encode(), 12)).astype(np.int64)
        assert set(at.tolist()) == plain_features(text, 12)
        rows.append((at, int(i % 3 == 0)))
    places, weights, bias = toxicity.fit(rows, 12, 3, 9)
    want, intercept = plain_ftrl(rows, 3, 9)
    assert set(places.tolist()) == set(want) and len(want) > 3 and abs(bias - intercept) < 1e-9
    assert np.allclose([want[p] for p in places.tolist()], weights, rtol=1e-5)


def plain_forward(model, data):
    """The network with loops: every chunk of 32 bytes at every 16th byte, padded with 256."""
    half, out = quality_cnn.HALF, model["embed"].astype(float)
    padded = [*data, *[256] * (max(2, -(-len(data) // half)) * half - len(data))]
    best = None
    for s in range(0, len(padded) - half, half):
        chunk = [out[b] for b in padded[s : s + 2 * half]]
        first, second = np.concatenate(chunk[:half]), np.concatenate(chunk[half:])
        z = first @ model["filters"][:, : quality_cnn.FILTERS] + second @ model["filters"][:, quality_cnn.FILTERS :]
        best = z if best is None else np.maximum(best, z)
    logit = np.maximum(best + model["bias"], 0) @ model["out"] + model["offset"][0]
    return 1 / (1 + math.exp(-logit))


def test_network_as_written():
    model = quality_cnn.init(3)
    model["bias"] += np.linspace(-0.2, 0.2, quality_cnn.FILTERS).astype(np.float32)
    texts = [b"", b"x", b"y" * 16, b"z" * 33, prose(3, 200).encode(), "é中文 ".encode() * 40]
    want = [plain_forward(model, t) for t in texts]
    assert np.allclose(quality_cnn.probabilities(model, texts), want, atol=1e-5) and np.allclose([quality_cnn.probability(model, t) for t in texts], want, atol=1e-5)


def test_gradient_is_that_of_the_loss():
    model = {k: v.astype(np.float64) for k, v in quality_cnn.init(4).items()}
    rows = quality_cnn.blocks(prose(5, 60).encode())
    loss = lambda: -1.7 * math.log(1 - 1 / (1 + math.exp(-(np.maximum(quality_cnn.pooled(model, rows)[0], 0) @ model["out"] + model["offset"][0]))))
    g = {k: np.zeros_like(v) for k, v in model.items()}
    quality_cnn.gradient(model, rows, 0, 1.7, g)
    rng = np.random.default_rng(1)
    for name, value in model.items():
        flat, grad = value.reshape(-1), g[name].reshape(-1)
        some = np.concatenate([np.flatnonzero(grad)[:20], rng.integers(0, flat.size, 10)])
        for i in some.tolist():
            own, e = flat[i], 1e-6
            flat[i] = own + e
            up = loss()
            flat[i] = own - e
            down = loss()
            flat[i] = own
            assert abs((up - down) / (2 * e) - grad[i]) < 1e-4, (name, i)


def test_sample_is_bounded_in_bytes(spark, tmp_path):
    rows = [(i, ("long " * 4000 if i % 10 == 0 else "short ") + str(i)) for i in range(100)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = common.labelled_sample(spark, str(tmp_path), "toxic", (5, 0), 1000, 50_000)
    texts = dict(rows)
    assert all(r["text"] == texts[r["doc_id"]] for r in got.collect()) and sum(len(r["text"]) for r in got.collect()) <= 50_000
    assert got.count() >= 70 and bag(got, "doc_id") == bag(common.labelled_sample(spark, str(tmp_path), "toxic", (5, 0), 1000, 50_000), "doc_id")


def test_settings_of_the_session_stay(spark, model):
    """Operators set nothing; queries choose small batches where the session's owner has chosen none."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = dict(spark.conf.getAll)
    spark.conf.unset(key)
    pii.with_spans(spark.read.parquet(f"{SF}/documents.parquet"), model=model).count()
    assert key not in spark.conf.getAll
    common.small_batches(spark)
    assert spark.conf.get(key) == "1000"
    spark.conf.set(key, "10000")
    common.small_batches(spark)
    assert spark.conf.get(key) == "10000"
    spark.conf.set(key, before[key]) if key in before else spark.conf.unset(key)
