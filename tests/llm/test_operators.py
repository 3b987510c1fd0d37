import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from odd import CLASH, LONG, TEXTS, bag, frame, prose

from vecloom.llm import decontaminate, near_dup, packing, pii, quality_cnn, quality_rules, sharding, token_counts, token_output, toxicity
from vecloom.llm.common import append
from vecloom.llm.tokens import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def ids(text):
    t = ids.__dict__.setdefault("t", tokenizers.Tokenizer.from_file(tokenizer_path()))
    return t.encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def others(df):
    """Columns of the odd frame that must come through as they are."""
    return [c for c in df.columns if c in CLASH]


def test_append_replaces_clashing_columns(spark, odd):
    import pyarrow as pa

    out = append(odd, [("SCORE", "bigint")], "text", lambda: lambda t: [pa.array([len(x.as_py() or "") for x in t], pa.int64())])
    assert [c.lower() for c in out.columns].count("score") == 1
    assert bag(out, "SCORE") == collections.Counter((len(t or ""),) for _, t in TEXTS)


# --- 2 -----------------------------------------------------------------------------------------------------------


def test_token_counts(odd, empty):
    sums = token_counts.suffix_sums(token_counts.length_histogram(odd, tokenizer_path()))
    lengths = [len(ids(t)) for _, t in TEXTS]
    rows = {r["length"]: r for r in sums.collect()}
    assert sorted(rows) == sorted(set(lengths))
    for n, r in rows.items():
        over = [x for x in lengths if x >= n]
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"], r["truncated_total"]) == (lengths.count(n), len(over), sum(over), sum(min(x, n) for x in lengths))
        assert r["docs_total"] == len(lengths) and r["tokens_total"] == sum(lengths) and math.isclose(r["quantile"], sum(x <= n for x in lengths) / len(lengths))
    for limit, got in token_counts.at_limits(sums, [0, 5, 100, 10**6]).items():
        assert got == {"docs_over": sum(x > limit for x in lengths), "tokens_over": sum(x for x in lengths if x > limit), "truncated_total": sum(min(x, limit) for x in lengths)}
    assert token_counts.quantile(sums, 0.5) == sorted(lengths)[math.ceil(0.5 * len(lengths)) - 1]
    none = token_counts.suffix_sums(token_counts.length_histogram(empty, tokenizer_path()))
    assert none.count() == 0 and token_counts.quantile(none, 0.5) is None


# --- 5 -----------------------------------------------------------------------------------------------------------


def check_packed(rows, texts, capacity, end):
    """Every id in one piece; sequences gapless and within capacity."""
    want = collections.Counter()
    for i, t in texts:
        x = [*ids(t), end]
        for s in range(0, len(x), capacity):
            part = x[s : s + capacity]
            want[(i, s, len(part), crc(part), len(x))] += 1
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return by


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_packing(odd, empty, capacity):
    check_packed(packing.pack_documents(odd, tokenizer_path(), capacity).collect(), TEXTS, capacity, 1)
    assert packing.pack_documents(empty, tokenizer_path(), capacity).count() == 0


def test_packed_ids_are_the_texts(odd):
    rows = packing.pack_documents(odd.where("doc_id = 7"), tokenizer_path(), 100, keep_ids=True).orderBy("start").collect()
    assert np.frombuffer(b"".join(r["ids"] for r in rows), "<u4").tolist() == [*ids(LONG), 1]


def test_packing_does_not_depend_on_tasks(odd):
    """Several groups in a task are packed one by one: the same rows whether it has one group or all; sequences stay in their group."""
    made = packing.pieces(odd.selectExpr("doc_id", "coalesce(text, '') AS text"), tokenizer_path(), 64, 1)
    some, one, many = (sorted(map(tuple, packing.pack(made, 5, 64, tasks=t).collect()), key=str) for t in (2, 1, 5))
    assert some == one == many
    groups = {r[-2] >> 40 for r in some}
    assert groups <= set(range(5)) and len(groups) > 1


def test_packed_sequences_hold_the_ids(odd, monkeypatch):
    """By default too, as op5 and the pipeline pack; in several groups by bytes; rows of a sequence in its order."""
    monkeypatch.setattr(packing, "GROUP_BYTES", 100_000)
    out = packing.pack_documents(odd, tokenizer_path(), 64)
    rows = out.collect()
    check_packed(rows, TEXTS, 64, 1)
    assert len({r["sequence_id"] >> 40 for r in rows}) > 5
    texts = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r["start"]):
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        texts[r["doc_id"]].append(bytes(r["ids"]))
    for i, t in TEXTS:
        if i and sum(j == i for j, _ in TEXTS) == 1:
            assert np.frombuffer(b"".join(texts[i]), "<u4").tolist() == [*ids(t), 1]
    at = [(r["sequence_id"], r["offset"]) for r in rows]
    assert at == sorted(at)


def naive_assign(lengths, capacity, linear, quadratic):
    """The rule as written, every sequence looked at for every piece."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins = [[0, 0.0] for _ in range(-(-sum(lengths) // capacity))]
    seq, off = {}, {}
    for i in order:
        n = lengths[i]
        room = [b for b in range(len(bins)) if bins[b][0] + n <= capacity]
        if not room:
            bins.append([0, 0.0])
            room = [len(bins) - 1]
        b = min(room, key=lambda b: (bins[b][1], b))
        seq[i], off[i] = b, bins[b][0]
        bins[b][0] += n
        bins[b][1] += linear * n + quadratic * n * n
    return [seq[i] for i in range(len(lengths))], [off[i] for i in range(len(lengths))]


def test_assignment_as_written():
    rng = random.Random(4)
    for _ in range(40):
        lengths = [rng.choice([1, 64, rng.randint(1, 64), rng.randint(1, 20)]) for _ in range(rng.randint(0, 120))]
        got = packing.assign(lengths, 64, 1.0, 1 / 64)
        want = naive_assign(lengths, 64, 1.0, 1 / 64)
        assert [x.tolist() for x in got] == list(want)


def test_padding_and_balance():
    rng = np.random.default_rng(5)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 20_000).astype(int) + 1)
    seq, _ = packing.assign(lengths, 2048, 1.0, 1 / 1024)
    used = np.bincount(seq, lengths)
    assert used.max() <= 2048 and used.sum() / (2048 * len(used)) > 0.98


# --- 7 -----------------------------------------------------------------------------------------------------------


def test_sharding(odd, empty):
    fixed = odd.drop("shard", "slot")
    out = sharding.shuffle_to_shards(odd, 8, cell_rows=2)
    rows = out.collect()
    sizes = collections.Counter(r["shard"] for r in rows)
    assert sum(sizes.values()) == len(TEXTS) and max(sizes.values()) - min(sizes[s] for s in range(8)) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    assert bag(out, *fixed.columns) == bag(odd, *fixed.columns)
    assert sharding.shuffle_to_shards(empty, 8).count() == 0
    again = sharding.shuffle_to_shards(odd, 8, cell_rows=2)
    assert bag(again, "doc_id", "text", "shard", "slot") == bag(out, "doc_id", "text", "shard", "slot")


def test_shuffle_is_uniform(spark):
    df = spark.range(0, 60, 1, 3)
    spots, n = collections.Counter(), 50
    for seed in range(n):
        for r in sharding.shuffle_to_shards(df, 2, seed, cell_rows=8).collect():
            spots[(r["id"] // 20, r["shard"], r["slot"] // 10)] += 1
    want = n * 60 / len(spots)
    assert len(spots) == 18 and sum((c - want) ** 2 / want for c in spots.values()) < 45  # chi square with about 12 degrees


def test_matrix_sums_and_large_counts():
    for rows in ([5, 0, 12, 3], [20], [1] * 20):
        m = sharding.Matrix(rows, [4, 4, 4, 4, 4], 1)
        got = [m.row(p) for p in range(len(rows))]
        assert [int(r.sum()) for r, _ in got] == rows and sum(r for r, _ in got).tolist() == [4] * 5
        for p, (_, before) in enumerate(got):
            assert before.tolist() == [sum(int(r[c]) for r, _ in got[:p]) for c in range(5)]
    draws = np.array([sharding.Matrix([30, 30], [20, 40], s).row(0)[0][0] for s in range(600)])
    assert abs(draws.mean() - 10) < 0.4 and abs(draws.var() - 30 * 20 / 60 * 40 / 60 * 30 / 59) < 0.7
    big = sharding.Matrix([10**9, 10**9, 5], [10**9, 10**9 + 5], 3)
    rows = [big.row(p)[0] for p in range(3)]
    assert sum(rows).tolist() == [10**9, 10**9 + 5] and [int(r.sum()) for r in rows] == [10**9, 10**9, 5] and big.large
    rng, n = np.random.default_rng(2), 10**9
    x = np.array([sharding.hypergeometric(n, 3 * n, 10_000, rng) for _ in range(400)])
    assert abs(x.mean() - 2500) < 10 and 35 < x.std() < 52
    assert sharding.hypergeometric(2 * n, 0, 5, rng) == 5 and sharding.hypergeometric(0, 2 * n, 5, rng) == 0


# --- 9 -----------------------------------------------------------------------------------------------------------


def test_token_files(spark, odd, empty, tmp_path):
    token_output.write_tokens(odd, str(tmp_path / "t"), tokenizer_path(), file_rows=4)
    rows = token_output.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == collections.Counter((i, len(ids(t)) + 1, crc([*ids(t), 0])) for i, t in TEXTS)
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] if r["doc_id"] is not None else -1 for r in rows]
    assert order == sorted(order)
    got = token_output.find_tokens(spark, str(tmp_path / "t"), [7, 9]).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in got} == {7: [*ids(LONG), 0], 9: [*ids("one two three"), 0]}
    token_output.write_tokens(empty, str(tmp_path / "e"), tokenizer_path())
    assert token_output.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_bloom_filters_are_in_the_files(spark, odd, tmp_path):
    token_output.write_tokens(odd.where("doc_id IS NOT NULL"), str(tmp_path / "t"), tokenizer_path(), file_rows=100)
    # Stripe footers name the streams' kinds; the file dump of the ORC library that Spark brings prints them.
    jvm, out = spark.sparkContext._jvm, []
    for p in (tmp_path / "t").glob("*.orc"):
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(p)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        out.append((reader.getRowIndexStride(), reader.getNumberOfRows(), reader.getCompressionKind().toString()))
        footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
        kinds = [footer.getStreams(i).getKind().toString() for i in range(footer.getStreamsCount())]
        assert "BLOOM_FILTER_UTF8" in kinds and "ROW_INDEX" in kinds
        assert "DIRECT_V2" in {footer.getColumns(i).getKind().toString() for i in range(footer.getColumnsCount())}
    assert out and all(x[0] == 1000 and x[2] == "ZSTD" for x in out)


# --- 3 -----------------------------------------------------------------------------------------------------------


def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")) if words else 0, len(lines) - len(set(lines)), len(covered)


def test_counts_as_written(odd):
    rng = random.Random(6)
    texts = [t for _, t in TEXTS] + ["".join(rng.choices(["a", "b ", "a b c ", "\n", "é", "#", "|", "\x1c", "\x85", "\xa0", "\t"], k=rng.randint(0, 40))) for _ in range(3000)]
    for t in texts:
        assert quality_rules.text_stats((t or "").encode())[:5] == plain_stats(t), t
    ids_ = np.random.default_rng(1).integers(0, 30, 5000)
    small, large = quality_rules._repeated(ids_, 30), quality_rules._repeated(ids_, 2**22)
    assert small == large == plain_stats(" ".join(map(str, ids_)))[4]


def test_rules_on_odd_documents(odd, empty):
    out = quality_rules.score_quality(odd)
    rows = out.collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        n = plain_stats(r["text"])
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r["base_failed"] and r["kept"]) and 0 <= r["quality"] <= 1
    assert quality_rules.score_quality(empty).count() == 0 and quality_rules.keep_good(empty).count() == 0
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns
    assert kept.count() == sum(r["kept"] for r in rows)
    assert not bag(kept, *others(odd)) - bag(odd, *others(odd))


def test_votes_are_weighed():
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.8
    patterns = collections.Counter()
    accuracy = [(0.9, 0.95), (0.7, 0.99), (0.6, 0.9), (0.8, 0.97)]  # on bad and on good documents
    for g in good:
        patterns[tuple(1 if rng.random() < 0.2 else (2 if (rng.random() < a[1]) == 1 else 0) if g else (0 if rng.random() < a[0] else 2) for a in accuracy)] += 1
    share, p = quality_rules.fit_votes(patterns)
    assert abs(share - 0.8) < 0.03
    for (bad, ok), (x, y) in zip(accuracy, p):
        assert abs(x[0] / (x[0] + x[2]) - bad) < 0.06 and abs(y[2] / (y[0] + y[2]) - ok) < 0.03
    assert quality_rules.fit_votes({}) == (0.5, [])


def test_rules_keep_clean_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    out = quality_rules.op3_quality_rules(spark, SF).toPandas().set_index("doc_id").join(labels.rename("label"), how="inner")
    good, bad = out[(out.label == 1) & ~out.base_failed], out[out.label == 0]
    assert good.kept.mean() > 0.97 and bad.kept.mean() < 0.2


# --- 1 and 4 -----------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op1_toxicity(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    for i, r in list(got.iterrows())[:50]:
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")
    held = got[got.held_out].join(labels, how="inner")
    assert (held.predicted == held.toxic).mean() > 0.95 and held[held.toxic == 0].predicted.mean() < 0.01


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = quality_cnn.op4_quality_classifier(spark, sf).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")
    held = got[got.held_out].join(labels, how="inner")
    assert (held.predicted == held.quality).mean() > 0.96 and held[held.quality == 1].predicted.mean() > 0.98


def test_classifiers_on_odd_documents(odd, empty):
    model = toxicity.fit([(np.unique(toxicity.features(t.encode())).astype(np.int64), y) for t, y in [("you stupid thing", 1), ("a fine day", 0)] * 30], epochs=3)
    net = quality_cnn.fit([(b"clean prose text", 1), (b"##!!##!!##", 0)] * 40, epochs=3)
    for out in (toxicity.score_toxicity(odd, model), quality_cnn.score_quality(odd, net)):
        rows = out.collect()
        assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if not r["text"]}) == 1
    assert toxicity.score_toxicity(empty, model).count() == 0 and quality_cnn.score_quality(empty, net).count() == 0
    assert toxicity.fit([])[2] == 0 and len(toxicity.fit([])[0]) == 0
    assert quality_cnn.probability(quality_cnn.fit([]), b"x") == 0.5
    assert quality_cnn.probability(quality_cnn.fit([(b"x", 1)]), b"x") > 0.9


def test_network_parts_agree(monkeypatch):
    net = quality_cnn.init()
    texts = [b"", b"x", b"y" * 15, b"z" * 16, b"w" * 33, LONG.encode(), None, prose(3, 500).encode()]
    want = [quality_cnn.probability(net, t) for t in texts]
    assert np.allclose(quality_cnn.probabilities(net, texts), want, atol=1e-6)
    monkeypatch.setattr(quality_cnn, "SLICE", 64)
    assert np.allclose([quality_cnn.probability(net, t) for t in texts], want, atol=1e-6)
    monkeypatch.undo()
    text = prose(9, 300).encode()  # every byte is in a chunk that overlaps the next
    changed = sum(quality_cnn.pooled(net, quality_cnn.blocks(text[:i] + b"\xff" * 8 + text[i + 8 :]))[0].tolist() != quality_cnn.pooled(net, quality_cnn.blocks(text))[0].tolist() for i in range(0, len(text) - 8, 97))
    assert changed > 0


# --- 6 -----------------------------------------------------------------------------------------------------------


def test_hits_on_odd_documents(spark, odd, empty):
    passage = prose(4, 80)[20:300]
    bench = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "no such passage anywhere in these documents at all")], "item_id bigint, text string")
    out = decontaminate.with_hits(odd, bench)
    assert {r["doc_id"] for r in out.where("size(hits) > 0").collect()} == {3}
    hit = out.where("size(hits) > 0").first()["hits"][0]
    assert (hit["item_id"], hit["start"], hit["end"], hit["edits"]) == (1, 20, 300, 0)
    kept = decontaminate.keep_clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(TEXTS) - 1
    assert decontaminate.with_hits(empty, bench).count() == 0
    assert decontaminate.keep_clean(odd, bench.limit(0)).count() == len(TEXTS)


def test_benchmark_in_blocks(spark, odd, monkeypatch):
    bench = spark.createDataFrame([(i, prose(2, 120)[i * 50 : i * 50 + 120]) for i in range(6)], "item_id bigint, text string")
    whole = decontaminate.with_hits(odd, bench).selectExpr("doc_id", "explode(hits) AS h").select("doc_id", "h.*")
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", ("item_id", "text", 200))
    parts = decontaminate.with_hits(odd, bench).selectExpr("doc_id", "explode(hits) AS h").select("doc_id", "h.*")
    assert bag(whole, *whole.columns) == bag(parts, *parts.columns) and whole.count() >= 12


# --- 10 ----------------------------------------------------------------------------------------------------------


def test_redaction(odd, empty):
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    want = collections.Counter()
    for i, t in TEXTS:
        new = t.replace("a.b@mail.example.com", "[EMAIL]").replace("4111 1111 1111 1111", "[CARD]") if t else t
        want[(i, new, None if t is None else len(new))] += 1
    assert bag(out, "doc_id", "text", "n_chars") == want
    assert bag(out, *others(odd)) == bag(odd, *others(odd))
    assert pii.redact(empty).count() == 0


# --- 8 -----------------------------------------------------------------------------------------------------------


def brute_classes(rows, words=5, threshold=0.8):
    """(doc_id, class_id, n_links, n_class) of each row, all pairs compared."""

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())

    s, parent, links = [grams(t) for _, t in rows], list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or both and 5 * both >= 4 * (len(s[i]) + len(s[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    group = collections.defaultdict(list)
    for i in range(len(rows)):
        group[root(i)].append(rows[i][0])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in group.items()}
    return collections.Counter((rows[i][0], least[root(i)], links[i], len(group[root(i)])) for i in range(len(rows)))


def test_near_duplicates_on_odd_documents(odd, empty):
    out = near_dup.near_duplicates(odd)
    assert bag(out, "doc_id", "class_id", "n_links", "n_class") == brute_classes(TEXTS)
    assert near_dup.near_duplicates(empty).count() == 0
    kept = near_dup.keep_one(odd)
    assert kept.columns == odd.columns
    texts = [t for _, t in TEXTS]
    groups = sum(1 / n for (_, _, _, n), c in brute_classes(TEXTS).items() for _ in range(c))
    assert kept.count() == round(groups) and set(bag(kept, "text")) <= {(t,) for t in texts}
    again = near_dup.near_duplicates(kept)
    assert again.where("n_class > 1").count() == 0
    assert near_dup.keep_one(empty).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A group of near copies of one text far larger than a block, many pairs around the threshold, next to others."""
    rng, rows = random.Random(8), []
    base = prose(20, 150).split(" ")
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(100 + i, 60)) for i in range(30)] + [(2000 + i, prose(50, 40)) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = brute_classes(rows)
    assert bag(near_dup.near_duplicates(df, block=16), "doc_id", "class_id", "n_links", "n_class") == want
    assert bag(near_dup.near_duplicates(df), "doc_id", "class_id", "n_links", "n_class") == want
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", 20_000)
    assert bag(near_dup.near_duplicates(df), "doc_id", "class_id", "n_links", "n_class") == want


def test_near_duplicates_larger_than_a_block(spark, monkeypatch):
    """Two or three texts that are each larger than a block: some blocks have no text."""
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", 1000)
    rows = []
    for group in range(12):
        for i in range(2 + group % 2):
            rows.append((10 * group + i, prose(300 + group, 250) + f" end{i}"))
    assert all(len(t) > 1000 for _, t in rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    assert bag(near_dup.near_duplicates(df), "doc_id", "class_id", "n_links", "n_class") == brute_classes(rows)


def test_chains_are_connected(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5, 5)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in near_dup.connected(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert near_dup.connected(edges.limit(0)).count() == 0
