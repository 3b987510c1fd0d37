import collections
import random

import numpy as np
from odd import bag, prose
from test_operators import brute_classes

from vecloom.llm import near_dup


def test_shortest_prefix():
    k = near_dup.shortest_prefix()
    assert 1 - (1 - near_dup.THRESHOLD**k) ** near_dup.TREES >= near_dup.RECALL > 1 - (1 - near_dup.THRESHOLD ** (k + 1)) ** near_dup.TREES
    assert near_dup.shortest_prefix(0.5, 0.9, 64, 3) == 3 and near_dup.shortest_prefix(1.0) == 1


def changed(rng, words, n):
    w = list(words)
    for i in rng.sample(range(0, len(w) - 5, 5), n):
        w[i + rng.randrange(5)] = f"w{rng.randrange(10**9)}"
    return w


def similarity(a, b):
    grams = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b)]
    return len(grams[0] & grams[1]) / len(grams[0] | grams[1])


def test_recall_of_lone_pairs_at_the_threshold(spark):
    """400 pairs of similarity 0.8 to 0.84, each without other near texts: all but one in a thousand are found."""
    rng, rows, want = random.Random(3), [], 0
    while want < 400:
        words = [f"v{rng.randrange(5000)}" for _ in range(200)]
        other = changed(rng, words, 4)
        if 0.8 <= similarity(words, other) < 0.84:
            rows += [(2 * want, " ".join(words)), (2 * want + 1, " ".join(other))]
            want += 1
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert got.where("n_links = 1 AND n_class = 2").count() >= 2 * want * 0.999


def texts_of(spark, rows):
    """(h1, labels, sketch) as the forest gets them."""
    sets = [near_dup.shingles(t.encode()) for _, t in rows]
    found = near_dup.signatures(sets, near_dup.TREES, near_dup.DEPTH)
    return spark.createDataFrame([(i, [bytes(x) for x in labels], sketch) for (i, _), (labels, sketch) in zip(rows, found)], "h1 bigint, labels array<binary>, sketch binary")


def test_texts_of_one_template_are_not_tied(spark):
    """600 texts that share two thirds of their words, similarity about 0.5: they collide in many nodes, but hardly any is compared."""
    rng = random.Random(4)
    template = [f"t{rng.randrange(5000)}" for _ in range(160)]
    rows = []
    for i in range(600):
        own = [f"o{rng.randrange(10**9)}" for _ in range(78)]
        rows.append((i, " ".join(template + own)))
    a, b = rows[0][1].split(), rows[1][1].split()
    assert 0.45 < similarity(a, b) < 0.55
    ties = near_dup.forest(texts_of(spark, rows), near_dup.TREES, near_dup.DEPTH, 0.8, 0.9999).distinct().collect()
    assert len({x for t in ties for x in t}) < 60
    shared = collections.Counter(label[: 2 * near_dup.shortest_prefix()] + bytes([t]) for r in texts_of(spark, rows).collect() for t, label in enumerate(r["labels"]))
    assert max(shared.values()) > 5  # without the sketches these would be one group


def test_prefixes_are_shortened_where_recall_asks(spark):
    """Close copies are settled at whole signatures; a pair at the threshold goes on to shorter prefixes."""
    rng = random.Random(5)
    one = [f"v{rng.randrange(5000)}" for _ in range(400)]
    close = [" ".join(one + [f"e{i}"]) for i in range(3)]
    found = near_dup.signatures([near_dup.shingles(t.encode()) for t in close], 32, 8)
    sketch = np.frombuffer(b"".join(s for _, s in found), np.uint64).reshape(3, -1)
    ties, there, got = near_dup.below_nodes(np.zeros(3, np.int64), np.full(3, -1), np.arange(3), sketch, 8, 32, 256, 0.8)
    assert len(ties) == 2 and (got >= near_dup.RECALL * there).all() and (there > 0).all()
    pair = np.frombuffer(bytes(128) + (b"\x11" * 26 + bytes(102)), np.uint64).reshape(2, -1)  # 52 of 256 values differ
    ties, there, got = near_dup.below_nodes(np.zeros(2, np.int64), np.full(2, -1), np.arange(2), pair, 8, 32, 256, 0.8)
    assert len(ties) == 1 and (got < near_dup.RECALL * there).all()
    far = np.frombuffer(bytes(128) + b"\x11" * 128, np.uint64).reshape(2, -1)
    assert near_dup.below_nodes(np.zeros(2, np.int64), np.full(2, -1), np.arange(2), far, 8, 32, 256, 0.8)[0] == []


def test_large_nodes_in_blocks_and_mixed_similarities(spark, monkeypatch):
    rng = random.Random(6)
    base, rows = prose(20, 150).split(" "), []
    for i in range(150):
        rows.append((i, " ".join(changed(rng, base, rng.choice([0, 1, 1, 2, 3, 5])))))
    rows += [(1000 + i, prose(400 + i, 70)) for i in range(40)]
    df, want = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), brute_classes(rows)
    assert bag(near_dup.near_duplicates(df), "doc_id", "class_id", "n_links", "n_class") == want
    monkeypatch.setattr(near_dup, "NODE_TEXTS", 20)
    assert bag(near_dup.near_duplicates(df), "doc_id", "class_id", "n_links", "n_class") == want


def test_estimates_follow_similarity():
    rng = random.Random(7)
    words = [f"v{rng.randrange(5000)}" for _ in range(400)]
    for n in (0, 2, 6, 20):
        other = changed(rng, words, n)
        sketches = [np.frombuffer(s, np.uint64)[None] for _, s in near_dup.signatures([near_dup.shingles(" ".join(w).encode()) for w in (words, other)], 32, 8)]
        assert abs(near_dup.estimates(*sketches, 256)[0] - similarity(words, other)) < 0.12


def test_many_rows_of_two_texts_with_null_ids(spark):
    """One row of each text is compared, whatever the ids."""
    a, b = prose(1, 100), prose(1, 98) + " x y"
    df = spark.createDataFrame([(None, a if i % 2 else b) for i in range(4000)], "doc_id bigint, text string").repartition(4)
    got = near_dup.near_duplicates(df)
    assert bag(got, "doc_id", "class_id", "n_links", "n_class") == {(None, None, 3999, 4000): 4000}
    assert near_dup.keep_one(df).count() == 1
