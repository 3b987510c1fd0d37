import collections

import pytest
from odd import TEXTS, bag, frame
from test_operators import brute_classes, check_packed, plain_stats

import corpus_pipeline
from vecloom.llm import pii, quality_rules
from vecloom.llm.decontaminate import Index

SF = "/root/testdata/sf0.001"


def brute(rows, benchmark):
    """The stages over (doc_id, text) rows, without Spark and without candidate search."""
    stats = [dict(zip((n for n, _ in quality_rules.STATS), quality_rules.text_stats((t or "").encode()))) for _, t in rows]
    votes = [_votes(s) for s in stats]
    share, p = quality_rules.fit_votes(collections.Counter(votes))
    kept = []
    for row, s, v in zip(rows, stats, votes):
        good, bad = share, 1 - share
        for i, x in enumerate(v):
            good, bad = good * p[i][1][x], bad * p[i][0][x]
        n = plain_stats(row[1])
        if not (n[0] < 50 or 100 * n[4] > 50 * n[0]) and good >= bad:
            kept.append(row)
    rows = sorted(set(kept), key=lambda r: (r[0] is None, r[0] or 0))
    out, gone = [], set()
    for i, row in enumerate(rows):
        if i in gone:
            continue
        out.append(row)
        todo = [i]
        while todo:
            a = todo.pop()
            for j in range(len(rows)):
                if j not in gone and j != i and j != a and _near(rows[a][1], rows[j][1]):
                    gone.add(j)
                    todo.append(j)
    index = Index(benchmark)
    clean = [r for r in out if not any(_least(a.tolist(), r[1]) <= e for (_, a), e in zip(index.items, index.edits))]
    model = pii.fit()
    done = []
    for i, t in clean:
        at, new = 0, ""
        for kind, a, b, _ in sorted(pii.find([t.encode()], *model)[0], key=lambda s: (s[1], -s[2])):
            if a >= at:
                new += t[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        done.append((i, new + t[at:]))
    return done


def _votes(s):
    w, letters = s["n_words"], s["n_upper"] + s["n_lower"]
    v = lambda good, bad: 0 if bad else 2 if good else 1
    return (
        v(100 <= w <= 20_000, w < 50), v(2 * s["word_chars"] >= 7 * w and s["word_chars"] <= 8 * w, s["word_chars"] < 2 * w or s["word_chars"] > 12 * w), v(50 * s["n_symbols"] <= w, 10 * s["n_symbols"] > w),
        v(10 * s["n_repeat_words"] <= w, 4 * s["n_repeat_words"] > w), v(s["n_dup_lines"] == 0 and s["n_lines"] > 1, 10 * s["n_dup_lines"] > 3 * s["n_lines"]), v(5 * s["n_upper"] <= letters, 5 * s["n_upper"] > 2 * letters),
        v(25 * s["n_marks"] <= w, 10 * s["n_marks"] > w), v(100 * s["n_bars"] <= w, 10 * s["n_bars"] > w), v(12 * s["n_punct"] <= s["word_chars"], 6 * s["n_punct"] > s["word_chars"]), v(5 * s["n_top_word"] <= w, 10 * s["n_top_word"] > 3 * w),
    )


def _near(a, b):
    return next(iter(brute_classes([(1, a), (2, b)])))[2] == 1


def _least(item, text):
    """Least edits that turn the passage into a part of the text, by numpy over the text."""
    import numpy as np

    from vecloom.llm.decontaminate import code_points

    t = code_points(text)
    row, step = np.zeros(len(t) + 1, np.int64), np.arange(len(t) + 1)
    for i, c in enumerate(item, 1):
        new = np.concatenate([[i], np.minimum(row[:-1] + (t != c), row[1:] + 1)])
        row = np.minimum.accumulate(new - step) + step
    return int(row.min())


def test_run_is_the_brute_force_result(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    want = brute(docs, items)
    assert 100 < len(want) < len(docs)
    check_packed(corpus_pipeline.run(spark, SF).collect(), want, 2048, 1)


def test_stages_return_the_columns_of_documents(spark):
    docs = frame(spark).select("doc_id", "text", "lang", "source", "n_chars", "score", "h1", "spans").repartition(2).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert not bag(out, "doc_id", "lang", "source", "score", "h1", "spans") - bag(docs, "doc_id", "lang", "source", "score", "h1", "spans")
    assert stage.__name__ == "pii" and corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(TEXTS)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_no_documents(spark, k):
    assert corpus_pipeline.STAGES[k][1](spark, frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars"), SF).count() == 0


def test_result_holds_the_redacted_texts(spark):
    from vecloom.llm.tokens import tokenizer_path

    words = " ".join(f"word{i}" for i in range(60))
    docs = frame(spark, [(1, f"{words} a.b@mail.example.com"), (2, None)])
    out = corpus_pipeline.packing(spark, corpus_pipeline.pii(spark, docs, SF), SF)
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer_path())
    got = {r["doc_id"]: memoryview(bytes(r["ids"])).cast("I").tolist() for r in out.collect()}
    assert got == {1: [*tokenizer.encode(f"{words} [EMAIL]", add_special_tokens=False).ids, 1], 2: [1]}
