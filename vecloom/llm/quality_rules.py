"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import append, documents, unused

STATS = [
    ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"),
    ("n_lines", "bigint"), ("n_upper", "bigint"), ("n_lower", "bigint"), ("n_marks", "bigint"), ("n_bars", "bigint"), ("n_top_word", "bigint"),
    ("n_punct", "bigint"),
]

#: Symbols of the contract's n_symbols.
SYMBOLS = b"#*$%&|<>"
#: ASCII punctuation.
PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _repeated(ids, n_kinds: int):
    """Positions of words in 3-word windows that occur twice or more. Exact: windows are numbers of three ids, or of two where three don't fit 63 bits."""
    import numpy as np

    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    if n_kinds**3 < 2**63:
        key = (a * n_kinds + b) * n_kinds + c
    else:
        pair = np.unique(a * n_kinds + b, return_inverse=True)[1]
        key = pair * n_kinds + c
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(ids), bool)
    at = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    for k in range(3):
        twice[at + k] = True
    return int(twice.sum())


def text_stats(data: bytes) -> tuple[int, ...]:
    """STATS of one text's UTF-8 bytes."""
    import numpy as np

    words = data.split()  # at \\x20 and \\x09-\\x0D only
    if not words:
        return (0,) * len(STATS)
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = int(n[:0x80].sum() + n[0xC0:].sum())
    spaces = int(n[0x20] + n[9:14].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    known: dict[bytes, int] = {}
    put = known.setdefault
    ids = np.array([put(w, len(known)) for w in words], np.int64)
    return (
        len(words), chars - spaces, int(n[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), _repeated(ids, len(known)) if len(ids) > 2 else 0,
        len(lines), int(n[65:91].sum()), int(n[97:123].sum()), int(n[[33, 63]].sum()), int(n[124]), int(np.bincount(ids).max()),
        int(n[list(PUNCT)].sum()),
    )


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with STATS of the whole text; null and empty texts have zeros."""

    def make():
        import numpy as np
        import pyarrow as pa

        def apply(texts):
            rows = [text_stats(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
            return [pa.array(c) for c in np.array(rows, np.int64).reshape(-1, len(STATS)).T]

        return apply

    return append(docs, STATS, text, make)


def _vote(good: Column, bad: Column) -> Column:
    """0: bad, 2: good, 1: abstain."""
    return F.when(bad, 0).when(good, 2).otherwise(1)


def rules(c=F.col) -> list[tuple[str, Column]]:
    """Each rule's vote. Counts are compared without division, so that texts without words get votes too."""
    w, letters = c("n_words"), c("n_upper") + c("n_lower")
    return [
        ("length", _vote((w >= 100) & (w <= 20_000), w < 50)),
        ("word_length", _vote((2 * c("word_chars") >= 7 * w) & (c("word_chars") <= 8 * w), (c("word_chars") < 2 * w) | (c("word_chars") > 12 * w))),
        ("symbols", _vote(50 * c("n_symbols") <= w, 10 * c("n_symbols") > w)),
        ("repeats", _vote(10 * c("n_repeat_words") <= w, 4 * c("n_repeat_words") > w)),
        ("lines", _vote((c("n_dup_lines") == 0) & (c("n_lines") > 1), 10 * c("n_dup_lines") > 3 * c("n_lines"))),
        ("capitals", _vote(5 * c("n_upper") <= letters, 5 * c("n_upper") > 2 * letters)),
        ("marks", _vote(25 * c("n_marks") <= w, 10 * c("n_marks") > w)),
        ("bars", _vote(100 * c("n_bars") <= w, 10 * c("n_bars") > w)),
        ("punctuation", _vote(12 * c("n_punct") <= c("word_chars"), 6 * c("n_punct") > c("word_chars"))),
        ("top_word", _vote(5 * c("n_top_word") <= w, 10 * c("n_top_word") > 3 * w)),
    ]


def fit_votes(patterns: dict[tuple[int, ...], int], rounds: int = 100, smooth: float = 1.0) -> tuple[float, list[list[list[float]]]]:
    """(share of good documents, P(vote | class) of each rule) by expectation-maximisation over counted vote patterns.

    A rule's two rows say how often it votes bad, abstains and votes good on bad and on good documents: its
    accuracies by class. At first a document with a bad vote is bad with 0.9, without one good with 0.9. If the
    classes have changed sides at the end (rules vote good more on the bad class), they are swapped back.
    """
    import numpy as np

    if not patterns:
        return 0.5, []
    votes, n = np.array(list(patterns), np.int64), np.array(list(patterns.values()), float)
    good = np.where((votes == 0).any(1), 0.1, 0.9)
    rules = votes.shape[1]
    hot = np.stack([votes == v for v in range(3)], 2).reshape(len(votes), 3 * rules).astype(float)
    for _ in range(rounds):
        share = ((n * good).sum() + smooth) / (n.sum() + 2 * smooth)
        p = (np.stack([n * (1 - good), n * good]) @ hot).reshape(2, rules, 3) + smooth
        p /= p.sum(2, keepdims=True)
        log = np.log(p).reshape(2, -1) @ hot.T + np.log([[1 - share], [share]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        done, good = np.abs(new - good).max() < 1e-6, new
        if done:
            break
    if (p[1, :, 2] - p[1, :, 0]).sum() < (p[0, :, 2] - p[0, :, 0]).sum():
        share, p = 1 - share, p[::-1]
    return float(share), p.transpose(1, 0, 2).tolist()


def learn(docs: DataFrame, text: str = "text") -> tuple[float, list[list[list[float]]]]:
    """fit_votes over all documents: they are counted by vote pattern first, at most 3 to the power of the rules' number rows."""
    votes = [v for _, v in rules()]
    code = sum((v * 3**i for i, v in enumerate(votes)), F.lit(0))
    found = with_stats(docs.select(text), text).groupBy(code.alias("code")).count().collect()
    return fit_votes({tuple(r["code"] // 3**i % 3 for i in range(len(votes))): r["count"] for r in found})


def posterior(model: tuple[float, list[list[list[float]]]], c=F.col) -> Column:
    """Probability that a document is good, given its votes: a sum of log odds."""
    share, p = model
    odds = F.lit(math.log(share / (1 - share)))
    for (_, vote), (bad, good) in zip(rules(c), p):
        odds += F.element_at(F.array(*(F.lit(math.log(g / b)) for b, g in zip(bad, good))), vote + 1)
    return 1 / (1 + F.exp(-odds))


def base_failed(c=F.col) -> Column:
    return (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))


def score_quality(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with STATS, base_failed, quality (the posterior) and kept: not base_failed and quality >= threshold.

    Texts are read twice: once for the counts of vote patterns over all documents, once for the verdicts. Null and
    empty texts have no words and fail. Equal texts get equal verdicts; an empty table stays empty. Columns of docs
    named as the new ones are replaced.
    """
    model = learn(docs, text)
    out = with_stats(docs, text)
    new = {"base_failed": base_failed(), "quality": posterior(model) if model[1] else F.lit(0.5)}
    out = out.drop(*(c for c in out.columns if c.lower() in ("base_failed", "quality", "kept")))
    return out.withColumns(new).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that are kept, with the columns of docs only."""
    from pyspark.sql import types as T

    # A copy of the text under a name of its own carries the statistics past any columns of docs with their names.
    box = unused(docs, "document_")
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(box), F.col(f"`{text}`").alias("text_"))
    assert isinstance(inner.schema[box].dataType, T.StructType)
    return score_quality(inner, "text_", threshold).where("kept").select(f"{box}.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's counts and verdicts of all documents, with the posterior."""
    out = score_quality(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
