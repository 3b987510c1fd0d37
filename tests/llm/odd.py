"""Documents as no one would wish them: nulls everywhere, empty, blank and very long texts, repeated rows, ties, clashing names."""

from __future__ import annotations

import collections
import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (". " if rng.random() < 0.05 else "") for _ in range(n))


LONG = prose(1, 60_000)
TEXTS = [
    (1, prose(2, 120)), (2, prose(2, 120)), (3, prose(2, 118) + " two others"), (3, prose(4, 80)), (4, ""), (5, None), (None, None), (None, prose(5, 90)), (None, prose(5, 90)), (6, " \n\t "), (7, LONG), (8, LONG + " end"),
    (9, "one two three"), (10, "one two three"), (11, "one  two\nthree"), (12, "x"), (13, prose(6, 70) + " write to a.b@mail.example.com or 4111 1111 1111 1111"), (13, prose(6, 70) + " write to a.b@mail.example.com or 4111 1111 1111 1111"),
    (14, "<|endoftext|> é́ \U0001f600  中文 \x00 \x1c"), (15, "\n\n\n"),
]
#: Names that the operators use themselves.
CLASH = ["score", "Kept", "hits", "spans", "n_words", "shard", "slot", "h1", "H2", "document_", "text_", "cell", "redacted", "class_id", "first", "quality", "id_", "key_", "n_tokens", "keys", "label", "n"]


def frame(spark, rows=TEXTS):
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(i, t, None, "s" if i else None, None if t is None else len(t), *[f"{c} {i}" for c in CLASH]) for i, t in rows], kinds)


def bag(df, *names):
    return collections.Counter(tuple(r) for r in df.select(*names).collect())
