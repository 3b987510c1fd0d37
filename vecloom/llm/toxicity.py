"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import append, crc_fold, documents, labelled_sample

#: Size of the hashed feature space.
BITS = 18
#: Labelled documents of each class that are learned from, at most.
PER_CLASS = 3000
EPOCHS = 6

#: ASCII letters in lower case and digits stay, other ASCII bytes part words; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def features(data: bytes, bits: int = BITS):
    """Hashed places of a text's words, word pairs and pairs with one word between them (repeats not yet removed)."""
    import zlib

    import numpy as np

    words = data.translate(_FOLD).split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    one, two = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    shift = np.uint64(64 - bits)
    a = h * one
    return np.concatenate([a, a[:-1] * np.uint64(3) + h[1:] * two, a[:-2] * np.uint64(5) + h[2:] * two + np.uint64(0x165667B19E3779F9)]) >> shift


class Ftrl:
    """FTRL-proximal: rates fall per coordinate with its gradients, L1 keeps rare and useless coordinates at zero."""

    def __init__(self, bits: int = BITS, alpha: float = 0.7, beta: float = 1.0, l1: float = 10.0, l2: float = 0.0):
        import numpy as np

        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at):
        import numpy as np

        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0, self.l1)  # the last coordinate is the intercept
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at, y: int) -> None:
        import numpy as np

        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def sparse(self):
        """(places, weights, intercept) of the coordinates that aren't zero."""
        import numpy as np

        w = self.weights(np.arange(len(self.z)))
        at = np.flatnonzero(w[:-1])
        return at.astype(np.int64), w[at].astype(np.float32), float(w[-1])


def fit(rows: list[tuple], bits: int = BITS, epochs: int = EPOCHS, seed: int = 3):
    """Weights from (places without repeats, y) rows, shuffled anew each epoch. Without rows: an intercept of 0."""
    import numpy as np

    model, rng = Ftrl(bits), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            model.learn(*rows[i])
    return model.sparse()


def learn(sample: DataFrame, bits: int = BITS):
    """fit on a bounded (text, y) sample. Workers hash the texts; the driver gets the places, in order of the ids."""

    def make():
        import numpy as np
        import pyarrow as pa

        return lambda texts: [pa.array([np.unique(features(t, bits)).astype(np.int32) for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.int32()))]

    import numpy as np

    table = append(sample, [("at", "array<int>")], "text", make).select("doc_id", "y", "at").toArrow().sort_by("doc_id")
    at = table.column("at").combine_chunks()
    if not len(table):
        return fit([], bits)
    flat, ends = at.values.to_numpy(), at.offsets.to_numpy()
    return fit([(flat[a:b].astype(np.int64), y) for a, b, y in zip(ends[:-1], ends[1:], table.column("y").to_pylist())], bits)


def score_toxicity(docs: DataFrame, model, text: str = "text", out: str = "score", bits: int = BITS) -> DataFrame:
    """docs with the probability of label 1 for each whole text; null and empty texts get the intercept's alone.

    A feature counts once however often a text has it. Equal texts get equal scores; an empty table stays empty.
    The weights are broadcast: at most 2^bits numbers, in fact the few that L1 leaves.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        import numpy as np
        import pyarrow as pa

        places, weights, bias = shared.value
        dense = np.zeros(1 << bits, np.float32)
        dense[places] = weights

        def one(data: bytes | None) -> float:
            at = features(data or b"", bits)
            at = np.unique(at[dense[at] != 0])
            return float(1 / (1 + np.exp(-np.clip(bias + dense[at].sum(dtype=np.float64), -35, 35))))

        return lambda texts: [pa.array([one(t) for t in texts.cast(pa.binary()).to_pylist()], pa.float64())]

    return append(docs, [(out, "double")], text, make)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; rows whose crc32 of the id modulo 5 is 0 are held out."""
    model = learn(labelled_sample(spark, sf_dir, "toxic", (5, 0), PER_CLASS))
    return score_toxicity(documents(spark, sf_dir).select("doc_id", "text"), model).select(
        "doc_id", (crc_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
