"""Document quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import append, crc_fold, documents, labelled_sample

#: Bytes of half a chunk: chunks of 2 * HALF bytes start at every HALF-th byte, so they overlap and cover the whole text.
HALF = 16
EMBED = 8
FILTERS = 48
#: Labelled documents of each class that are learned from, at most.
PER_CLASS = 2000
EPOCHS = 8
#: Bytes that are embedded at once; longer texts are taken in parts with a running maximum.
SLICE = 1 << 18


def init(seed: int = 5) -> dict:
    """Start values: embeddings of the 256 bytes and of padding, filters for the two halves of a chunk, the combination."""
    import numpy as np

    rng = np.random.default_rng(seed)
    scale = (2 / (2 * HALF * EMBED)) ** 0.5
    return {
        "embed": rng.normal(0, 1, (257, EMBED)).astype(np.float32),
        "filters": rng.normal(0, scale, (HALF * EMBED, 2 * FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.1, FILTERS).astype(np.float32),
        "offset": np.zeros(1, np.float32),
    }


def blocks(data: bytes):
    """The text in rows of HALF bytes, padded with 256, at least two rows. A chunk is two rows in sequence."""
    import numpy as np

    rows = max(2, -(-len(data) // HALF))
    out = np.full(rows * HALF, 256, np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(rows, HALF)


def pooled(model: dict, rows):
    """(maximum over all chunks of each filter, the chunk it comes from)."""
    import numpy as np

    step = SLICE // HALF
    best, where = None, None
    for s in range(0, len(rows) - 1, step):
        part = model["embed"][rows[s : s + step + 1]].reshape(-1, HALF * EMBED) @ model["filters"]
        z = part[:-1, :FILTERS] + part[1:, FILTERS:]
        at = z.argmax(0)
        top = z[at, np.arange(FILTERS)]
        if best is None:
            best, where = top, at
        else:
            better = top > best
            best, where = np.where(better, top, best), np.where(better, at + s, where)
    return best + model["bias"], where


def probability(model: dict, data: bytes | None) -> float:
    import numpy as np

    h = np.maximum(pooled(model, blocks(data or b""))[0], 0)
    return float(1 / (1 + np.exp(-np.clip(h @ model["out"] + model["offset"][0], -30, 30))))


def probabilities(model: dict, texts: list[bytes | None]) -> list[float]:
    """As probability, many texts in one pass: chunks that would span two texts are left out of the maximum."""
    import numpy as np

    out, i = [], 0
    while i < len(texts):
        some, size = [], 0
        while i < len(texts) and (not some or size + len(texts[i] or b"") <= SLICE):
            some.append(blocks(texts[i] or b""))
            size += len(texts[i] or b"")
            i += 1
        if len(some) == 1:
            top = pooled(model, some[0])[0][None]
        else:
            ends = np.cumsum([len(x) for x in some])
            part = model["embed"][np.concatenate(some)].reshape(-1, HALF * EMBED) @ model["filters"]
            z = part[:-1, :FILTERS] + part[1:, FILTERS:]
            z[ends[:-1] - 1] = -np.inf
            top = np.maximum.reduceat(z, np.concatenate([[0], ends[:-1]]), axis=0) + model["bias"]
        logit = np.maximum(top, 0) @ model["out"] + model["offset"][0]
        out += (1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))).tolist()
    return out


def gradient(model: dict, x, y: int, weight: float, g: dict) -> None:
    """Adds to g the gradient of weight times the log loss for blocks x and label y: only the chunks that win the maximum have one."""
    import numpy as np

    top, at = pooled(model, x)
    h = np.maximum(top, 0)
    p = 1 / (1 + np.exp(-np.clip(h @ model["out"] + model["offset"][0], -30, 30)))
    d = weight * (p - y)
    g["out"] += d * h
    g["offset"] += d
    dz = (d * model["out"] * (top > 0)).astype(model["out"].dtype)
    g["bias"] += dz
    for half in (0, 1):
        chunk = x[at + half]
        e = model["embed"][chunk].reshape(FILTERS, -1)
        cols = slice(half * FILTERS, (half + 1) * FILTERS)
        g["filters"][:, cols] += e.T * dz
        np.add.at(g["embed"], chunk, (model["filters"][:, cols].T * dz[:, None]).reshape(FILTERS, HALF, EMBED))


def fit(rows: list[tuple[bytes, int]], epochs: int = EPOCHS, batch: int = 32, rate: float = 3e-3, seed: int = 5) -> dict:
    """Adam on the log loss of (text, label) rows, classes weighed alike; only the chunks that win the maximum get gradients.

    Without rows of both classes the network says the share of label 1 (a half without rows).
    """
    import numpy as np

    model = init(seed)
    share = sum(y for _, y in rows) / len(rows) if rows else 0.5
    if share in (0, 1) or not rows:
        model["out"][:] = 0
        model["offset"][:] = {0: -3.0, 1: 3.0}.get(share, 0.0)
        return model
    weight = {1: 0.5 / share, 0: 0.5 / (1 - share)}
    data, rng = [(blocks(t), y) for t, y in rows], np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(x) for k, x in model.items()}, {k: np.zeros_like(x) for k, x in model.items()}, 0
    total = epochs * -(-len(data) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for i in range(0, len(order), batch):
            g = {k: np.zeros_like(x) for k, x in model.items()}
            for j in order[i : i + batch]:
                x, y = data[j]
                gradient(model, x, y, weight[y] / batch, g)
            step += 1
            now = rate * (1 - 0.9 * step / total)
            for k in model:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                model[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def learn(sample: DataFrame, **options) -> dict:
    """fit on a bounded (doc_id, text, y) sample, in order of the ids."""
    rows = sorted((r["doc_id"], r["text"], r["y"]) for r in sample.select("doc_id", "text", "y").toLocalIterator())
    return fit([(t.encode(), y) for _, t, y in rows], **options)


def score_quality(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of label 1 for each whole text, to five places; a null or empty text is two blocks of padding.

    Equal texts get equal scores up to that rounding, whatever texts are computed with them; an empty table stays empty; the model is a few dozen kB, whatever the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        import pyarrow as pa

        return lambda texts: [pa.array([round(p, 5) for p in probabilities(shared.value, texts.cast(pa.binary()).to_pylist())], pa.float64())]

    return append(docs, [(out, "double")], text, make)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; rows whose crc32 of the id modulo 4 is 2 are held out."""
    model = learn(labelled_sample(spark, sf_dir, "quality", (4, 2), PER_CLASS))
    return score_quality(documents(spark, sf_dir).select("doc_id", "text"), model).select(
        "doc_id", (crc_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
