"""A quality classifier by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkmill.llm.common import WordHashes, bounded_batches, carried, thrifty, written

PASSAGE_WORDS = 64
WORD_BINS = 64
#: Labelled documents, at most, that the model is fitted on: those first by a hash of their id.
SAMPLE = 4_000
#: Passages, at most, that these documents may have together: one that doesn't fit what is left is passed over.
SAMPLE_PASSAGES = 80_000
FEATURES = 128 + 8 + WORD_BINS


def held_out(key: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def passages(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the number of passages of each text (one at least).

    A passage is 64 words in sequence, the last may be shorter; an empty text has one empty passage.
    Features: shares of the ASCII characters, of other bytes, of words that repeat the word before
    or an earlier word of the passage, of words by first and last letter's kind, lengths, and hashed words.
    """
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words])
    count = np.maximum(1, -(-n // PASSAGE_WORDS))
    first = np.cumsum(count) - count
    total = int(count.sum())
    flat = [x for w in words for x in w]
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(first, n) + place // PASSAGE_WORDS
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    raw = np.frombuffer(b"".join(flat), np.uint8)
    chars = np.minimum(raw, 128).astype(np.int64)
    x = np.bincount(np.repeat(at, size) * 129 + chars, minlength=total * 129).reshape(total, 129).astype(np.float32)
    n_words = np.maximum(np.bincount(at, minlength=total), 1).astype(np.float32)
    n_chars = np.maximum(x.sum(axis=1), 1)
    share = lambda flags: np.bincount(at, weights=flags, minlength=total) / n_words
    h = hashes.of(flat)
    again = np.zeros(len(flat))
    again[1:] = (h[1:] == h[:-1]) & (at[1:] == at[:-1])
    order = np.lexsort((h, at))
    earlier = np.zeros(len(flat))
    earlier[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (at[order[1:]] == at[order[:-1]])
    ends = np.cumsum(size)
    upper = lambda c: (c >= 65) & (c <= 90)
    letter = lambda c: upper(c) | ((c >= 97) & (c <= 122)) | (c >= 128)
    a, z = (raw[ends - size], raw[ends - 1]) if len(flat) else (raw, raw)
    more = [
        share(again), share(earlier), share(upper(a)), share(upper(z)), share(~letter(a)), share(~letter(z)),
        n_chars / n_words / 10, np.log1p(n_words) / 5
    ]
    bins = np.bincount(
        at * WORD_BINS + (h >> np.uint64(40)).astype(np.int64) % WORD_BINS, minlength=total * WORD_BINS
    ).reshape(total, WORD_BINS) / n_words[:, None]
    x = np.sqrt(x / n_chars[:, None])[:, :128]
    return np.concatenate([x, np.stack(more, axis=1), bins], axis=1).astype(np.float32), count


class GatedAttention:
    """h = tanh(W x) encodes a passage; its weight is the softmax, over the document's passages, of
    w . (tanh(V h) * sigmoid(U h)); the score is the sigmoid of c . (the weighted sum of h) + b."""

    SHAPES = {"W": (FEATURES + 1, 32), "V": (32, 16), "U": (32, 16), "w": (16,), "c": (32,), "b": ()}

    def __init__(self, parts: dict | None = None, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = parts or {
            k: r.normal(0, 1 / np.sqrt(s[0]) if s else 0, s) for k, s in self.SHAPES.items()
        } | {"mean": np.zeros(FEATURES), "scale": np.ones(FEATURES)}

    def forward(self, x: np.ndarray, count: np.ndarray):
        p, first = self.p, np.cumsum(count) - count
        x = np.concatenate([(x - p["mean"]) / p["scale"], np.ones((len(x), 1))], axis=1)
        h = np.tanh(x @ p["W"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
        a = e / np.repeat(np.add.reduceat(e, first), count)
        z = np.add.reduceat(a[:, None] * h, first)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return y, (x, h, v, u, a, z)

    def gradients(self, x, count, label):
        p = self.p
        y, (x, h, v, u, a, z) = self.forward(x, count)
        d = (y - label) / len(label)
        dz = np.repeat(d[:, None] * p["c"], count, axis=0)
        da = (dz * h).sum(axis=1)
        first = np.cumsum(count) - count
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), count))
        g = de[:, None] * p["w"]
        dv, du = g * u * (1 - v**2), g * v * u * (1 - u)
        dh = a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T
        return {"W": x.T @ (dh * (1 - h**2)), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ de, "c": z.T @ d, "b": d.sum()}

    def fit(
        self, x: np.ndarray, count: np.ndarray, label: np.ndarray, steps: int = 1500, batch: int = 64,
        rate: float = 3e-3, decay: float = 1e-3
    ) -> GatedAttention:
        """Adam on the cross-entropy of the documents' labels."""
        slices = [slice(i, i + 4096) for i in range(0, len(x), 4096)]  # sums by slices: no copy of all of x
        self.p["mean"] = sum(x[s].sum(axis=0, dtype=float) for s in slices) / len(x)
        spread = sum(((x[s] - self.p["mean"]) ** 2).sum(axis=0) for s in slices) / len(x)
        self.p["scale"] = np.sqrt(spread) + 0.02
        r, first = np.random.default_rng(11), np.cumsum(count) - count
        m = {k: np.zeros(s) for k, s in self.SHAPES.items()}
        s2 = {k: np.zeros(s) for k, s in self.SHAPES.items()}
        t, epochs = 0, max(2, round(steps / -(-len(label) // batch)))
        for epoch in range(epochs):
            order = r.permutation(len(label))
            for i in range(0, len(order), batch):
                docs = order[i : i + batch]
                rows = np.concatenate([np.arange(first[d], first[d] + count[d]) for d in docs])
                g = self.gradients(x[rows], count[docs], label[docs])
                t += 1
                for k, v in g.items():
                    v = v + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s2[k] = 0.999 * s2[k] + 0.001 * v**2
                    self.p[k] = self.p[k] - rate * 0.03 ** (epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s2[k] / (1 - 0.999**t)) + 1e-8)
        return self


def within_bound(sizes: list[tuple[int, int, int]], most: int) -> list[int]:
    """The keys, of (key, label, passages) in their order, that together have `most` passages at most.

    The smallest document of each label comes first, so that both are there; one that doesn't fit what is left is passed
    over, and those after it are still looked at."""
    smallest = [min((x for x in sizes if x[1] == y), key=lambda x: x[2], default=None) for y in (0, 1)]
    if None in smallest:
        return []
    if sum(x[2] for x in smallest) > most:
        raise ValueError(f"no document of each label fits {most} passages: raise most_passages")
    first, left = {x[0] for x in smallest}, most - sum(x[2] for x in smallest)
    kept = []
    for key, _, n in sizes:
        if key in first:
            kept.append(key)
        elif n <= left:
            kept.append(key)
            left -= n
    return kept


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    sample: int = SAMPLE, most_passages: int = SAMPLE_PASSAGES
) -> dict:
    """A model's parameters, learnt from at most `sample` labelled rows that are not held out.

    Labels of rows with several different ones, or none, are left out. The sample is the rows first
    by a hash of the id, all passages of each, as far as they have at most most_passages together (within_bound());
    it is fitted in one task, since it is bounded. Of a repeated id the first text in order counts. Without both labels
    there is nothing to learn and all documents get one score; if no document of each label fits, it raises.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(key))).groupBy(F.col(key).cast("long").alias("k")).agg(
        F.min(label).alias("lo"), F.max(label).alias("hi")
    ).where("lo = hi")
    known = known.select("k", F.col("lo").cast("int").alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text")).join(F.broadcast(known), "k")
    rows = rows.groupBy("k").agg(F.min("text").alias("text"), F.first("y").alias("y"))

    def encoded(batches):
        hashes = WordHashes()
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            x, count = passages(texts, hashes)
            ends = np.cumsum(count)
            out = [x[e - n : e].tobytes() for e, n in zip(ends, count, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("y"), pa.array(out, pa.binary())], names=["k", "y", "x"])

    def trained(pdf):
        import pandas as pd

        pdf = pdf.sort_values("k")
        xs = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in pdf["x"]]
        model = GatedAttention()
        y = pdf["y"].to_numpy(float)
        if 0 < y.sum() < len(y):
            model.fit(np.concatenate(xs), np.array([len(v) for v in xs]), y)
        return pd.DataFrame({"name": list(model.p), "values": [np.asarray(v, float).ravel().tolist() for v in model.p.values()]})

    features = written(bounded_batches(rows).select("k", "y", "text").mapInArrow(thrifty(encoded), "k long, y int, x binary"), "features")
    n = (F.length("x") / (4 * FEATURES)).cast("long")
    sizes = features.select("k", "y", n).orderBy(F.xxhash64("k"), "k").collect()  # a number for each row of the sample
    kept = docs.sparkSession.createDataFrame([(k,) for k in within_bound(sizes, most_passages)], "k long")
    parts = features.join(F.broadcast(kept), "k").withColumn("one", F.lit(1)).groupBy("one").applyInPandas(
        trained, "name string, values array<double>"
    ).collect()  # a few thousand numbers
    return {r["name"]: np.array(r["values"]).reshape(GatedAttention.SHAPES.get(r["name"], (FEATURES,))) for r in parts}


def score(docs: DataFrame, parameters: dict, keep: list[str], text: str = "text") -> DataFrame:
    """Per row of docs: the columns `keep` and score, from the whole text. Null texts count as empty.

    A kept column named score comes back as score_of_row. Without parameters (no labelled rows) each score is 0.5."""
    shipped = docs.sparkSession.sparkContext.broadcast(parameters)
    rows, own, back = carried(docs, keep, text, ["score"])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def scored(batches) -> Iterator[pa.RecordBatch]:
        hashes, model = WordHashes(), GatedAttention(shipped.value) if shipped.value else None
        for b in batches:
            texts = [t or b"" for t in b.column("_text").cast(pa.binary()).to_pylist()]
            out, at = [], 0
            while at < len(texts):  # a few megabytes at a time
                end, size = at, 0
                while end < len(texts) and (end == at or size < 1 << 20):
                    size += len(texts[end])
                    end += 1
                out.append(model.forward(*passages(texts[at:end], hashes))[0] if model else np.full(end - at, 0.5))
                at = end
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in own), pa.array(np.concatenate(out) if out else [], pa.float64())],
                names=[*own, "score"]
            )

    out = bounded_batches(rows).mapInArrow(thrifty(scored), ", ".join(f"{k} {kinds[k]}" for k in own) + ", score double")
    return out.select(*back, "score")
