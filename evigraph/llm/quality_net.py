"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hashed_sample, small_batches
from .textops import _bytes, mix, pieces

#: Bytes of a chunk and of its overlap with the next; width and step of a filter.
CHUNK, OVERLAP, WIDTH, STEP = 512, 64, 8, 4
#: Learned values per byte, one more says that the text repeats itself here; filters.
EMBED, FILTERS = 7, 12
LAGS = range(2, 21)
PAD = 256
#: Labelled documents that the network is fitted on, at most (by hash); chunks of each that reach the driver (49 MB in all), and those drawn per epoch.
SAMPLE, FIT_CHUNKS, PER_DOC = 2_000, 16, 4
#: Steps of the fit, however many documents there are; documents of a step; first rate.
STEPS, BATCH, RATE = 400, 32, 0.015


def repeats_itself(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the WIDTH bytes from each place on recur at a short lag before, within one text.

    ends are the texts' bounds in data: what stands in other texts changes nothing.
    """
    out = np.zeros(len(data), bool)
    since = np.arange(len(data)) - np.repeat(ends[:-1], np.diff(ends))
    until = np.repeat(ends[1:], np.diff(ends)) - np.arange(len(data))
    for lag in LAGS:
        if len(data) < lag + WIDTH:
            break
        same = data[lag:] == data[:-lag]
        for shift in (1, 2, 4):  # runs of 8
            same[:-shift] &= same[shift:]
        out[lag : len(data) - WIDTH + 1] |= same[: len(data) - WIDTH - lag + 1] & (since[lag : len(data) - WIDTH + 1] >= lag)
    return out & (until >= WIDTH)


def chunked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, repeats, text) of the overlapping chunks that cover every text; places past the end are PAD."""
    data, ends = _bytes(texts)
    again = repeats_itself(data, ends)
    length = np.diff(ends)
    hop = CHUNK - OVERLAP
    count = np.maximum(1, -(-(length - OVERLAP) // hop))
    text = np.repeat(np.arange(len(length)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = (ends[:-1][text] + nth * hop)[:, None] + np.arange(CHUNK)[None, :]
    outside = at >= ends[1:][text][:, None]
    at = np.minimum(at, max(len(data) - 1, 0))
    codes = data[at].astype(np.int16) if len(data) else np.zeros(at.shape, np.int16)
    same = again[at] if len(data) else np.zeros(at.shape, bool)
    codes[outside], same[outside] = PAD, False
    return codes, same, text


class Net:
    """Embedding, one layer of filters, the largest response of each in a chunk, their mean over chunks, one logit."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        self.embed[PAD] = 0
        self.filters = rng.normal(0, 1 / np.sqrt(WIDTH * (EMBED + 1)), (WIDTH * (EMBED + 1), FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.weight = rng.normal(0, 0.1, FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def windows(self, codes: np.ndarray, same: np.ndarray) -> np.ndarray:
        x = np.empty((*codes.shape, EMBED + 1), np.float32)
        x[..., :EMBED], x[..., EMBED] = self.embed[codes], same
        places = (CHUNK - WIDTH) // STEP + 1
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (len(x), places, WIDTH * (EMBED + 1)), (s[0], s[1] * STEP, s[2]))

    def pooled(self, codes: np.ndarray, same: np.ndarray):
        """(largest responses, their places) of each chunk and filter."""
        windows = self.windows(codes, same)
        z = (np.ascontiguousarray(windows).reshape(-1, windows.shape[2]) @ self.filters).reshape(*windows.shape[:2], -1)
        at = z.argmax(1)
        return np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0] + self.shift, 0), at, windows

    def features(self, codes: np.ndarray, same: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), FILTERS), np.float32)
        for a in range(0, len(codes), 256):
            windows = self.windows(codes[a : a + 256], same[a : a + 256])
            z = np.ascontiguousarray(windows).reshape(-1, windows.shape[2]) @ self.filters
            out[a : a + 256] = np.maximum(z.reshape(*windows.shape[:2], -1).max(1) + self.shift, 0)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        """One probability for each whole text, over all its chunks."""
        codes, same, text = chunked(texts)
        features = self.features(codes, same)
        n = np.bincount(text, minlength=len(texts))
        mean = np.stack([np.bincount(text, features[:, k], len(texts)) for k in range(FILTERS)], 1) / n[:, None]
        return 1 / (1 + np.exp(-np.clip(mean @ self.weight.astype(np.float64) + float(self.bias[0]), -30, 30)))

    def gradients(self, codes: np.ndarray, same: np.ndarray, of: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of some texts, chunk by chunk; ``of`` names the text of each chunk."""
        share = (1 / np.bincount(of, minlength=len(labels)).astype(np.float32))[of]
        h, place, windows = self.pooled(codes, same)
        mean = np.zeros((len(labels), FILTERS), h.dtype)
        np.add.at(mean, of, h * share[:, None])
        p = 1 / (1 + np.exp(-(mean @ self.weight + self.bias[0])))
        error = ((p - labels) / len(labels)).astype(h.dtype)
        grads = {"weight": mean.T @ error, "bias": np.array([error.sum()], h.dtype)}
        back = error[of][:, None] * share[:, None] * self.weight[None, :] * (h > 0)
        grads["shift"] = back.sum(0)
        seen = windows[np.arange(len(codes))[:, None], place]  # chunk, filter, window
        grads["filters"] = np.einsum("nf,nfk->kf", back, seen)
        flow = (back[:, :, None] * self.filters.T[None]).reshape(len(codes), FILTERS, WIDTH, EMBED + 1)[..., :EMBED]
        chars = codes[np.arange(len(codes))[:, None, None], place[:, :, None] * STEP + np.arange(WIDTH)]
        grads["embed"] = np.zeros_like(self.embed)
        np.add.at(grads["embed"], chars.ravel(), flow.reshape(-1, EMBED))
        grads["embed"][PAD] = 0
        return grads

    def fit(self, codes: np.ndarray, same: np.ndarray, text: np.ndarray, labels: np.ndarray, seed: int = 5) -> Net:
        """Adam on the cross entropy; every epoch draws up to PER_DOC chunks of each text. ``text`` is ascending."""
        rng = np.random.default_rng(seed)
        n_texts = len(labels)
        first = np.searchsorted(text, np.arange(n_texts + 1))
        params = ["embed", "filters", "shift", "weight", "bias"]
        moment = {p: [np.zeros_like(getattr(self, p)), np.zeros_like(getattr(self, p))] for p in params}
        step = 0
        epochs = max(1, round(STEPS / -(-n_texts // BATCH)))
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs) + 1e-4
            order = rng.permutation(n_texts)
            for a in range(0, len(order), BATCH):
                docs = order[a : a + BATCH]
                size = first[docs + 1] - first[docs]
                drawn = [first[d] + (rng.choice(n, PER_DOC, replace=False) if n > PER_DOC else np.arange(n)) for d, n in zip(docs, size, strict=True)]
                of = np.repeat(np.arange(len(docs)), [len(x) for x in drawn])
                at = np.concatenate(drawn)
                grads = self.gradients(codes[at], same[at], of, labels[docs])
                step += 1
                for name in params:
                    m, v = moment[name]
                    m += 0.1 * (grads[name] - m)
                    v += 0.001 * (grads[name] ** 2 - v)
                    value = getattr(self, name)
                    value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(doc_id: str) -> Column:
    """Whether a row's label must not be learned: crc32(doc_id as text) mod 3 = 1. A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Net:
    """A network fitted on at most ``sample`` labelled documents that are not held out, by at most FIT_CHUNKS chunks of each.

    Of rows of labels that repeat a doc_id the largest label counts, of rows of docs
    one text; null labels and null doc_ids don't. With one class or no rows the network is untrained
    but its bias.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    known = hashed_sample(known, ["_id"], sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())

    def chunks(batches):
        for batch in batches:
            for part in pieces(batch):
                codes, same, text = chunked(part.column("text"))
                nth = np.arange(len(text)) - np.searchsorted(text, text)
                count = np.bincount(text)[text]
                # FIT_CHUNKS of a text at most, spread over the whole of it
                at = np.flatnonzero((count <= FIT_CHUNKS) | ((nth * FIT_CHUNKS) // count != ((nth - 1) * FIT_CHUNKS) // count))
                cells = [np.concatenate((codes[k].view(np.uint8), same[k].view(np.uint8))).tobytes() for k in at]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(text[at])) for c in ("_id", "_label", "_hash")), pa.array(nth[at]), pa.array(cells, pa.binary())], ["_id", "_label", "_hash", "_nth", "_cells"])

    joined = rows.join(F.broadcast(known), "_id").withColumn("_hash", F.xxhash64("text"))
    joined = joined.groupBy("_id", "_label").agg(F.min(F.struct("_hash", "text")).alias("x")).select("_id", "_label", "x.*")
    found = joined.mapInArrow(chunks, "_id long, _label int, _hash long, _nth long, _cells binary").toPandas()
    found["_order"] = mix(found["_id"].to_numpy(np.int64).view(np.uint64))
    found = found.sort_values(["_order", "_id", "_hash", "_nth"], kind="stable")
    starts = (found["_nth"] == 0).to_numpy() if len(found) else np.zeros(0, bool)
    text = np.cumsum(starts) - 1
    y = found["_label"].to_numpy(np.float32)[starts]
    net = Net()
    if not len(y) or y.min() == y.max():
        net.weight[:] = 0
        net.bias[:] = 0 if not len(y) else (4 if y[0] else -4)
        return net
    cells = np.frombuffer(b"".join(found["_cells"]), np.uint8).reshape(len(found), 3 * CHUNK)
    codes = np.ascontiguousarray(cells[:, : 2 * CHUNK]).view(np.int16)
    return net.fit(codes, cells[:, 2 * CHUNK :].astype(bool), text, y)


def score_documents(docs: DataFrame, net: Net) -> DataFrame:
    """docs with ``score`` (double, 0 to 1, higher: label 1 likelier) of every whole text.

    Only the text is an input; scores have six decimals. Null and empty texts are scored as one chunk of
    padding. Rows that repeat are each scored; a column named score in docs is
    replaced. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("score")
    schema = docs.withColumn("score", F.lit(0.0)).schema

    def score(batches):
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(net.scores(part.column("text")).round(6))], [*part.schema.names, "score"])

    return docs.mapInArrow(score, schema)


def keep_good(docs: DataFrame, net: Net, least: float = 0.5) -> DataFrame:
    """docs whose score reaches ``least``."""
    own = docs.withColumnRenamed("score", "_kept_score")
    return score_documents(own, net).filter(F.col("score") >= least).drop("score").withColumnRenamed("_kept_score", "score").select(*docs.columns)
