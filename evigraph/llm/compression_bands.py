"""Quality rules: counts over whole texts, and bands of zstandard ratios for documents and their chunks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textops import Words, is_space, pieces

#: Least words, and the most words in a hundred that may lie in repeated windows of WINDOW words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
#: zstandard level; bytes of a chunk; share of the bytes in chunks outside their band from which a document is rejected.
LEVEL, CHUNK, CHUNK_SHARE = 3, 4_096, 0.25
#: Bands are half octaves of length in bytes. Labelled good documents that a band needs; decimal places of the ratios that limits are fitted on.
BAND_DOCS, STEP = 40, 4
#: Fences: this many interquartile ranges beyond the quartiles of a band, and this share of them on top for every octave to the band they are taken from.
FENCE, DRIFT = 2.5, 0.12
#: Limits for ordinary prose where there are no labels: band, least and most ratio.
DEFAULT_LIMITS = {12: (0.9, 2.0), 16: (1.1, 2.3), 20: (1.3, 2.8), 24: (1.5, 3.6), 28: (1.6, 4.2), 32: (1.7, 4.8)}


def band_of(size: int) -> int:
    """The half octave that a length in bytes is in."""
    return int(2 * math.log2(max(1, size)))


def limits_of(size: int, limits: dict[int, tuple[float, float]]) -> tuple[float, float]:
    """(least, most) ratio for a length: its band's, else those of the nearest band, wider by DRIFT an octave."""
    band = band_of(size)
    near = min(limits, key=lambda b: (abs(b - band), b))
    wider = 1 + DRIFT * abs(near - band) / 2
    return limits[near][0] / wider, limits[near][1] * wider


def _compressor():
    return zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)


def fit_limits(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[int, tuple[float, float]]:
    """Limits by band: fences around the quartiles of the ratios of documents labelled good.

    Fitted on all labelled documents; ratios are rounded to STEP places, so the
    quartiles come from counts of the values in each band, which stay few however
    many documents there are. Texts are not shuffled, only their ratios. Ids with
    contradicting labels take no part, nor do bands with fewer than BAND_DOCS
    documents. Without any such band: DEFAULT_LIMITS.
    """
    small_batches(docs.sparkSession)
    good = labels.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").alias("q")).filter("q = 1").select(F.col(id_col).alias("_id"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).filter(F.col("_id").isNotNull() & (F.length("text") > 0))

    def ratios(batches):
        z = _compressor()
        for batch in batches:
            for part in pieces(batch):
                raw = [t.encode() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array([band_of(len(b)) for b in raw], pa.int32()), pa.array([round(len(b) / len(z.compress(b)), STEP) for b in raw], pa.float64())], ["_id", "band", "ratio"])

    known = texts.mapInArrow(ratios, f"_id {texts.schema['_id'].dataType.simpleString()}, band int, ratio double")
    counts = known.hint("shuffle_merge").join(good.hint("shuffle_merge"), "_id").groupBy("band", "ratio").agg(F.count("*").alias("n"))
    found = counts.groupBy("band").agg(F.sum("n").alias("n"), F.expr("percentile(ratio, array(0.25, 0.75), n)").alias("q")).filter(F.col("n") >= BAND_DOCS)
    out = {}
    for r in found.collect():  # a row a band: some dozens
        low, high = r["q"]
        out[r["band"]] = (low - FENCE * (high - low), high + FENCE * (high - low))
    return out or dict(DEFAULT_LIMITS)


def repeated_words(w: Words, k: int = WINDOW) -> np.ndarray:
    """How many words of each text lie in windows of k words that the text holds twice or more."""
    n, counts = len(w.hash), w.counts()
    if not n:
        return np.zeros(len(counts), np.int64)
    unit = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(w.first[1:][unit] - np.arange(n) >= k)
    value = np.zeros(len(at), np.uint64)
    for j in range(k):
        value = value * np.uint64(0x9E3779B97F4A7C15) + w.hash[at + j]
    order = np.lexsort((value, unit[at]))
    same = (value[order][1:] == value[order][:-1]) & (unit[at][order][1:] == unit[at][order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at[twice], 1)
    np.add.at(edges, at[twice] + k, -1)
    return np.bincount(unit, weights=np.cumsum(edges)[:n] > 0, minlength=len(counts)).astype(np.int64)


def in_bands(raw: bytes, limits: dict[int, tuple[float, float]], z) -> tuple[float, float, bool]:
    """(ratio, share of bytes in chunks outside their band, verdict) of a text.

    Chunks are CHUNK bytes from the start; the rest is a chunk if it is half as
    long at least, else part of the last. A text of one chunk is judged as a whole.
    """
    if not raw:
        return 1.0, 0.0, True
    ratio = len(raw) / len(z.compress(raw))
    low, high = limits_of(len(raw), limits)
    n, bad = max(1, (len(raw) + CHUNK // 2) // CHUNK), 0
    if n > 1:
        for k in range(n):
            chunk = raw[k * CHUNK : (k + 1) * CHUNK if k < n - 1 else len(raw)]
            least, most = limits_of(len(chunk), limits)
            bad += len(chunk) * (not least <= len(chunk) / len(z.compress(chunk)) <= most)
    share = bad / len(raw)
    return ratio, share, low <= ratio <= high and share < CHUNK_SHARE


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_share double"


def quality_rules(docs: DataFrame, limits: dict[int, tuple[float, float]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, bad_share), a row per document.

    A document fails the base rules with fewer than LEAST_WORDS words or more
    than MOST_REPEATED in a hundred words in repeated windows. Others are kept if
    the zstandard ratio of the whole text lies in the band for its length and
    less than CHUNK_SHARE of its bytes lie in chunks outside theirs. One pass, no
    shuffle. Null, empty and white texts have no words and fail; null ids stay
    null; repeated rows are judged alone; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    limits = dict(limits or DEFAULT_LIMITS)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    def judge(batches):
        z = _compressor()
        for batch in batches:
            for part in pieces(batch):
                w = Words(part.column("text"), lower=False)
                ends = np.append(w.unit_start, w.unit_end[-1:])
                of_text = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[ends])  # noqa: B023, E731
                n = w.counts()
                chars, symbols = of_text(~is_space(w.data) & ((w.data & 0xC0) != 0x80)), of_text(symbol[w.data])
                repeated = repeated_words(w)
                failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
                dup, ratio, share, kept = [], [], [], []
                for k in range(part.num_rows):
                    raw = w.data[ends[k] : ends[k + 1]].tobytes()
                    lines = [x for x in raw.split(b"\n") if x.strip()]
                    dup.append(len(lines) - len(set(lines)))
                    for to, x in zip((ratio, share, kept), in_bands(raw, limits, z), strict=True):
                        to.append(x)
                columns = [part.column("_id"), *(pa.array(x.astype(np.int64)) for x in (n, chars, symbols)), pa.array(dup, pa.int64()), pa.array(repeated), pa.array(failed), pa.array(np.array(kept, bool) & ~failed), pa.array(ratio, pa.float64()), pa.array(share, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_share"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(judge, f"_id {rows.schema['_id'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("_id", id_col)


def keep_ruled(docs: DataFrame, limits: dict[int, tuple[float, float]] | None = None, text_col: str = "text") -> DataFrame:
    """The documents that pass quality_rules, with all their columns; no join, as each row is judged where it lies."""
    small_batches(docs.sparkSession)
    limits = dict(limits or DEFAULT_LIMITS)

    def keep(batches):
        z = _compressor()
        for batch in batches:
            for part in pieces(batch, text_col):
                w = Words(part.column(text_col), lower=False)
                n, repeated = w.counts(), repeated_words(w)
                ends = np.append(w.unit_start, w.unit_end[-1:])
                ok = (n >= LEAST_WORDS) & (100 * repeated <= MOST_REPEATED * n)
                for k in np.flatnonzero(ok):
                    ok[k] = in_bands(w.data[ends[k] : ends[k + 1]].tobytes(), limits, z)[2]
                yield part.filter(pa.array(ok))

    return docs.mapInArrow(keep, docs.schema)
