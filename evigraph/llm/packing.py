"""Packing: power-of-two decomposition of tokenized documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textops import _bytes, is_space, lowered, pieces

#: Bytes (of parts, their ids, and a fixed share of each) that a Python worker remembers, at most twice as many; parts longer than LONG aren't remembered.
REMEMBERED, SHARE, LONG = 48 << 20, 150, 512
_known: dict[str, list[dict[str, bytes]]] = {}
_bytes_of: dict[str, int] = {}
_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.encode_special_tokens = False
        _loaded[path] = found
    return _loaded[path]


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = True
_SIGN[48:58] = _SIGN[65:91] = _SIGN[97:123] = False
_SIGN[39] = False  # an apostrophe may begin a contraction


def _parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Parts that are tokenized each for itself, and the first part of each text.

    Cuts are at ASCII white space and, once A-Z are lower-cased as the tokenizer
    does, between an ASCII letter and a sign other than an apostrophe, where its
    own word pattern cuts as well. Texts with the beginning of a special token
    are cut at white space only and left as they are.
    """
    data, ends = _bytes(texts)
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(len(texts) + 1, np.int64)
    word = ~is_space(data)
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    if b"<|" not in data.tobytes():
        data = lowered(data)
        letter, sign = _LETTER[data], _SIGN[data]
        opens[1:] |= (letter[1:] & sign[:-1]) | (sign[1:] & letter[:-1])
    edge = ends[:-1][ends[:-1] < len(data)]
    opens[edge] = word[edge]
    start = np.flatnonzero(opens)
    before = np.concatenate(([0], np.cumsum(word)))  # bytes kept
    offsets = np.append(before[start], before[-1])
    parts = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])])
    return parts, np.searchsorted(start, ends)


def _ids_of(words: list[str], path: str, remembered: int | None = None) -> list[bytes]:
    """Ids of each part, remembered in two generations: what is still in use survives."""
    young, old = _known.setdefault(path, [{}, {}])
    if _bytes_of.get(path, 0) > (remembered or REMEMBERED):
        young, old = _known[path] = [{}, young]
        _bytes_of[path] = 0
    fresh, now = [], {}
    for w in words:
        if w not in young:
            if (ids := old.get(w)) is not None:
                young[w] = ids
                _bytes_of[path] = _bytes_of.get(path, 0) + len(w) + len(ids) + SHARE
            else:
                fresh.append(w)
    for a in range(0, len(fresh), 20_000):
        some = fresh[a : a + 20_000]
        for w, e in zip(some, _tokenizer(path).encode_batch_fast(some, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32).tobytes()
            if len(w) > LONG:
                now[w] = ids
            else:
                young[w] = ids
                _bytes_of[path] = _bytes_of.get(path, 0) + len(w) + len(ids) + SHARE
    return [young[w] if w in young else now[w] for w in words]


def token_ids(texts: pa.Array, path: str, end_id: int, remembered: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids uint32, first): ids of each whole text followed by end_id, in CSR form.

    For tokenizers that lower-case, drop white space and cut words from signs,
    so that a text's ids are those of its parts in turn; see _parts.
    """
    parts, first_part = _parts(texts)
    coded = parts.dictionary_encode()
    own = _ids_of(coded.dictionary.to_pylist(), path, remembered)
    flat = np.frombuffer(b"".join(own), np.uint32)
    size = np.fromiter(map(len, own), np.int64, len(own)) // 4
    begin = np.cumsum(size) - size
    part = coded.indices.to_numpy(zero_copy_only=False)
    length = size[part] if len(part) else np.zeros(0, np.int64)
    total = np.concatenate(([0], np.cumsum(length)))
    first = np.concatenate(([0], np.cumsum(np.diff(total[first_part]) + 1)))
    out = np.full(first[-1], end_id, np.uint32)
    if total[-1]:
        source = np.repeat(begin[part] - total[:-1], length) + np.arange(total[-1])
        last = np.zeros(first[-1], bool)
        last[first[1:] - 1] = True
        out[~last] = flat[source]
    return out, first


def binary_lengths(n: int, longest: int) -> list[int]:
    """n as powers of two up to ``longest``, largest first."""
    out = [longest] * (n // longest)
    rest = n % longest
    return out + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack_powers(docs: DataFrame, tokenizer: str, end_id: int = 2, longest: int = 4096, remembered: int | None = None) -> DataFrame:
    """Sequences of a power-of-two length, each from one document and without padding.

    Every whole text becomes its ids and end_id, cut into binary-length pieces,
    largest first; a piece is a sequence. Returns (doc_id, start long, length
    long, doc_tokens long, bucket int, ids binary, sequence_id long, offset
    long): ids are unsigned little-endian 32-bit, bucket is log2(length), and
    batches of one bucket (``write_buckets``) need no padding. sequence_id is
    unique, and the same in every rerun over the same partitions; offset is 0.

    Null and empty texts give one piece, end_id alone. Rows that repeat a doc_id
    (or have none) are packed each for itself. Other columns are ignored. No
    shuffle takes place. An empty table gives no rows. ``remembered`` bounds what a
    worker remembers of parts, in bytes, in place of REMEMBERED; results are the same.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    small_batches(docs.sparkSession)

    def cut(batches):
        for batch in batches:
            for part in pieces(batch):
                ids, first = token_ids(part.column("text"), tokenizer, end_id, remembered)
                raw = ids.tobytes()
                doc, start, length = [], [], []
                for d, n in enumerate(np.diff(first).tolist()):
                    sizes, at = binary_lengths(n, longest), 0
                    for size in sizes:
                        start.append(at)
                        at += size
                    doc += [d] * len(sizes)
                    length += sizes
                doc, start, length = np.array(doc), np.array(start), np.array(length)
                ends = np.concatenate(([0], np.cumsum(length))) * 4  # pieces follow one another as documents do
                column = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(np.diff(first)[doc]), pa.array(np.log2(length).astype(np.int32)), column],
                    ["doc_id", "start", "length", "doc_tokens", "bucket", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, bucket int, ids binary")
    return out.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder of Parquet files per sequence length."""
    packed.write.partitionBy("bucket").parquet(path)


def digests(packed: DataFrame) -> DataFrame:
    """packed with ids_crc32 in place of ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
