"""Periodic runs of words: block convolution by an exact number-theoretic transform, then extension."""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textops import Words, pieces

#: A run has at least MIN_WORDS words and MIN_TURNS periods.
MIN_WORDS, MIN_TURNS = 24, 3
#: The transform's prime, 7 * 2**20 + 1, and a primitive root of it. A sum of RADIX products of residues stays below 2**53,
#: so float64 products of matrices are exact integers.
PRIME, ROOT, RADIX = 7_340_033, 3, 64
#: Words of the shortest and of the longest blocks; numbers handled at a time.
BASE, LONGEST, STRIP = 8, 2_048, 1 << 16


def _powers(n: int, inverse: bool) -> np.ndarray:
    """The n-th roots of unity, in order of exponent."""
    root = pow(ROOT, (PRIME - 1) // n, PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    out = [1]
    for _ in range(n - 1):
        out.append(out[-1] * root % PRIME)
    return np.array(out, np.float64)


@functools.cache
def _matrix(n: int, inverse: bool) -> np.ndarray:
    """The n x n transform."""
    return _powers(n, inverse)[np.outer(np.arange(n), np.arange(n)) % n]


@functools.cache
def _twiddles(n: int, inverse: bool) -> np.ndarray:
    """Factors between the RADIX rows and n / RADIX columns of a transform of n."""
    return _powers(n, inverse)[np.outer(np.arange(RADIX), np.arange(n // RADIX)) % n]


def _reduced(x: np.ndarray) -> np.ndarray:
    """Residues in place, of numbers below 2**53; from -1 to PRIME, as the quotient is rounded."""
    x -= np.floor(x * (1.0 / PRIME)) * PRIME
    return x


def forward(x: np.ndarray) -> np.ndarray:
    """The transform of each row (a power of two long), in an order that ``backward`` takes."""
    n = x.shape[-1]
    if n <= RADIX:
        return _reduced(x @ _matrix(n, False))
    rows = _reduced(_matrix(RADIX, False) @ x.reshape(-1, RADIX, n // RADIX))
    rows = _reduced(rows * _twiddles(n, False))
    return forward(rows.reshape(-1, n // RADIX)).reshape(-1, n)


def backward(x: np.ndarray) -> np.ndarray:
    """Undoes ``forward``, but for a factor of the row's length."""
    n = x.shape[-1]
    if n <= RADIX:
        return _reduced(x @ _matrix(n, True))
    rows = backward(x.reshape(-1, n // RADIX)).reshape(-1, RADIX, n // RADIX)
    rows = _reduced(rows * _twiddles(n, True))
    return _reduced(_matrix(RADIX, True) @ rows).reshape(-1, n)


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences of each block and its window from each place on, modulo PRIME.

    Row k of ``windows`` is a power of two of at least as many numbers as row k of
    ``blocks``; the result has the places at which the block fits into the window.
    """
    (n, b), w = blocks.shape, windows.shape[1]
    shift = w - b
    padded = np.zeros((n, w))
    padded[:, 0] = blocks[:, 0]
    padded[:, : w - b : -1] = blocks[:, 1:]  # reversed: the cyclic product correlates
    product = backward(_reduced(forward(padded) * forward(windows)))[:, : shift + 1]
    product = _reduced(product * float(pow(w, PRIME - 2, PRIME)))
    squares = np.concatenate((np.zeros((n, 1)), np.cumsum(_reduced(windows * windows), axis=1)), axis=1)
    total = squares[:, b : b + shift + 1] - squares[:, : shift + 1] + _reduced(blocks * blocks).sum(1, keepdims=True)
    return np.abs(_reduced(total - 2 * product + 2.0 * PRIME))


def seeds(ids: np.ndarray, first: np.ndarray, block: int, length: int):
    """(place, distance) of blocks with a zero-mismatch occurrence at a distance of this scale, in the same text.

    Blocks start at multiples of ``block`` from a text's start and have ``length``
    words; distances are from ``block`` to twice that, at BASE from 1 on. A block's
    window comes right after it, in strips of as many distances as it has words.
    """
    counts = np.diff(first)
    least = 1 if block == BASE else block
    per = np.maximum(0, (counts - length - least) // block + 1) * (counts >= max(MIN_WORDS, MIN_TURNS * least))
    text = np.repeat(np.arange(len(counts)), per)
    place = first[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * block
    found_at, found_d = [], []
    w = 4 * BASE if block == BASE else 2 * length
    padded = np.concatenate((ids, np.zeros(2 * w)))
    view = np.lib.stride_tricks.sliding_window_view(padded, w)
    for skip in range(0, 1) if block == BASE else range(block, 2 * block, length):
        live = np.flatnonzero(place + skip + length <= first[1:][text])
        for a in range(0, len(live), max(1, STRIP // w)):
            at = place[live[a : a + max(1, STRIP // w)]]
            zero = mismatches(view[at, :length], view[at + skip])[:, : 2 * BASE if block == BASE else length]
            row, d = np.nonzero((zero == 0) | (zero == PRIME))
            found_at.append(at[row])
            found_d.append(d + skip)
    if not found_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, d = np.concatenate(found_at), np.concatenate(found_d)
    of = np.searchsorted(first, at, "right") - 1
    ok = (d >= least) & (at + d + length <= first[1:][of]) & (MIN_TURNS * d <= counts[of])
    return at[ok], d[ok]


def _equal_ahead(x: np.ndarray, i: int, d: int, stop: int) -> int:
    """How far x goes on equal to itself d later, from i; i + d stays below stop."""
    at, step = i, 64
    while at + d < stop:
        to = min(at + step, stop - d)
        differ = x[at:to] != x[at + d : to + d]
        if differ.any():
            return at + int(differ.argmax())
        at, step = to, step * 2
    return at


def _equal_behind(x: np.ndarray, i: int, d: int, stop: int) -> int:
    """The least place from which x is equal to itself d later up to i (not included); not below stop."""
    at, step = i, 64
    while at > stop:
        low = max(at - step, stop)
        differ = x[low:at] != x[low + d : at + d]
        if differ.any():
            return at - int(differ[::-1].argmax())
        at, step = low, step * 2
    return at


def all_runs(words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of every text, by start and period; starts count from the first text's first word.

    ``words`` are numbers that differ as the words do, ``first`` bounds the texts.
    A run of period q, B <= q < 2B, has 3q words or more, so a block of B words
    from a multiple of B on recurs q later inside it: each scale B = 8, 16, ...
    finds those of its distances (B = 8 those below 8 as well, by the 24 words).
    Longer scales take the first LONGEST words of a block. What an earlier run
    with a divisor of the distance holds needs no extension.
    """
    ids = (words % np.uint64(PRIME)).astype(np.float64)
    runs: dict[tuple[int, int], int] = {}
    longest, block = int(np.diff(first).max(initial=0)), BASE
    while block == BASE or MIN_TURNS * block <= longest:
        length = min(block, LONGEST)
        at, d = seeds(ids, first, block, length)
        known = list(runs.items())
        order = np.lexsort((at, d))
        at, d = at[order], d[order]
        if len(at) and known:
            by_place = np.argsort(at, kind="stable")
            places, open_ = at[by_place], np.ones(len(at), bool)
            for (start, size), q in known:
                some = by_place[np.searchsorted(places, start) : np.searchsorted(places, start + size)]
                open_[some[(d[some] % q == 0) & (at[some] + d[some] + length <= start + size)]] = False
            at, d = at[open_], d[open_]
        now, low, high, new = 0, 0, 0, []
        for i, q in zip(at.tolist(), d.tolist(), strict=True):
            if q == now and low <= i and i + length <= high:
                continue
            if any(q % p == 0 and s <= i and i + q + length <= s + n for s, n, p in new[-64:]):
                continue
            if (words[i : i + length] != words[i + q : i + q + length]).any():
                continue
            of = int(np.searchsorted(first, i, "right")) - 1
            now, low, high = q, _equal_behind(words, i, q, int(first[of])), _equal_ahead(words, i + length, q, int(first[of + 1]))
            size = high - low + q
            if size >= max(MIN_WORDS, MIN_TURNS * q) and (low, size) not in runs:  # an equal stretch has a smaller period
                runs[low, size] = q
                new.append((low, size, q))
        block *= 2
    return sorted((start, size, q) for (start, size), q in runs.items())


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """For a tenth of the ids: which original word stands at each place, so that the text turns from some word on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, plant: bool = False, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """A row per document: its runs, the one of greatest exponent, and the text with each run's turns after the first left out.

    Words are runs of other characters than space and 0x09-0x0D, compared as they
    are. A run is a stretch with smallest period q of max(24, 3q) words or more
    that no neighbouring word extends; start, length, period and exponent_milli
    are of the run with the greatest length / period (ties: smallest start, then
    period), null without a run. ``runs`` has all of them; ``collapsed`` the kept
    words, joined by a space (both null without ``texts``). With ``plant`` the
    texts of ids whose crc32 is divisible by ten are first made to turn (tests of
    the operator at scale). Null, empty and white texts have no word and no run;
    null ids stay and aren't planted; other columns are ignored. Words are told
    apart by 64-bit hashes. No shuffle; texts are handled whole, about 2 MB at a
    time, a longer one alone.
    """
    small_batches(docs.sparkSession)
    names = [x.split(" ")[0] for x in "_id,n_runs,start,length,period,exponent_milli,runs_sha256,collapsed_sha256,runs,collapsed".split(",")]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches):
        for batch in batches:
            for part in pieces(batch):
                w = Words(part.column("text"), lower=False)
                words, ids = w.hash, part.column("_id").to_pylist()
                ends = np.append(w.unit_start, w.unit_end[-1:])
                sources = {}
                if plant:
                    for k in range(part.num_rows):
                        a, b = int(w.first[k]), int(w.first[k + 1])
                        if (source := planted(b - a, ids[k])) is not None:
                            words[a:b], sources[k] = words[a:b][source], source
                found = all_runs(words, w.first)
                of = np.searchsorted(w.first, [r[0] for r in found], "right") - 1 if found else []
                by_text: dict[int, list] = {}
                for k, (s, n, q) in zip(of, found, strict=True):
                    by_text.setdefault(int(k), []).append((s - int(w.first[k]), n, q))
                rows = []
                for k in range(part.num_rows):
                    raw = w.data[ends[k] : ends[k + 1]].tobytes().split()
                    runs = by_text.get(k, [])
                    if k in sources or runs:
                        keep = np.ones(len(raw), bool)
                        for s, n, q in runs:
                            keep[s + q : s + n] = False
                        source = sources.get(k, np.arange(len(raw)))
                        raw = [raw[i] for i in source[keep].tolist()]
                    text = b" ".join(raw)
                    best = min(runs, key=_by_exponent) if runs else (None,) * 3
                    said = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                    rows.append((ids[k], len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(said).hexdigest(), hashlib.sha256(text).hexdigest(), [dict(start=s, length=n, period=q) for s, n, q in runs] if texts else None, text.decode() if texts else None))
                kinds = [part.column("_id").type, *[pa.int64()] * 5, pa.string(), pa.string(), run_type, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(find, f"_id {rows.schema['_id'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("_id", id_col)


@functools.total_ordering
class _Turns:
    """Orders runs by falling exact length / period."""

    def __init__(self, length: int, period: int):
        self.length, self.period = length, period

    def __eq__(self, other):
        return self.length * other.period == other.length * self.period

    def __lt__(self, other):
        return self.length * other.period > other.length * self.period


def _by_exponent(run: tuple[int, int, int]):
    return _Turns(run[1], run[2]), run[0], run[2]
