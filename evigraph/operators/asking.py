"""Asking a judge: chunk by chunk so that a failed chunk fails alone, and never twice for the same body."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.workspace import Work
from .stages import merge_join

#: Characters of an error that are kept.
ERROR_CHARS = 500


def judged_chunks(asks: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], chunk: Sequence[str], item: Sequence[str], answers: str) -> DataFrame:
    """(chunk, item, answers, error): each chunk's rows go to fn together; what fn raises stays with the chunk.

    ``chunk`` and ``item`` name the columns of a chunk and of a row in it,
    ``answers`` is the schema of what fn returns besides the item columns. Rows of a
    chunk that raised have null answers and the error; rows that fn left out have
    neither. A chunk is as large as ``claims.chunked`` made it; a task goes through
    the sorted chunks of its partition, as a group of its own for each costs far
    more than most asks.
    """
    names = [f.name for f in StructType.fromDDL(answers)]
    keys = asks.select(*chunk, *item).schema

    schema = StructType([*keys.fields, *StructType.fromDDL(answers).fields, *StructType.fromDDL("error string").fields])

    def ask(frame: pd.DataFrame, own: list[tuple]) -> tuple[Sequence[int], list[list], str | None]:
        """The rows of one chunk that come out, by number, the answers by name, the error."""
        try:
            got = fn(frame)
            rows: Sequence[int] = range(len(frame))
            if not _same_items(own, got, item):
                got = frame[list(item)].assign(_row=rows).merge(got[[*item, *names]], on=list(item), how="left")
                rows = got["_row"].tolist()
            return rows, [got[name].tolist() for name in names], None
        except Exception as e:  # noqa: BLE001  whatever a judge raises belongs to its chunk alone
            return range(len(frame)), [[None] * len(frame) for _ in names], f"{type(e).__name__}: {e}"[:ERROR_CHARS]

    def ask_all(batches):
        for batch, starts in _whole_chunks(batches, chunk):
            own = list(zip(*(batch[c].tolist() for c in item), strict=True))
            rows, values, errors = [], [[] for _ in names], []
            for a, b in zip(starts, starts[1:], strict=False):
                frame = batch.iloc[a:b]
                frame.index = pd.RangeIndex(b - a)
                some, told, error = ask(frame, own[a:b])
                rows += [a + k for k in some]
                errors += [error] * len(some)
                for held, x in zip(values, told, strict=True):
                    held += x
            # one frame for all chunks of a batch, as a frame costs far more than most asks
            out = batch[[*chunk, *item]].iloc[rows].reset_index(drop=True)
            for name, held in zip([*names, "error"], [*values, errors], strict=True):
                out[name] = pd.Series(held, dtype=object)
            yield out

    n = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # told, as Spark would join partitions that are small in bytes
    return asks.repartition(n, *chunk).sortWithinPartitions(*chunk).mapInPandas(ask_all, schema)


def _same_items(own: list[tuple], got: pd.DataFrame, item: Sequence[str]) -> bool:
    """Whether got has the items of own, each once and in order, so that nothing need be looked up."""
    return len(got) == len(own) and len(set(own)) == len(own) and own == list(zip(*(got[c].tolist() for c in item), strict=True))


def _whole_chunks(batches: Iterable[pd.DataFrame], chunk: Sequence[str]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Sorted batches as frames of whole chunks and where these start, with the end; a chunk that goes on in the next batch waits for its end."""
    held: list[pd.DataFrame] = []
    goes_on: list = []
    for batch in batches:
        if batch.empty:
            continue
        new = pd.Series(False, index=batch.index)
        for c in chunk:
            last = batch[c].shift()
            new |= (batch[c] != last) & ~(batch[c].isna() & last.isna())
        ids = [tuple(None if pd.isna(v) else v for v in batch[list(chunk)].iloc[n]) for n in (0, -1)]
        starts = [0, *(n for n in new.to_numpy().nonzero()[0].tolist() if n)]
        if held and ids[0] != goes_on:
            whole = pd.concat(held, ignore_index=True)
            yield whole, [0, len(whole)]
            held = []
        before = sum(map(len, held))
        if len(starts) > 1:
            last = starts[-1]
            whole = pd.concat([*held, batch.iloc[:last]], ignore_index=True)
            yield whole, [0, *(before + n for n in starts[1:])]
            held = [batch.iloc[last:]]
        else:
            held.append(batch)
        goes_on = ids[1]
    if held:
        whole = pd.concat(held, ignore_index=True)
        yield whole, [0, len(whole)]


def judged_with_retries(asks: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], chunk: Sequence[str], item: Sequence[str], answers: str, work: Work, rounds: int = 2) -> DataFrame:
    """As ``judged_chunks``, with failed chunks asked again; ``round`` tells which round a row is from.

    Every round is written before the next one begins, so no chunk that was
    answered is asked again, whatever is recomputed later.
    """
    done, left = [], asks
    for n in range(rounds):
        got = work(judged_chunks(left, fn, chunk, item, answers).withColumn("round", F.lit(n)), f"round-{n}")
        failed = got.filter("error is not null")
        if n == rounds - 1:
            done.append(got)
            break
        done.append(got.filter("error is null"))
        left = merge_join(asks, failed.select(*chunk).distinct(), list(chunk), "left_semi")
        if failed.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def chunk_outcomes(judged: DataFrame, chunk: Sequence[str]) -> DataFrame:
    """(chunk, n_items, n_answered, error) of judged rows with a column answered: what came of every chunk."""
    return judged.groupBy(*chunk).agg(F.count("*").alias("n_items"), F.count_if("answered").alias("n_answered"), F.max("error").alias("error"))


class AnswerStore:
    """Answers kept by the hash of what was asked, in Parquet under one path.

    A run appends its answers in a folder of its own, so a run that is repeated
    replaces what it wrote. Where two runs at once answered the same key, the
    answer of the lesser run name holds, for every reader.
    """

    def __init__(self, work: Work, schema: str):
        self.work, self.schema, self.names = work, schema, [f.name for f in StructType.fromDDL(schema)]
        self.path = f"{work.path}/answers"

    def _rows(self) -> DataFrame:
        spark = self.work.spark
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        schema = f"ask_key string, {self.schema}, run string"
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self.path)

    def known(self) -> DataFrame:
        """(ask_key, answers, run): one row a key."""
        return self._rows().groupBy("ask_key").agg(F.min(F.struct("run", *self.names)).alias("x")).select("ask_key", *(f"x.{c}" for c in self.names), "x.run")

    def missing(self, asks: DataFrame) -> DataFrame:
        """One row of every key in asks that has no answer yet."""
        return merge_join(asks.dropDuplicates(["ask_key"]), self._rows().select("ask_key").distinct(), "ask_key", "left_anti")

    def ask(self, asks: DataFrame, fn: Callable[[DataFrame], DataFrame], run: str) -> DataFrame:
        """asks with their answers and the run these are from; fn (asks with distinct keys to ask_key and answers) sees only what no earlier run answered.

        Answers with an error, or none at all, aren't kept, so the next run asks again.
        """
        others = self._rows().filter(F.col("run") != run).select("ask_key").distinct()
        new = merge_join(asks.dropDuplicates(["ask_key"]), others, "ask_key", "left_anti")
        got = fn(new)
        if "error" in got.columns:
            got = got.filter("error is null")
        got.select("ask_key", *self.names).write.mode("overwrite").parquet(f"{self.path}/run={run}")
        return merge_join(asks, self.known(), "ask_key", "left")
