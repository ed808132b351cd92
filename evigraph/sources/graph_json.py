"""Graphs as JSON documents: sink and source."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "struct<id:string,type:string,label:string,url:string>"
EDGE = "struct<subject:string,predicate:string,object:string,confidence:double>"


def to_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, document): one JSON text per graph, ends in order. A document is one value, so a graph must fit one row."""
    url = F.col("url") if "url" in nodes.columns else F.lit(None).cast("string")
    n = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("id", "type", "label", url.alias("url")))).alias("nodes"))
    e = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("subject", "predicate", "object", "confidence"))).alias("edges"))
    whole = n.join(e, "graph_id", "left")
    keyed = F.map_from_entries(F.transform("nodes", lambda x: F.struct(x["id"].alias("k"), x.alias("v"))))
    return whole.select("graph_id", F.to_json(F.struct(keyed.alias("nodes"), F.coalesce("edges", F.array().cast(f"array<{EDGE}>")).alias("edges"))).alias("document"))


def write(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    to_documents(nodes, edges).write.json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("graph_id string, document string").json(path)


def parse_nodes(documents: DataFrame) -> DataFrame:
    """Nodes of documents whose nodes are a map by id, or an array."""
    as_map = F.from_json("document", f"nodes map<string,{NODE}>")["nodes"]
    as_list = F.from_json("document", f"nodes array<{NODE}>")["nodes"]
    return documents.select("graph_id", F.inline(F.coalesce(F.map_values(as_map), as_list)))


def parse_edges(documents: DataFrame) -> DataFrame:
    return documents.select("graph_id", F.inline(F.from_json("document", f"edges array<{EDGE}>")["edges"]))


def to_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, kind, value): one JSON text per node and per edge, for graphs of any size."""
    url = F.col("url") if "url" in nodes.columns else F.lit(None).cast("string")
    n = nodes.select("graph_id", F.lit("node").alias("kind"), F.to_json(F.struct("id", "type", "label", url.alias("url"))).alias("value"))
    return n.unionByName(edges.select("graph_id", F.lit("edge").alias("kind"), F.to_json(F.struct("subject", "predicate", "object", "confidence")).alias("value")))


def from_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of such lines."""
    of = lambda kind, shape: lines.filter(F.col("kind") == kind).select("graph_id", F.from_json("value", shape).alias("x")).select("graph_id", "x.*")
    return of("node", NODE), of("edge", EDGE)


class ElementReader:
    """Takes a graph's JSON apart piece by piece: every node and edge as soon as it ends.

    Holds the text of one element at a time, however long the document. Elements
    are the objects in the top-level nodes (a map or a list) and edges.
    """

    def __init__(self) -> None:
        self.depth, self.text, self.escape = 0, False, False
        self.name, self.key, self.held = [], "", None

    def feed(self, piece: str):
        """(kind, JSON) of the elements that end in a piece."""
        at, begin = 0, 0
        while at < len(piece):
            if self.text:
                if self.escape:
                    self.escape = False
                    if self.depth == 1:
                        self.name.append(piece[at])
                    at += 1
                    continue
                found = _IN_TEXT.search(piece, at)
                stop = found.start() if found else len(piece)
                if self.depth == 1:
                    self.name.append(piece[at:stop])
                at = stop
                if found:
                    self.text, self.escape = found.group() != '"', found.group() == "\\"
                    if not self.text and self.depth == 1:
                        self.key = "".join(self.name)
                    at += 1
                continue
            found = _MARK.search(piece, at)
            if not found:
                break
            at, mark = found.end(), found.group()
            if mark == '"':
                self.text, self.name = True, []
            elif mark in "{[":
                self.depth += 1
                if self.depth == 3 and mark == "{" and self.key in _KINDS:
                    self.held, begin = [], found.start()
            else:
                self.depth -= 1
                if self.depth == 2 and self.held is not None:
                    yield _KINDS[self.key], "".join((*self.held, piece[begin:at]))
                    self.held = None
        if self.held is not None:
            self.held.append(piece[begin:])


_IN_TEXT, _MARK, _KINDS = re.compile(r'["\\]'), re.compile(r'["{}\[\]]'), {"nodes": "node", "edges": "edge"}


def read_large(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, kind, value): a row for each node and edge of graph documents of any size, a file each; see ``from_lines``.

    Spark reads files cut at closing braces, so no row is longer than an element's
    part; the pieces of a file go, in order, through one task that joins them to
    elements (``ElementReader``). A file may be larger than any memory.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("id"), "value")
    order = ["file", "part", "id"]
    dealt = raw.repartition("file").sortWithinPartitions(*order).select("file", "value")

    def elements(batches):
        now, reader = None, ElementReader()
        for b in batches:
            out: list[tuple[str, str, str]] = []
            for file, value in zip(b.column("file").to_pylist(), b.column("value").to_pylist(), strict=True):
                if file != now:
                    now, reader = file, ElementReader()
                out += [(file, kind, text) for kind, text in reader.feed(value + "}")]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in range(3)], ["file", "kind", "value"])

    return dealt.mapInArrow(elements, "file string, kind string, value string")
