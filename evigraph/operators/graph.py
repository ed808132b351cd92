"""Slices, texts and roll-ups of merged graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CATEGORIES, CATEGORY_LEAST, CATEGORY_TEXTS, OWN_COLOURS, SLICE_EDGES, SUMMARY_EDGES, TABLE_ROWS, TYPE_ORDER
from .merge import endpoints
from .stages import merge_join


def categories(spark) -> DataFrame:
    """The category dimension in order: (category, predicates, types, text, place)."""
    rows = [(name, list(p), list(t), CATEGORY_TEXTS[name], k) for k, (name, (p, t)) in enumerate(CATEGORIES.items())]
    return spark.createDataFrame(rows, "category string, predicates array<string>, types array<string>, text string, place int")


def picked_categories(flags: DataFrame, least: float = CATEGORY_LEAST) -> DataFrame:
    """(keys, categories, scores) of flags (keys, category, noul): those that reach the threshold in the dimension's order, and all as a map.

    Keys are all other columns. Unknown categories are left out, unanswered ones count as 0.
    """
    keys = [c for c in flags.columns if c not in ("category", "noul")]
    known = flags.join(F.broadcast(categories(flags.sparkSession).select("category", "place")), "category")
    noul = F.coalesce("noul", F.lit(0.0))
    picked = F.transform(F.array_sort(F.collect_list(F.when(noul >= least, F.struct("place", "category")))), lambda x: x["category"])
    return known.groupBy(*keys).agg(picked.alias("categories"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "noul")))).alias("scores"))


def _top(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def projection(edges: DataFrame, keys: list[str], most: int = SLICE_EDGES) -> DataFrame:
    """The strongest edges of each projection by confidence rounded to 3 places, with edges_total.

    The total is an aggregate of its own, so that Spark limits inside partitions before it sorts.
    """
    totals = edges.groupBy(*keys).agg(F.count("*").alias("edges_total"))
    top = _top(edges.withColumn("confidence", F.round("confidence", 3)), keys, [F.desc("confidence"), F.col("subject"), F.col("predicate"), F.col("object")], most)
    return merge_join(top, totals, keys)


def slice_graphs(nodes: DataFrame, edges: DataFrame, asked: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of slices: asked is (graph_id, question_id, category), queries (graph_id, id).

    An edge is in if its predicate is of a category or both its ends are kept;
    nodes are kept by type, as ends of edges chosen by predicate, or as the query.
    The category dimension is fixed and tiny, so it is broadcast.
    """
    dim = F.broadcast(categories(nodes.sparkSession))
    chosen = asked.join(dim, "category")
    key = ["graph_id", "question_id"]
    predicates = chosen.select(*key, F.explode("predicates").alias("predicate")).distinct()
    types = chosen.select(*key, F.explode("types").alias("type")).distinct()
    by_predicate = merge_join(edges, predicates, ["graph_id", "predicate"])
    ends = by_predicate.select(*key, F.col("subject").alias("id")).union(by_predicate.select(*key, F.col("object").alias("id")))
    by_type = merge_join(nodes, types, ["graph_id", "type"]).select(*key, "id")
    asking = merge_join(asked.select(*key).distinct(), queries, "graph_id").select(*key, "id")
    kept = ends.union(by_type).union(asking).distinct()
    wide = merge_join(merge_join(edges, asked.select(*key).distinct(), "graph_id"), predicates.withColumn("_p", F.lit(True)), [*key, "predicate"], "left")
    for side in ("subject", "object"):
        wide = merge_join(wide, kept.select(*key, F.col("id").alias(side), F.lit(True).alias(f"_{side}")), [*key, side], "left")
    inside = wide.filter(F.col("_p").isNotNull() | (F.col("_subject").isNotNull() & F.col("_object").isNotNull()))
    return merge_join(nodes, kept, ["graph_id", "id"]), inside.drop("_p", "_subject", "_object")


def graph_text(edges: DataFrame, labels: DataFrame, most: int = SUMMARY_EDGES) -> DataFrame:
    """(graph_id, text): each predicate's strongest edges, a line each under a header, predicates in order."""
    named = edges
    for side in ("subject", "object"):
        side_labels = labels.select("graph_id", F.col("id").alias(side), F.col("label").alias(f"{side}_label"))
        named = named.join(side_labels, ["graph_id", side], "left").withColumn(f"{side}_label", F.coalesce(F.nullif(f"{side}_label", F.lit("")), side))
    w = Window.partitionBy("graph_id", "predicate")
    order = w.orderBy(F.desc("confidence"), "subject", "object")
    totals = edges.groupBy("graph_id", "predicate").agg(F.count("*").alias("total"))
    ranked = merge_join(named.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most), totals, ["graph_id", "predicate"])
    line = F.format_string("  %s -%s-> %s (%.2f)", "subject_label", "predicate", "object_label", "confidence")
    blocks = ranked.groupBy("graph_id", "predicate").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("lines"), F.max("total").alias("total"))
    more = F.when(F.col("total") > most, F.concat(F.lit("\n  ... "), (F.col("total") - most).cast("string"), F.lit(" more"))).otherwise("")
    block = F.concat(F.lit("["), F.col("predicate"), F.lit("]\n"), F.array_join(F.col("lines.line"), "\n"), more)
    return blocks.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("predicate", block.alias("b")))), lambda x: x["b"]), "\n").alias("text"))


def ego(nodes: DataFrame, edges: DataFrame, centres: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(neighbours, edges) of each centre (graph_id, centre): incident edges, and nodes at their ends."""
    ends = F.explode(F.array_distinct(F.array("subject", "object")))
    around = merge_join(edges.withColumn("centre", ends), centres, ["graph_id", "centre"])
    near = around.select("graph_id", "centre", F.explode(F.array("subject", "object")).alias("id")).distinct()
    return merge_join(nodes, near, ["graph_id", "id"]), around


def type_counts(nodes: DataFrame) -> DataFrame:
    """(type, n, place): nodes per type in display order, types outside it last by name."""
    order = F.array_position(F.array(*map(F.lit, TYPE_ORDER)), F.col("type"))
    counts = nodes.groupBy("type").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.when(order == 0, 1_000).otherwise(order), "type"))
    return counts.withColumn("place", place.cast("long"))


def predicate_rank(edges: DataFrame, own: int = OWN_COLOURS) -> DataFrame:
    """(predicate, n, place, colour): the most frequent keep their own colour, the rest share "other"."""
    counts = edges.groupBy("predicate").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "predicate")).cast("long")
    return counts.withColumn("place", place).withColumn("colour", F.when(F.col("place") <= own, F.col("predicate")).otherwise("other"))


def stacked_counts(nodes: DataFrame, edges: DataFrame, side: str = "subject") -> DataFrame:
    """(type, predicate, n, offset): edges by the type of one end and predicate, with running offsets per type."""
    typed = edges.join(nodes.select("graph_id", F.col("id").alias(side), "type"), ["graph_id", side])
    counts = typed.groupBy("type", "predicate").agg(F.count("*").alias("n"))
    w = Window.partitionBy("type").orderBy(F.desc("n"), "predicate").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))


def incident_counts(edges: DataFrame) -> DataFrame:
    """(graph_id, id, predicate, n, degree): incident edges of every node; a self loop counts once."""
    each = edges.select("graph_id", "predicate", F.explode(F.array_distinct(F.array("subject", "object"))).alias("id"))
    counts = each.groupBy("graph_id", "id", "predicate").agg(F.count("*").alias("n"))
    return counts.withColumn("degree", F.sum("n").over(Window.partitionBy("graph_id", "id")))


def group_links(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(graph_id, group_a, group_b, n, mean_confidence, predicates): edges between different groups (graph_id, id, grp), unordered.

    predicates maps each predicate to its edges.
    """
    sided = edges
    for side in ("subject", "object"):
        sided = sided.join(groups.select("graph_id", F.col("id").alias(side), F.col("grp").alias(f"{side}_grp")), ["graph_id", side])
    pairs = sided.filter("subject_grp <> object_grp").withColumns({"group_a": F.least("subject_grp", "object_grp"), "group_b": F.greatest("subject_grp", "object_grp")})
    key = ["graph_id", "group_a", "group_b"]
    each = pairs.groupBy(*key, "predicate").agg(F.count("*").alias("k"), F.sum("confidence").alias("c"))
    mean = F.round(F.sum("c"), 4) / F.sum("k")  # rounded: the order of addition can't show
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicate", "k"))))
    return each.groupBy(*key).agg(F.sum("k").alias("n"), mean.alias("mean_confidence"), counts.alias("predicates"))


def group_contents(nodes: DataFrame, groups: DataFrame, labels: int = 5) -> DataFrame:
    """(graph_id, grp, size, labels, types): group sizes, first labels by id, and how many nodes of each type."""
    key = ["graph_id", "grp"]
    placed = nodes.join(groups, ["graph_id", "id"])
    first = _top(placed, key, [F.col("id")], labels).groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "label"))), lambda x: x["label"]), ",").alias("labels"))
    each = placed.groupBy(*key, "type").agg(F.count("*").alias("k"))
    counts = each.groupBy(*key).agg(F.sum("k").alias("size"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "k")))).alias("types"))
    return merge_join(counts, first, key).select(*key, "size", "labels", "types")


def node_rows(nodes: DataFrame) -> DataFrame:
    """Flat node table: the label falls back to the id, unsafe links to null, resolve_id to the local id."""
    from ..functions.links import safe_link

    local = F.regexp_replace("id", "^[^:]*:", "")
    pick = F.coalesce(F.try_element_at("attrs", F.lit("resolve_id")), F.try_element_at("attrs", F.lit("gene_id")), local)
    return nodes.select("graph_id", "id", "type", F.coalesce(F.nullif("label", F.lit("")), "id").alias("label"), safe_link("url").alias("url"), pick.alias("resolve_id"))


def edge_rows(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Flat edge table with the labels of both ends, ids where there is none."""
    out = edges
    for side in ("subject", "object"):
        names = nodes.select("graph_id", F.col("id").alias(side), F.nullif("label", F.lit("")).alias(f"{side}_label"))
        out = out.join(names, ["graph_id", side], "left").withColumn(f"{side}_label", F.coalesce(f"{side}_label", side))
    return out


def matching_rows(rows: DataFrame, needle: str, columns: list[str], order: list[Column], most: int = TABLE_ROWS) -> DataFrame:
    """Rows of which a column contains the needle, the first ``most`` in order, with total."""
    found = rows.filter(F.exists(F.array(*(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns)), lambda x: x.contains(needle.lower())))
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(*order).limit(most).crossJoin(F.broadcast(total))  # total is one row


def nodes_of(edges: DataFrame, type_of: Column, label_of: Column) -> DataFrame:
    """Nodes at the ends of edges, type and label from their id."""
    return endpoints(edges).withColumns({"type": type_of, "label": label_of})


def node_projection(nodes: DataFrame) -> DataFrame:
    """(graph_id, id, node) as a question sees nodes: type, label, and the organism only where it is known."""
    organism = F.try_element_at("attrs", F.lit("organism"))
    whole = F.to_json(F.struct(F.nullif(organism, F.lit("")).alias("organism"), F.col("type").alias("type"), F.coalesce(F.nullif("label", F.lit("")), "id").alias("label")))
    return nodes.select("graph_id", "id", whole.alias("node"))
