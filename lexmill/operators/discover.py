"""Structure discovery over a node table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import strip


def tag_inventory(nodes: DataFrame) -> DataFrame:
    """tag, n: every element name and how often it occurs."""
    return nodes.groupBy("tag").agg(F.count("*").alias("n"))


def tag_edges(nodes: DataFrame) -> DataFrame:
    """parent_tag, tag, n: which elements occur in which; roots have no row. A path ends in the parent's and the own name, so nothing is joined."""
    return nodes.where("depth > 0").groupBy(F.element_at("path", -2).alias("parent_tag"), "tag").agg(F.count("*").alias("n"))


def tag_graph(nodes: DataFrame) -> DataFrame:
    """tag, parents, children: the distinct parent and child names of each element, in alphabetical order."""
    edges = tag_edges(nodes)
    up = edges.groupBy("tag").agg(F.array_sort(F.collect_set("parent_tag")).alias("parents"))
    down = edges.groupBy(F.col("parent_tag").alias("tag")).agg(F.array_sort(F.collect_set("tag")).alias("children"))
    none = F.array().cast("array<string>")
    both = nodes.select("tag").distinct().join(up, "tag", "left").join(down, "tag", "left")
    return both.select("tag", F.coalesce("parents", none).alias("parents"), F.coalesce("children", none).alias("children"))


def path_suffixes(nodes: DataFrame) -> DataFrame:
    """path: every distinct element path and each of its suffixes."""
    paths = nodes.select("path").distinct()
    return paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.array_join(F.slice("path", i, F.size("path")), "/"))).alias("path")).distinct()


def valid_paths(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those rows of paths (path_id, path) whose neighbouring steps are all edges of the tag graph; one step alone passes."""
    steps = paths.withColumn("steps", F.filter(F.split("path", "/"), lambda x: x != ""))
    pairs = steps.select("path_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("steps") - 1, F.lit(1))), lambda i: F.struct(F.element_at("steps", i).alias("parent_tag"), F.get("steps", i).alias("tag")))).alias("e")).select("path_id", "e.*").where("tag is not null")
    bad = pairs.join(tag_edges(nodes), ["parent_tag", "tag"], "left_anti").select("path_id").distinct()
    return paths.join(bad, "path_id", "left_anti")


def value_inventory(nodes: DataFrame, tags: list[str], attribute: str | None = None, limit: int | None = 100) -> DataFrame:
    """value, n: distinct trimmed text (attribute None) or attribute values of elements, in order; at most `limit` of them; blank ones don't count."""
    value = strip(F.col("text") if attribute is None else F.col("attrs")[attribute])
    found = nodes.where(F.col("tag").isin(tags)).select(value.alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n")).orderBy("value")
    return found if limit is None else found.limit(limit)


def container_profile(containers: DataFrame) -> DataFrame:
    """structure, n from containers (entry, level, name): how many entries have which set of names at which level."""
    levels = containers.groupBy("entry", "level").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    each = levels.groupBy("entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "names"))), lambda x: F.concat_ws(":", x["level"], x["names"])), ";").alias("structure"))
    return each.groupBy("structure").agg(F.count("*").alias("n"))


def container_ancestry(nodes: DataFrame, tag: str = "container") -> DataFrame:
    """doc_id, pre, names: the names of the containers around each container, outermost first, leaving out those without a token of their own."""
    own = nodes.where(F.col("tag") == tag).select("doc_id", "pre", "ancestors", F.col("attrs")["name"].alias("name"))
    direct = nodes.where("tag = 'TOKEN'").select("doc_id", F.col("parent").alias("pre")).distinct()
    around = own.select("doc_id", "pre", F.explode_outer("ancestors").alias("up"))
    holders = own.join(direct, ["doc_id", "pre"], "left_semi").select("doc_id", F.col("pre").alias("up"), "name")
    found = around.join(holders, ["doc_id", "up"], "left").groupBy("doc_id", "pre").agg(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("up", "name")))).alias("x"))
    return found.select("doc_id", "pre", F.transform("x", lambda s: s["name"]).alias("names"))
