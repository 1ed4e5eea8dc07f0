"""URL filters with dated lists: entries become validity intervals, and every capture meets those active at its fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import stored

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]+)"
BUCKET = 30 * 86_400
#: Lists of up to so many bytes are sent to every executor.
LIST_BYTES = 32_000_000


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def path_parts(url: Column) -> Column:
    return F.array_remove(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1), "/"), "")


def url_keys(url: Column) -> Column:
    """What a list can name: the host, every parent of it with two labels or more, and the host with the first, first two, ... parts of the path."""
    host, parts, nothing = host_of(url), path_parts(url), F.array().cast("array<string>")
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", host, F.slice(parts, 1, i)))).otherwise(nothing)
    return F.when(host != "", F.array_distinct(F.concat(parents, paths))).otherwise(nothing)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """pattern, begins, ends (null: still active) from dated entries: pattern, dated (epoch seconds), action 'add' or 'remove'.

    Hosts are compared in lower case, paths as they are. An entry holds until the pattern's next one. Of entries with one pattern and time, 'remove' wins. Rows with a null are ignored.
    """
    host = F.substring_index("pattern", "/", 1)
    own = entries.select(F.concat(F.lower(host), F.expr("substring(pattern, length(substring_index(pattern, '/', 1)) + 1)")).alias("pattern"), F.col("dated").cast("long").alias("dated"), F.col("action").alias("action")).where("pattern is not null and dated is not null and action in ('add', 'remove')")
    one = own.groupBy("pattern", "dated").agg(F.max("action").alias("action"))  # 'remove' > 'add'
    each = one.withColumn("ends", F.lead("dated").over(Window.partitionBy("pattern").orderBy("dated")))
    return each.where("action = 'add'").select("pattern", F.col("dated").alias("begins"), "ends")


def temporal_list_join(captures: DataFrame, entries: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """page_id, blocked, n_active, first_match for every capture: page_id, url, fetched (epoch seconds).

    Other columns are ignored. The as-of join is an equi-join on (pattern, time bucket), then begins <= fetched < ends: an interval lies in each bucket that it
    meets between the first and the last capture, so a pattern's history isn't paired with all its captures, and a hot
    host is spread over the buckets; past LIST_BYTES, what still meets in one bucket is left to the engine's splitting of skewed joins. n_active: how many patterns of the URL are active; first_match: the least of them. A
    capture whose url or time is null or has no host is not blocked. Rows that repeat a page_id, null too, are one capture: it
    counts what is active for any of them.
    """
    captures = captures.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("fetched").cast("long"))
    range_ = captures.agg(F.min("fetched").alias("a"), F.max("fetched").alias("b")).first()
    a, b = (range_["a"] or 0) // bucket, (range_["b"] or 0) // bucket
    spans = validity_intervals(entries)
    begins = F.greatest(F.floor(F.col("begins") / bucket), F.lit(a))
    ends = F.least(F.floor(F.coalesce(F.col("ends") - 1, F.lit((b + 1) * bucket)) / bucket), F.lit(b))
    spans = spans.withColumn("x", begins).withColumn("y", ends).where("x <= y").select("pattern", "begins", "ends", F.explode(F.sequence("x", "y")).alias("bucket"))
    spans = stored(spans)
    size = spans.agg(F.coalesce(F.sum(F.octet_length("pattern") + 40), F.lit(0))).first()[0]
    spans = F.broadcast(spans) if size <= LIST_BYTES else spans  # so captures are shuffled only to lists too long to send
    keys = captures.select("page_id", "fetched", F.floor(F.col("fetched") / bucket).alias("bucket"), F.explode_outer(url_keys(F.col("url"))).alias("pattern"))
    active = (keys["pattern"] == spans["pattern"]) & (keys["bucket"] == spans["bucket"]) & (spans["begins"] <= keys["fetched"]) & (spans["ends"].isNull() | (keys["fetched"] < spans["ends"]))
    met = keys.join(spans, active, "left").select("page_id", spans["pattern"].alias("match")).distinct()
    return met.groupBy("page_id").agg(F.count("match").alias("n_active"), F.min("match").alias("first_match")).select("page_id", (F.col("n_active") > 0).alias("blocked"), "n_active", "first_match")
