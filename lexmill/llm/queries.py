"""The corpus operators over their whole tables: one query for each, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import table


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.token_store import token_file_digests

    return token_file_digests(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.repetition import repetition_rules

    return repetition_rules(table(spark, sf_dir, "documents")).drop("spans")


def op4_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.hmm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.packing import packed_documents

    return packed_documents(table(spark, sf_dir, "documents"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list for the pages' own hosts, as the tables hold none: a fixed rule on each host's md5 decides what is added and removed when."""
    from lexmill.llm.url_lists import host_of, path_parts

    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host != ''").distinct().withColumn("m", F.md5("host"))
    digits = lambda at, n: F.conv(F.substring("m", at, n), 16, 10).cast("long")
    start = F.lit(1_672_531_200) + digits(1, 4) * 300
    parent = F.regexp_replace("host", r"^[^.]*\.(?=[^.]*\.)", "")
    adds = hosts.where(digits(5, 2) < 80).select("host", "m", start.alias("dated"), F.when(digits(7, 1) < 2, parent).otherwise(F.col("host")).alias("pattern"))
    removes = adds.where(digits(8, 1) < 8).select("pattern", (F.col("dated") + 86_400 * (1 + digits(9, 2))).alias("dated"), F.lit("remove").alias("action"))
    back = adds.where(digits(8, 1) < 3).select("pattern", (F.col("dated") + 86_400 * (120 + digits(11, 2))).alias("dated"), F.lit("add").alias("action"))
    first = F.get(path_parts(F.col("url")), 0)
    paths = pages.select(F.concat_ws("/", host_of(F.col("url")), first).alias("pattern")).where(first.isNotNull()).distinct().withColumn("m", F.md5("pattern")).where(digits(5, 2) < 60)
    return adds.select("pattern", "dated", F.lit("add").alias("action")).unionByName(removes).unionByName(back).unionByName(paths.select("pattern", start.alias("dated"), F.lit("add").alias("action")))


def op7_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages have no fetch time: a page's is fixed by its page_id, within two years."""
    from lexmill.llm.url_lists import temporal_list_join

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.lit(1_672_531_200) + F.pmod(F.col("page_id") * 7_919_113, F.lit(63_072_000)))
    return temporal_list_join(captures, list_entries(pages))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.line_templates import without_recurring_lines

    return without_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.centroids import clustered

    return clustered(table(spark, sf_dir, "embeddings"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.byte_bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.llm.hard_negatives import hard_negatives, relabelled

    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_store, op2_decontamination, op3_repetition_rules, op4_hmm_scores, op5_toxicity, op6_best_fit_packing, op7_temporal_url_lists, op8_line_templates, op9_quality, op10_jaccard_join, op11_centroid_clustering, op12_byte_bpe, op13_hard_negatives)
}

_OP2 = """
WITH words AS (SELECT *, row_number() OVER () AS r FROM (
  SELECT 'd' AS kind, doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT 'i', item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')
  FROM benchmark WHERE item_id IS NOT NULL)),
items AS (
  SELECT DISTINCT id AS item_id, r AS set_id, least(len(w), 5) AS k, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE kind = 'i' AND len(w) > 0)),
held AS (
  SELECT DISTINCT id AS doc_id, r, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT id, r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT DISTINCT k FROM items) WHERE kind = 'd' AND len(w) >= k)),
sizes AS (SELECT set_id, count(*) AS n FROM items GROUP BY 1),
found AS (SELECT doc_id, item_id, any_value(n)::BIGINT AS n_shingles, count(*)::BIGINT AS n_found FROM held JOIN items USING (k, s) JOIN sizes USING (set_id) GROUP BY doc_id, r, item_id, set_id HAVING 100 * count(*) >= 75 * any_value(n))
SELECT doc_id, item_id, n_shingles, n_found FROM found QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_found DESC, n_shingles DESC) = 1
"""

_HOST = r"'^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)'"
_OP7 = rf"""
WITH p AS (
  SELECT page_id, 1672531200 + (page_id * 7919113) % 63072000 AS fetched, lower(regexp_extract(coalesce(url, ''), {_HOST}, 1)) AS host,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]+)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages),
h AS (SELECT DISTINCT host, md5(host) AS m FROM p WHERE host <> ''),
a AS (
  SELECT host, m, 1672531200 + ('0x' || substr(m, 1, 4))::BIGINT * 300 AS dated,
    CASE WHEN ('0x' || substr(m, 7, 1))::BIGINT < 2 AND len(string_split(host, '.')) > 2 THEN substr(host, strpos(host, '.') + 1) ELSE host END AS pattern
  FROM h WHERE ('0x' || substr(m, 5, 2))::BIGINT < 80),
e AS (
  SELECT pattern, dated, 'add' AS action FROM a
  UNION ALL SELECT pattern, dated + 86400 * (1 + ('0x' || substr(m, 9, 2))::BIGINT), 'remove' FROM a WHERE ('0x' || substr(m, 8, 1))::BIGINT < 8
  UNION ALL SELECT pattern, dated + 86400 * (120 + ('0x' || substr(m, 11, 2))::BIGINT), 'add' FROM a WHERE ('0x' || substr(m, 8, 1))::BIGINT < 3
  UNION ALL SELECT pattern, 1672531200 + ('0x' || substr(md5(pattern), 1, 4))::BIGINT * 300, 'add' FROM (SELECT DISTINCT host || '/' || parts[1] AS pattern FROM p WHERE host <> '' AND len(parts) > 0) WHERE ('0x' || substr(md5(pattern), 5, 2))::BIGINT < 60),
i AS (
  SELECT pattern, dated AS begins, lead(dated) OVER (PARTITION BY pattern ORDER BY dated) AS ends, action
  FROM (SELECT pattern, dated, max(action) AS action FROM e GROUP BY 1, 2)),
l AS (SELECT page_id, fetched, host, parts, string_split(host, '.') AS ls FROM p WHERE host <> ''),
k AS (
  SELECT page_id, fetched, array_to_string(ls[j:], '.') AS pattern FROM (SELECT *, unnest(range(1, greatest(len(ls) - 1, 1) + 1)) AS j FROM l)
  UNION SELECT page_id, fetched, host || '/' || array_to_string(parts[:j], '/') FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS j FROM l)),
r AS (
  SELECT k.page_id, count(DISTINCT k.pattern) AS n, min(k.pattern) AS f FROM k JOIN i ON i.pattern = k.pattern AND i.action = 'add' AND i.begins <= k.fetched AND (i.ends IS NULL OR k.fetched < i.ends) GROUP BY 1)
SELECT p.page_id, coalesce(n, 0) > 0 AS blocked, coalesce(n, 0)::BIGINT AS n_active, f AS first_match FROM (SELECT DISTINCT page_id FROM p) p LEFT JOIN r USING (page_id)
"""

_OP8 = """
WITH l AS (
  SELECT doc_id, spot, line, list_filter(string_split_regex(regexp_replace(line, '[0-9]+', '<*>', 'g'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS t
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS spot FROM documents WHERE text IS NOT NULL)),
own AS (SELECT DISTINCT doc_id, t, len(t) AS n, t[1:3] AS head FROM l WHERE len(t) >= 4),
c AS (SELECT n, head, t, count(*) AS docs FROM own GROUP BY ALL),
f AS (SELECT n, head, sum(docs) AS docs, count(*) AS kinds FROM c GROUP BY ALL HAVING sum(docs) >= 3),
k AS (SELECT c.n, c.head, c.t, c.docs, f.kinds FROM c JOIN f USING (n, head)),
placed AS (SELECT n, head, t, docs, kinds, unnest(range(4, n + 1)) AS spot FROM k),
toks AS (SELECT n, head, spot, t[spot] AS tok, sum(docs) AS m FROM placed GROUP BY ALL),
shaped AS (
  SELECT p.n, p.head, p.t, any_value(p.kinds) AS kinds, list(CASE WHEN q.m >= 3 THEN q.tok ELSE '<*>' END ORDER BY p.spot) AS g
  FROM placed p JOIN toks q ON q.n = p.n AND q.head = p.head AND q.spot = p.spot AND q.tok = p.t[p.spot] GROUP BY p.n, p.head, p.t),
tpl AS (SELECT n, head, t, CASE WHEN kinds = 1 THEN NULL ELSE g END AS g FROM shaped WHERE kinds = 1 OR len(list_filter(g, lambda x: x = '<*>')) <= 0.4 * n),
counts AS (SELECT tpl.n, tpl.head, g, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM tpl JOIN own ON own.t = tpl.t GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
gone AS (SELECT own.doc_id, own.t FROM own JOIN tpl ON own.t = tpl.t JOIN counts ON counts.n = tpl.n AND counts.head = tpl.head AND counts.g IS NOT DISTINCT FROM tpl.g WHERE own.doc_id <> counts.first_doc),
marked AS (SELECT l.doc_id, spot, line, gone.doc_id IS NOT NULL AS gone_ FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.t = l.t),
kept AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY spot) FILTER (NOT gone_), '') AS text, count(*) AS n_lines, count(*) FILTER (gone_) AS n_dropped FROM marked GROUP BY doc_id)
SELECT d.doc_id, kept.text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped FROM documents d LEFT JOIN kept USING (doc_id)
"""

_OP10 = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = w.doc_id)::BIGINT AS component_id
FROM words w LEFT JOIN n USING (doc_id)
"""



def _op11(k: int = 40, rounds: int = 5) -> str:
    """Each round in SQL: the least of (squared distance, number) for each vector, then the floored means."""
    nearest = "SELECT v.r, min(struct_pack(d := d, c := c)) AS m FROM (SELECT v.r, c.c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d FROM v, {c} c) v GROUP BY v.r"
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, m.c AS c FROM ({nearest.format(c=f'c{n}')}))")
        steps.append(f"s{n} AS (SELECT c, i, ((s - ((s % n) + n) % n) / n)::BIGINT AS y FROM (SELECT c, i, sum(v.x[i])::BIGINT AS s, count(*) AS n FROM a{n} JOIN v USING (r), range(1, 65) t(i) GROUP BY c, i))")
        steps.append(f"c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(list(y ORDER BY i) FILTER (y IS NOT NULL), any_value(o.x)) AS x FROM c{n} o LEFT JOIN s{n} s ON s.c = o.c GROUP BY o.c)")
    steps.append(f"f AS MATERIALIZED (SELECT r, m.c AS c, m.d AS d FROM ({nearest.format(c=f'c{rounds}')}))")
    return f"WITH {', '.join(steps)} SELECT vec_id, f.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY f.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(x.x, ',')) AS centroid_sha256 FROM f JOIN v USING (r) JOIN c{rounds} x ON x.c = f.c"


_OP13 = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS a, c.r, c.vec_id AS c, a.label = c.label AS same, coalesce(list_sum(list_transform(range(1, least(len(a.x), len(c.x)) + 1), lambda i: a.x[i] * c.x[i])), 0)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT a, r, c, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5)
SELECT p.a AS anchor_id, p.c AS positive_id, (row_number() OVER (PARTITION BY p.a, p.r ORDER BY n.score DESC, n.c))::INTEGER AS rank, n.c AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.r ORDER BY n.score DESC, n.c) <= 5
"""

ORACLE: dict[str, str] = {"op2_decontamination": _OP2, "op7_temporal_url_lists": _OP7, "op8_line_templates": _OP8, "op10_jaccard_join": _OP10, "op11_centroid_clustering": _op11(), "op13_hard_negatives": _OP13}
