"""Line dedup by a log-template tree: lines meet in leaves by token count and leading tokens, where variable fields are generalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import WORD, join_ids, small, stored

FIELD = "<*>"


def _normal(rows: DataFrame) -> DataFrame:
    """rows with column `normal`: `text` with runs of digits generalised and its lines' tokens one blank apart, without blanks at the lines' ends."""
    rows = rows.withColumn("normal", F.regexp_replace("text", "[0-9]+", FIELD))  # a step of its own, so that it is done once
    text, odd = F.col("normal"), F.lit(False)
    for x in ("  ", "\t", "\r", "\x0b", "\x0c", " \n", "\n "):
        odd = odd | text.contains(x)
    even = F.regexp_replace(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "), r" ?\n ?", "\n")
    return rows.withColumn("normal", F.trim(F.when(odd, even).otherwise(text)))


def _lines(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """doc_id, line (normal), leaf and code of every line of at least `min_tokens` tokens."""
    lines = _normal(docs).select("doc_id", F.explode(F.split("normal", "\n")).alias("line"))
    some = lines.where(F.substring_index("line", " ", min_tokens - 1) != F.col("line"))  # looks no further than it must
    blanks = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    return some.select("doc_id", "line", F.xxhash64(blanks, F.substring_index("line", " ", depth)).alias("leaf"), F.xxhash64("line").alias("code"))


def _nearest(loose: DataFrame, known: DataFrame, depth: int, similarity: float) -> DataFrame:
    """leaf, code, template: for each line of `loose` (leaf, code, tokens) the template of `known` (leaf, template, fields) in its leaf that it agrees with at most places.

    The leading tokens, which a leaf's lines share, count as places that agree; `similarity` of all places must.
    """
    need = F.greatest(F.ceil(F.lit(similarity) * F.size("tokens")) - depth, F.lit(0))
    lines = loose.select("leaf", "code", need.alias("need"), F.slice("tokens", depth + 1, F.size("tokens")).alias("rest"))
    places = lines.where("need > 0").select("leaf", "code", "need", F.posexplode("rest").alias("at", "token"))
    constants = known.select("leaf", "template", F.explode("fields").alias("f")).select("leaf", "template", "f.at", "f.token")
    agreed = places.join(constants, ["leaf", "at", "token"]).groupBy("leaf", "code", "template").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need")
    best = agreed.groupBy("leaf", "code").agg(F.min_by("template", F.struct(-F.col("n"), "template")).alias("template"))
    by_head = lines.where("need = 0").join(known.groupBy("leaf").agg(F.min("template").alias("template")), "leaf").select("leaf", "code", "template")
    return best.unionByName(by_head)


def line_templates(docs: DataFrame, depth: int = 3, min_docs: int = 3, min_tokens: int = 4, similarity: float = 0.6, nearest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(templates, lines): template, code, n_docs, first_doc of recurring templates, and the stored (leaf, code, doc_id) of all lines.

    The tree has fixed depth: a line goes to a leaf by its token count and its `depth` leading tokens. In a leaf where lines of at
    least `min_docs` documents meet, a token that fewer lines than that have at its place is a variable field. A template
    is a line with its fields generalised; it recurs if constant tokens make up `similarity` of it and `min_docs`
    documents have it. `nearest`: a line without a recurring template of its own gets the one of its leaf that most documents
    have, if it agrees with that at `similarity` of the places or more, and otherwise the recurring one it agrees with best,
    if so; n_docs and first_doc stay those of the template's own lines.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    lines = _lines(docs, depth, min_tokens)
    seen = stored(lines.select("leaf", "code", "doc_id").distinct())
    codes = seen.groupBy("leaf", "code").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    leaves = stored(codes.groupBy("leaf").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).where(F.col("n") >= min_docs).select("leaf", "kinds"))
    kinds = codes.join(leaves, "leaf").select("leaf", "code", "n")
    wanted = stored(codes.join(small(leaves.where("kinds > 1").select("leaf")), "leaf", "left_semi"))
    again = _lines(join_ids(docs, wanted.select("doc_id").distinct(), "left_semi"), depth, min_tokens).select("leaf", "code", "line")
    several = stored(again.join(small(wanted.select("leaf", "code", "n")), ["leaf", "code"]).groupBy("leaf", "code", "n").agg(F.split(F.first("line"), " ").alias("tokens")))

    placed = several.select("leaf", "code", "n", F.size("tokens").alias("size"), F.posexplode(F.slice("tokens", depth + 1, F.size("tokens"))).alias("at", "token"))
    common = placed.groupBy("leaf", "at", "token").agg(F.sum("n").alias("m")).where(F.col("m") >= min_docs)
    kept = placed.join(common, ["leaf", "at", "token"], "left").select("leaf", "code", "size", F.struct("at", F.when(F.col("m").isNotNull(), F.col("token")).otherwise(FIELD).alias("token")).alias("field"))
    shaped = kept.groupBy("leaf", "code", "size").agg(F.array_sort(F.collect_list("field")).alias("fields"))  # of one line
    fields = F.size(F.filter("fields", lambda f: f["token"] == FIELD))
    general = shaped.where(fields <= (1 - similarity) * F.col("size")).select("leaf", "code", F.xxhash64("leaf", "fields").alias("template"))
    single = kinds.join(leaves.where("kinds = 1").select("leaf"), "leaf", "left_semi").select("leaf", "code", F.col("leaf").alias("template"))
    short = several.where(F.size("tokens") <= depth).select("leaf", "code", F.col("leaf").alias("template"))
    of = stored(general.unionByName(single).unionByName(short))
    counts = seen.join(small(of), ["leaf", "code"]).select("template", "doc_id").distinct().groupBy("template").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).where(F.col("n_docs") >= min_docs)
    if not nearest:
        return of.join(counts, "template"), seen
    counts = stored(counts)
    own = stored(of.join(counts, "template"))
    known = stored(shaped.join(own, ["leaf", "code"]).groupBy("leaf", "template").agg(F.first("fields").alias("fields"), F.first("n_docs").alias("n_docs")))
    head = known.groupBy("leaf").agg(F.max_by(F.struct("template", "fields"), F.struct("n_docs", "template")).alias("t")).select("leaf", "t.*")
    loose = stored(several.where(F.size("tokens") > depth).join(own, ["leaf", "code"], "left_anti"))
    near = stored(_nearest(loose, head, depth, similarity))  # so copies of a leaf's main line don't meet all its other templates
    far = _nearest(loose.join(near, ["leaf", "code"], "left_anti"), known, depth, similarity)
    return own.unionByName(near.unionByName(far).join(counts, "template")), seen


def _cut(docs: DataFrame, **rules) -> DataFrame:
    """row (a struct of docs' columns), text (of which the recurring lines are gone), n_lines, n_dropped (0: the text is as it was)."""
    templates, seen = line_templates(docs, **rules)
    known = small(stored(templates.select("leaf", "code", "first_doc")))
    dropped = seen.join(known, ["leaf", "code"]).where(F.col("doc_id") != F.col("first_doc"))
    by_doc = dropped.groupBy("doc_id").agg(F.collect_set("code").alias("codes"))  # of one document's lines
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    id_, text = F.col("row").getField("doc_id").cast("long"), F.col("row").getField("text").cast("string")
    out = own.join(by_doc, id_ == by_doc["doc_id"], "left")
    lines = F.split(text, "\n")
    some = _normal(out.withColumn("text", F.when(F.col("codes").isNotNull(), text)))
    both = F.arrays_zip(lines.alias("line"), F.split("normal", "\n").alias("normal"))
    some = some.withColumn("stays", F.filter(both, lambda x: ~F.array_contains("codes", F.xxhash64(x["normal"])))["line"])
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    cut = F.col("codes").isNotNull()
    return some.select("row", F.when(cut, F.array_join("stays", "\n")).otherwise(text).alias("text"), n_lines.alias("n_lines"), F.when(cut, n_lines - F.size("stays")).otherwise(F.lit(0)).cast("long").alias("n_dropped"))


def without_recurring_lines(docs: DataFrame, depth: int = 3, min_docs: int = 3, min_tokens: int = 4, similarity: float = 0.6, nearest: bool = False) -> DataFrame:
    """docs with recurring lines dropped from every document but each template's first (least doc_id), plus n_lines and n_dropped.

    docs: doc_id, text and any other columns, which stay (but n_lines and n_dropped are replaced). Lines are cut at \\n; those with fewer
    than `min_tokens` tokens stay, as do null and empty texts and rows with a null doc_id. Rows that repeat a doc_id are one document:
    its lines don't recur by that. A line's place is not used, so a line repeated in one document stays or goes as a whole.
    `nearest`: lines that are no template's own but agree with one at `similarity` of the places go too. No Python runs on the
    executors.
    """
    out = _cut(docs, depth=depth, min_docs=min_docs, min_tokens=min_tokens, similarity=similarity, nearest=nearest)
    own = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*own, "n_lines", "n_dropped")


def deduplicated(docs: DataFrame, depth: int = 3, min_docs: int = 3, min_tokens: int = 4, similarity: float = 0.6, nearest: bool = True) -> DataFrame:
    """docs as without_recurring_lines() leaves them, with their own columns alone.

    n_chars, if there, is that of the new text. Documents that lose their last word go; those that had none stay, as nothing was cut.
    """
    out = _cut(docs, depth=depth, min_docs=min_docs, min_tokens=min_tokens, similarity=similarity, nearest=nearest)
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(WORD))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row").getField("n_chars").cast("long"))
    return out.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])
