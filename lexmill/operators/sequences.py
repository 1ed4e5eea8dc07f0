"""Token and label sequences: features, sequence cuts, decoding of labels into containers, and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lexmill.functions.text import escaped, peeled, replaced, strip
from lexmill.sources.store import stored


def token_features(tokens: DataFrame) -> DataFrame:
    """tokens (doc_id, ord, line, font_size, bold, italic, font_name, text) with newline and features; empty tokens are left out.

    newline: the line differs from the token's before (0 before the first); it isn't reset at a page.
    """
    own = tokens.where("text is not null and text <> ''")
    before = F.coalesce(F.lag("line").over(Window.partitionBy("doc_id").orderBy("ord")), F.lit(0))
    own = own.withColumn("newline", (F.col("line") != before).cast("int"))
    named = [F.concat(F.lit(f"{n}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for n, c in (("SIZE", "font_size"), ("BOLD", "bold"), ("ITALIC", "italic"), ("FONT", "font_name"), ("TOKEN", "text"), ("NEWLINE", "newline"))]
    return own.withColumn("features", F.array(*named))


def split_punctuation(tokens: DataFrame) -> DataFrame:
    """Tokens (doc_id, ord, line, word, text) with the signs at their ends as tokens of their own, and word renumbered along each line.

    A run of tokens on one line shifts by the tokens that were added before in the run.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("ord")
    cut = tokens.withColumn("parts", peeled(F.col("text"))).where(F.size("parts") > 0)
    turn = (F.col("line") != F.lag("line").over(by_doc)).cast("int")
    cut = cut.withColumn("run", F.sum(F.coalesce(turn, F.lit(0))).over(by_doc))
    in_run = Window.partitionBy("doc_id", "run").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("shift", F.coalesce(F.sum(F.size("parts") - 1).over(in_run), F.lit(0)))
    return cut.select("doc_id", "ord", "line", F.posexplode("parts").alias("nth", "text"), "word", "shift").select("doc_id", "ord", "nth", "line", (F.col("word") + F.col("shift") + F.col("nth")).cast("long").alias("word"), "text")


def islands(rows: DataFrame, key: Column, by: WindowSpec, name: str) -> DataFrame:
    """rows with a running number of the runs of equal keys."""
    return rows.withColumn(name, F.sum(F.when(F.lag(key).over(by).eqNullSafe(key), 0).otherwise(1)).over(by))


def label_of_container(container: Column, name: Column, by: WindowSpec) -> Column:
    """name_start at a container's first token, name_inside at the others, noise outside all containers."""
    first = F.row_number().over(by) == 1
    return F.when(container.isNull(), F.lit("noise")).otherwise(F.concat(name, F.when(first, "_start").otherwise("_inside")))


def decoded(labels: DataFrame) -> DataFrame:
    """labels (seq, ord, label) with base and container: labels back to containers.

    A new container begins at a _start, where the base label changes, and at the first token; 'scrap' and 'noise' are bases like others.
    """
    by = Window.partitionBy("seq").orderBy("ord")
    base = F.regexp_replace("label", "_(start|inside)$", "")
    own = labels.withColumn("base", base)
    new = F.col("label").endswith("_start") | ~F.lag("base").over(by).eqNullSafe(F.col("base"))
    return own.withColumn("container", F.sum(new.cast("int")).over(by))


def segments(labels: DataFrame, start: str = "entry_start", dropped: str = "scrap") -> DataFrame:
    """labels (seq, ord, label) without `dropped`, and with segment: the running number of `start` labels, across pages; rows before the first go."""
    by = Window.partitionBy("seq").orderBy("ord")
    return labels.where(F.col("label") != dropped).withColumn("segment", F.sum((F.col("label") == start).cast("int")).over(by)).where("segment > 0")


def sequences(tokens: DataFrame, key: str) -> DataFrame:
    """One row for each key: its features and labels in order, as a tagger is trained on."""
    pairs = F.array_sort(F.collect_list(F.struct("ord", "features", "label")))
    return tokens.groupBy(key).agg(pairs.alias("x")).select(key, F.transform("x", lambda s: s["features"]).alias("features"), F.transform("x", lambda s: s["label"]).alias("labels"))


def aligned(raw: DataFrame, annotated: DataFrame) -> DataFrame:
    """Raw tokens (doc_id, ord, text) with the labels of annotated ones (doc_id, ord, text, label), up to the first place where the texts differ."""
    both = raw.join(annotated.select("doc_id", "ord", F.col("text").alias("other"), "label"), ["doc_id", "ord"])
    stop = both.where("text <> other").groupBy("doc_id").agg(F.min("ord").alias("stop"))
    return both.join(stop, "doc_id", "left").where("stop is null or ord < stop").drop("other", "stop")


def page_window(tokens: DataFrame, first: int, last: int) -> DataFrame:
    return tokens.where(F.col("page").between(first, last))


def next_pages(tokens: DataFrame, done: int, n: int) -> DataFrame:
    """The n pages after `done` windows of n."""
    return page_window(tokens, done * n + 1, (done + 1) * n)


def bodies(rows: DataFrame, n: int, order: list[str], key: str) -> DataFrame:
    """rows of each key in bodies of n, with the range of places that a body holds, as 'from-to'."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    out = rows.withColumn("k", k).withColumn("body", F.floor((F.col("k") - 1) / n))
    last = F.max("k").over(Window.partitionBy(key, "body"))
    return out.withColumn("range", F.concat_ws("-", (F.col("body") * n + 1).cast("string"), last.cast("string"))).drop("k")


def places(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with place, from 1, in an order that has no ties.

    Places come from a range partitioning and the partitions' counts, so no single task sees all rows.
    """
    spread = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))  # read twice
    counts = spread.groupBy("part").agg(F.count("*").alias("m"))
    before = counts.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"))  # a row for each partition
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return spread.join(F.broadcast(before), "part").withColumn("place", (own + F.col("before")).cast("long")).drop("part", "before")


def head_tail_split(rows: DataFrame, order: list[str], share: float = 0.75) -> DataFrame:
    """rows with test: whether a row lies in the last part of all, in order; the head has round(n * share) rows, halves to even."""
    head = round(rows.count() * share)
    return places(rows, order).withColumn("test", F.col("place") > head).drop("place")


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(actual).cast("string").alias("actual"), F.col(predicted).cast("string").alias("predicted")).agg(F.count("*").alias("n"))


def classification_report(matrix: DataFrame) -> DataFrame:
    """label, support, precision, recall, f1 from a confusion matrix; a ratio over nothing is 0."""
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    by_actual = matrix.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"), right.alias("hit"))
    by_predicted = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    both = by_actual.join(by_predicted, "label", "full").na.fill(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("hit"), F.col("said")), ratio(F.col("hit"), F.col("support"))
    return both.select("label", F.col("support").cast("long").alias("support"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def accuracy(matrix: DataFrame) -> DataFrame:
    """n, right, accuracy, one row, of a confusion matrix; the share is 0 without rows."""
    right = F.coalesce(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))), F.lit(0)).cast("long")
    sums = matrix.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), right.alias("right"))
    return sums.withColumn("accuracy", F.when(F.col("n") > 0, F.col("right") / F.col("n")).otherwise(0.0))


def vocabulary(values: DataFrame, column: str) -> DataFrame:
    """value, id: distinct values numbered alphabetically, so that a run repeats; ids begin at 1, 0 is for the unknown."""
    found = values.select(F.col(column).alias("value")).where("value is not null").distinct()
    return places(found, ["value"]).select("value", F.col("place").alias("id"))


def coded(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """rows with code: the id that a vocabulary (value, id) has for the column, 0 for what it lacks and for null."""
    ids = known.select(F.col("value").alias(column), F.col("id").alias("code"))
    return rows.join(ids, column, "left").withColumn("code", F.coalesce("code", F.lit(0).cast("long")))


#: A vocabulary of up to so many values goes to every task as a map; longer ones are joined.
MAP_VALUES = 10_000


def char_codes(rows: DataFrame, column: str, known: DataFrame, width: int) -> DataFrame:
    """rows with codes: the ids that a vocabulary (value, id) of characters has for a text's characters, 0 for those it lacks.

    Always `width` long: shorter texts are padded with zeros on the left, of longer ones the last characters count. A null text is empty.
    """
    few = known.limit(MAP_VALUES + 1).collect()
    chars = F.filter(F.split(F.coalesce(F.col(column), F.lit("")), ""), lambda c: c != "")
    if len(few) <= MAP_VALUES:
        table = F.create_map(*[F.lit(x) for r in few for x in (r["value"], int(r["id"]))]).cast("map<string,bigint>")
        codes = F.transform(chars, lambda c: F.coalesce(F.try_element_at(table, c), F.lit(0)))
        out = rows.withColumn("codes", codes)
    else:
        own = rows.withColumn("row__", F.monotonically_increasing_id())
        each = stored(own).select("*", F.posexplode_outer(chars).alias("at__", "char__"))
        met = each.join(known.select(F.col("value").alias("char__"), F.col("id").alias("code__")), "char__", "left")
        found = F.array_sort(F.collect_list(F.when(F.col("at__").isNotNull(), F.struct("at__", F.coalesce("code__", F.lit(0)).cast("long").alias("c")))))
        out = met.groupBy("row__", *rows.columns).agg(F.transform(found, lambda s: s["c"]).alias("codes")).drop("row__")
    long_ = F.slice("codes", F.greatest(F.size("codes") - width + 1, F.lit(1)), width)
    return out.withColumn("codes", F.concat(F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(width) - F.size("codes"), F.lit(0))), long_))


def one_hot(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """rows with hot: a sparse vector (size, indices, values) of which features a vocabulary (value, id) has; unknown and null features count not.

    column: an array of features, each of which counts once. A feature's place is its id less 1, so the vector is as long as the vocabulary.
    Features meet the vocabulary by a join, rows with none of them have no places set.
    """
    size, own = known.count(), stored(rows.withColumn("row__", F.monotonically_increasing_id()))
    each = own.select("row__", F.explode(F.array_distinct(column)).alias("value")).join(known, "value")
    places = each.groupBy("row__").agg(F.transform(F.array_sort(F.collect_set("id")), lambda i: (i - 1).cast("int")).alias("indices"))
    joined = own.join(places, "row__", "left").withColumn("indices", F.coalesce("indices", F.array().cast("array<int>")))
    return joined.withColumn("hot", F.struct(F.lit(size).cast("int").alias("size"), "indices", F.transform("indices", lambda i: F.lit(1.0)).alias("values"))).drop("row__", "indices")


def unseen_labels(test: DataFrame, train: DataFrame, column: str = "label") -> DataFrame:
    """Labels of the test rows that no training row has; a test set with any can't be evaluated."""
    return test.select(column).where(F.col(column).isNotNull()).distinct().join(train.select(column).distinct(), column, "left_anti")


def max_lengths(tokens: DataFrame, seq: str, text: str) -> DataFrame:
    """max_tokens, max_chars, one row: the longest sequence and the longest token, each 0 without rows."""
    each = tokens.groupBy(seq).agg(F.count("*").alias("n"), F.max(F.length(text)).alias("chars"))
    return each.agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_tokens"), F.coalesce(F.max("chars"), F.lit(0)).cast("long").alias("max_chars"))


def renumbered(rows: DataFrame, entry: str, sense: list[str], old_id: str) -> DataFrame:
    """rows with entry_n (the entry's place among all), sense_n (the row's place in its entry) and orig_id, what old_id held before."""
    entries = places(rows.select(entry).distinct(), [entry]).withColumnRenamed("place", "entry_n")
    k = F.row_number().over(Window.partitionBy(entry).orderBy(*sense)).cast("long")
    return rows.join(entries, entry).withColumn("sense_n", k).withColumnRenamed(old_id, "orig_id")


def container_texts(tokens: DataFrame, base: str) -> DataFrame:
    """original, mapped: the distinct texts of containers of one base label, as a map of each to itself.

    tokens: seq, ord, label, text; a container's tokens are joined by spaces, leaving out null ones, and one without any has no text.
    """
    own = decoded(tokens).where(F.col("base") == base).groupBy("seq", "container").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("ord", "text")))).alias("x"))
    texts = own.where(F.size("x") > 0).select(F.array_join(F.transform("x", lambda s: s["text"]), " ").alias("original")).distinct()
    return texts.select("original", F.col("original").alias("mapped"))


def clean_containers(tokens: DataFrame, replacements: dict[str, str]) -> DataFrame:
    """seq, container, base, text, rest: each container's trimmed token texts joined by spaces and put through the replacements.

    A comma, colon or semicolon that ends the last token is leftover text, in rest ('' without one). Null tokens count as empty.
    """
    own = decoded(tokens).groupBy("seq", "container", "base").agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text")))).alias("x"))
    joined = own.withColumn("joined", F.array_join(F.transform("x", lambda s: strip(s["text"])), " "))
    text = replaced(F.regexp_replace("joined", "[,:;]$", ""), replacements)
    return joined.select("seq", "container", "base", text.alias("text"), F.regexp_extract("joined", "([,:;])$", 1).alias("rest"))


def with_levels(tokens: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Raw tokens (seq, ord, ...) with level_1, level_2, ...: the running number of the container that holds them at each level, and its base.

    levels: seq, ord, label, outermost first. Labels keep their token's ord, so they join by it and texts needn't be compared; a token that a
    level has no label for is in no container there. Inner containers are numbered within the one around.
    """
    out, around = tokens, ["seq"]
    for i, labels in enumerate(levels, 1):
        own = labels.join(out.select("seq", "ord", *around[1:]), ["seq", "ord"])
        key = F.struct(*around)
        found = decoded(own.withColumn("seq", key)).select("seq.seq", "ord", F.col("container").alias(f"level_{i}"), F.col("base").alias(f"base_{i}"))
        out = out.join(found, ["seq", "ord"], "left")
        around.append(f"level_{i}")
    return out


def container_markup(tokens: DataFrame, levels: int, token: Column) -> DataFrame:
    """seq, place, tei: tokens of with_levels() as nested containers, a row for each token, with the body's start and end.

    token: a token's own markup. A container opens before the first of its tokens and closes after the last; a token that a level has no
    container for, or scrap as base, stands in the one around. place 0 is the start, others count the tokens of a sequence.
    """
    by = Window.partitionBy("seq").orderBy("ord")
    inside = lambda i: F.col(f"level_{i}").isNotNull() & (F.col(f"base_{i}") != "scrap")
    out, chain = tokens, []
    for i in range(1, levels + 1):
        chain = [*chain, F.when(inside(i), F.col(f"level_{i}"))]
        known = F.lit(True)
        for c in chain:
            known = known & c.isNotNull()
        out = out.withColumn(f"id__{i}", F.when(known, F.struct(*[c.alias(f"c{k}") for k, c in enumerate(chain)])))
    starts, ends = [], []
    for i in range(1, levels + 1):
        own = F.col(f"id__{i}")
        starts.append(F.when(own.isNotNull() & ~own.eqNullSafe(F.lag(own).over(by)), F.concat(F.lit('<container name="'), escaped(F.col(f"base_{i}")), F.lit('">'))).otherwise(""))
        ends.insert(0, F.when(own.isNotNull() & ~own.eqNullSafe(F.lead(own).over(by)), "</container>").otherwise(""))
    rows = out.select("seq", F.row_number().over(by).cast("long").alias("place"), F.concat(*starts, token, *ends).alias("tei"))
    bodies = tokens.select("seq").distinct()
    first, last = bodies.select("seq", F.lit(0).cast("long").alias("place"), F.lit("<body>").alias("tei")), bodies.select("seq", F.lit(2**63 - 1).alias("place"), F.lit("</body>").alias("tei"))
    return rows.unionByName(first).unionByName(last)


def in_dictionary_order(rows: DataFrame) -> DataFrame:
    """rows with place, from 1, by entry_id (if there is one), lemma, pos and sense_id (if there is one); nulls first, equal rows in any order."""
    return places(rows, [c for c in ("entry_id", "lemma", "pos", "sense_id") if c in rows.columns])
