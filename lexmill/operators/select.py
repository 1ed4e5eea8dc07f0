"""Selectors over a node table: path expressions, unions and exclusions, as joins on (doc_id, pre)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.pieces import inner_text, text_pieces

AXES = ["ancestor-or-self", "ancestor", "descendant-or-self", "descendant", "following-sibling", "preceding-sibling", "child", "parent", "self", "attribute"]
NAME = r"(?:(?:[^\W\d][\w.-]*|\*):)?(?:[^\W\d][\w.-]*|\*)"
STEP = re.compile(rf"(?:({'|'.join(AXES)})::|(@))?(text\(\)|{NAME}|\.\.|\.)(\[.*)?$", re.DOTALL)
QUOTED = r"""(?:'([^']*)'|"([^"]*)")"""
#: What compares an operand (an attribute, text(), . or a path below the element) with a quoted text.
COMPARISONS = [("contains", rf"contains\(\s*(.+?)\s*,\s*{QUOTED}\s*\)"), ("starts", rf"starts-with\(\s*(.+?)\s*,\s*{QUOTED}\s*\)"), ("unequal", rf"(.+?)\s*!=\s*{QUOTED}"), ("equal", rf"(.+?)\s*=\s*{QUOTED}")]
NODE = ["doc_id", "pre", "post", "parent", "depth", "sib", "tag", "attrs", "text", "tail", "path", "ancestors", "prefix", "ns", "scope"]
SIBLINGS = ("following-sibling", "preceding-sibling")


def parted(expression: str, sign: str) -> list[str]:
    """The expression cut at a sign (or a word between blanks) that stands outside brackets, parentheses and quotes."""
    out, depth, quote, i = [""], 0, "", 0
    while i < len(expression):
        c = expression[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"" and depth:
            quote = c
        else:
            depth += (c in "[(") - (c in "])")
            if not depth and expression.startswith(sign, i):
                out.append("")
                i += len(sign)
                continue
        out[-1] += c
        i += 1
    return out


def words_apart(inside: str, word: str) -> list[str]:
    """The parts of a predicate around 'or' or 'and'."""
    marked = re.sub(r"""('[^']*'|"[^"]*")""", lambda m: m[0].replace(" ", "\0"), inside)
    return [x.replace("\0", " ").strip() for x in parted(marked, f" {word} ")]


def predicate(inside: str) -> tuple:
    """What stands in brackets, as (attribute, text or None) for one that an element has, else (kind, operand, text or more).

    Kinds: place (0 is last()), lacks, contains, starts, unequal, equal, has, and, or, not. An operand is an attribute's name, or after a
    '/': text(), . or a path.
    """
    inside = inside.strip()
    for word in ("or", "and"):
        sides = words_apart(inside, word)
        if len(sides) > 1:
            return word, [predicate(s) for s in sides], None
    if inside.startswith("(") and inside.endswith(")") and len(parted(inside[:-1], ")")) == 1:
        return predicate(inside[1:-1])
    place = re.fullmatch(r"(?:position\(\)\s*=\s*)?(\d+|last\(\))", inside)
    if place and place[1] != "0":
        return "place", 0 if place[1] == "last()" else int(place[1]), None
    denied = re.fullmatch(r"not\((.*)\)", inside, re.DOTALL)
    if denied:
        inner = predicate(denied[1])
        return ("lacks", inner[0], None) if len(inner) == 2 and inner[1] is None else ("not", [inner], None)
    for kind, pattern in COMPARISONS:
        found = re.fullmatch(pattern, inside, re.DOTALL)
        if found:
            of, *texts = found.groups()
            text = next(t for t in texts if t is not None)
            of = operand(of)
            return (of, text) if kind == "equal" and not of.startswith("/") else (kind, of, text)
    of = operand(inside)
    return (of, None) if not of.startswith("/") else ("has", of, None)


def operand(inside: str) -> str:
    """An attribute's name, or with a '/' before it a path whose text counts."""
    attribute = re.fullmatch(rf"@({NAME})", inside)
    if attribute and "*" not in inside:
        return attribute[1]
    if inside in (".", "text()"):
        return f"/{inside}"
    try:
        steps = steps_of(inside)
    except ValueError:
        steps = []
    if not steps or inside.startswith("/"):
        raise ValueError(f"predicate not supported: [{inside}]")
    return f"/{inside}"


def brackets(tests: str) -> list[str] | None:
    """The insides of predicates that follow each other, or None."""
    out = []
    while tests:
        depth, quote = 0, ""
        for i, c in enumerate(tests):
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            else:
                depth += (c == "[") - (c == "]")
                if not depth:
                    break
        if tests[0] != "[" or depth or quote:
            return None
        out.append(tests[1:i])
        tests = tests[i + 1 :]
    return out


def steps_of(expression: str) -> list[tuple[str, str, list[tuple]]]:
    """(axis, name, predicates) of each step of a path; whatever isn't understood is an error.

    Places count siblings, so they go with children, siblings and '//' alone. text() and attributes end a path.
    """
    out, deep = [], False
    for i, part in enumerate(parted(expression.strip(), "/")):
        if part == "":
            deep = i > 0
            continue
        found = STEP.match(part)
        if not found:
            raise ValueError(f"path step not supported: {part!r} in {expression!r}")
        axis, sign, name, tests = found.groups()
        axis = "attribute" if sign else axis
        inside = brackets(tests or "")
        if inside is None:
            raise ValueError(f"predicate not supported: {tests!r} in {expression!r}")
        read = [predicate(m) for m in inside]
        placed = any(test[0] == "place" and len(test) == 3 for test in read)
        if out and out[-1][0] in ("attribute", "text") or placed and (axis not in (None, "child", *SIBLINGS) or name in ("..", ".", "text()")) or deep and axis not in (None, "child", "attribute"):
            raise ValueError(f"path step not supported: {part!r} in {expression!r}")
        if axis in SIBLINGS and any(test[0] == "place" and len(test) == 3 for test in read[:-1]):
            raise ValueError(f"path step not supported: {part!r} in {expression!r}")
        if name == "text()" or axis == "attribute":
            if read or axis not in (None, "child", "attribute") or axis == "attribute" and name in ("text()", ".", ".."):
                raise ValueError(f"path step not supported: {part!r} in {expression!r}")
            if deep:
                out.append(("descendant-or-self", "*", []))
            axis = "attribute" if axis == "attribute" else "text"
        elif name == "..":
            axis, name = "parent", "*"
        elif name == ".":
            axis, name = "self", "*"
        elif deep:
            axis = "descendant"
        out.append((axis or "child", name, read))
        deep = False
    return out


def name_test(name: str, namespaces: dict[str, str] | None) -> Column:
    """Whether an element has a step's name.

    A name without a prefix is that of elements written without one (so of no namespace, or of a default one); a prefix is looked up in the
    mapping's namespaces, or where it isn't there in the scope of the element; '*:x' is x in any namespace.
    """
    prefix, colon, local = name.rpartition(":")
    if not colon:
        return F.lit(True) if name == "*" else (F.col("tag") == name) & (F.col("prefix") == "")
    same = F.lit(True) if local == "*" else F.col("tag") == local
    if prefix == "*":
        return same
    uri = F.lit(namespaces[prefix]) if prefix in (namespaces or {}) else F.col("scope")[prefix]
    return F.coalesce(same & (F.col("ns") == uri), F.lit(False)) | (F.col("tag") == name)


def tags_of(name: str) -> set[str] | None:
    """The local names of elements that have a step's name; None: any."""
    local = name.rpartition(":")[2]
    return None if local == "*" else {local, name}


def names_of(selector: dict | None) -> set[str] | None:
    """The local names of what a selector selects; None: any, or they aren't known."""
    if not selector:
        return set()
    kind = selector.get("type")
    if kind == "xpath":
        ends = [steps_of(p)[-1:] for p in parted(selector["expr"], "|")]
        each = [tags_of(end[0][1]) if end and end[0][0] not in ("attribute", "text") else None for end in ends]
    else:
        each = [names_of(s) for s in (selector["selectors"] if kind == "union" else [selector["left"]])]
    return None if None in each else set().union(*each)


def around(tags: set[str] | None, itself: bool = False) -> Column:
    """The elements around a row's, outermost first, that have one of the names."""
    chain = F.concat("ancestors", F.array("pre")) if itself else F.col("ancestors")
    return chain if tags is None else F.filter(chain, lambda x, i: F.get("path", i).isin(*sorted(tags)))


def attribute(name: str, namespaces: dict[str, str] | None = None) -> Column:
    """An element's attribute; null if it has none. Prefixes are looked up as in name_test(); xml: is one of every document."""
    prefix, colon, local = name.rpartition(":")
    if not colon or prefix == "xml":
        return F.col("attrs")[name]
    if prefix in (namespaces or {}):
        return F.col("attrs")[f"{{{namespaces[prefix]}}}{local}"]
    return F.coalesce(F.element_at("attrs", F.concat(F.lit("{"), F.col("scope")[prefix], F.lit("}"), F.lit(local))), F.col("attrs")[name])


def compared(value: Column, kind: str, text: str | None) -> Column:
    return {"has": lambda: value.isNotNull(), "equal": lambda: value == text, "unequal": lambda: value != text, "contains": lambda: value.contains(text), "starts": lambda: value.startswith(text)}[kind]()


def _met(rows: DataFrame, nodes: DataFrame, kind: str, of: str, text: str | None, namespaces: dict[str, str] | None) -> DataFrame:
    """doc_id, pre of the rows whose text or path meets a test; like XPath's, contains() and starts-with() see the first text alone."""
    if of == "/.":
        return inner_text(nodes, rows).where(compared(F.col("value"), kind, text)).select("doc_id", "pre")
    if of == "/text()":
        own = text_pieces(nodes).select("doc_id", F.col("owner").alias("pre"), "at", F.col("piece").alias("value"))
    elif steps_of(of[1:])[-1][0] in ("attribute", "text"):
        own = values(nodes, of[1:], rows, namespaces).select("doc_id", F.col("ctx").alias("pre"), "at", "value")
    else:
        found = select(nodes, of[1:], rows, namespaces)
        if kind == "has":
            return found.select("doc_id", F.col("ctx").alias("pre")).distinct()
        own = found.select("doc_id", "ctx", "pre").join(inner_text(nodes, found), ["doc_id", "pre"]).select("doc_id", F.col("ctx").alias("pre"), F.col("pre").alias("at"), "value")
    if kind in ("contains", "starts"):
        own = own.groupBy("doc_id", "pre").agg(F.min_by("value", "at").alias("value"))
    return own.where(compared(F.col("value"), kind, text)).select("doc_id", "pre").distinct()


def _tested(rows: DataFrame, nodes: DataFrame, name: str, tests: list, namespaces: dict[str, str] | None) -> DataFrame:
    """The rows that have a step's name and meet its predicates; tests of text and paths come as joins."""
    rows = rows.where(name_test(name, namespaces))
    columns, n = rows.columns, 0

    def condition(test: tuple) -> Column:
        nonlocal rows, n
        kind, of, text = test if len(test) == 3 else ("has" if test[1] is None else "equal", *test)
        if kind in ("and", "or", "not"):
            sides = [condition(t) for t in of]
            return reduce(lambda a, b: a & b if kind == "and" else a | b, sides) if kind != "not" else ~sides[0]
        if kind == "lacks":
            return attribute(of, namespaces).isNull()
        if not of.startswith("/"):
            return F.coalesce(compared(attribute(of, namespaces), kind, text), F.lit(False))
        n += 1
        rows = rows.join(_met(rows, nodes, kind, of, text, namespaces).withColumn(f"met__{n}", F.lit(True)), ["doc_id", "pre"], "left")
        return F.col(f"met__{n}").isNotNull()

    for test in tests:
        if test[0] == "place" and len(test) == 3:  # among the siblings that met the predicates before it
            rows = _first_or_last(rows, ["doc_id", "parent"], "pre", test[1])
            continue
        met = condition(test)
        rows = rows.where(met).select(*columns)
    return rows


def _first_or_last(rows: DataFrame, by: list[str], order: str, place: int, backwards: bool = False) -> DataFrame:
    """The rows at a place of their group; the first and the last (place 0) by an aggregate, so that no task sorts a large group."""
    if place in (0, 1):
        end = F.max(order) if (place == 0) != backwards else F.min(order)
        ends = rows.groupBy(*by).agg(end.alias(order))
        shared = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by]
        return rows.alias("x").join(ends.alias("y"), reduce(lambda a, b: a & b, [*shared, F.col(f"x.{order}") == F.col(f"y.{order}")]), "left_semi")
    key = F.col(order).desc() if backwards else F.col(order)
    return rows.withColumn("place__", F.row_number().over(Window.partitionBy(*by).orderBy(key))).where(F.col("place__") == place).drop("place__")


def _walked(nodes: DataFrame, expression: str, steps: list, context: DataFrame | None, namespaces: dict[str, str] | None, tags: set[str] | None = None) -> DataFrame:
    single = True  # at most one row for each ctx, so a step repeats nothing
    if context is None:
        now, top = None, True
    else:
        now, top = context.select(*NODE).withColumn("ctx", F.col("pre")), False
    for axis, name, tests in steps:
        held, tags = tags, tags if axis == "self" and name == "*" else tags_of(name)  # the local names before the step and after it
        if top:
            if axis == "self":
                continue
            if axis not in ("child", "descendant", "descendant-or-self"):
                return nodes.select(*NODE).where("false").withColumn("ctx", F.lit(-1).cast("long"))
            found = nodes if axis != "child" else nodes.where("depth = 0")
            now, top = _tested(found.select(*NODE), nodes, name, tests, namespaces).withColumn("ctx", F.lit(-1).cast("long")), False
            single = False
            continue
        if axis == "self":
            keys = _tested(now.select(*NODE).dropDuplicates(["doc_id", "pre"]), nodes, name, tests, namespaces).select("doc_id", "pre")
            now = now.join(keys, ["doc_id", "pre"], "left_semi") if name != "*" or tests else now
            continue
        place = tests[-1][1] if axis in SIBLINGS and tests and tests[-1][0] == "place" and len(tests[-1]) == 3 else None
        at = now.select("doc_id", "ctx", F.col("pre").alias("from"), F.col("parent").alias("up"), F.col("ancestors").alias("above"), F.col("sib").alias("beside"))
        to = _tested(nodes.select(*NODE), nodes, name, tests if place is None else tests[:-1], namespaces)
        if axis == "child":
            now = to.withColumn("from", F.col("parent")).join(at.drop("up", "above", "beside"), ["doc_id", "from"])
        elif axis == "parent":
            now = to.withColumn("up", F.col("pre")).join(at.drop("from", "above", "beside"), ["doc_id", "up"])
        elif axis in ("descendant", "descendant-or-self"):
            now = to.withColumn("from", F.explode(around(held, axis != "descendant"))).join(at.drop("up", "above", "beside"), ["doc_id", "from"])
        elif axis in SIBLINGS:
            after = axis == "following-sibling"
            now = to.withColumn("up", F.col("parent")).join(at.drop("above"), ["doc_id", "up"]).where(F.col("sib") > F.col("beside") if after else F.col("sib") < F.col("beside"))
            now = now if place is None else _first_or_last(now, ["doc_id", "ctx", "from"], "sib", place, not after)
        else:
            above = F.col("above") if axis == "ancestor" else F.concat("above", F.array("from"))
            now = to.join(at.select("doc_id", "ctx", F.explode(above).alias("pre")), ["doc_id", "pre"])
        now = now.select(*NODE, "ctx")
        if not single and axis != "child":
            now = now.dropDuplicates(["doc_id", "ctx", "pre"])
        single = single and axis == "parent"
    if now is None:
        now = nodes.where("false").select(*NODE).withColumn("ctx", F.lit(-1).cast("long"))
    return now


def select(nodes: DataFrame, expression: str, context: DataFrame | None = None, namespaces: dict[str, str] | None = None, tags: set[str] | None = None) -> DataFrame:
    """doc_id, ctx and the columns of NODE of the elements that a path selects, distinct.

    context: rows of the node table that the path starts from (ctx is their pre); without it, a root above each document, so ./x and .//x can
    select the document element too (ctx is then -1). A path outside a context row is followed: nodes are never detached. Paths
    joined by | select what any of them does. namespaces: what the path's prefixes stand for; others are read in each element's
    scope. Paths that end in text() or an attribute select no elements: values() has them. tags: the local names that the context's rows have, if
    known (None: any), so that of all elements around another only such are looked up.
    """
    paths = parted(expression, "|")
    if len(paths) > 1:
        return reduce(DataFrame.unionByName, [select(nodes, p, context, namespaces, tags) for p in paths]).dropDuplicates(["doc_id", "ctx", "pre"])
    steps = steps_of(expression)
    if steps and steps[-1][0] in ("attribute", "text"):
        raise ValueError(f"not a path of elements: {expression!r}")
    return _walked(nodes, expression, steps, context, namespaces, tags)


def values(nodes: DataFrame, expression: str, context: DataFrame | None = None, namespaces: dict[str, str] | None = None) -> DataFrame:
    """doc_id, ctx, pre, at, kind, name, value: the texts and attributes that a path ending in text() or an attribute selects, distinct.

    pre is the element that has it; a text's at is the tick that it follows, an attribute's the element's pre. kind: 'text' (name null) or
    'attribute' (name as in attrs; '@*' has all). Paths joined by | may mix both.
    """
    paths = parted(expression, "|")
    if len(paths) > 1:
        return reduce(DataFrame.unionByName, [values(nodes, p, context, namespaces) for p in paths]).dropDuplicates(["doc_id", "ctx", "at", "kind", "name"])
    *steps, (kind, name, _) = steps_of(expression) or [("", "", [])]
    if kind not in ("attribute", "text"):
        raise ValueError(f"not a path of text or attributes: {expression!r}")
    at = _walked(nodes, expression, steps, context, namespaces)
    if kind == "text":
        own = text_pieces(nodes).select("doc_id", F.col("owner").alias("pre"), "at", F.col("piece").alias("value"))
        return at.select("doc_id", "ctx", "pre").join(own, ["doc_id", "pre"]).select("doc_id", "ctx", "pre", "at", F.lit("text").alias("kind"), F.lit(None).cast("string").alias("name"), "value")
    if name == "*":
        return at.select("doc_id", "ctx", "pre", F.col("pre").alias("at"), F.lit("attribute").alias("kind"), F.explode("attrs").alias("name", "value"))
    return at.select("doc_id", "ctx", "pre", F.col("pre").alias("at"), F.lit("attribute").alias("kind"), F.lit(name).alias("name"), attribute(name, namespaces).alias("value")).where("value is not null")


def selected(nodes: DataFrame, selector: dict | None, context: DataFrame | None = None, tags: set[str] | None = None) -> DataFrame:
    """What a selector of a mapping selects: {type: xpath, expr, namespaces?}, {type: union, selectors} or {type: exclude, left, right}. tags: as in select()."""
    if not selector:
        return select(nodes, ".", context).where("false")
    kind = selector.get("type")
    if kind == "xpath":
        return select(nodes, selector["expr"], context, selector.get("namespaces"), tags)
    if kind == "union":
        out = None
        for part in selector["selectors"]:
            one = selected(nodes, part, context, tags)
            out = one if out is None else out.unionByName(one)
        return out.dropDuplicates(["doc_id", "ctx", "pre"])
    if kind == "exclude":
        return selected(nodes, selector["left"], context, tags).join(selected(nodes, selector["right"], context, tags).select("doc_id", "ctx", "pre"), ["doc_id", "ctx", "pre"], "left_anti")
    raise ValueError(f"selector type {kind!r}")


def namespaces_of(selector: dict | None) -> dict[str, str]:
    """The prefixes that a selector or its parts declare."""
    if not selector:
        return {}
    parts = [selector.get(k) for k in ("left", "right")] + list(selector.get("selectors", []))
    return reduce(lambda a, b: {**b, **a}, map(namespaces_of, parts), dict(selector.get("namespaces") or {}))


def parent_normalised(selector: dict) -> dict:
    """A selector whose paths that end in '..' are just '..', as far down as unions and exclusions go."""
    if selector.get("type") == "xpath":
        return {**selector, "expr": ".."} if selector["expr"].endswith("..") else selector
    return {k: [parent_normalised(x) for x in v] if isinstance(v, list) else parent_normalised(v) if isinstance(v, dict) else v for k, v in selector.items()}


def preview_entries(nodes: DataFrame, path: str, limit: int | None = None) -> DataFrame:
    """The elements that a path selects anywhere in a document, in document order, at most `limit` a document (null or 0: all).

    Prefixes are read as each document declares them.
    """
    own = select(nodes, f".//{path.strip().lstrip('./')}").drop("ctx")
    if not limit:
        return own
    return own.withColumn("k__", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre"))).where(F.col("k__") <= limit).drop("k__")


def entries(nodes: DataFrame, selector: dict) -> DataFrame:
    """The nodes that are entries, with outermost (pre of the topmost entry around, or of itself) and is_top.

    Where none has an element of an entry's name around it, which one job looks up, nothing is joined.
    """
    own = selected(nodes, selector).drop("ctx")
    above = own.select("doc_id", "pre", F.explode(around(names_of(selector))).alias("up"))
    if above.isEmpty():
        return own.withColumn("outermost", F.col("pre")).withColumn("is_top", F.lit(True))
    keys = own.select("doc_id", F.col("pre").alias("up"))
    tops = above.join(keys, ["doc_id", "up"]).groupBy("doc_id", "pre").agg(F.min("up").alias("top"))
    return own.join(tops, ["doc_id", "pre"], "left").withColumn("outermost", F.coalesce("top", "pre")).withColumn("is_top", F.col("top").isNull()).drop("top")


def in_exit_order(own: DataFrame) -> DataFrame:
    """Elements with place, their document's order of ends from 1: what is nested comes before what holds it."""
    return own.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("post")).cast("long"))
