"""Declarative mappings: which nodes play which lexical role, with what value, and how they enter the output."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import group_start, translated
from lexmill.operators.pieces import inner_text
from lexmill.operators.select import attribute, names_of, namespaces_of, parent_normalised, selected
from lexmill.sources.store import dropped, stored

INNER, INNER_REC, CONSTANT = "{meta}innerText", "{meta}innerTextRec", "{meta}constant"
#: The roles, in the order in which they may consume an element.
ROLES = ["def", "pos", "hw", "inflected", "variant", "sec_hw", "hw_tr", "ex", "ex_tr", "note", "gloss", "usg", "xr"]
LANGUAGES = {"hw_tr": "hw_tr_lang", "ex": "ex_lang", "ex_tr": "ex_tr_lang"}


@dataclass
class Mapping:
    """Selectors of entries and senses, and a transformer for each role or language slot."""

    entry: dict
    sense: dict | None
    slots: dict[str, dict]

    @classmethod
    def of(cls, spec: dict | str) -> Mapping:
        spec = json.loads(spec) if isinstance(spec, str) else dict(spec)
        unknown = set(spec) - {"entry", "sense", "entry_lang", *ROLES, *LANGUAGES.values()}
        if unknown:
            raise ValueError(f"unknown slots: {sorted(unknown)}")
        for part in spec.values():
            check(part)
        return cls(spec["entry"], spec.get("sense"), {k: v for k, v in spec.items() if k not in ("entry", "sense") and v})

    def normalised(self) -> Mapping:
        return Mapping(parent_normalised(self.entry), self.sense and parent_normalised(self.sense), {k: parent_normalised(v) for k, v in self.slots.items()})

    def to_json(self) -> str:
        return json.dumps({"entry": self.entry, **({"sense": self.sense} if self.sense else {}), **self.slots}, sort_keys=True, ensure_ascii=False)


def check(part: dict | None) -> None:
    """Raises unless part is a selector or transformer of a known type."""
    if not part:
        return
    check(part.get("adoptSelector"))
    kind = part.get("type")
    inner = {"xpath": [], "simple": ["selector"], "exclude": ["left", "right"]}
    if kind == "union":
        for x in part.get("selectors") or part.get("transformers") or []:
            check(x)
    elif kind in inner:
        for k in inner[kind]:
            check(part[k])
    else:
        raise ValueError(f"type {kind!r}")


def java_pattern(pattern: str, group) -> tuple[str, int]:
    """A pattern with its named groups as Java writes them, and the number of the group asked for (0 if there is no such)."""
    compiled = re.compile(pattern)
    number = compiled.groupindex.get(group, 0) if isinstance(group, str) and not group.isdigit() else int(group or 0)
    named = {name: f"g{i}" for name, i in compiled.groupindex.items()}  # Java's names have no underscore
    java = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{named[m[1]]}>", pattern)
    java = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{named[m[1]]}>", java)
    return java, number if number <= compiled.groups else -1


def leaves(transformer: dict) -> list[dict]:
    """The simple transformers of a transformer, in their order."""
    if transformer["type"] == "union":
        return [leaf for t in transformer["transformers"] for leaf in leaves(t)]
    return [transformer]


def found_all(nodes: DataFrame, transformers: list[dict], context: DataFrame | None = None, chain: bool = False, tags: set[str] | None = None, keep: bool = False) -> DataFrame:
    """doc_id, ctx, pre, attr, value, matched, start, final and t (the transformer's place in the list) of what each finds from each context row.

    value: the text or attribute; nodes without the attribute, or whose value the pattern doesn't occur in, are left out. matched: the pattern's
    group (a group that doesn't exist: ''), start: how many characters of the value precede it. final: matched, translated by xlat where it has it. Of a union, the first transformer that
    finds a node counts. An element without children has its text itself; those of the others come by one join for all transformers, if there
    are any, which is looked up in what was found. chain: above has the nodes' ancestors. tags: the local names of the context's rows, if known. keep:
    what was joined is stored, so that the result is cheap to read again.
    """
    kept = ["above"] if chain else []
    simple = [(t, leaf) for t, transformer in enumerate(transformers) for leaf in leaves(transformer)]
    out, texts = None, set()
    for i, (t, leaf) in enumerate(simple):
        attr = leaf.get("attr") or INNER_REC
        at = selected(nodes, leaf["selector"], context, tags)
        value = F.lit(leaf.get("const", "")) if attr == CONSTANT else F.lit(None).cast("string") if attr in (INNER, INNER_REC) else attribute(attr, namespaces_of(leaf["selector"]))
        if attr in (INNER, INNER_REC):
            value = F.when(F.col("post") == F.col("pre") + 1, F.coalesce("text", F.lit("")))
        one = at.withColumn("above", F.col("ancestors")).select("doc_id", "ctx", "pre", F.lit(t).alias("t"), F.lit(i).alias("leaf"), F.lit(attr).alias("attr"), value.alias("value"), *kept)
        if attr in (INNER, INNER_REC):
            texts.add(attr)
        else:
            one = one.where("value is not null")
        out = one if out is None else out.unionByName(one)
    out = first = stored(out) if texts or keep else out
    without = {r["attr"] for r in out.where("value is null").select("attr").distinct().collect()} if texts else set()  # two at most
    for attr in sorted(without):
        text = inner_text(nodes, out.where((F.col("attr") == attr) & F.col("value").isNull()), attr == INNER_REC).select("doc_id", "pre", F.lit(attr).alias("attr"), F.col("value").alias("inside"))
        out = out.join(text, ["doc_id", "pre", "attr"], "left").withColumn("value", F.coalesce("value", "inside")).drop("inside")
    if without and keep:
        out = stored(out)
        dropped(nodes.sparkSession, [first])
    met, matched, start = F.lit(True), F.col("value"), F.lit(0)
    for i, (_, leaf) in enumerate(simple):
        if leaf.get("rex"):
            pattern, group = java_pattern(leaf["rex"], leaf.get("rexGroup"))
            met = F.when(F.col("leaf") == i, F.col("value").rlike(pattern)).otherwise(met)
            matched = F.when(F.col("leaf") == i, F.regexp_extract("value", pattern, group) if group >= 0 else F.lit("")).otherwise(matched)
            own = F.length(F.split("value", pattern, 2)[0]) if group == 0 else group_start(leaf["rex"], group)(F.when(F.col("leaf") == i, F.col("value"))) if group > 0 else F.lit(0)
            start = F.when(F.col("leaf") == i, own).otherwise(start)
    out = out.where(met).withColumn("matched", matched).withColumn("start", F.coalesce(start, F.lit(0)))
    if len(simple) > len(transformers):
        first = Window.partitionBy("doc_id", "ctx", "pre", "t").orderBy("leaf")
        out = out.withColumn("k", F.row_number().over(first)).where("k = 1")
    final = F.col("matched")
    for i, (_, leaf) in enumerate(simple):
        if leaf.get("xlat"):
            final = F.when(F.col("leaf") == i, translated(F.col("matched"), leaf["xlat"])).otherwise(final)
    return out.select("doc_id", "ctx", "pre", "t", "attr", "value", "matched", "start", final.alias("final"), *kept)


def found(nodes: DataFrame, transformer: dict, context: DataFrame | None = None) -> DataFrame:
    """found_all() of one transformer."""
    return found_all(nodes, [transformer], context).drop("t")


def strategy(attr: Column, value: Column, matched: Column) -> Column:
    """How a match enters the output: beside its element, as a part of its text, or in its place."""
    return F.when(~attr.isin(INNER, INNER_REC), "sibling").when(value != matched, "part").otherwise("consume")


def may_meet(transformers: list[dict]) -> bool:
    """Whether two transformers may find the same element; those of elements with different names can't."""
    names = [[names_of(leaf["selector"]) for leaf in leaves(t)] for t in transformers]
    if any(n is None for own in names for n in own):
        return len(transformers) > 1
    found_ = [set().union(*own) for own in names]
    return sum(map(len, found_)) > len(set().union(*found_))


def role_matches(nodes: DataFrame, mapping: Mapping, entry_nodes: DataFrame, chain: bool = False) -> DataFrame:
    """doc_id, entry (pre), pre, role, rank, attr, value, matched, start, final, strategy of all roles, and above (ancestors) if `chain`.

    Of the matches that would consume one element, the first role in ROLES does; the others become parts. Where roles that may find the same
    element don't occur, nothing is dealt out for that. The result is cheap to read again.
    """
    own = [r for r in ROLES if r in mapping.slots]
    if not own:
        raise ValueError("the mapping has no role")
    names = F.array(*[F.lit(r) for r in own])
    out = found_all(nodes, [mapping.slots[r] for r in own], entry_nodes, chain, names_of(mapping.entry), keep=True).withColumn("role", F.get(names, F.col("t")))
    out = out.withColumn("rank", F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role"))).drop("t")
    out = out.withColumnRenamed("ctx", "entry").withColumn("strategy", strategy(F.col("attr"), F.col("value"), F.col("matched")))
    if not may_meet([mapping.slots[r] for r in own]):
        return out
    order = Window.partitionBy("doc_id", "entry", "pre", "strategy").orderBy("rank")
    return stored(out.withColumn("k", F.row_number().over(order)).withColumn("strategy", F.when((F.col("strategy") == "consume") & (F.col("k") > 1), "part").otherwise(F.col("strategy"))).drop("k"))


def nearest(nodes: DataFrame, at: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """at (doc_id, pre, ...) with the value (doc_id, pre, final) of the nearest element around each row's, itself included; null if none has one."""
    keys = at.select("doc_id", "pre").distinct().join(nodes.select("doc_id", "pre", "ancestors"), ["doc_id", "pre"])
    up = keys.select("doc_id", "pre", F.explode(F.concat("ancestors", F.array("pre"))).alias("up"))
    met = up.join(values.select("doc_id", F.col("pre").alias("up"), "final").dropDuplicates(["doc_id", "up"]), ["doc_id", "up"])
    best = met.groupBy("doc_id", "pre").agg(F.max_by("final", "up").alias(name))
    return at.join(best, ["doc_id", "pre"], "left")


def with_languages(nodes: DataFrame, mapping: Mapping, matches: DataFrame) -> DataFrame:
    """matches with lang: for roles with a language slot, that of the nearest element around. Stored if there is such a role."""
    out, given = matches.withColumn("lang", F.lit(None).cast("string")), False
    for role, slot in LANGUAGES.items():
        if role in mapping.slots and slot in mapping.slots:
            of = F.col("role") == role
            with_ = nearest(nodes, out.where(of).drop("lang"), found(nodes, mapping.slots[slot]), "lang")
            out, given = out.where(~of).unionByName(with_), True
    return stored(out) if given else out


def taken_spans(matches: DataFrame) -> DataFrame:
    """doc_id, pre, recursive, start, end: the characters of an element's inner text that a match takes; those of attributes and constants take none."""
    own = matches.where(F.col("attr").isin(INNER, INNER_REC))
    return own.select("doc_id", "pre", (F.col("attr") == INNER_REC).alias("recursive"), F.col("start").cast("long").alias("start"), (F.col("start") + F.length("matched")).cast("long").alias("end")).distinct()


def adopted(nodes: DataFrame, selector: dict, adopters: DataFrame) -> DataFrame:
    """doc_id, adoptee, adopter: what `selector` selects from each adopter (doc_id, pre), each element by the first adopter in document order, and
    none that lies inside its adopter already."""
    rows = nodes.join(adopters.select("doc_id", "pre").distinct(), ["doc_id", "pre"], "left_semi")
    found_ = selected(nodes, selector, rows).where(~F.array_contains("ancestors", F.col("ctx")) & (F.col("pre") != F.col("ctx")))
    return found_.groupBy("doc_id", F.col("pre").alias("adoptee")).agg(F.min("ctx").alias("adopter"))


def annotated(nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """The node table with the roles that each element plays, in role order: [role, attr, matched, final]."""
    by_node = matches.groupBy("doc_id", "pre").agg(F.array_sort(F.collect_list(F.struct("rank", "role", "attr", "matched", "final"))).alias("x"))
    roles = by_node.select("doc_id", "pre", F.transform("x", lambda s: F.struct(s["role"], s["attr"], s["matched"], s["final"])).alias("roles"))
    return nodes.join(roles, ["doc_id", "pre"], "left")


def match_statistics(matches: DataFrame) -> DataFrame:
    """role, strategy, n, entries: how often each role enters the output in which way, and in how many entries."""
    return matches.groupBy("role", "strategy").agg(F.count("*").alias("n"), F.count_distinct("doc_id", "entry").alias("entries"))


#: Namespaces of attributes that a source element hands on, and of what is told about it.
LEGACY, META = "urn:lexmill:legacy", "urn:lexmill:meta"


def legacy_attributes(nodes: DataFrame, legacy: str = LEGACY, meta: str = META) -> DataFrame:
    """The node table with each element's attributes as its output carries them: plain ones in the legacy namespace, xml:id as the id and the
    element's name as the e of the meta namespace; attributes with a namespace of their own, and xml:lang, stay."""
    renamed = F.transform_keys("attrs", lambda k, v: F.when(k == "xml:id", F.lit(f"{{{meta}}}id")).when(k.contains(":"), k).otherwise(F.concat(F.lit(f"{{{legacy}}}"), k)))
    scope = F.map_concat(F.map_filter("scope", lambda k, v: ~k.isin("a", "m")), F.create_map(F.lit("a"), F.lit(legacy), F.lit("m"), F.lit(meta)))
    own = F.map_filter(renamed, lambda k, v: k != F.lit(f"{{{meta}}}e"))
    return nodes.withColumn("attrs", F.map_concat(own, F.create_map(F.lit(f"{{{meta}}}e"), F.col("tag")))).withColumn("scope", scope)
