"""XML documents as a node table."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import escaped

NODES = "doc_id long, pre long, post long, parent long, depth int, sib int, tag string, attrs map<string,string>, text string, tail string, path array<string>, ancestors array<long>, prefix string, ns string, scope map<string,string>"
_MAP = pa.map_(pa.string(), pa.string())
_ARROW = pa.schema([("doc_id", pa.int64()), ("pre", pa.int64()), ("post", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("sib", pa.int32()), ("tag", pa.string()), ("attrs", _MAP), ("text", pa.string()), ("tail", pa.string()), ("path", pa.list_(pa.string())), ("ancestors", pa.list_(pa.int64())), ("prefix", pa.string()), ("ns", pa.string()), ("scope", _MAP)])
#: Nodes in a batch; a batch has a cost of its own, so documents of a few nodes share one.
BATCH_NODES = 5000
#: Fixed value: what the prefix xml stands for in every document.
XML_NAMESPACE = "http://www.w3.org/XML/1998/namespace"


def named(raw: str, scope: dict[str, str], attribute: bool = False) -> tuple[str, str, str]:
    """Prefix, local name and namespace of a name as written; one whose prefix isn't declared is a whole name without a namespace."""
    prefix, colon, local = raw.partition(":")
    if not colon:
        return "", raw, "" if attribute else scope.get("", "")
    if prefix == "xml":
        return prefix, local, XML_NAMESPACE
    return (prefix, local, scope[prefix]) if local and scope.get(prefix) else ("", raw, "")


class _Builder:
    """Numbers nodes as tags come: pre and post are the ticks of a clock at a node's start and end."""

    def __init__(self, doc_id, blank: bool):
        self.doc_id, self.blank, self.clock = doc_id, blank, 0
        self.open: list[dict] = []
        self.rows: list[dict] = []
        self.last: dict | None = None  # the node whose tail comes next

    def start(self, tag: str, attrs) -> None:
        up = self.open[-1] if self.open else None
        scope, pairs, own, attrs = up["names"] if up else {}, up["scope"] if up else [], {}, dict(attrs)
        declared = {name[6:]: uri for name, uri in attrs.items() if name == "xmlns" or name.startswith("xmlns:")} if attrs else None
        if declared:
            scope = {**scope, **declared}
            pairs = list(scope.items())
        prefix, local, uri = named(tag, scope)
        for name, value in attrs.items():
            if name != "xmlns" and not name.startswith("xmlns:"):
                p, n, u = named(name, scope, True)
                own[name if p in ("", "xml") else f"{{{u}}}{n}"] = value
        if up and "below" not in up:  # siblings share their lists
            up["below"], up["paths"] = [*up["ancestors"], up["pre"]], {}
        path = up["paths"].get(local) if up else [local]
        if path is None:
            path = up["paths"][local] = [*up["path"], local]
        node = {"doc_id": self.doc_id, "pre": self.clock, "parent": up and up["pre"], "depth": len(self.open), "sib": up["n"] if up else 0, "tag": local, "attrs": list(own.items()), "text": "", "tail": "", "n": 0, "prefix": prefix, "ns": uri, "names": scope, "scope": pairs, "raw": tag, "path": path, "ancestors": up["below"] if up else []}
        if up:
            up["n"] += 1
        self.clock += 1
        self.open.append(node)
        self.rows.append(node)
        self.last = None

    def data(self, text: str) -> None:
        if self.last is not None:
            self.last["tail"] += text
        elif self.open:
            self.open[-1]["text"] += text

    def end(self, tag: str) -> None:
        """Closes the innermost open element of that name, and what it still holds open; a stray end tag is ignored."""
        top = len(self.open) - 1
        at = top if top >= 0 and self.open[top]["raw"] == tag else next((i for i in range(top, -1, -1) if self.open[i]["raw"] == tag), None)
        if at is None:
            at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i]["raw"].lower() == tag.lower()), None)
        while at is not None and len(self.open) > at:
            self.last = self.open.pop()
            self.last["post"] = self.clock
            self.clock += 1

    def done(self) -> list[dict]:
        while self.open:
            self.end(self.open[-1]["raw"])
        if self.blank:
            for r in self.rows:
                r["text"], r["tail"] = (x if x.strip() else "" for x in (r["text"], r["tail"]))
        return self.rows


class _Tolerant(HTMLParser):
    """Markup that a strict parser rejects; names keep their case."""

    CDATA_CONTENT_ELEMENTS = ()

    def __init__(self, to: _Builder):
        super().__init__(convert_charrefs=True)
        self.to = to

    def handle_starttag(self, tag, attrs):
        raw = self.get_starttag_text() or ""
        own = raw[1 : 1 + len(tag)]
        names = {}
        for name, value in attrs:
            at = raw.lower().find(name)
            names[raw[at : at + len(name)] if at >= 0 else name] = value or ""
        self.to.start(own if own.lower() == tag else tag, names)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.to.end(tag)

    def handle_endtag(self, tag):
        self.to.end(tag)

    def handle_data(self, data):
        self.to.data(data)


def parse(doc_id, raw: str | None, blank: bool = False) -> list[dict]:
    """A document's nodes, in document order; strictly, and if that fails tolerantly."""
    if not raw or not raw.strip():
        return []
    strict = _Builder(doc_id, blank)
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = strict.start, strict.end, strict.data
    try:
        parser.Parse(raw.lstrip("﻿ \t\r\n").encode("utf-8", "replace"), True)
        return strict.done()
    except expat.ExpatError:
        loose = _Builder(doc_id, blank)
        tolerant = _Tolerant(loose)
        tolerant.feed(raw)
        tolerant.close()
        return loose.done()


def node_batches(batches: Iterator[pa.RecordBatch], blank: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches of documents (doc_id, raw) as batches of a node table, in which small documents lie together."""
    ready: list[dict] = []
    for batch in batches:
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ready += parse(doc_id, raw, blank)
            while len(ready) >= BATCH_NODES:
                yield _as_batch(ready[:BATCH_NODES])
                ready = ready[BATCH_NODES:]
    if ready:
        yield _as_batch(ready)


def _as_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], type=f.type) for f in _ARROW], schema=_ARROW)


def shred(docs: DataFrame, drop_blank_text: bool = False) -> DataFrame:
    """The node table of documents (doc_id, raw): one row for each element.

    pre < post are a node's entry and exit times, so a contains d where a.pre < d.pre and d.post < a.post; ancestors holds the
    ancestors' pre from the root down, which makes ancestor and descendant joins equi-joins. tag is the local name, prefix the one it is
    written with, ns its namespace ('' for none), scope the prefixes in force ('' for the default namespace); an undeclared prefix stays
    part of the name. attrs has an attribute with a prefix under {namespace}name, but xml:lang and the like as written, and no
    declarations. text comes before the first child, tail after the element. Malformed documents are repaired: stray end tags are ignored, open elements closed. Null
    and blank documents have no nodes.
    """

    return docs.select(F.col("doc_id").cast("long"), F.col("raw").cast("string")).mapInArrow(lambda batches: node_batches(batches, drop_blank_text), NODES)


def document_parts(nodes: DataFrame) -> DataFrame:
    """doc_id, place, tei: documents as markup again, in rows that follow each other by place.

    The document element's start, each of its children with all inside, and its end are a row each, so a document stays many rows; a task joins
    the tags and texts of one child. Namespaces are declared where their scope begins.
    """
    above = nodes.select("doc_id", F.col("pre").alias("parent"), F.col("scope").alias("outer"))
    own = nodes.join(above, ["doc_id", "parent"], "left")
    outer = F.coalesce("outer", F.create_map().cast("map<string,string>"))
    pair = lambda name, value: F.concat(F.lit(" "), name, F.lit('="'), escaped(value), F.lit('"'))
    new = F.filter(F.map_entries("scope"), lambda e: ~F.coalesce(F.try_element_at(outer, e["key"]) == e["value"], F.lit(False)))
    declared = F.array_join(F.transform(new, lambda e: pair(F.when(e["key"] == "", F.lit("xmlns")).otherwise(F.concat(F.lit("xmlns:"), e["key"])), e["value"])), "")
    prefix = lambda uri: F.get(F.map_keys(F.map_filter("scope", lambda k, v: (v == uri) & (k != ""))), 0)
    qualified = lambda k: F.when(k.startswith("{"), F.concat_ws(":", prefix(F.regexp_extract(k, r"^\{([^}]*)\}", 1)), F.regexp_replace(k, r"^\{[^}]*\}", ""))).otherwise(k)
    attributes = F.array_join(F.transform(F.map_entries("attrs"), lambda e: pair(qualified(e["key"]), e["value"])), "")
    name = F.when(F.col("prefix") == "", F.col("tag")).otherwise(F.concat_ws(":", "prefix", "tag"))
    text = lambda c: F.coalesce(escaped(F.col(c)), F.lit(""))
    child = F.when(F.size("ancestors") == 0, F.lit(None)).when(F.size("ancestors") == 1, F.col("pre")).otherwise(F.get("ancestors", F.lit(1)))
    start = own.select("doc_id", child.alias("child"), F.col("pre").alias("at"), F.concat(F.lit("<"), name, declared, attributes, F.lit(">"), text("text")).alias("x"))
    end = own.select("doc_id", child.alias("child"), F.col("post").alias("at"), F.concat(F.lit("</"), name, F.lit(">"), F.when(F.col("parent").isNull(), "").otherwise(text("tail"))).alias("x"))
    events = start.unionByName(end).withColumn("place", F.coalesce("child", "at"))
    return events.groupBy("doc_id", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]), "").alias("tei"))


def kind_of(content: Column, path: Column) -> Column:
    """A file's kind by its first bytes, else by its name."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "application/pdf").when(head.startswith("504B0304"), "application/zip").when(F.lower(path).rlike(r"\.(xml|tei|html?|txt)$") | head.startswith("3C"), "text/xml").otherwise("application/octet-stream")


def read_documents(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """doc_id, path, raw of files, globs and zip members (each a document).

    doc_id is a hash of the path, so it needs no shuffle and stays as files come and go.
    """
    files = spark.read.format("binaryFile").load(path)
    files = files.withColumn("kind", kind_of(F.col("content"), F.col("path")))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, kind in zip(*(c.to_pylist() for c in batch.columns)):
                parts = [(name, content)]
                if kind == "application/zip":
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        parts = [(f"{name}!{m}", z.read(m)) for m in z.namelist() if not m.endswith("/")]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.string()), pa.array([c.decode(encoding, "replace") for _, c in parts], pa.string())], names=["path", "raw"])

    found = files.where("kind in ('text/xml', 'application/zip')").select("path", "content", "kind").mapInArrow(members, "path string, raw string")
    return found.withColumn("doc_id", F.xxhash64("path")).select("doc_id", "path", "raw")
