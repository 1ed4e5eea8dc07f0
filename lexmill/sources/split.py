"""One large XML file read by many tasks: byte ranges that end with an element, and what is open where each begins."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.sources.store import stored
from lexmill.sources.xml import _ARROW, NODES, _Builder

TOKEN = re.compile(r"""<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE(?:[^\[>]|\[[^\]]*\])*>|<(/?)([^\s/>!?]+)(?:[^>"']|"[^"]*"|'[^']*')*?(/?)>""", re.DOTALL)
BLOCK = "path string, start long, closed int, kids int, opened array<struct<raw:string,at:long,kids:int>>, ticks long"
_BLOCK = pa.schema([("path", pa.string()), ("start", pa.int64()), ("closed", pa.int32()), ("kids", pa.int32()), ("opened", pa.list_(pa.struct([("raw", pa.string()), ("at", pa.int64()), ("kids", pa.int32())]))), ("ticks", pa.int64())])


class _Scan:
    """What a stretch of tags does to the elements open before it: how many it closes, which it opens, and how many children the last one
    that stays open gets."""

    def __init__(self):
        self.closed = self.kids = self.ticks = 0
        self.opened: list[list] = []

    def feed(self, text: str) -> None:
        for m in TOKEN.finditer(text):
            if not m[2]:
                continue
            if m[1]:
                if self.opened:
                    self.opened.pop()
                else:
                    self.closed, self.kids = self.closed + 1, 0
                self.ticks += 1
                continue
            if self.opened:
                self.opened[-1][2] += 1
            else:
                self.kids += 1
            if m[3]:
                self.ticks += 2
            else:
                self.opened.append([m[0], self.ticks, 0])
                self.ticks += 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """path, first byte and the records of each block, in order. Records must be used up in turn."""
    rows = ((p, s, v) for b in batches for p, s, v in zip(*(c.to_pylist() for c in b.columns)))
    held = next(rows, None)
    while held is not None:
        key = held[:2]

        def records():
            nonlocal held
            while held is not None and held[:2] == key:
                yield held[2]
                held = next(rows, None)

        yield *key, records()
        while held is not None and held[:2] == key:
            held = next(rows, None)


def _lines(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """path, start, value: the file's text cut after each end of `tag`, read in splits; start is the split's first byte."""
    text = spark.read.text(path, lineSep=f"</{tag}>")
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def _summaries(lines: DataFrame, tag: str) -> DataFrame:
    """A row for each split; its last record goes without the end of `tag`, which a file's last record may lack."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, start, records in _blocks(batches):
            own, before = _Scan(), None
            for text in records:
                if before is not None:
                    own.feed(f"{before}</{tag}>")
                before = text
            own.feed(before)
            row = [path, start, own.closed, own.kids, [{"raw": r, "at": a, "kids": k} for r, a, k in own.opened], own.ticks]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK)], schema=_BLOCK)

    return lines.mapInArrow(scan, BLOCK)


def _contexts(summaries: list) -> dict[tuple[str, int], tuple[list, int, int | None, bool]]:
    """Of each split what is open where it begins (start tag, pre, children so far), the clock, whose tail goes on, and whether it ends its file."""
    out, path, state, clock, tail = {}, None, [], 0, None
    order = sorted(summaries, key=lambda r: (r["path"], r["start"]))
    for r, after in zip(order, [*order[1:], None]):
        ends = after is None or after["path"] != r["path"]
        if r["path"] != path:
            path, state, clock, tail = r["path"], [], 0, None
        out[r["path"], r["start"]] = ([list(x) for x in state], clock, tail, ends)
        if r["closed"] > len(state):
            raise ValueError(f"{path}: an end tag without a start; read it whole")
        state = state[: len(state) - r["closed"]]
        if state:
            state[-1] = [*state[-1][:2], state[-1][2] + r["kids"]]
        state = state + [[x["raw"], clock + x["at"], x["kids"]] for x in r["opened"]]
        clock += r["ticks"]
        if not ends:
            if not state:
                raise ValueError(f"{path}: an end tag without a start; read it whole")
            tail, state, clock = state[-1][1], state[:-1], clock + 1
    return out


def read_nodes(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """The node table of large well-formed files, as shred() makes it, each file read by as many tasks as it has splits.

    Files are cut after ends of `tag` (an element that files have many of, as their entries are); other cuts than those would do as well,
    so nested ones are fine. A first pass sums up what each split opens and closes; the driver strings these together, a row for each split, and
    a second pass parses each split on top of what is open there. Elements that splits part are joined again. doc_id is the hash of the
    path that Spark has for the file. UTF-8 without document types that declare entities; files with `</tag>` in comments, and malformed
    ones, raise ValueError: read_documents() and shred() take them whole.
    """
    lines = _lines(spark, path, tag)
    contexts = spark.sparkContext.broadcast(_contexts(_summaries(lines, tag).collect()))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict], path: str) -> pa.RecordBatch:
            columns = [pa.array([r.get(f.name) for r in rows], type=f.type) for f in _ARROW]
            return pa.RecordBatch.from_arrays([*columns, pa.array([path] * len(rows), pa.string())], schema=_ARROW.append(pa.field("path__", pa.string())))

        for path, start, records in _blocks(batches):
            context, clock, tail, last = contexts.value[path, start]
            build, parser = _Builder(None, False), expat.ParserCreate()
            parser.buffer_text = True
            parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = build.start, build.end, build.data
            try:
                for raw, pre, _ in context:
                    parser.Parse(raw.encode(), False)
                    build.open[-1]["pre"] = pre
                for node, (_, _, kids) in zip(build.open, context):
                    node["n"] = kids
                build.rows.clear()
                build.clock = clock
                carried = list(build.open)
                build.last = going_on = {"pre": tail, "tail": ""} if tail is not None else None
                before = None
                for text in records:
                    if before is not None:
                        parser.Parse(f"{before}</{tag}>".encode(), False)
                    else:
                        text = text if clock else text.lstrip("﻿ \t\r\n")
                    before = text
                    if len(build.rows) > 5000:
                        ready = [r for r in build.rows if "post" in r and r is not build.last]
                        build.rows = [r for r in build.rows if "post" not in r or r is build.last]
                        yield batch(ready, path)
                parser.Parse(before.encode(), False)
                if not last or build.open:
                    parser.Parse(f"</{tag}>".encode(), False)
                if last:
                    parser.Parse(b"", True)
            except expat.ExpatError as e:
                raise ValueError(f"{path}, after byte {start}: {e}; read it whole") from e
            yield batch(build.rows, path)
            ends = [{"pre": r["pre"], "post": r.get("post"), "tail": r["tail"] if r is build.last or "post" in r else None, "depth": -1} for r in carried if "post" in r]
            if going_on and going_on["tail"]:
                ends.append({"pre": going_on["pre"], "tail": going_on["tail"], "depth": -1})
            yield batch(ends, path)

    rows = lines.mapInArrow(parse, f"{NODES}, path__ string").withColumn("doc_id", F.xxhash64("path__")).drop("path__")
    rows = stored(rows)
    ends = rows.where("depth = -1").groupBy("doc_id", "pre").agg(F.max("post").alias("end__"), F.concat_ws("", F.collect_list("tail")).alias("tail__"))  # a few for each split
    whole = rows.where("depth >= 0").join(F.broadcast(ends), ["doc_id", "pre"], "left")
    return whole.withColumn("post", F.coalesce("post", "end__")).withColumn("tail", F.concat(F.coalesce("tail", F.lit("")), F.coalesce("tail__", F.lit("")))).select(rows.columns)
