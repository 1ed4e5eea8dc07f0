"""Scalar functions on columns; all stay in the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = ".,;:!?’"
#: The universal part-of-speech tags.
UNIVERSAL_POS = ["ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X"]
#: Characters that an XML name may start with, and those that may follow, in the basic plane and without the colon.
NAME_START = r"A-Z_a-zÀ-ÖØ-öø-˿Ͱ-ͽͿ-῿‌‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�"
NAME_MORE = r"\-.0-9·̀-ͯ‿⁀"


def strip(text: Column) -> Column:
    """Without white space (Unicode's) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def escaped(text: Column) -> Column:
    """Text or a quoted attribute value in XML; null stays null."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def element(tag: str, content: Column, **attributes: Column) -> Column:
    """One element's markup; attributes with a null value are left out, a trailing _ in a name goes and __ is a colon."""
    pairs = [F.coalesce(F.concat(F.lit(f' {n.rstrip("_").replace("__", ":")}="'), escaped(v.cast("string")), F.lit('"')), F.lit("")) for n, v in attributes.items()]
    return F.concat(F.lit(f"<{tag}"), *pairs, F.lit(">"), F.coalesce(content, F.lit("")), F.lit(f"</{tag}>"))


def acronym(title: Column) -> Column:
    """The first letter of each word, upper-cased; 'dict' if there is none."""
    letters = F.transform(F.split(strip(F.coalesce(title, F.lit(""))), r"(?U)\s+"), lambda w: F.upper(F.regexp_extract(w, r"\p{L}", 0)))
    joined = F.array_join(letters, "")
    return F.when(joined == "", F.lit("dict")).otherwise(joined)


def name_safe(text: Column) -> Column:
    """A part of an identifier: trimmed, white space as '.', each character that XML names don't allow as its number between 〇 signs (and 〇 itself too, so that different texts stay different)."""
    dotted = F.regexp_replace(strip(text), r"(?U)\s+", ".")
    allowed = rf"[{NAME_START}{NAME_MORE}&&[^〇]]"
    each = F.transform(F.split(dotted, ""), lambda c: F.when(c.rlike(allowed) | (c == ""), c).otherwise(F.concat(F.lit("〇"), F.lower(F.hex(F.ascii(c))), F.lit("〇"))))
    return F.array_join(each, "")


def without_namespace(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^\{[^}]*\}", "")


def without_default_namespaces(raw: Column) -> Column:
    return F.regexp_replace(raw, r'\s*xmlns="[^"]*"', "")


def handle_suffix(link: Column) -> Column:
    """What follows hdl.handle.net/ in a link, or all of it."""
    return F.substring_index(strip(link), "hdl.handle.net/", -1)


def entry_head(xml: Column) -> Column:
    """The first ten characters of an entry's first line."""
    return F.substring(F.split(without_default_namespaces(xml), "\n")[0], 1, 10)


def peeled(token: Column) -> Column:
    """A token cut into its body (if any) and the punctuation signs that end it, in their order."""
    body = F.rtrim(token, F.lit(PUNCTUATION))
    signs = F.split(F.substr(token, F.length(body) + 1), F.lit(""))
    return F.when(F.length(body) == F.length(token), F.filter(F.array(token), lambda x: x != "")).otherwise(F.filter(F.concat(F.array(body), signs), lambda x: x != ""))


def group_start(pattern: str, group: int):
    """A function of a text column: how many characters precede a group of the pattern's first match; null without one.

    The JVM tells where a match begins, but not where a group does, so this one runs in Arrow batches.
    """
    @F.pandas_udf("int")
    def start(texts: pd.Series) -> pd.Series:
        compiled = re.compile(pattern)
        found = [compiled.search(t) if t is not None else None for t in texts]
        return pd.Series([None if m is None or m.start(group) < 0 else m.start(group) for m in found], dtype="Int32")

    return start


def seamed(pieces: Column) -> Column:
    """Pieces of text in one, with a space wherever two would meet without white space."""
    close = lambda a, b: (a == "") | (b == "") | a.rlike(r"(?U)\s$") | b.rlike(r"(?U)^\s")
    return F.aggregate(pieces, F.lit(""), lambda a, b: F.concat(a, F.when(close(a, b), "").otherwise(" "), b))


def translated(text: Column, table: dict[str, str]) -> Column:
    """A value's translation, or itself where the table has none."""
    if not table:
        return text
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, text), text)


def replaced(text: Column, table: dict[str, str]) -> Column:
    """A fold of regular-expression replacements, in the keys' order, and trimmed."""
    for pattern in sorted(table):
        text = F.regexp_replace(text, pattern, table[pattern])
    return strip(text)


def result_message(line: Column, column: Column, level: Column, kind: Column, message: Column) -> Column:
    return F.concat_ws(":", line, column, level, kind, message)
