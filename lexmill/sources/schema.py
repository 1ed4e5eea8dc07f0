"""RELAX NG content models (XML syntax) as one small automaton for each element name."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from xml.etree import ElementTree

#: Fixed value: the namespace of the schema language.
RNG = "{http://relaxng.org/ns/structure/1.0}"
EMPTY, NEVER, TEXT = ("empty",), ("never",), ("text",)
ANY = "*"


def choice(*parts: tuple) -> tuple:
    flat = [p for part in parts for p in (part[1] if part[0] == "choice" else [part]) if p != NEVER]
    unique = tuple(dict.fromkeys(flat))
    return NEVER if not unique else unique[0] if len(unique) == 1 else ("choice", unique)


def both(kind: str, a: tuple, b: tuple) -> tuple:
    """a then b ('group'), or a and b mixed ('interleave')."""
    if NEVER in (a, b):
        return NEVER
    return b if a == EMPTY else a if b == EMPTY else (kind, a, b)


@lru_cache(maxsize=100_000)
def nullable(p: tuple) -> bool:
    kind = p[0]
    if kind in ("empty", "text"):
        return True
    if kind == "choice":
        return any(map(nullable, p[1]))
    if kind == "many":
        return nullable(p[1])
    return kind in ("group", "interleave") and nullable(p[1]) and nullable(p[2])


@lru_cache(maxsize=100_000)
def after(p: tuple, name: str) -> tuple:
    """What may follow once a child of that name has been met (the pattern's derivative)."""
    kind = p[0]
    if kind == "element":
        return EMPTY if p[1] in (name, ANY) else NEVER
    if kind == "text":
        return NEVER
    if kind == "choice":
        return choice(*(after(x, name) for x in p[1]))
    if kind == "many":
        return both("group", after(p[1], name), choice(p, EMPTY))
    if kind == "group":
        first = both("group", after(p[1], name), p[2])
        return choice(first, after(p[2], name)) if nullable(p[1]) else first
    if kind == "interleave":
        return choice(both("interleave", after(p[1], name), p[2]), both("interleave", p[1], after(p[2], name)))
    return NEVER


def names_in(p: tuple) -> set[str]:
    if p[0] == "element":
        return {p[1]}
    return set().union(*(names_in(x) for x in (p[1] if p[0] == "choice" else p[1:]) if isinstance(x, tuple)))


def text_in(p: tuple) -> bool:
    return p == TEXT or any(text_in(x) for x in (p[1] if p[0] == "choice" else p[1:]) if isinstance(x, tuple))


@dataclass
class Model:
    """steps[state][name] is the next state, ANY for all other names; state 0 is the first."""

    steps: list[dict[str, int]] = field(default_factory=list)
    final: list[bool] = field(default_factory=list)
    text: bool = False
    required: list[str] = field(default_factory=list)

    @property
    def free(self) -> bool:
        """Whether a child's name alone says if it may come, whatever came before it."""
        return all(set(s) == set(self.steps[0]) for s in self.steps) and all(self.final[i] for s in self.steps for i in s.values())


def automaton(pattern: tuple, limit: int = 2000) -> Model:
    out, known, todo = Model(text=text_in(pattern)), {pattern: 0}, [pattern]
    alphabet = sorted(names_in(pattern))
    for p in todo:
        steps = {}
        for name in alphabet:
            q = after(p, name if name != ANY else "\0")
            if q != NEVER:
                if q not in known:
                    known[q] = len(known)
                    todo.append(q)
                    if len(todo) > limit:
                        raise ValueError("content model with too many states")
                steps[name] = known[q]
        out.steps.append(steps)
        out.final.append(nullable(p))
    return out


def compiled(schema: str) -> dict[str, Model]:
    """The automaton of each element name of a grammar; of definitions with one name the first counts.

    Understood: element, attribute, ref, choice, group, interleave, mixed, optional, zeroOrMore, oneOrMore, text, empty, notAllowed, data, value,
    list, anyName. Definitions that combine are joined. Names go without their namespace; attributes are only looked at for being
    required.
    """
    root = ElementTree.fromstring(schema)
    defined: dict[str, list] = {}
    for d in root.iter(f"{RNG}define"):
        defined.setdefault(d.get("name"), []).append(d)
    made: dict[str, Model] = {}
    waiting: list = []
    queued: set[int] = set()

    def name_of(e) -> str:
        name = e.get("name") or next((n.text for n in e if n.tag == f"{RNG}name"), ANY)
        return name.strip().rpartition(":")[2] if name != ANY else ANY

    def parts(e, open_: tuple) -> tuple:
        out, required = EMPTY, []
        for child in e:
            p, r = read(child, open_)
            out = both("group", out, p)
            required += r
        return out, required

    def read(e, open_: tuple) -> tuple:
        kind = e.tag.removeprefix(RNG) if e.tag.startswith(RNG) else ""
        if kind == "element":
            if id(e) not in queued:
                queued.add(id(e))
                waiting.append(e)
            return ("element", name_of(e)), []
        if kind == "attribute":
            return EMPTY, [e.get("name")] if e.get("name") else []
        if kind == "ref":
            name = e.get("name")
            if name in open_:
                raise ValueError(f"definition {name!r} holds itself")
            found = [parts(d, (*open_, name)) for d in defined.get(name, [])]
            if len(found) == 1:
                return found[0]
            mixed = any(d.get("combine") == "interleave" for d in defined.get(name, []))
            out = EMPTY if mixed else NEVER
            for p, _ in found:
                out = both("interleave", out, p) if mixed else choice(out, p)
            return out, [r for _, own in found for r in own] if mixed else []
        if kind == "choice":
            found = [read(c, open_) for c in e if c.tag.startswith(RNG)]
            shared = set.intersection(*(set(r) for _, r in found)) if found else set()
            return choice(*(p for p, _ in found)), sorted(shared)
        if kind in ("optional", "zeroOrMore", "oneOrMore"):
            p, required = parts(e, open_)
            p = ("many", p) if kind != "optional" and p not in (EMPTY, NEVER) else p
            return (p, required) if kind == "oneOrMore" else (choice(p, EMPTY), [])
        if kind in ("interleave", "mixed"):
            out, required = (TEXT if kind == "mixed" else EMPTY), []
            for c in e:
                p, r = read(c, open_)
                out, required = both("interleave", out, p), required + r
            return out, required
        if kind in ("group", "div"):
            return parts(e, open_)
        if kind in ("text", "data", "value", "list"):
            return TEXT, []
        if kind == "notAllowed":
            return NEVER, []
        return EMPTY, []  # empty, documentation, name classes

    for e in list(root.iter(f"{RNG}element")):
        read(e, ())
    for e in waiting:
        name = name_of(e)
        if name != ANY and name not in made:
            pattern, required = parts(e, ())
            made[name] = automaton(pattern)
            made[name].required = sorted(set(required))
    return made
