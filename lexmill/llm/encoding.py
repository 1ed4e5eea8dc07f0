"""Exact encoding with a tokenizer file: texts are cut at white space, and each distinct chunk of a batch is encoded once."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexmill.llm.common import SPACE_BYTE, flat

#: Texts that match go to the tokenizer whole: white space beyond ASCII, controls, strings of special tokens, and letters
#: whose lower-casing or composition looks at their neighbours.
BY_ITSELF = r"[^\t-\r -~¡-įĲ-ž]|<\|"
#: The steps before the model that are known to always cut where a chunk begins, so that a text's ids are its chunks' ids.
KNOWN_STEPS = [
    {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    },
    {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}},
]


def chunk_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where chunks begin in texts that lie one after the other; edges: where the texts begin, and the end.

    A chunk is a word with the blank before it, or the rest of a run of white space.
    """
    space = SPACE_BYTE[data]
    ahead = np.ones(len(data), dtype=bool)
    ahead[:-1] = space[1:]
    ahead[edges[1:][edges[1:] > edges[:-1]] - 1] = True
    behind = np.zeros(len(data), dtype=bool)
    behind[1:] = space[:-1]
    begins = space & ~(behind & ahead)
    own = behind & ~space
    own[1:] &= data[:-1] != 0x20
    begins |= own
    begins[edges[:-1][edges[:-1] < len(data)]] = True
    return np.flatnonzero(begins)


class ChunkedEncoder:
    """Ids of many texts at once, of an encoder that may cut texts where chunks begin.

    A batch's distinct chunks are looked up among those of earlier batches; new ones are encoded by learn(), and remembered until
    there are too many.
    """

    LIMIT = 1_200_000

    def forget(self) -> None:
        self.chunks = pa.array([], pa.binary())
        self.ids, self.ends = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def learn(self, chunks: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chunks' ids, one after the other, and how many each has; whole: chunks that may hold anything."""
        raise NotImplementedError

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one text after the other, and how many each has. Null is empty."""
        data, edges = flat(texts)
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        odd = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, BY_ITSELF), False).to_numpy(zero_copy_only=False))
        starts = chunk_starts(data, edges)
        for i in odd.tolist():  # one chunk each
            a, b = np.searchsorted(starts, [edges[i], edges[i + 1]])
            starts[a + 1 : b] = -1
        starts = starts[starts >= 0] if len(odd) else starts
        chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        of, distinct = chunks.indices.to_numpy(), chunks.dictionary
        whole = np.zeros(len(distinct), dtype=bool)
        whole[of[np.searchsorted(starts, edges[odd])]] = True
        if len(self.chunks) > self.LIMIT:
            self.forget()
        row = pc.fill_null(pc.index_in(distinct, value_set=self.chunks), -1).to_numpy()
        new = np.flatnonzero(row < 0)
        ids, sizes = self.learn(distinct.take(pa.array(new)), whole[new])
        row = row.copy()
        row[new] = len(self.ends) - 1 + np.arange(len(new))
        ids, ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        if whole.any():
            keep = ~whole[new]
            mine, sizes = ids[len(self.ids) :][np.repeat(keep, sizes)], sizes[keep]
            self.chunks = pa.concat_arrays([self.chunks, distinct.take(pa.array(new[keep]))])
            self.ids, self.ends = np.concatenate([self.ids, mine]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        elif len(new):
            self.chunks = pa.concat_arrays([self.chunks, distinct.take(pa.array(new))])
            self.ids, self.ends = ids, ends
        rows = row[of]
        first, n = ends[rows], (ends[1:] - ends[:-1])[rows]
        after = np.cumsum(n)
        at = np.arange(int(after[-1])) + np.repeat(first - (after - n), n)
        total = np.concatenate([[0], after])
        return ids[at], np.diff(total[np.searchsorted(starts, edges)])


class Encoder(ChunkedEncoder):
    """Ids by a tokenizer file: new chunks are encoded some twenty at a time with a special token between them.

    A file whose steps aren't among KNOWN_STEPS encodes every text whole.
    """

    TOGETHER = 20

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        special = [t["content"] for t in steps["added_tokens"] if t["special"]]
        plain = all(t["content"].startswith("<|") for t in steps["added_tokens"]) and not steps["post_processor"]
        self.between = special[-1] if special and plain and {k: steps[k] for k in ("normalizer", "pre_tokenizer")} in KNOWN_STEPS else None
        self.forget()

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = chunks.cast(pa.string()).to_pylist()
        alone = np.flatnonzero(whole).tolist()
        some = [t for t, w in zip(texts, whole.tolist()) if not w] if alone else texts
        mark, n = self.tokenizer.token_to_id(self.between), self.TOGETHER
        groups = [self.between.join(some[i : i + n]) + self.between for i in range(0, len(some), n)]
        parts = []
        for i in range(0, len(groups), 500):
            parts += [np.array(ids, dtype=np.uint32) for ids in self.encoded(groups[i : i + 500])]
        ids = np.concatenate([np.zeros(0, dtype=np.uint32), *parts])
        marks = np.flatnonzero(ids == mark)
        if len(marks) != len(some):
            raise ValueError("a chunk holds a special token")
        sizes = np.diff(marks, prepend=-1) - 1
        ids = ids[ids != mark]
        if alone:
            own = self.encoded([texts[i] for i in alone])
            where = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(np.flatnonzero(~whole), alone)]
            ids = np.insert(ids, np.repeat(where, [len(x) for x in own]), np.array([t for x in own for t in x], dtype=np.uint32))
            every = np.empty(len(texts), dtype=np.int64)
            every[~whole], every[whole] = sizes, [len(x) for x in own]
            sizes = every
        return ids, sizes

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.between is None:
            own = self.encoded([t or "" for t in texts.to_pylist()])
            return np.array([x for ids in own for x in ids], dtype=np.uint32), np.array([len(x) for x in own], dtype=np.int64)
        return super().batch(texts)


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str, limit: int = ChunkedEncoder.LIMIT) -> Encoder:
    """This worker's encoder for a file of the public tokenizers, or for a path; it remembers about `limit` chunks."""
    if name not in _ENCODERS:
        path = name
        if not os.path.isabs(name):
            import public_tokenizers

            path = public_tokenizers.path(name)
        _ENCODERS[name] = Encoder(path)
    _ENCODERS[name].LIMIT = limit
    return _ENCODERS[name]


def slices(texts: list[str | None], chars: int = 1_000_000):
    """Index ranges of about so many characters."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_slices(texts: pa.Array, size: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of about so many bytes, one text at least."""
    _, edges = flat(texts)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + size, side="right")) - 1)
        yield a, b
        a = b
