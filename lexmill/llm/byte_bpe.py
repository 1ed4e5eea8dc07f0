"""Byte-level BPE from a file of ranks: merges in the order of a rank queue whose set of ranks is a hierarchical bitmap."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import record_batch
from lexmill.llm.encoding import ChunkedEncoder, text_slices

#: Fixed value: where the rank files' texts are cut before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DIGEST_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
IDS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


class RankSet:
    """A set of ranks as bits in three levels: a bit of a word says whether the 64-bit word below it has any; the top is one word of as many
    bits as it takes. The least rank is the first bit set of one word a level."""

    def __init__(self, size: int):
        self.low, self.middle, self.top = [0] * (-(-size // 64)), [0] * (-(-size // 4096)), 0

    def add(self, rank: int) -> None:
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def remove(self, rank: int) -> None:
        word = self.low[rank >> 6] = self.low[rank >> 6] & ~(1 << (rank & 63))
        if not word:
            word = self.middle[rank >> 12] = self.middle[rank >> 12] & ~(1 << (rank >> 6 & 63))
            if not word:
                self.top &= ~(1 << (rank >> 12))

    def least(self) -> int:
        """-1 if there is none."""
        word = self.top
        if not word:
            return -1
        at = (word & -word).bit_length() - 1
        word = self.middle[at]
        at = at << 6 | (word & -word).bit_length() - 1
        word = self.low[at]
        return at << 6 | (word & -word).bit_length() - 1


class Ranks:
    """The tokens of a rank file, and the merges of one pre-token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.size = max(self.ranks.values()) + 1
        self.longest = max(map(len, self.ranks))
        self.queue = RankSet(self.size)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a pre-token: again and again the leftmost neighbours whose joint bytes have the least rank become one.

        Buckets hold, for each rank that occurs, the left ends of neighbours that had it when they were put there; an entry whose
        neighbours have changed since is skipped. Time grows with the length times the logarithm of a bucket's size.
        """
        if piece in self.ranks:
            return [self.ranks[piece]]
        n, get, longest, queue = len(piece), self.ranks.get, self.longest, self.queue
        end = list(range(1, n + 1))  # of the part that begins here
        before = list(range(-1, n - 1))
        joint = [get(piece[i : i + 2]) for i in range(n - 1)]  # rank of the part that begins here with the next one
        joint.append(None)
        buckets: dict[int, list[int]] = {}
        for i, rank in enumerate(joint):
            if rank in buckets:
                buckets[rank].append(i)
            elif rank is not None:
                buckets[rank] = [i]
                queue.add(rank)
        while (rank := queue.least()) >= 0:
            held = buckets[rank]
            i = heappop(held) if len(held) > 1 else held.pop()  # ascending lists are heaps
            if not held:
                queue.remove(rank)
            if joint[i] != rank:
                continue
            middle = end[i]
            stop = end[i] = end[middle]
            joint[middle] = joint[i] = None
            j = before[i]
            if stop < n:
                before[stop] = i
                after = end[stop]
            else:
                after = -1
            for left, right in ((i, after), (j, stop)):
                if left < 0 or right < 0:
                    continue
                new = joint[left] = get(piece[left:right]) if right - left <= longest else None
                if new is not None:
                    if held := buckets.get(new):
                        heappush(held, left)
                    else:
                        buckets[new] = [left]
                        queue.add(new)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out


    def joint(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of neighbours' joint bytes; -1 for none."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    #: Buckets of up to so many entries are worked off one by one.
    FEW = 12

    def merged_all(self, pieces: list[bytes]) -> list[list[int]]:
        """merged() of many pre-tokens at once: they lie one after the other in one list of parts with one rank queue.

        A rank's whole bucket is taken at once: its merges don't touch those of other pre-tokens, and within one a merge makes no
        neighbours of a lesser rank, as all that could make them has been merged before. A file of ranks for which that doesn't hold shows
        here, and such pre-tokens go through merged().
        """
        whole = [self.ranks.get(p) for p in pieces]
        todo = [i for i, r in enumerate(whole) if r is None]
        if not todo:
            return [[r] for r in whole]
        data = np.frombuffer(b"".join([pieces[i] for i in todo]), dtype=np.uint8)
        n, sizes = len(data), np.fromiter((len(pieces[i]) for i in todo), dtype=np.int64, count=len(todo))
        ends = np.cumsum(sizes)
        token = self.bytes[data]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        joint = np.full(n, -1, dtype=np.int64)
        inner = np.flatnonzero(after >= 0)
        joint[inner] = self.joint(token[inner], token[inner + 1])
        queue, get, size, odd = self.queue, self.pairs.get, self.size, []
        first = inner[joint[inner] >= 0]
        order = np.argsort(joint[first], kind="stable")
        ranks, starts = np.unique(joint[first][order], return_index=True)
        buckets: dict[int, list[int]] = dict(zip(ranks.tolist(), (part.tolist() for part in np.split(first[order], starts[1:]))))
        for rank in buckets:
            queue.add(rank)
        tokens, afters, befores, joints = memoryview(token), memoryview(after), memoryview(before), memoryview(joint)

        def put(rank: int, at: int) -> None:
            held = buckets.get(rank)
            if held:
                held.append(at)
            else:
                buckets[rank] = [at]
                queue.add(rank)

        while (rank := queue.least()) >= 0:
            queue.remove(rank)
            held = buckets.pop(rank)
            if len(held) <= self.FEW:
                for i in sorted(held) if len(held) > 1 else held:
                    if joints[i] != rank:
                        continue
                    middle = afters[i]
                    stop = afters[i] = afters[middle]
                    tokens[i], tokens[middle], joints[middle], joints[i] = rank, -1, -1, -1
                    if stop >= 0:
                        befores[stop] = i
                        new = get(rank * size + tokens[stop], -1)
                        if new >= 0:
                            joints[i] = new
                            put(new, i)
                            if new < rank:
                                odd.append(i)
                    if (j := befores[i]) >= 0:
                        new = joints[j] = get(tokens[j] * size + rank, -1)
                        if new >= 0:
                            put(new, j)
                            if new < rank:
                                odd.append(j)
                continue
            at = np.unique(held)
            at = at[joint[at] == rank]
            if not len(at):
                continue
            follows = np.zeros(len(at), dtype=bool)
            follows[1:] = after[at[:-1]] == at[1:]
            if follows.any():  # of neighbours that overlap, the first, the third and so on
                places = np.arange(len(at))
                at = at[(places - np.maximum.accumulate(np.where(follows, 0, places))) % 2 == 0]
            middle = after[at]
            stop = after[middle]
            token[at], token[middle], joint[middle], joint[at] = rank, -1, -1, -1
            after[at] = stop
            more = stop >= 0
            before[stop[more]] = at[more]
            left = before[at]
            left = left[left >= 0]
            new_at, new_left = self.joint(token[at[more]], token[stop[more]]), self.joint(token[left], token[after[left]])
            joint[at[more]], joint[left] = new_at, new_left
            spots, news = np.concatenate([at[more], left]), np.concatenate([new_at, new_left])
            fine = news >= 0
            spots, news = spots[fine], news[fine]
            odd += spots[news < rank].tolist()
            for new, i in zip(news.tolist(), spots.tolist()):
                put(new, i)
        kept = token >= 0
        ids, edges = token[kept].tolist(), np.concatenate([[0], np.cumsum(kept)[ends - 1]]).tolist()
        out = [None if r is None else [r] for r in whole]
        for k, i in enumerate(todo):
            out[i] = ids[edges[k] : edges[k + 1]]
        for k in set(np.searchsorted(ends, odd, side="right").tolist()):
            out[todo[k]] = self.merged(pieces[todo[k]])
        return out


class RankEncoder(ChunkedEncoder):
    """Ids of many texts at once: a batch's distinct chunks are looked up among those of earlier ones, and new ones are cut by the pattern and merged."""

    #: Distinct pre-tokens remembered beside the chunks that hold them.
    PIECES = 400_000

    def __init__(self, path: str):
        import regex

        self.ranks, self.cut, self.pieces = Ranks(path), regex.compile(PATTERN), {}
        size = self.ranks.size
        tokens = [b""] * size
        for token, rank in self.ranks.ranks.items():
            tokens[rank] = token
        self.tokens = Strings.of(tokens)
        self.digits = Strings.of([b"%d " % i for i in range(size)])
        self.forget()

    def ids_of(self, text: str) -> list[int]:
        return self.all_ids([text])[0]

    def all_ids(self, texts: list[str]) -> list[list[int]]:
        """Each text's ids; pre-tokens that aren't remembered are merged together."""
        cut = [self.cut.findall(t) for t in texts]
        new = list({piece for own in cut for piece in own if piece not in self.pieces})
        known = dict(zip(new, self.ranks.merged_all([p.encode() for p in new])))
        own = lambda p: known[p] if p in known else self.pieces[p]
        out = [own(pieces[0]) if len(pieces) == 1 else [i for p in pieces for i in own(p)] for pieces in cut]
        if len(self.pieces) + len(known) > self.PIECES:
            self.pieces.clear()
        self.pieces.update((p, ids) for p, ids in known.items() if len(p) <= 64)
        return out

    def learn(self, chunks: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.all_ids(chunks.cast(pa.string()).to_pylist())
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        return np.fromiter((x for ids in own for x in ids), dtype=np.uint32, count=int(sizes.sum())), sizes


class Strings:
    """Byte strings by number, for gathering many of them at once."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.data, self.starts, self.sizes = data, starts, sizes

    @staticmethod
    def of(strings: list[bytes]) -> Strings:
        sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        return Strings(np.frombuffer(b"".join(strings), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes)

    def joined(self, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The strings of these numbers, one after the other, and where each ends."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[numbers] - (ends - sizes), sizes)
        return self.data[at].tobytes(), ends


_ENCODERS: dict[str, RankEncoder] = {}


def rank_encoder(name: str) -> RankEncoder:
    """This worker's encoder for a rank file of the public tokenizers, or for a path."""
    if name not in _ENCODERS:
        path = name
        if not os.path.isabs(name):
            import public_tokenizers

            path = public_tokenizers.path(name)
        _ENCODERS[name] = RankEncoder(path)
    return _ENCODERS[name]


#: Ids whose strings are gathered at a time.
STRETCH = 1 << 20


def _sha256(strings: Strings, ids: np.ndarray, trim: int = 0) -> str:
    """Of the ids' strings one after the other, without the last `trim` bytes; long documents are hashed in stretches."""
    digest = hashlib.sha256()
    for a in range(0, len(ids), STRETCH):
        text, _ = strings.joined(ids[a : a + STRETCH])
        digest.update(text[: len(text) - trim] if a + STRETCH >= len(ids) else text)
    return digest.hexdigest()


def encoded_ids(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, ids of whole texts; other columns are left out. A null text is empty and has no ids; rows with a null or repeated doc_id are encoded like others."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = rank_encoder(ranks)
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                ids, n = enc.batch(batch.column(1).slice(a, b - a))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield record_batch(IDS_SCHEMA, [batch.column(0).slice(a, b - a), lists])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, ids array<int>")


def decoded_bytes(rows: DataFrame, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, bytes of rows (doc_id, ids): the tokens' bytes joined, which need not be whole characters. A null list gives null, an empty one no bytes; an id the file lacks raises IndexError."""
    schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = rank_encoder(ranks).tokens
        for batch in batches:
            lists = batch.column(1)
            out = [None if not lists[i].is_valid else tokens.joined(np.asarray(lists[i].values, dtype=np.int64))[0] for i in range(len(lists))]
            yield record_batch(schema, [batch.column(0), pa.array(out, pa.binary())])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(decode, "doc_id long, bytes binary")


def round_trip_digests(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space) and decoded_sha256 (of the bytes that the ids decode to).

    Whole texts are encoded, cut nowhere but where the pattern cuts; a null text is empty. Rows with a null or repeated doc_id are encoded
    like others, and other columns are left out. Ids never leave the task that made them: digests are all that does.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = rank_encoder(ranks)
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                ids, n = enc.batch(batch.column(1).slice(a, b - a))
                edges = np.concatenate([[0], np.cumsum(n)])
                own = [ids[x:y] for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]
                yield record_batch(DIGEST_SCHEMA, [batch.column(0).slice(a, b - a), n, [_sha256(enc.digits, x, 1) for x in own], [_sha256(enc.tokens, x) for x in own]])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
