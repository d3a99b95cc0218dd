"""Byte-level BPE: ids of whole texts by merge rank, and the bytes of ids."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WIDTH = 4  # bytes of an id, little-endian unsigned


@dataclass(frozen=True)
class BpeRule:
    """``memo`` pre-tokens of at most ``word`` characters are remembered by a worker; texts are split and merged about ``part`` characters at a time."""

    memo: int = 800_000
    word: int = 128
    part: int = 1 << 18


class RankQueue:
    """Positions filed by merge rank; the least rank comes first, in it the leftmost position.

    ``levels[0]`` has one bit a rank, each level above one bit for every word of
    the level below that is not zero, up to a single word: the least rank is
    found by one find-first-set a level. A bucket is a heap of positions.
    """

    SHIFT = 8
    MASK = (1 << SHIFT) - 1

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.levels: list[list[int]] = []
        words = max(1, ranks)
        while not self.levels or words > 1:
            words = (words + self.MASK) >> self.SHIFT
            self.levels.append([0] * words)
        self.down = self.levels[::-1]

    def fill(self, ranks: np.ndarray) -> None:
        """File every position whose rank is not negative."""
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        found, first = np.unique(ranks[order], return_index=True)
        for rank, positions in zip(found.tolist(), np.split(order, first[1:])):
            self.buckets[rank] = positions.tolist()  # ascending, so a heap
            self._mark(rank)

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
        else:
            self.buckets[rank] = [position]
            self._mark(rank)

    def _mark(self, rank: int) -> None:
        for level in self.levels:
            word = rank >> self.SHIFT
            held = level[word]
            level[word] = held | 1 << (rank & self.MASK)
            if held:
                break
            rank = word

    def least(self) -> int | None:
        """The least rank that has positions, or None."""
        rank = 0
        for level in self.down:
            word = level[rank]
            if not word:
                return None
            rank = rank << self.SHIFT | (word & -word).bit_length() - 1
        return rank

    def close(self, rank: int) -> None:
        """Give up the bucket of a rank, which is empty."""
        del self.buckets[rank]
        for level in self.levels:
            word = rank >> self.SHIFT
            level[word] &= ~(1 << (rank & self.MASK))
            if level[word]:
                break
            rank = word


class Merger:
    """Ids of pre-tokens: their bytes are linked lists, all in one, whose neighbours are merged in the order of the queue.

    Pre-tokens do not touch each other, so the order among them is of no matter
    and many are merged together.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.queue = ranks, RankQueue(max(ranks.values(), default=0) + 1)
        self.singles = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.pairs = np.full(1 << 16, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of every piece; none is empty."""
        ranks, queue, text = self.ranks, self.queue, b"".join(pieces)
        buckets, push, rank_of, bucket_of = queue.buckets, queue.push, ranks.get, queue.buckets.get
        ends = np.cumsum([len(p) for p in pieces])
        raw, n = np.frombuffer(text, np.uint8).astype(np.int64), len(text)
        pair = np.append(self.pairs[raw[:-1] << 8 | raw[1:]], -1)
        pair[ends - 1] = -1
        queue.fill(pair)
        edge = bytearray(n + 1)  # where a piece begins or ends
        edge[0] = 1
        for e in ends.tolist():
            edge[e] = 1
        pair, token, alive = pair.tolist(), self.singles[raw].tolist(), bytearray(b"\1") * n
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while (rank := queue.least()) is not None:
            bucket = buckets[rank]
            while bucket:
                p = heappop(bucket)
                if pair[p] != rank:
                    continue  # the pair filed here has been merged or has grown
                gone = after[p]
                end = after[gone]
                pair[gone] = -1
                alive[gone] = 0
                token[p] = rank
                after[p] = end
                before[end] = p
                lower = False
                if edge[end]:
                    pair[p] = -1
                else:
                    pair[p] = found = rank_of(text[p : after[end]], -1)
                    if found >= 0:
                        if (held := bucket_of(found)) is None:
                            push(found, p)
                        else:
                            heappush(held, p)
                        lower = found < rank
                if not edge[p]:
                    left = before[p]
                    pair[left] = found = rank_of(text[left:end], -1)
                    if found >= 0:
                        if (held := bucket_of(found)) is None:
                            push(found, left)
                        else:
                            heappush(held, left)
                        if found < rank:
                            lower = True
                if lower:
                    break  # a merge of less rank goes before the rest of this one
            if not bucket:
                queue.close(rank)
        kept = np.frombuffer(alive, np.uint8).view(bool)
        packed = np.array(token, np.int64)[kept].astype("<u4").tobytes()
        cuts = [0, *(np.cumsum(kept)[ends - 1] * WIDTH).tolist()]
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]


class Codec:
    """Encoder and decoder of one rank file.

    Packed ids of pre-tokens are remembered; when they are too many the older
    half is let go, but for those that are met again.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, rule: BpeRule = BpeRule()):
        import regex

        self.rule, self.merger, self.words = rule, Merger(ranks), {i: b for b, i in ranks.items()}
        self.whole = {token: rank.to_bytes(WIDTH, "little") for token, rank in ranks.items()}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.split = regex.compile(pattern).findall
        # The end of a run of letters or of digits always ends a pre-token, whatever follows.
        self.seam = regex.compile(r"\p{L}(?!\p{L})|\p{N}(?!\p{N})").search

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts that no pre-token crosses."""
        start = 0
        while len(text) - start > self.rule.part and (seam := self.seam(text, start + self.rule.part)):
            yield text[start : seam.end()]
            start = seam.end()
        yield text[start:]

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pre-tokens that are not remembered, merged together; short ones are remembered."""
        known, older, whole, unmerged, raw = {}, self.older, self.whole, [], []
        for p in pieces:
            if (ids := older.get(p)) is None:
                b = p.encode()
                if (ids := whole.get(b)) is None:
                    unmerged.append(p)
                    raw.append(b)
                    continue
            known[p] = ids
        if unmerged:
            known |= zip(unmerged, self.merger.ids(raw))
        if len(self.memo) + len(known) > self.rule.memo // 2:
            self.older, self.memo = self.memo, {}
        self.memo |= {p: ids for p, ids in known.items() if len(p) <= self.rule.word}
        return known

    def _ids(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        memo, older = self.memo, self.older
        known = self._learn(set().union(*split).difference(memo))
        # What was remembered before may just have become the older half.
        known = _Chain(self.memo, known, memo, older)
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; new pre-tokens of texts of about ``part`` characters are merged together."""
        out, group, held = [], [], 0
        for text in texts:
            if len(text) > self.rule.part:
                out += self._ids(group)
                out.append(b"".join(ids for part in self.parts(text) for ids in self._ids([part])))
                group, held = [], 0
                continue
            group.append(text)
            held += len(text)
            if held >= self.rule.part:
                out += self._ids(group)
                group, held = [], 0
        return out + self._ids(group)

    def decode(self, packed: list[bytes]) -> list[bytes]:
        step, word = WIDTH * self.rule.part, self.words.__getitem__
        return [b"".join(b"".join(map(word, np.frombuffer(ids[a : a + step], "<u4").tolist())) for a in range(0, len(ids), step)) for ids in packed]


class _Chain(dict):
    """Look-ups in ``first``, and where it has nothing in the others; a view, nothing is copied but what was missing."""

    def __init__(self, first: dict, *others: dict):
        super().__init__()
        self.all = (first, *others)

    def __missing__(self, key):
        for held in self.all:
            found = held.get(key)
            if found is not None:
                self[key] = found
                return found
        raise KeyError(key)


_CODECS: dict[tuple, Codec] = {}


def codec(vocabulary: str, rule: BpeRule) -> Codec:
    """The codec of a rank file of the installed tokenizers, once a worker."""
    key = (vocabulary, rule)
    if key not in _CODECS:
        import public_tokenizers

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _CODECS[key] = Codec(ranks, public_tokenizers.PATTERN, rule)
    return _CODECS[key]


def _translated(column: int, out: pa.Field, change: Callable, size: int = 4 << 20) -> Callable:
    """A function over Arrow batches: the values of ``column`` changed and added as ``out``, some megabytes of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = change()
        for batch in batches:
            first, values, held = 0, [], 0
            for at, value in enumerate(batch.column(column)):
                values.append(value.as_py())
                held += len(values[-1])
                if held >= size or at + 1 == batch.num_rows:
                    rows = batch.slice(first, len(values))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(apply(values), out.type)], schema=pa.schema([*batch.schema, out]))
                    first, values, held = at + 1, [], 0

    return run


def encode(docs: DataFrame, vocabulary: str, rule: BpeRule = BpeRule()) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit) of every document (``doc_id, text``).

    ``vocabulary`` names a rank file of the installed tokenizers; each match of
    their pattern is merged by itself, lowest rank first and, among equal ranks,
    leftmost first; strings of special tokens are ordinary text.

    A null text counts as empty and has no ids; equal texts have equal ids; rows
    with null or repeated ids are encoded like any other; other columns are
    ignored; an empty table gives no rows. Whole texts are read, however long:
    a text is split in parts at the ends of words, and the cost of a pre-token
    grows with n log n of its length, its memory with about 50 bytes a byte.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    run = _translated(1, pa.field("ids", pa.binary()), lambda: codec(vocabulary, rule).encode)
    made = rows.mapInArrow(lambda batches: (b.select(["doc_id", "ids"]) for b in run(batches)), "doc_id long, ids binary")
    return made.select("doc_id", (F.octet_length("ids") / F.lit(WIDTH)).cast("long").alias("n_tokens"), "ids")


def decode(coded: DataFrame, vocabulary: str, rule: BpeRule = BpeRule()) -> DataFrame:
    """``doc_id, n_tokens, ids`` with ``decoded``: the bytes that the ids stand for.

    Null ids count as none and give no bytes. An id that the vocabulary lacks is
    an error. Ids cut within a character give bytes that are no whole UTF-8.
    """
    small_batches(coded.sparkSession)
    rows = coded.select("doc_id", "n_tokens", F.coalesce(F.col("ids"), F.lit(b"")).alias("ids"))
    run = _translated(2, pa.field("decoded", pa.binary()), lambda: codec(vocabulary, rule).decode)
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
