"""Fill fixed-length training sequences by minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
FIELDS = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
WIDTH = 4  # bytes of an id, little-endian unsigned
#: ASCII marks that make a token of their own behind a word; not the apostrophe, nor what special tokens are spelled with.
TAIL = b".,!?;:\"#$%&()*+-/=@[]\\^_`{}~"


@dataclass(frozen=True)
class PackRule:
    """Sequence length, id closing a document, pieces open for choice, words whose ids a worker remembers."""

    capacity: int = 4096
    end_id: int = 2
    window: int = 192
    memo: int = 800_000


class Encoder:
    """Ids of a text, word by word.

    The tokenizer drops white space and never merges across it, so a text's ids
    are the ids of its words in order, and a worker remembers those of words it
    met. When they are too many the older half is let go, but for words that are
    met again.
    """

    def __init__(self, path: str, memo: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.older, self.limit = Tokenizer.from_file(path), {}, {}, memo // 2
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.model, self.raw_ids = self.tokenizer.model, [i.to_bytes(WIDTH, "little") for i in range(len(self.closes))]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; words that are new to the worker are encoded together."""
        if len(self.memo) > self.limit:
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        split = [[] if b"<|" in raw else raw.lower().split() for raw in texts]
        unknown = set().union(*split).difference(memo)
        known = {w: older[w] for w in unknown if w in older}
        memo.update(known)
        self._learn(unknown.difference(known))
        return [
            # What may spell a special token is left to the tokenizer.
            self._bytes(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids) if b"<|" in raw else b"".join(map(memo.__getitem__, words))
            for raw, words in zip(texts, split)
        ]

    @staticmethod
    def _bytes(ids) -> bytes:
        return np.asarray(ids, dtype="<u4").tobytes()

    def _learn(self, words: set[bytes]) -> None:
        letters, others, split = [], [], {}
        memo, pieces, raw_ids = self.memo, self.model.tokenize, self.raw_ids

        def sort(word: bytes) -> None:
            if word.isalpha():  # a-z alone: nothing to normalise or to split
                memo[word] = b"".join([raw_ids[t.id] for t in pieces(word.decode())])
            else:
                (letters if not word.isascii() and word.decode().isalpha() else others).append(word)

        for w in words:
            if w.isalpha():
                sort(w)
                continue
            base = w.rstrip(TAIL)
            if len(base) < len(w) and base[-1:].isalnum() and b"'" not in w:
                split[w] = base, w[len(base):]
            else:
                sort(w)
        for part in {p for pair in split.values() for p in pair}.difference(self.memo, words):
            sort(part)
        if letters:
            ids = np.asarray(self.tokenizer.encode_batch_fast([b" ".join(letters).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(letters):
                self._keep(letters, ids, ends)
            else:
                others += letters
        if others:
            got = self.tokenizer.encode([w.decode() for w in others], is_pretokenized=True, add_special_tokens=False)
            self._keep(others, np.asarray(got.ids, dtype="<u4"), np.searchsorted(np.asarray(got.word_ids, dtype=np.int64), np.arange(1, len(others) + 1)))
        for w, (base, tail) in split.items():
            memo[w] = memo[base] + memo[tail]

    def _keep(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        raw, at = ids.tobytes(), [0, *(ends * WIDTH).tolist()]
        self.memo.update(zip(words, map(raw.__getitem__, map(slice, at, at[1:]))))


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths whose sum is largest within ``room``: length -> how many.

    Bit ``s`` of the running integer says that a sum ``s`` can be reached. Equal
    lengths enter in powers of two, and each step's integer is kept to walk back.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


class Packer:
    """Packs the documents of one partition; ``out`` collects finished pieces."""

    def __init__(self, rule: PackRule, first_id: int):
        self.rule, self.next_id, self.out, self.out_bytes = rule, first_id, [], 0
        self.pool: dict[int, list] = {}
        self.pieces = self.tokens = 0

    def _emit(self, pieces) -> None:
        at = 0
        for doc_id, start, ids, doc_tokens in pieces:
            n = len(ids) // WIDTH
            self.out.append((doc_id, start, n, ids, doc_tokens, self.next_id, at))
            self.out_bytes += len(ids)
            at += n
        self.next_id += 1

    def _put(self, piece) -> None:
        n = len(piece[2]) // WIDTH
        if n:
            self.pool.setdefault(n, []).append(piece)
            self.pieces, self.tokens = self.pieces + 1, self.tokens + n

    def _take(self, n: int):
        self.pieces, self.tokens = self.pieces - 1, self.tokens - n
        stack = self.pool[n]
        piece = stack.pop()
        if not stack:
            del self.pool[n]
        return piece

    def add(self, doc_id, ids: bytes) -> None:
        n, step = len(ids) // WIDTH, self.rule.capacity
        for start in range(0, n - n % step, step):
            self._emit([(doc_id, start, ids[start * WIDTH:(start + step) * WIDTH], n)])
        if n % step:
            start = n - n % step
            self._put((doc_id, start, ids[start * WIDTH:], n))
        while self.pieces > self.rule.window and self.tokens >= step:
            self._fill(step)

    def _fill(self, size: int) -> None:
        """One sequence of exactly ``size`` tokens; the pool holds as many."""
        longest = max(self.pool)
        chosen, room = [], size
        if longest <= size:
            chosen.append(self._take(longest))
            room -= longest
        if room:
            for length, times in best_fill({n: len(s) for n, s in self.pool.items()}, room).items():
                for _ in range(times):
                    chosen.append(self._take(length))
                    room -= length
        if room:  # no sum fits: cut the shortest piece that is long enough
            doc_id, start, ids, doc_tokens = self._take(min(n for n in self.pool if n > room))
            chosen.append((doc_id, start, ids[:room * WIDTH], doc_tokens))
            self._put((doc_id, start + room, ids[room * WIDTH:], doc_tokens))
        self._emit(chosen)

    def finish(self) -> None:
        """Whole sequences while tokens last, then powers of two, which need no padding."""
        while self.tokens:
            self._fill(self.rule.capacity if self.tokens >= self.rule.capacity else 1 << (self.tokens.bit_length() - 1))

    def flush(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*self.out), FIELDS)], schema=FIELDS)
        self.out, self.out_bytes = [], 0
        return batch


def _groups(batches: Iterator[pa.RecordBatch], size: int = 1 << 17) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of some documents at a time, about ``size`` bytes of text."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            ids.append(doc_id.as_py())
            texts.append(text.as_py() or b"")
            held += len(texts[-1])
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


_ENCODERS: dict[str, Encoder] = {}


def pack(docs: DataFrame, tokenizer: str, rule: PackRule = PackRule()) -> DataFrame:
    """Pieces of every document with their ids, placed in sequences.

    ``tokenizer`` names a file of the installed tokenizers. A row per piece:
    ``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens,
    sequence_id, offset``. Each partition packs its own documents, so nothing is
    shuffled; its last tokens go to sequences whose length is a power of two.

    A null or empty text is a document of its closing id alone; null and repeated
    ids are packed like any other row; other columns are ignored; an empty table
    gives no rows. Memory: ``rule.window`` pieces and one document.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import public_tokenizers
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = Encoder(public_tokenizers.path(tokenizer), rule.memo)
        encoder, end = _ENCODERS[tokenizer], int(rule.end_id).to_bytes(WIDTH, "little")
        packer = Packer(rule, TaskContext.get().partitionId() << 33)
        for docs_, texts in _groups(batches):
            for doc_id, ids in zip(docs_, encoder.encode(texts)):
                packer.add(doc_id, ids + end)
                if packer.out_bytes > 8 << 20:
                    yield packer.flush()
        packer.finish()
        if packer.out:
            yield packer.flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, SCHEMA)
