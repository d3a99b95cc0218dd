import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gaugeflow.llm.packing import Encoder, PackRule, best_fill, pack

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


def test_best_fill_is_the_largest_sum_within_the_room():
    draw = random.Random(4)
    for _ in range(200):
        counts = {draw.randint(1, 40): draw.randint(1, 4) for _ in range(draw.randint(0, 7))}
        room = draw.randint(0, 120)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
        chosen = best_fill(counts, room)
        assert sum(n * k for n, k in chosen.items()) == max(sums)
        assert all(0 < k <= counts[n] for n, k in chosen.items())


@pytest.mark.parametrize("text", [
    "Plain words, twice: plain words.", "it's don't we'll I'd 'sx x's", "a1b2 3.14 (x). y).", "ÀÉ é İstanbul ΣΑΣ ﬁne Å", "<|endoftext|> mid<|startoftext|>x <| y", "tab\tnew\nline\u00a0nbsp\u2003em \u3000wide", "", "!!! ??? ...", "e\u0301 \u0301a 日本語 ไทย 😀🙂",
])
def test_word_by_word_ids_equal_the_tokenizers(tokenizer, text):
    encoder = Encoder(public_tokenizers.path(NAME), 10)
    for _ in range(2):
        assert np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_many_texts_at_a_time(tokenizer, prose):
    texts = [prose(k, k) for k in range(60)] + ["a <|endoftext|> b", "", "x. x, x"]
    for memo in (4, 10_000):
        encoder = Encoder(public_tokenizers.path(NAME), memo)
        for _ in range(2):
            got = encoder.encode([t.encode() for t in texts])
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def check(rows, want, capacity=4096):
    """Every id in one piece, sequences gapless, padding only short of the capacity."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    got = sorted((d, b"".join(bytes(p.ids) for p in sorted(ps, key=lambda p: p.start))) for d, ps in by_doc.items())
    assert got == sorted(want.items())
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[d]) // 4
            at += p.length
    padding = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_pieces_cover_all_ids_without_padding(spark, tokenizer, prose):
    docs = [(k, prose(k, n)) for k, n in enumerate([3, 5000, 20_000, 0, 900, 1, 77, 4000, 350, 351] * 4)]
    rows = pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), NAME).collect()
    want = {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for k, t in docs}
    assert check(rows, want) == 0


def test_small_windows_still_fill(spark, tokenizer, prose):
    docs = [(k, prose(k, 1 + k % 50)) for k in range(200)]
    rows = pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), NAME, PackRule(capacity=64, window=4, memo=50)).collect()
    want = {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for k, t in docs}
    assert check(rows, want, 64) == 0


def test_messy_rows(spark, messy):
    rows = pack(messy, NAME).collect()
    assert sorted(sum(r.length for r in rows if r.doc_id == d) for d in (4, 5, 6)) == [1, 1, 1]
    assert sum(r.start == 0 for r in rows if r.doc_id == 11) == 2
    assert sum(r.start == 0 for r in rows if r.doc_id is None) == 2
    assert pack(messy.limit(0), NAME).count() == 0


def test_query_digests(spark):
    from gaugeflow.llm.queries import QUERIES

    rows = QUERIES["op8_packing"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path(NAME))
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = np.array([*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
