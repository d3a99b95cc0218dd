import base64
import hashlib
import random
from heapq import heappop

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from gaugeflow.llm.bpe import BpeRule, Codec, Merger, RankQueue, decode, encode

FILE = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path(FILE), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def strange(seed, n):
    draw = random.Random(seed)
    pools = ["abcdefghijklmnop", " \t\n\r\x0b\x1c\x85　", "0123456789٣४", "'sStTrReE'", "äöüßéñ", "漢字かなカナ", "😀👩‍👩‍👧🏽", ".,;:!?-_/\\<|endoftext|>", "́‍\x00\x7f"]
    return "".join("".join(draw.choices(draw.choice(pools), k=draw.randint(1, 9))) for _ in range(n))


def take(queue):
    """The next rank and position."""
    rank = queue.least()
    if rank is None:
        return None
    position = heappop(queue.buckets[rank])
    if not queue.buckets[rank]:
        queue.close(rank)
    return rank, position


def test_queue_gives_the_least_rank_and_its_leftmost_position():
    draw, queue, held = random.Random(4), RankQueue(70_000), []
    for _ in range(4000):
        if held and draw.random() < 0.45:
            assert take(queue) == min(held)
            held.remove(min(held))
        else:
            entry = (draw.choice([draw.randrange(70_000), 7, 255, 256, 65_535, 65_536]), draw.randrange(10**6))
            held.append(entry)
            queue.push(*entry)
    assert [take(queue) for _ in range(len(held) + 1)] == [*sorted(held), None]
    assert not any(map(any, queue.levels)) and not queue.buckets


def test_queue_is_filled_in_order():
    queue = RankQueue(300)
    queue.fill(np.array([5, -1, 299, 5, 0, -1, 5]))
    assert [take(queue) for _ in range(6)] == [(0, 4), (5, 0), (5, 3), (5, 6), (299, 2), None]


def test_merges_follow_the_ranks_however_long_the_pre_token(ranks, plain):
    """Long runs of one letter, of few letters and of any bytes, against the library."""
    draw, merger = random.Random(5), Merger(ranks)
    pieces = [b"a" * 5000, b"ab" * 3000, b"=" * 777, bytes(draw.randrange(256) for _ in range(4000)), "ñ".encode() * 900]
    pieces += ["".join(draw.choices("aeinrst", k=n)).encode() for n in (1, 2, 3, 8, 30, 99, 100, 101, 20_000)]
    want = [packed(plain._core_bpe.encode_single_piece(p)) for p in pieces]
    whole = [k for k, p in enumerate(pieces) if p in ranks]  # taken as they are, before anything is merged
    got = merger.ids(pieces)
    assert [g for k, g in enumerate(got) if k not in whole] == [w for k, w in enumerate(want) if k not in whole]
    assert [merger.ids([p])[0] for p in pieces] == got


def test_parts_never_cut_a_pre_token(ranks, plain):
    small = Codec(ranks, public_tokenizers.PATTERN, BpeRule(memo=50, word=6, part=16))
    for seed in range(150):
        text = strange(seed, 60)
        ids = small.encode([text, "", text[:9]])
        assert ids == [packed(plain.encode_ordinary(t)) for t in (text, "", text[:9])]
        assert small.decode(ids) == [text.encode(), b"", text[:9].encode()]
    assert len(small.memo) <= 200 and len(small.older) <= 200


def test_documents_equal_the_library_and_come_back(spark, messy, plain):
    extra = [(20, strange(1, 3000)), (21, "x" * 30_000), (22, " " * 5000), (23, "\n\n  a  \n b"), (24, "<|endoftext|>")]
    docs = messy.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    got = decode(encode(docs, FILE), FILE).collect()
    want = sorted((r.doc_id or 0, packed(plain.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.collect())
    assert sorted((r.doc_id or 0, bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)


def test_empty_table_null_ids_and_unknown_ids(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0
    coded = spark.createDataFrame([(1, 0, None)], "doc_id long, n_tokens long, ids binary")
    assert bytes(decode(coded, FILE).first().decoded) == b""
    with pytest.raises(Exception, match="KeyError"):
        decode(spark.createDataFrame([(1, 1, bytearray(b"\xff\xff\xff\x7f"))], "doc_id long, n_tokens long, ids binary"), FILE).collect()


def test_query_digests(spark, plain):
    from gaugeflow.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op12_bpe"](spark, sf).collect():
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
