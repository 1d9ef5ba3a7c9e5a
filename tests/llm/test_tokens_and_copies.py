"""Tokenizers against their libraries, exact copies against a dictionary, the token store's round trip."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from recollect.llm import byte_bpe, exact_dedup, token_store

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
TEXTS = [
    "a  b", "\n\n a\tb \n", "", None, "x \x1f y z", "don't  'LL we'VE 12 ½ ²x", "日本語 テキスト 🙂🙂 foo\xa0bar　qux", "<|endoftext|> hi<|startoftext|>x", " lead", "trail ",
    "éé éé o​k", "a\r\nb ﬁ ǅ", "İstanbul ΣΑΣ", "🙂" * 3000, "word " * 20000, "x" * 50000, "a\x85b c d", "tab\t\ttab  .\n\n\n!",
]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n=300):
    rng = random.Random(5)
    return ["".join(rng.choice("ab c.,'s12\n\t éß日🙂  A") for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_ids_are_the_library_s(library):
    bpe = byte_bpe.ByteBPE(RANKS, P.PATTERN)
    for x, ids in zip(TEXTS + random_texts(), bpe.encode(TEXTS + random_texts()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(x or "")
        assert bpe.decode(ids) == (x or "").encode()


def test_offsets_join_to_the_text():
    bpe = byte_bpe.ByteBPE(RANKS, P.PATTERN)
    text = "Größe 日本 🙂 ok"
    ids = bpe.encode([text])[0]
    start, end = bpe.offsets(ids, bpe.decode(ids))
    assert start[0] == 0 and end[-1] == len(text)
    assert all(s < e for s, e in zip(start, end, strict=True)) and (np.diff(start) >= 0).all()


def test_encode_and_decode_frames(spark, library):
    docs = spark.createDataFrame([(i, x, "n") for i, x in enumerate(TEXTS)], "doc_id long, text string, decoded string")
    tokens = byte_bpe.encoded(docs, RANKS, P.PATTERN)
    back = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decoded(tokens, RANKS, P.PATTERN).collect()}
    assert back == {i: (x or "").encode() for i, x in enumerate(TEXTS)}
    for r in byte_bpe.round_trip(docs, RANKS, P.PATTERN).collect():
        ids = library.encode_ordinary(TEXTS[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
        pieces, at, starts, ends = [library.decode_single_token_bytes(x) for x in ids], 0, [], []
        points = [i for i, c in enumerate(TEXTS[r.doc_id] or "") for _ in c.encode()]  # the character of each byte
        for x in pieces:
            starts.append(points[at])
            ends.append(points[at + len(x) - 1] + 1)
            at += len(x)
        assert r.offsets_sha256 == hashlib.sha256(np.array(starts + ends, "<u4").tobytes()).hexdigest()
    clashing = spark.createDataFrame([(1, "a b", "x", 7)], "doc_id long, text string, token_ids string, n_tokens int")
    assert byte_bpe.encoded_digests(clashing, RANKS, P.PATTERN).columns == ["doc_id", "text", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256"]
    assert byte_bpe.round_trip(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_token_store(spark):
    texts = TEXTS + random_texts(60)
    docs = spark.createDataFrame([(i * 7 - 40, x) for i, x in enumerate(texts)] + [(9, "twice"), (9, "twice")], "doc_id long, text string").repartition(6)
    tokenizer = Tokenizer.from_file(WORDS)
    shards = token_store.write_token_store(docs, WORDS, 1)
    got = sorted(token_store.read_token_store(shards).collect(), key=lambda r: r.start)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: r[0])
    at = 0
    for (doc_id, text), r in zip(rows, got, strict=True):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [len(token_store.token_ids(shards, d)) for d in (-40, 9, 2, 100000)] == [1, 3, 1, 0]
    found = token_store.token_ids(shards, -33)
    assert found[0].tolist() == [*tokenizer.encode(texts[1], add_special_tokens=False).ids, 1]
    assert token_store.token_ids(shards, 100001) == []


def test_token_store_nulls_and_nothing(spark):
    docs = spark.createDataFrame([(None, "a"), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.start, r.n_tokens) for r in sorted(token_store.token_digests(spark, docs, WORDS, 1).collect(), key=lambda r: r.start)] == [(None, 0, 2), (3, 2, 1)]
    assert token_store.token_digests(spark, docs.limit(0), WORDS, 1).count() == 0


def copies(n=400):
    rng = random.Random(2)
    pool = ["", None, "a", "ab", "abc", "abd", "b" * 5000, "é"] + ["p" * rng.randint(0, 5) + str(rng.randint(0, 60)) for _ in range(80)]
    return [(i, rng.choice(pool)) for i in range(n)] + [(7, "ab"), (7, "ab"), (None, "only null"), (None, "ab")]


@pytest.mark.parametrize(("keep", "limit"), [("largest", 1 << 20), ("largest", 500), ("smallest", 300)])
def test_exact_copies(spark, keep, limit):
    rows = copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup.exact_duplicates(docs, keep, limit).collect()
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    pick = max if keep == "largest" else min
    owner = {hashlib.sha256(t.encode()).hexdigest(): (pick([d for d in ids if d is not None], default=None), len(ids)) for t, ids in groups.items()}
    assert len(got) == len(rows)
    assert all((r.keep_id, r.group_size) == owner[r.text_sha256] for r in got)
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(owner)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_copies_of_nothing(spark):
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trie_spills_and_keeps_all():
    rng = random.Random(1)
    trie, want = exact_dedup.OwnerTrie(max, 2000), {}
    for i in range(3000):
        key = rng.choice([b"", b"shared" * 900]) + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 9)))
        trie.add(key, i, 1)
        owner, n = want.get(key, (0, 0))
        want[key] = (max(owner, i), n + 1)
    assert trie.spilled
    assert {k: (o, n) for k, o, n in trie.items()} == want


def test_added_columns_replace_those_of_any_case(spark):
    import public_tokenizers

    from recollect.llm import quality
    from recollect.llm.byte_bpe import encoded_digests

    docs = spark.createDataFrame([(1, "a text", "x", 2, 0.5), (2, None, "y", 3, 0.7)], "doc_id long, Text string, Token_Ids string, N_TOKENS int, Score double")
    got = encoded_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert [c.lower() for c in got.columns].count("token_ids") == 1 and got.select("token_ids", "n_tokens").count() == 2
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    kept = quality.without_low_quality(docs, labels, threshold=0.0)
    assert kept.columns == docs.columns and sorted(r.Score for r in kept.collect()) == [0.5, 0.7]
