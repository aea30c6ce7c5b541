"""Ids by recursive queries against the library, and ids decoded against the texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from treequarry.llm import bpe


def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return library(bpe.ranks_of(public_tokenizers.path(bpe.RANKS)))


@pytest.fixture(scope="module")
def coder():
    return bpe.TextCoder(bpe.RANKS, limit=300)


def test_random_texts(vocabulary, coder):
    rng = random.Random(6)
    alphabet = ["a", "B", "the", "ing", "é", "ß", "1", "½", "'s", "'", "!", "#", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\x1c", "\x85", "日", "本", "🙂", "ﬁ", "<|endoftext|>", "don't", "ͅ", "́", " ", "\x00"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)] + [None, ""]
    for i in range(0, len(texts), 500):
        some = texts[i : i + 500]
        found = coder.many(some)
        assert [ids.tolist() for ids, _ in found] == [vocabulary.encode_ordinary(t or "") for t in some]
        assert coder.coder.decode([ids for ids, _ in found]) == [(t or "").encode() for t in some]
        assert [shown for _, shown in found] == [",".join(map(str, ids.tolist())) for ids, _ in found]


def test_long_pieces(vocabulary, coder):
    rng = random.Random(7)
    texts = ["x" * n for n in (65, 66, 1001, 20_000)] + ["".join(rng.choices("abcdeghinorstéß", k=n)) for n in (70, 500, 6000)] + ["ab" * 3000, "日本語" * 900, "=-" * 300 + "#" * 777]
    for text, (ids, _) in zip(texts, coder.many(texts), strict=True):
        assert ids.tolist() == vocabulary.encode_ordinary(text)


def test_vocabularies_whose_ranks_do_not_grow():
    """Pairs that make lower pairs: contractions must still come one by one from the left."""
    rng = random.Random(8)
    for seed in range(30):
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 256 + 25:
            tokens.add(b"".join(rng.choices([t for t in tokens if set(t) <= set(b"abc")], k=2)))
        more = [t for t in tokens if len(t) > 1]
        rng.shuffle(more)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(sorted(more, key=len) if seed % 2 else more)}
        plain = library(ranks)
        coder = bpe.Coder.__new__(bpe.Coder)
        coder.__dict__ |= own(ranks).__dict__
        pieces = [bytes(rng.choices(b"abc", k=rng.choice([3, 9, 30, 70, 200]))) for _ in range(60)]
        assert [x.tolist() for x in coder.encode(pieces)] == [plain.encode_ordinary(p.decode()) for p in pieces]


def own(ranks):
    name = "/own/ranks"
    kept, bpe.ranks_of = bpe.ranks_of, lambda path: ranks
    try:
        return bpe.Coder(name)
    finally:
        bpe.ranks_of = kept


def test_operator(spark, documents, texts, nothing, vocabulary):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for r in documents.select("doc_id", "text").collect():
        ids = vocabulary.encode_ordinary(r["text"] or "")
        want[(r["doc_id"], len(ids), sha(",".join(map(str, ids)).encode()), sha((r["text"] or "").encode()))] += 1
    out = bpe.round_trip(documents)
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    assert Counter(map(tuple, out.collect())) == want
    assert bpe.round_trip(nothing).count() == 0


def test_ids_and_bytes_as_tables(spark, documents, vocabulary):
    ids = bpe.encoded(documents)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in ids.collect()) == Counter((r["doc_id"], tuple(vocabulary.encode_ordinary(r["text"] or ""))) for r in documents.collect())
    assert Counter((r["doc_id"], bytes(r["bytes"]).decode()) for r in bpe.decoded(ids).collect()) == Counter((r["doc_id"], r["text"] or "") for r in documents.collect())
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 10**9])], "doc_id long, ids array<int>")
    assert all(bytes(r["bytes"]) == b"" for r in bpe.decoded(odd).collect())


def test_units_without_an_end(coder):
    assert np.concatenate([ids for ids, _ in coder.many(["a b\nc", "", None])]).size == 4
