"""Alignments against a plain version that puts whole texts through the libraries and lists every link."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from treequarry.llm import alignment
from treequarry.llm.tokens import BYTE_SIGNS

SIGNS = {s: b for b, s in BYTE_SIGNS.items()}


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(public_tokenizers.path(alignment.SIDE_A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.SIDE_B))

    def groups(text):
        if not text:
            return []
        want = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ends = []
        for ids, token in ((ids_a, lambda i: bytes(SIGNS[s] for s in a.id_to_token(i))), (ids_b, lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
            joined, own = b"", []
            for i in ids:
                joined += token(i)
                own.append(len(joined))
            if joined != want:
                return []
            ends.append(own)
        shared, found = sorted(set(ends[0]) & set(ends[1])), []
        begin = 0
        for end in shared:
            found.append(([i for i, e in zip(ids_a, ends[0], strict=True) if begin < e <= end], [i for i, e in zip(ids_b, ends[1], strict=True) if begin < e <= end]))
            begin = end
        return found

    return groups


def whole(rows, groups):
    """Every link of every row, and the counts over all rows."""
    own = [(doc_id, groups(text)) for doc_id, text in rows]
    counts = Counter(pair for _, gs in own for pair in {(x, y) for a, b in gs for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = Counter()
    for doc_id, gs in own:
        links = [(x, y) for a, b in gs for x in a for y in b]
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        out[(doc_id, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if gs else "")] += 1
    return out


def test_operator(spark, plain, documents, texts, nothing):
    # the plain version lists every link, so the longest texts are left to the test of long texts
    short = documents.filter("coalesce(length(text), 0) < 15000")
    rows = [(r["doc_id"], r["text"]) for r in short.select("doc_id", "text").collect()]
    want = whole(rows, plain)
    for broadcast_pairs in (alignment.BROADCAST_PAIRS, 40, 0):
        out = alignment.token_alignment(short, broadcast_pairs=broadcast_pairs)
        assert Counter(map(tuple, out.collect())) == want
    assert [t for c, t in out.dtypes if c not in ("doc_id", "groups_sha256")] == ["bigint"] * 6
    assert alignment.token_alignment(nothing).count() == 0


def test_random_texts(plain):
    rng = random.Random(9)
    alphabet = ["a", "B", "the", "ing", "é", "1", "½", "'s", "!", "#", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\x1c", "日", "🙂", "ﬁ", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "▁", "ͅ", "Å"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)] + [None, ""]
    aligner = alignment.Aligner(alignment.SIDE_A, alignment.SIDE_B, limit=100)
    assert aligner.cuts
    for i in range(0, len(texts), 300):
        for text, got in zip(texts[i : i + 300], aligner.many(texts[i : i + 300]), strict=True):
            gs = plain(text)
            assert (got.groups if got else "") == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs), repr(text)
            if gs:
                links = Counter(x << 32 | y for a, b in gs for x in a for y in b)
                assert got.numbers == (sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), sum(links.values()))
                assert dict(zip(got.pairs.tolist(), got.times.tolist(), strict=True)) == links


def test_long_texts(spark, plain):
    """A group of many tokens on either side: links are counted, not listed."""
    rng = random.Random(3)
    prose = " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(20_000))
    aligner = alignment.Aligner(alignment.SIDE_A, alignment.SIDE_B)
    one, other = aligner.many(["x" * 20_000, prose])
    assert one.numbers[3] >= one.numbers[2] and sum(one.times.tolist()) == one.numbers[3]
    aligner.cuts = False
    (whole_text,) = aligner.many([prose])
    assert (whole_text.groups, whole_text.numbers) == (other.groups, other.numbers)


def test_frequent_from(spark):
    counts = spark.createDataFrame([(n,) for n in [1] * 5 + [2, 3, 4, 8, 9, 100]], "n_docs long")
    assert [alignment.frequent_from(counts, k) for k in (0, 1, 2, 3, 4, 100)] == [128, 16, 16, 8, 4, 1]
