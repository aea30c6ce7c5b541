"""The pipeline against plain versions of its stages, one after another."""

import random
import re
from collections import defaultdict

import pytest

from tests.llm import test_near_copies as near
from tests.llm.test_documents import plain_quality
from tests.llm.test_passages_and_packing import check_bins, plain_removed
from treequarry.llm import near_copies, substrings

pipeline = pytest.importorskip("corpus_pipeline")


def plain_heads(pairs):
    """The smallest doc_id of each component of the documents that are similar enough, trying all pairs."""
    pairs = sorted(pairs)
    heads = near.plain_heads([t or "" for _, t in pairs])
    return {pairs[k][0] for k in heads}


def test_near_copies(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(900)]
    rows, n = [], 0
    for size in [1] * 30 + [2] * 10 + [40]:
        base = rng.choices(words, k=rng.randint(90, 300))
        for copy in range(size):
            text = list(base)
            for at in rng.sample(range(len(text)), copy and len(text) // 60):
                text[at] = rng.choice(words) + "x"
            rows.append((n, " ".join(text), "clash"))
            n += 1
    rows += [(n, None, ""), (n + 1, "", ""), (5, rows[5][1], "again"), (None, rows[3][1] + " end", "")]
    out = near_copies.representatives(spark.createDataFrame(rows, "doc_id long, text string, f0 string"))
    got = sorted(r["doc_id"] for r in out.collect())
    assert out.columns == ["doc_id", "text", "f0"] and got == sorted(plain_heads([(i, t) for i, t, _ in rows if i is not None])) and len(got) == 30 + 10 + 1 + 1
    assert near_copies.representatives(out.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    item, shared, long = prose(30), prose(60), prose(400)
    texts = [prose(rng.randint(60, 200)) + ("\n" + prose(50)) * (i % 3) for i in range(40)]
    texts += [texts[0], texts[1], long, long + " end", prose(30) + " " + item + " " + prose(30), "too short", "# $ " * 30 + prose(20), None]
    texts += [prose(60) + " " + shared + " " + prose(60) for _ in range(4)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    good = [(i, t) for i, t, *_ in rows if not plain_quality(t)[5] and plain_quality(t)[2] <= 0.2 * plain_quality(t)[0]]
    heads = plain_heads(good)
    single = [(i, t) for i, t in good if i in heads]
    cut = {i: substrings.without(t, s) for (i, t), s in plain_removed(single).items()}
    flat = lambda t: " ".join(re.findall(r"[a-z]+", t))
    windows = [" ".join(item.split()[k : k + 10]) for k in range(21)]
    clean = {i: t for i, t in cut.items() if not any(f" {w} " in f" {flat(t)} " for w in windows)}
    assert len(good) > len(single) > len(clean) and sum(map(len, cut.values())) < sum(len(t) for _, t in single)

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), want in zip(pipeline.STAGES[:-1], ([i for i, _ in good], sorted(heads), sorted(heads), sorted(clean)), strict=True):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert sorted(r["doc_id"] for r in docs.collect()) == want, name
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == clean
    out = pipeline.run(spark, str(tmp_path)).collect()
    check_bins(out, (1024, 2048, 4096, 8192))
    length = defaultdict(int)
    for p in out:
        length[p["doc_id"]] += p["piece_length"]
    from tokenizers import Tokenizer

    from treequarry.llm.tokens import tokenizer_path

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert length == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
