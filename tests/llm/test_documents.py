"""Operators 2, 3, 4, 7 and 8 against brute force on a small fixture."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from treequarry.llm import decontaminate, quality, simhash, token_counts, token_files, tokens


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def pairs(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]


def test_token_files(documents, nothing, library):
    ordered = sorted(pairs(documents), key=lambda x: (x[0] is not None, x[0], x[1] is not None, x[1] or ""))
    want, start = [], 0
    for doc_id, text in ordered:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows_of(token_files.token_files(documents), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)
    assert token_files.token_files(nothing).count() == 0


def test_index_is_minimal_perfect_and_finds_strangers_out(spark, documents):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 2**63, (2, 5000)).astype(np.uint64)
    d, slot = token_files.displacements(x, y)
    assert sorted(slot) == list(range(5000)) and (token_files.slots_of(x, y, d, 5000) == slot).all()
    from treequarry.llm.common import shared_folder

    files = token_files.write_token_files(documents, shared_folder(spark, "t"), bucket_keys=16, shard_bytes=5000)
    known = token_files.keys_of(documents)
    assert token_files.look_up(known, files).count() == documents.count() == token_files.read_back(known, files).count()
    strangers = spark.createDataFrame([(i, 0) for i in range(10**6, 10**6 + 300)], "doc_id long, occurrence long")
    assert token_files.look_up(strangers, files).count() == 0


def test_token_counts(documents, nothing, library):
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in pairs(documents)]
    assert rows_of(token_counts.token_counts(documents), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)
    assert rows_of(token_counts.token_counts(documents, table_rows=3), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)
    assert token_counts.token_counts(nothing).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fingerprints):
    """(doc_id, fingerprint) to component ids by trying all pairs."""
    label = {f: f for _, f in fingerprints}

    def top(f):
        while label[f] != f:
            f = label[f]
        return f

    distinct = list(label)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bin(a ^ b).count("1") <= 4:
                label[top(a)] = top(b)
    least = {}
    for i, f in fingerprints:
        if i is not None:
            least[top(f)] = min(least.get(top(f), i), i)
    return sorted(((i, f"{f:016x}", least.get(top(f))) for i, f in fingerprints), key=str)


def test_simhash(documents, nothing):
    want = plain_components([(i, plain_fingerprint(t)) for i, t in pairs(documents)])
    assert rows_of(simhash.near_duplicates(documents), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("block", [4, 1024])
def test_fingerprint_links(spark, block):
    """Crowded lists: fingerprints scattered about few centres, cut into blocks of any size."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 6).tolist()
    prints = {c ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 7), replace=False)) for c in centres for _ in range(60)} | set(rng.integers(0, 2**63, 200).tolist())
    from treequarry.llm.components import connected_components

    nodes = spark.createDataFrame([(f,) for f in prints], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.fingerprint_edges(nodes, 4, block)).collect()}
    want = plain_components([(f, f) for f in prints])
    assert sorted(((f, f"{f:016x}", roots.get(f, f)) for f in prints), key=str) == want


def test_decontamination(spark, documents, nothing):
    own = [(r["doc_id"], r["text"]) for r in documents.collect() if r["text"]]
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    cut = lambda t: re.findall(word, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    long_text = max((t for _, t in own if " " in t), key=len)
    items = [(1, " ".join(long_text.split()[50:75])), (2, "ONE"), (10, "again-and, again"), (3, None), (4, ""), (5, "never to be found in anything here at all you see"), (6, "same line here same line here same line here same line"), (6, "same line")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def plain(text):
        words, hit, found = cut(text), set(), set()
        for item, t in items:
            w = cut(t)
            for k in range(max(1, len(w) - 9)) if w else ():
                p = w[k : k + 10]
                for i in range(len(words) - len(p) + 1):
                    if words[i : i + len(p)] == p:
                        hit |= set(range(i, i + len(p)))
                        found.add(str(item))
        return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)

    want = sorted(((i, *plain(t)) for i, t in pairs(documents)), key=str)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(decontaminate.contamination(documents, benchmark), *columns) == want
    assert rows_of(decontaminate.contamination(documents, benchmark, block_windows=3), *columns) == want
    assert sum(r[5] for r in want) >= 4
    assert decontaminate.contamination(nothing, benchmark).count() == 0
    clean = decontaminate.contamination(documents, benchmark.limit(0))
    assert clean.filter("contaminated").count() == 0 and clean.count() == documents.count()


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    marked = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    failed = len(words) < 10 or 100 * len(marked) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), failed


def test_quality(documents, nothing):
    want = sorted(((i, *plain_quality(t)) for i, t in pairs(documents)), key=str)
    out = quality.quality(documents)
    assert rows_of(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert out.filter("base_failed and kept").count() == 0 and out.filter("kept").count() > 20
    assert quality.quality(nothing).count() == 0
    assert set(quality.cascade_order(documents)) == {r.name for r in quality.RULES}
    kept = quality.keep_good(documents)
    assert kept.columns == documents.columns and kept.count() == out.filter("kept").count()


@pytest.mark.parametrize("text, kept", [("good words " + " ".join(f"w{i}x" for i in range(40)), True), (" ".join(f"w{i}###" for i in range(40)), False), (" ".join(f"{i}" for i in range(40)), False), (" ".join(f"W{chr(65 + i % 26) * (i % 7 + 1)}" for i in range(40)), False)])
def test_quality_rules(spark, text, kept):
    assert quality.quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["kept"] is kept


def test_null_and_large_ids_are_looked_up(spark, tmp_path):
    """A null among the ids of a bucket must not cost large ids their last digits."""
    big = 2**60
    rows = [(big + i, f"text {i}") for i in range(6)] + [(None, "none"), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["start"]) for r in token_files.token_files(table).collect()}
    assert sorted(i for i, _ in got if i is not None) == [big + i for i in range(6)] and len([1 for i, _ in got if i is None]) == 2


def test_contaminated_documents_go_and_columns_stay(spark):
    item = " ".join(f"w{i}" for i in range(14))
    rows = [(1, f"x {item} y", "mine"), (2, "clean words only", "kept"), (3, None, "null")]
    table = spark.createDataFrame(rows, "doc_id long, text string, found string")
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    for block in (200_000, 2):
        out = decontaminate.uncontaminated(table, bench, block_windows=block)
        assert out.columns == table.columns and sorted(map(tuple, out.collect())) == rows[1:]
    assert decontaminate.uncontaminated(table, bench.limit(0)).count() == 3 and decontaminate.uncontaminated(table.limit(0), bench).count() == 0
