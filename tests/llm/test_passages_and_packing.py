"""Operators 5 and 6 on small fixtures."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from treequarry.llm import packing, substrings


def plain_removed(pairs, min_words=16):
    """Documents in rank order against the set of units seen so far."""
    seen, out = set(), {}
    for doc in sorted(set(pairs), key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        units, marked = substrings.unit_words(doc[1]), set()
        for n, unit in enumerate(units):
            if tuple(unit) in seen:
                marked.add(n)
            seen.add(tuple(unit))
        out[doc] = substrings.removed_spans(doc[1], marked, min_words)
    return out


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(60)
    clean = [prose(120) + "\nA short line that all share." for _ in range(12)]
    within = [prose(40) + " " + shared.upper() + " " + prose(40) for _ in range(6)]
    whole = [prose(30) + "\n" + shared.replace(" ", "  ", 2) + "\n" + prose(30) for _ in range(6)]
    return shared, clean, within + whole


def test_passages(spark, passages):
    shared, clean, dirty = passages
    rows = [(i, t) for i, t in enumerate(clean + dirty)] + [(90, None), (91, ""), (92, dirty[0]), (92, dirty[0]), (None, dirty[1])]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    out = substrings.passages(documents).collect()
    assert len(out) == len(rows)
    want = plain_removed([r for r in rows if r[1] is not None])
    by_id = defaultdict(list)
    for r in out:
        by_id[r["doc_id"]].append(r)
    for (doc_id, text), spans in want.items():
        for r in by_id[doc_id]:
            assert r["removed_spans"] == ",".join(f"{a}-{b}" for a, b in spans)
            assert r["text"] == substrings.without(text, spans) and r["n_removed"] == len(spans)
            assert r["removed_chars"] == sum(b - a for a, b in spans)
    assert all(by_id[i][0]["text"] == t for i, t in enumerate(clean))  # clean documents stay as they are
    words = shared.split()
    left = [i for i in range(len(clean), len(clean) + len(dirty)) if " ".join(words[25:35]) in " ".join((by_id[i][0]["text"] or "").lower().split())]
    assert left == [len(clean)]  # the earliest alone keeps the passage
    assert by_id[90][0]["text"] is None and by_id[91][0]["text"] == "" and len(by_id[92]) == 2
    assert by_id[92][0]["text"] == "" and len(by_id[None]) == 1


def test_passages_on_hard_texts(documents, nothing):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = plain_removed([r for r in rows if r[1] is not None])
    got = {(r["doc_id"], r["removed_spans"], r["text"]) for r in substrings.passages(documents).collect()}
    assert got == {(i, ",".join(f"{a}-{b}" for a, b in s), substrings.without(t, s)) for (i, t), s in want.items()} | {(i, "", None) for i, t in rows if t is None}
    assert substrings.passages(nothing).count() == 0
    kept = substrings.deduplicated(documents)
    assert kept.columns == [*documents.columns, "removed_spans"] and kept.count() == len(rows)


def check_bins(pieces, capacities):
    bins = defaultdict(list)
    for p in pieces:
        bins[p["bin_id"]].append(p)
    for inside in bins.values():
        inside.sort(key=lambda p: p["bin_offset"])
        at = 0
        for p in inside:
            assert p["bin_offset"] == at
            at += p["piece_length"]
        assert {p["bin_capacity"] for p in inside} == {min(c for c in capacities if c >= at)}
    return bins


def test_packing(spark):
    rng = random.Random(2)
    lengths = [rng.choice([3, 3, 3, 40, 700, 1000, 1024, rng.randint(1, 8192), rng.randint(1, 30_000)]) for _ in range(3000)] + [0, 8192, 8193]
    table = spark.createDataFrame([(i % 2900, n) for i, n in enumerate(lengths)], "doc_id long, n long")
    capacities = packing.CAPACITIES
    pieces = packing.pieces_of(table, "n", 8192)
    out = packing.pack(pieces.select("doc_id", "piece", "piece_start", "piece_length"), salt_rows=50).collect()
    assert sum(p["piece_length"] for p in out) == sum(lengths)
    assert len(out) == sum(-(-n // 8192) for n in lengths)
    bins = check_bins(out, capacities)
    room = sum(inside[0]["bin_capacity"] for inside in bins.values())
    assert room < 1.01 * sum(lengths) + 8192
    assert packing.pack(pieces.limit(0)).count() == 0


def test_plan_uses_everything_up():
    rng = random.Random(4)
    for _ in range(60):
        capacities = tuple(rng.sample(range(5, 60), rng.randint(1, 4)))
        histogram = {rng.randint(1, max(capacities)): rng.randint(1, 50) for _ in range(rng.randint(0, 12))}
        patterns = packing.plan(histogram, capacities)
        used = defaultdict(int)
        for p in patterns:
            assert p.used <= p.capacity in capacities and not any(p.used <= c < p.capacity for c in capacities)
            for length, n in p.counts.items():
                used[length] += n * p.bins
        assert dict(used) == histogram and len(patterns) <= 7 * len(histogram)


def test_packed_documents(documents, nothing):
    from tokenizers import Tokenizer

    from treequarry.llm.tokens import tokenizer_path

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    out = packing.packed_documents(documents, (64, 256)).collect()
    check_bins(out, (64, 256))
    want = sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in documents.collect())
    assert sum(p["piece_length"] for p in out) == want
    assert packing.packed_documents(nothing).count() == 0


def test_removed_passages_stand_earlier_and_repeats_go(spark, passages):
    """Without the module's units: what is cut stands earlier word for word, and repeated lines and passages go."""
    shared, clean, dirty = passages
    rng = random.Random(12)
    line = " ".join("".join(rng.choices("klmnop", k=5)) for _ in range(20))
    rows = list(enumerate([*clean, *dirty, line + "\n" + clean[0][:300], clean[1] + "\n" + line.upper(), line + "\n" + line]))
    out = {r["doc_id"]: r for r in substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    before = " \0"
    for i, text in rows:
        own = ""
        at = 0
        for span in out[i]["removed_spans"]:
            own += " \0 " + " ".join(text[at : span["start"]].lower().split()) + " "
            for part in text[span["start"] : span["end"]].lower().split("\n"):
                words = part.split()
                assert all(f" {' '.join(words[k : k + 5])} " in f" {before} \0 {own} " for k in range(max(1, len(words) - 4))), (i, part)
            at = span["end"]
        before += " \0 " + " ".join(text.lower().split()) + " "
    assert all(not out[i]["removed_spans"] for i in range(len(clean)))
    n = len(clean) + len(dirty)
    assert line not in out[n + 1]["text"].lower() and out[n + 2]["text"] == "" and out[n]["text"].startswith(line)
    kept = [len(set(shared.split()) & set(out[i]["text"].lower().split())) for i in range(len(clean) + 1, n)]
    assert max(kept) <= 24


def test_places_against_a_plain_search():
    rng = random.Random(5)
    histogram = {rng.randint(1, 300): rng.randint(1, 2000) for _ in range(120)}
    rows = packing.ranges(packing.plan(histogram, (100, 200, 300)))
    places = packing.Places(rows)
    pieces = [(length, rank) for length, n in histogram.items() for rank in range(n)]
    rng.shuffle(pieces)
    length, rank = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
    got = places(length, rank)
    at = defaultdict(list)
    for row in rows:
        at[row[0]].append(row)
    for i in range(0, len(pieces), 97):
        _, low, _, per_bin, first, capacity, offset = next(r for r in at[length[i]] if r[1] <= rank[i] < r[2])
        k = int(rank[i]) - low
        assert tuple(got.iloc[i]) == (first + k // per_bin, capacity, offset + k % per_bin * length[i])
    assert len(packing.Places([])(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_size_of_a_plan_is_bounded_by_the_capacity():
    rng = random.Random(8)
    for largest, most in ((64, 10**9), (64, 5), (300, 10**7)):
        patterns = packing.plan({length: rng.randint(1, most) for length in range(1, largest + 1)}, (largest // 2, largest))
        assert len(patterns) <= 3.5 * largest and all(sum(p.counts) <= largest for p in patterns)


def test_cost_near_the_best_on_small_cases():
    """Against the least cost over all ways to fill bins, tried out."""
    rng = random.Random(3)
    for _ in range(25):
        lengths, capacities = sorted(rng.randint(1, 12) for _ in range(6)), (6, 12)
        cost = sum((p.capacity + 2) * p.bins for p in packing.plan(dict(Counter(lengths)), capacities, bin_cost=2))

        def best(left):
            if not left:
                return 0
            found, rest = 10**9, left[:-1]
            for mask in range(1 << len(rest)):
                used = left[-1] + sum(x for k, x in enumerate(rest) if mask >> k & 1)
                if used <= 12:
                    found = min(found, (6 if used <= 6 else 12) + 2 + best([x for k, x in enumerate(rest) if not mask >> k & 1]))
            return found

        least = best(lengths)
        assert least <= cost <= 1.35 * least
