"""Codes of vectors against a plain version with complete distances."""

import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from treequarry.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, whole string, error string"


def plain(rows, n_parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(Fraction(float(np.float32(x))) * 4096) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    d = len(kept[0][1]) // n_parts
    cut = [[v[p * d : p * d + d] for p in range(n_parts)] for _, v, _ in kept]
    start = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in start] for p in range(n_parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda part, book: min((far(part, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(n_parts):
            own = [near(c[p], books[p])[1] for c in cut]
            for k in range(len(books[p])):
                members = [c[p] for c, o in zip(cut, own, strict=True) if o == k]
                if members:
                    books[p][k] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    found = [[near(c[p], books[p]) for p in range(n_parts)] for c in cut]
    errors = [sum(x for x, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    digest = vector_codes.books_digest(np.array(books))
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], digest) for (i, _, label), f, e in zip(kept, found, errors, strict=True))


def table(n, dimensions, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dimensions)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], rng.choice([None, 1, 2, 2, 2])) for i in rng.sample(range(10 * n), n)]
    rows += [rows[3], rows[3], (7, [0.0] * dimensions, None), (None, [0.25] * dimensions, 1)]
    bad = [[None] * dimensions, [float("nan")] + [0.0] * (dimensions - 1), [float("inf")] * dimensions, [-float("inf")] + [0.1] * (dimensions - 1), None, []]
    return rows + [(-1 - k, v, 3) for k, v in enumerate(bad)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize(("n", "dimensions"), [(300, 16), (120, 64), (9, 8)])
def test_against_complete_distances(spark, n, dimensions):
    rows = table(n, dimensions, n)
    assert Counter(map(tuple, vector_codes.vector_codes(frame(spark, rows)).collect())) == plain(rows)


def test_ties_and_equal_vectors(spark):
    rows = [(i, [float(i % 3)] * 8, 1) for i in range(40)]
    assert Counter(map(tuple, vector_codes.vector_codes(frame(spark, rows)).collect())) == plain(rows)


def test_search_against_all_distances():
    rng = np.random.default_rng(4)
    for _ in range(50):
        d, k = rng.integers(1, 9), rng.integers(1, 20)
        x, book = rng.integers(-6, 6, (70, d)), rng.integers(-6, 6, (k, d))
        all_of = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        index, best = vector_codes.nearest(x, book)
        assert (index == all_of.argmin(axis=1)).all() and (best == all_of.min(axis=1)).all()


def test_nothing_usable(spark):
    for rows in ([], [(1, None, 1), (2, [], 2), (3, [None], 3)]):
        out = vector_codes.vector_codes(frame(spark, rows))
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0


def test_lengths_and_bounds(spark):
    """Of several lengths the commonest stays; vectors whose squares do not fit are left out; odd lengths are filled up."""
    rows = [(i, [0.1 * i] * 5, 1) for i in range(20)] + [(100 + i, [0.5] * 7, 1) for i in range(5)] + [(200, [3e38] * 5, 1)]
    assert sorted(r["vec_id"] for r in vector_codes.vector_codes(frame(spark, rows)).collect()) == list(range(20))


def test_many_labels_join_by_shuffle(spark, monkeypatch):
    rows = table(60, 16, 2)
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 1)
    assert Counter(map(tuple, vector_codes.vector_codes(frame(spark, rows)).collect())) == plain(rows)
