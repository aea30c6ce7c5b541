"""Components of edges against a plain union of sets, with chunks much smaller than the groups."""

import random

from treequarry.llm import components


def plain(edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_spanning_edges():
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(70, 70), (71, 72), (71, 72)]
    kept = components.spanning_edges(edges)
    proper = plain([e for e in edges if e[0] != e[1]])
    assert plain(kept) == proper and len(kept) == len(proper) - len(set(proper.values()))


def test_components_and_thinning(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(900)] + [(1000 + i, 1001 + i) for i in range(40)] + [(-7, -9), (-9, -7)]
    edges = [e for e in edges if e[0] != e[1]]
    table = spark.createDataFrame(edges, "a long, b long")
    thin = components.thinned(table, len(edges), chunk=100)
    kept = [tuple(r) for r in thin.collect()]
    assert plain(kept) == plain(edges) and len(kept) < len(edges) and set(kept) <= set(edges)
    assert {r["node"]: r["root"] for r in components.connected_components(table).collect()} == plain(edges)
    assert components.connected_components(table.limit(0)).count() == 0


def test_edges_of_one_chunk_take_no_rounds(spark, monkeypatch):
    """A long chain in any order, and dense groups: two checkpoints where they fit a chunk, rounds with the same result where not."""
    rng, written = random.Random(8), []
    edges = [(i, i + 1) for i in range(300)] + [tuple(rng.sample(range(1000, 1040), 2)) for _ in range(300)]
    rng.shuffle(edges)
    table = spark.createDataFrame(edges, "a long, b long")
    kept = components.checkpointed
    monkeypatch.setattr(components, "checkpointed", lambda df: written.append(1) or kept(df))
    roots = lambda: sorted((r["node"], r["root"]) for r in components.connected_components(table).collect())
    assert roots() == sorted(plain(edges).items()) and len(written) == 2
    for chunk in (50, 500):
        monkeypatch.setattr(components, "CHUNK", chunk)
        assert roots() == sorted(plain(edges).items())
