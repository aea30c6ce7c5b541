"""States of workspaces from changes, against snapshots that are kept whole."""

import random

from treequarry.operators import timeline

SNAPSHOT = "workspace long, path string, hash string, mode string"
CHANGES = "workspace long, path string, before string, before_mode string, after string, after_mode string, id long"


def test_states_undo_and_redo_against_whole_snapshots(spark):
    rng = random.Random(5)
    names = {"path": "path", "hash": "", "mode": "_mode"}
    start = {1: {"a": ("h0", "644"), "z": ("hz", "600")}, 2: {}}
    states, rows = {w: [dict(s)] for w, s in start.items()}, []
    for n in range(1, 13):
        for w in start:
            old = states[w][-1]
            new = dict(old)
            for path in rng.sample("abc", 2):
                if rng.random() < 0.3:
                    new.pop(path, None)
                else:
                    new[path] = (f"h{rng.randrange(6)}", rng.choice(["644", "755"]))
            states[w].append(new)
            rows += [(w, p, *old.get(p, (None, None)), *new.get(p, (None, None)), n) for p in sorted(old | new) if old.get(p) != new.get(p)]
    changes = spark.createDataFrame(rows, CHANGES)
    snapshot = lambda k: spark.createDataFrame([(w, p, *v) for w in start for p, v in states[w][k].items()], SNAPSHOT)
    got = timeline.differences(snapshot(4), snapshot(5), 5, names)
    columns = [field.split()[0] for field in CHANGES.split(", ")]
    assert {tuple(r) for r in got.select(columns).collect()} == {r for r in rows if r[-1] == 5}
    base = snapshot(12)
    for k in (0, 1, 6, 12):
        cursors = spark.createDataFrame([(1, k), (2, k)], "workspace long, cursor long")
        found = {(r["workspace"], r["path"], r["hash"], r["mode"]) for r in timeline.as_of(changes, cursors, base).collect()}
        assert found == {(w, p, *v) for w in start for p, v in states[w][k].items()}

    objects = spark.createDataFrame([(f"h{i}", f"text {i}") for i in range(6)] + [("hz", "z")], "hash string, content string")
    actions = spark.createDataFrame([(w, n, not (w == 2 and n == 7)) for w in start for n in range(1, 13)], "workspace long, id long, undoable boolean")
    files = lambda k: spark.createDataFrame([(w, p, objects_of[v[0]]) for w in start for p, v in states[w][k].items()], "workspace long, path string, content string")
    objects_of = {r["hash"]: r["content"] for r in objects.collect()}
    at = spark.createDataFrame([(1, 7), (2, 7)], "workspace long, cursor long")
    as_set = lambda df: {tuple(r) for r in df.collect()}
    writes, outcome = timeline.stepped(changes, actions, at, objects)
    assert as_set(outcome) == {(1, 7, None, 6), (2, 7, "not_undoable", 7)}
    assert as_set(timeline.written(files(7).filter("workspace = 1"), writes)) == as_set(files(6).filter("workspace = 1"))
    writes, outcome = timeline.stepped(changes, actions, at, objects, force=True)
    assert as_set(timeline.written(files(7), writes)) == as_set(files(6))
    writes, outcome = timeline.stepped(changes, actions, at, objects, redo=True)
    assert as_set(timeline.written(files(7), writes)) == as_set(files(8)) and as_set(outcome) == {(1, 8, None, 8), (2, 8, None, 8)}
    ends = spark.createDataFrame([(1, 12), (2, 1)], "workspace long, cursor long")
    assert as_set(timeline.targets(actions, ends, redo=True).select("workspace", "error")) == {(1, "nothing"), (2, None)}
    assert as_set(timeline.targets(actions, ends).select("workspace", "error")) == {(1, None), (2, "nothing")}
    # a workspace without one of its objects stays as it is
    writes, outcome = timeline.stepped(changes, actions, at, objects.limit(0), redo=True)
    assert writes.filter("content is not null").count() == 0
    assert {r["error"] for r in outcome.collect()} == {"missing_object"}


def test_changes_of_settings_and_sizes(spark):
    rows = [(1, 1, "config", None, "x"), (1, 1, "mode", None, "whitelist"), (1, 2, "mode", "whitelist", "blacklist"), (1, 2, "objects.a", None, "h"), (1, 3, "objects.a", "h", None), (1, 3, "objects.b", "h", "i"), (1, 4, "config", "x", None)]
    got = timeline.setting_changes(spark.createDataFrame(rows, "workspace long, id long, key string, before string, after string"))
    assert sorted((r["id"], r["line"]) for r in got.collect()) == [(1, "+ config created"), (2, '+ objects["a"]: h'), (2, 'mode: "whitelist" -> "blacklist"'), (3, '- objects["a"]'), (4, "- config removed")]
    changes = spark.createDataFrame([(1, "p", None, None, "h", "644", 1), (1, "p", "h", "644", None, None, 2)], CHANGES)
    sizes = spark.createDataFrame([("h", 5)], "hash string, size long")
    assert sorted((r["id"], r["before"], r["after"]) for r in timeline.file_changes(changes, sizes).collect()) == [(1, "0 bytes", "5 bytes"), (2, "5 bytes", "0 bytes")]
