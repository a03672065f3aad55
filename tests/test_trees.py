"""Scenarios of diffs, overlays and merges, and their properties."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from arborlake.operators import delta, history, refs, trees

TREE = "path string, type string, checksum string"


def tree(spark, *rows):
    return spark.createDataFrame(list(rows), TREE)


def changes(a, b):
    return sorted((r["kind"], r["path"]) for r in trees.diff(a, b).collect())


def test_diff_collapses_removed_and_expands_added(spark):
    a = tree(spark, ("gone", "d", "m"), ("gone/x", "f", "1"), ("same", "f", "1"))
    b = tree(spark, ("same", "f", "1"), ("new", "d", "m"), ("new/deep", "d", "m"), ("new/deep/y", "f", "2"))
    assert changes(a, b) == [("A", "new"), ("A", "new/deep"), ("A", "new/deep/y"), ("D", "gone")]


def test_diff_of_a_type_change_is_one_line(spark):
    a = tree(spark, ("four", "f", "1"), ("dir", "d", "m"), ("dir/x", "f", "2"))
    b = tree(spark, ("four", "d", "m"), ("four/five", "f", "3"), ("dir", "f", "9"))
    assert changes(a, b) == [("M", "dir"), ("M", "four")]


def test_diff_with_itself_and_with_nothing(spark):
    a = tree(spark, ("d", "d", "m"), ("d/x", "f", "1"))
    assert changes(a, a) == []
    assert changes(tree(spark).limit(0), a) == [("A", "d"), ("A", "d/x")]


def simulated(a: dict, b: dict) -> list:
    """The diff by recursion over directories, as a plain program would do it."""

    def names(t, base):
        return {p for p in t if (p.rpartition("/")[0] == base)}

    out = []

    def added(p):
        out.append(("A", p))
        for q in names(b, p):
            added(q)

    def walk(base):
        for p in names(a, base) - names(b, base):
            out.append(("D", p))
        for p in names(b, base) - names(a, base):
            added(p)
        for p in names(a, base) & names(b, base):
            if a[p] != b[p]:
                out.append(("M", p))
            if a[p][0] == b[p][0] == "d":
                walk(p)

    walk("")
    return sorted(out)


def test_diff_equals_a_recursion_on_random_trees(spark):
    rng = random.Random(3)

    def grow(base="", depth=0):
        out = {}
        for n in rng.sample("abcd", rng.randint(1, 3)):
            p = f"{base}/{n}" if base else n
            if depth < 3 and rng.random() < 0.5:
                out[p] = ("d", rng.choice("mn"))
                out |= grow(p, depth + 1)
            else:
                out[p] = (rng.choice("fl"), rng.choice("12"))
        return out

    for _ in range(6):
        a, b = grow(), grow()
        frames = [tree(spark, *[(p, t, c) for p, (t, c) in x.items()]) for x in (a, b)]
        assert changes(*frames) == simulated(a, b)


def test_whiteouts(spark):
    lower = tree(spark, ("baz", "d", "m"), ("baz/cow", "f", "1"), ("baz/deeper", "d", "m"), ("baz/deeper/x", "f", "1"), ("opq", "d", "m"), ("opq/old", "f", "1"))
    upper = tree(spark, ("baz/.wh.cow", "f", ""), ("baz/.wh.deeper", "f", ""), ("opq/.wh..wh..opq", "f", ""), ("opq/new", "f", "2"), ("anewdir", "d", "m"), ("anewdir/blah", "f", "3"))
    got = sorted(r["path"] for r in trees.apply_whiteouts(lower, upper).collect())
    assert got == ["anewdir", "anewdir/blah", "baz", "opq", "opq/new"]


def test_checkout_modes(spark):
    source = tree(spark, ("d", "d", "m"), ("x", "f", "new"), ("only", "f", "s"), ("c", "d", "m"))
    target = tree(spark, ("d", "d", "k"), ("x", "f", "old"), ("there", "f", "t"), ("c", "f", "z"))

    def of(mode):
        return {r["path"]: (r["checksum"], r["action"]) for r in trees.checkout(source, target, mode).collect()}

    assert of("union_files")["x"] == ("new", "replace") and of("add_files")["x"] == ("old", "keep")
    assert of("union_identical")["x"][1] == "conflict" and of("none")["d"][1] == "conflict"
    assert all(of(m)["c"][1] == "conflict" and of(m)["only"][1] == "add" and of(m)["there"][1] == "keep" for m in ("union_files", "add_files"))


def test_overlay_conflicts(spark):
    rows = spark.createDataFrame([(1, "a", "f", "1"), (2, "a/b", "f", "2"), (1, "c", "f", "1")], "layer int, " + TREE)
    assert [r["path"] for r in trees.overlay_conflicts(rows).collect()] == ["a"]


def test_merge_keeps_local_changes(spark):
    o = tree(spark, ("a", "f", "1"), ("b", "f", "1"), ("c", "f", "1"))
    m = tree(spark, ("a", "f", "2"), ("b", "f", "1"), ("own", "f", "9"))
    n = tree(spark, ("a", "f", "3"), ("b", "f", "4"), ("c", "f", "5"))
    got = {r["path"]: (r["checksum"], r["status"]) for r in trees.merge_config(o, m, n).collect()}
    assert got == {"a": ("2", "local"), "b": ("4", "new"), "own": ("9", "local")}


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "parent string, child string")
    seeds = spark.createDataFrame([("a",)], "checksum string")
    assert sorted(r[0] for r in history.closure(seeds, edges).collect()) == ["a", "b", "c"]


def test_history_doubling(spark):
    n = 37
    commits = spark.createDataFrame([(f"c{i}", f"c{i - 1}" if i else "missing") for i in range(n)], "checksum string, parent string")
    tips = spark.createDataFrame([(f"c{n - 1}",), ("c3",), ("none",)], "checksum string")
    got = {(r["tip"], r["checksum"]): r["distance"] for r in history.along(commits, tips).collect()}
    assert got == {(f"c{t}", f"c{t - d}"): d for t in (n - 1, 3) for d in range(t + 1)}


def test_similar_objects_takes_the_nearest_base(spark):
    schema = "checksum string, size bigint, name string"
    old = spark.createDataFrame([("o1", 69, "n"), ("o2", 70, "n"), ("o3", 130, "n"), ("o4", 100, "stem.txt"), ("o5", 10, "other")], schema)
    new = spark.createDataFrame([("x", 100, "n"), ("y", 110, "stem.gz"), ("z", 1000, "other")], schema)
    got = {r["to"]: (r["from"], r["fuzzy"]) for r in delta.similar_objects(old, new).collect()}
    assert got == {"x": ("o2", False), "y": ("o4", True)}


def test_part_packing(spark):
    rows = [("d", i, f"c{i}", s, k) for i, (s, k) in enumerate([(5, "plain"), (6, "plain"), (20, "plain"), (1, "patch"), (30, "patch"), (1, "patch"), (3, "plain")])]
    got = delta.pack_parts(spark.createDataFrame(rows, "delta string, seq bigint, checksum string, size bigint, kind string"), 10).orderBy("seq").collect()
    assert [r["part"] for r in got] == [0, 1, 2, 3, 3, 4, 4]


def test_prune_depths(spark):
    commits = spark.createDataFrame([(f"c{i}", f"c{i - 1}" if i else None, 100 - i if i == 2 else i) for i in range(5)], "checksum string, parent string, ts bigint")
    tip = spark.createDataFrame([("c4",)], "checksum string")
    assert [history.along(commits, tip.withColumn("depth", F.lit(d))).count() for d in (2, 1, 0, -1)] == [3, 2, 1, 5]
    assert sorted(r["checksum"] for r in history.along(commits, tip, young=F.col("ts") >= 3).collect()) == ["c2", "c3", "c4"]


@pytest.mark.parametrize("depth", [0, 1, 3, 7, -1])
def test_history_walks_equal_plain_loops(spark, depth):
    rng = random.Random(depth)
    parent = {i: (rng.randrange(i) if i and rng.random() < 0.95 else None) for i in range(200)}
    ts = {i: rng.randint(0, 9) for i in parent}
    commits = spark.createDataFrame([(f"c{i}", f"c{p}" if p is not None else None, ts[i]) for i, p in parent.items()] + [("x", "gone", 5)], "checksum string, parent string, ts bigint")
    tips = spark.createDataFrame([(f"c{i}", depth if i % 2 else -1) for i in range(180, 200)] + [("x", depth)], "checksum string, depth int")
    for least in (None, 2):
        want = {("x", "x", 0)}
        for i in range(180, 200):
            limit, at, n = (depth if i % 2 else -1), i, 0
            while at is not None and (n == 0 or least is None or ts[at] >= least) and (limit < 0 or n <= limit):
                want.add((f"c{i}", f"c{at}", n))
                at, n = parent[at], n + 1
        got = history.along(commits, tips, None if least is None else F.col("ts") >= least).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_holders_are_found_from_below(spark):
    edges = spark.createDataFrame([("c1", "t1"), ("t1", "f1"), ("t1", "f2"), ("c2", "t2"), ("t2", "f2"), ("c3", "t3"), ("t3", "f3"), ("f3", "t3")], "parent string, child string")
    commits, bad = (spark.createDataFrame([(x,) for x in own], "checksum string") for own in (["c1", "c2", "c3"], ["f2", "nowhere"]))
    assert sorted(r["checksum"] for r in history.holders(bad, edges, commits).collect()) == ["c1", "c2"]
    assert sorted(r["checksum"] for r in history.closure(commits, edges).collect()) == ["c1", "c2", "c3", "f1", "f2", "f3", "t1", "t2", "t3"]


def test_successors_are_followed_to_the_end(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("z", "x"), ("n", "gone"), *[(f"l{i}", f"l{i + 1}" if i < 40 else None) for i in range(41)]]
    got = {r["ref"]: r["target"] for r in refs.follow(spark.createDataFrame(pairs, "ref string, next string")).collect()}
    assert got == {"a": "c", "b": "c", "c": "c", "x": "x", "y": "y", "z": "z", "n": "n"} | {f"l{i}": "l40" for i in range(41)}


def test_remotes_match_by_collection_and_keyring(spark):
    wanted = spark.createDataFrame([("org.a", "main"), ("org.b", "main"), ("org.c", "main"), (None, "main")], "collection_id string, ref_name string")
    remotes = spark.createDataFrame([("r2", "org.a", True), ("r1", "org.a", False), ("r3", "org.a", True), ("r4", "org.b", False), ("r5", None, True)], "remote string, collection_id string, keyring boolean")
    assert {(r["collection_id"], r["remote"]) for r in refs.match_collections(wanted, remotes).collect()} == {("org.a", "r2"), ("org.b", None), ("org.c", None), (None, None)}
