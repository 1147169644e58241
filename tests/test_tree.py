from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestack.operators import tree
from tests.catalogue import T, file, folder, make


def brute(folders, files):
    present = {f["id"]: f["parent_id"] for f in folders if not f.get("missing")}
    files = [f for f in {f["id"]: f for f in files}.values() if not f.get("missing")]
    size = lambda f: max(f["size_bytes"] or 0, 0)

    def above(i):
        seen = []
        while i in present and i not in seen:
            seen.append(i)
            i = present[i]
        return seen

    out = {i: [0, 0, 0, 0, 0] for i in present}
    for i, parent in present.items():
        if parent in present:
            out[parent][4] += 1
    for i, parent in present.items():
        for a in above(i):
            out[a][2] += out[i][4]
    links = defaultdict(list)
    for f in files:
        if f["folder_id"] in present:
            out[f["folder_id"]][3] += 1
            for a in above(f["folder_id"]):
                out[a][0] += size(f)
                out[a][1] += 1
        if f["folder_id"] is not None and f.get("identity_device") is not None and f.get("identity_inode") is not None:
            links[f["volume_id"], f["identity_device"], f["identity_inode"]].append(f)
    for group in links.values():
        if len(group) > 1:
            n = defaultdict(int)
            for f in group:
                for a in above(f["folder_id"]):
                    n[a] += 1
            for a, k in n.items():
                out[a][0] -= (k - 1) * max(map(size, group)) if k > 1 else 0
    return {i: tuple(v) for i, v in out.items()}


def rolled(spark, folders, files):
    got = tree.folder_statistics(make(spark, "folders", folders), make(spark, "files", files)).collect()
    return {r.folder_id: (r.recursive_size_bytes, r.recursive_file_count, r.recursive_subfolder_count, r.direct_file_count, r.direct_subfolder_count) for r in got}


@pytest.mark.parametrize("seed", range(4))
def test_random_trees_against_brute_force(spark, seed):
    rng = random.Random(seed)
    folders = [folder(1, None, "")] + [folder(i, rng.choice([i - 1, rng.randrange(1, i), 999]), f"p{i}", missing=int(rng.random() < 0.1)) for i in range(2, 40)]
    files = []
    for i in range(150):
        inode = rng.choice([None, rng.randrange(30)])
        files.append(file(i, rng.choice([None, 500, rng.randrange(1, 40)]), f"f{i}", rng.choice([-1, 0, rng.randrange(99)]) if inode is None else inode, volume=rng.choice([1, 2]), missing=int(rng.random() < 0.1), identity_device=1, identity_inode=inode))
    assert rolled(spark, folders, files + files[:20]) == brute(folders, files)


def test_the_small_tree(spark):
    folders = [folder(1, None, ""), folder(2, 1, "Docs"), folder(3, 1, "Photos")]
    files = [file(1, 2, "Docs/report.txt", 5), file(2, 2, "Docs/budget.csv", 5), file(3, 3, "Photos/image.JPG", 4)]
    assert rolled(spark, folders, files) == {1: (14, 3, 2, 0, 2), 2: (10, 2, 0, 2, 0), 3: (4, 1, 0, 1, 0)}


def test_hard_links_count_once_in_sizes(spark):
    linked = [file(i, 1, n, 1024, identity_device=3, identity_inode=2**63 + 7 - 2**64) for i, n in ((1, "a"), (2, "b"))]
    assert rolled(spark, [folder(1, None, "")], linked) == {1: (1024, 2, 0, 2, 0)}


def test_cycles_end(spark):
    folders = [folder(1, 2, "a"), folder(2, 1, "b"), folder(3, 1, "c"), folder(4, 4, "self")]
    got = {(r.descendant, r.ancestor) for r in tree.ancestor_closure(make(spark, "folders", folders)).collect()}
    assert got == {(1, 1), (1, 2), (2, 2), (2, 1), (3, 3), (3, 1), (3, 2), (4, 4)}


@pytest.mark.parametrize("seed", range(3))
def test_closures_of_any_links(spark, seed):
    rng = random.Random(seed)
    parent = {i: rng.choice([None, *range(1, 40), 99]) if rng.random() < 0.3 else rng.randrange(1, 40) for i in range(1, 40)}
    gone = set(rng.sample(range(1, 40), 4))
    want = set()
    for i in parent.keys() - gone:
        at, steps, met = i, 0, set()
        while at in parent and at not in gone and at not in met:
            want.add((i, at, steps))
            met.add(at)
            at, steps = parent[at], steps + 1
    folders = [folder(i, p, f"f{i}", missing=int(i in gone)) for i, p in parent.items()]
    got = [tuple(r) for r in tree.ancestor_closure(make(spark, "folders", folders)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_deep_chain(spark):
    folders = [folder(i, i - 1 if i > 1 else None, f"d{i}") for i in range(1, 26)]
    assert tree.ancestor_closure(make(spark, "folders", folders)).count() == 25 * 26 // 2


def test_empty_and_rebuilt_table(spark):
    assert rolled(spark, [], []) == {}
    folders = make(spark, "folders", [folder(1, None, "", recursive_size_bytes=99), folder(2, 1, "x", missing=1, recursive_size_bytes=98)])
    got = {r.id: r for r in tree.with_statistics(folders, make(spark, "files", [file(1, 1, "a", 123)]), T).collect()}
    assert (got[1].recursive_size_bytes, got[1].recursive_file_count, got[1].stats_updated_at) == (123, 1, T)
    assert got[2].recursive_size_bytes is None and got[2].stats_updated_at is None


def test_extra_columns(spark):
    folders = make(spark, "folders", [folder(1, None, "")]).withColumns({"ancestor": F.lit(1), "n": F.lit(2), "folder_id": F.lit(3), "child": F.lit(3)})
    assert tree.folder_statistics(folders, make(spark, "files", [file(1, 1, "a", 3)]).withColumn("links", F.lit(1))).count() == 1
