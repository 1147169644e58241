from __future__ import annotations

from datetime import date, datetime

import pytest

from lodestack.operators import browse, changes, stats, volumes
from lodestack.streaming.batches import LatestSearch, result_batches
from tests.catalogue import T, file, folder, make


@pytest.fixture(scope="module")
def tree(spark):
    folders = [folder(1, None, ""), folder(2, 1, "beta"), folder(3, 1, "Alpha", recursive_size_bytes=9), folder(4, 3, "Alpha/x"), folder(5, 1, "gone", missing=1), folder(9, None, "", 2)]
    files = [file(1, 1, "b.txt", 5), file(2, 1, "A.mp4", 7), file(3, 3, "Alpha/c", None), file(4, 1, "n", 0), file(1, 1, "b.txt", 5)]
    return make(spark, "folders", folders), make(spark, "files", files)


def test_children_and_files(tree):
    folders, files = tree
    assert [r.id for r in browse.child_folders(folders, 1, 1).collect()] == [3, 2, 5]
    assert [r.id for r in browse.child_folders(folders, 1, None).collect()] == [1]
    assert [r.id for r in browse.folder_files(files, 1, 1).collect()] == [2, 1, 4]
    assert browse.root_folder(folders, 2).first()["id"] == 9 and browse.folder_by_path(folders, 1, "Alpha/x").first()["id"] == 4
    assert [(r.id, r.level) for r in browse.navigate(folders, 1, "/Alpha/x/none").collect()] == [(1, 0), (3, 1), (4, 2)]


@pytest.mark.parametrize("column", ["name", "size_bytes", "modified_at", "type_label"])
@pytest.mark.parametrize("descending", [False, True])
def test_listing_keeps_its_groups(tree, column, descending):
    rows = browse.directory_listing(*tree, 3, column, descending).collect()
    assert [(r.name, r.item_type) for r in rows] == [("..", "folder"), ("x", "folder"), ("c", "file")]
    root = browse.directory_listing(*tree, 1, column, descending).collect()
    assert [r.position for r in root] == [1, 1, 1, 2, 2, 2]
    sizes = [r.size_bytes for r in browse.directory_listing(*tree, 1, "size_bytes", descending).collect() if r.item_type == "file"]
    assert sizes == sorted(sizes, reverse=descending)


def test_properties(spark, tree):
    folders, files = tree
    vols = make(spark, "volumes", [{"id": 1, "name": "One"}])
    got = browse.item_properties("file", files, folders, vols, 3).collect()
    assert [(r.parent_folder_name, r.type, r.volume_name) for r in got] == [("Alpha", "File", "One")]
    assert browse.item_properties("folder", files, folders, vols, 4).first()["parent_relative_path"] == "Alpha"
    assert browse.item_properties("disk", files, folders, vols, 4) is None


def test_catalogue_info(spark):
    vols = make(spark, "volumes", [{"id": 1, "capacity_bytes": 1000, "used_bytes": 600, "free_bytes": 400, "last_scan_at": T}, {"id": 2, "capacity_bytes": 2000, "used_bytes": 800, "free_bytes": 1200, "last_scan_at": datetime(2024, 2, 2)}])
    folders = make(spark, "folders", [folder(i, None, str(i), missing=int(i == 4)) for i in range(1, 5)])
    files = make(spark, "files", [file(1, 1, "a", 100), file(2, 1, "b", 150), file(3, 1, "c", 25, missing=1)])
    scans = make(spark, "scan_history", [{"id": 1, "volume_id": 1}])
    r = stats.catalogue_info(vols, folders, files, scans).first()
    assert (r.volume_count, r.capacity_bytes, r.used_bytes, r.free_bytes, r.indexed_size_bytes, r.file_count, r.folder_count) == (2, 3000, 1400, 1600, 250, 2, 3)
    assert (r.missing_file_count, r.missing_folder_count, r.scan_count, r.latest_scan_at) == (1, 1, 1, datetime(2024, 2, 2))
    none = stats.catalogue_info(*[make(spark, n, []) for n in ("volumes", "folders", "files", "scan_history")]).first()
    assert none.asDict() == {k: (None if k == "latest_scan_at" else 0) for k in none.asDict()}


def test_dates_counts_and_types(spark, tree):
    folders, files = tree
    dated = make(spark, "files", [file(1, 1, "a", modified_at=datetime(2020, 5, 5, 23)), file(2, 1, "b", modified_at=datetime(2021, 1, 1), missing=1), file(3, 1, "c")])
    r = stats.content_dates(dated, make(spark, "folders", [folder(1, None, "", modified_at=datetime(2020, 6, 1))])).first()
    assert (r.earliest, r.latest) == (date(2020, 5, 5), date(2020, 6, 1))
    vols = make(spark, "volumes", [{"id": 1}, {"id": 2}, {"id": 3}])
    assert {r.id: (r.indexed_file_count, r.indexed_folder_count) for r in stats.volume_counts(vols, folders, files).collect()} == {1: (4, 4), 2: (0, 1), 3: (0, 0)}
    assert {(r.type_label, r.file_count) for r in stats.type_counts(files).collect()} == {("Text", 1), ("Video", 1), ("File", 2)}


def test_history_is_pruned_by_volume(spark):
    scans = make(spark, "scan_history", [{"id": i, "volume_id": 1 + i % 2} for i in range(1, 212)])
    kept = stats.prune_history(scans)
    assert {r.volume_id: r["count"] for r in kept.groupBy("volume_id").count().collect()} == {1: 100, 2: 100} and kept.agg({"id": "min"}).first()[0] == 12
    assert stats.prune_history(scans, -1).count() == 0
    errors = make(spark, "scan_errors", [{"id": 1, "scan_id": 3}, {"id": 2, "scan_id": 211}, {"id": 3, "scan_id": None}])
    assert {r.id for r in stats.prune_errors(errors, scans, kept).collect()} == {2, 3}
    assert [r.id for r in stats.recent_history(scans, 1, 2).collect()] == [210, 208]


def test_scan_log(spark):
    scans = make(spark, "scan_history", [
        {"id": 1, "volume_id": 1, "started_at": T, "status": "completed", "files_seen": 3, "folders_seen": 2, "files_added": 1, "files_removed": 0, "files_changed": 2, "bytes_before": 1500, "bytes_after": 500},
        {"id": 2, "volume_id": 1, "started_at": T, "status": "failed", "message": "gone"},
    ])
    errors = make(spark, "scan_errors", [{"id": 5, "volume_id": 1, "path": "a/b", "message": "denied", "created_at": T}] * 2)
    got = [(r.section, r.id, r.line_number, r.line) for r in stats.scan_log(scans, errors).orderBy("section", "id", "line_number").collect()]
    assert got == [
        ("error", 5, 0, "2024-01-01 00:00 - a/b: denied"),
        ("scan", 1, 0, "2024-01-01 00:00 - completed - 3 files, 2 folders, 0 errors"),
        ("scan", 1, 1, "  Changes: +1 files, -0 files, 2 changed; +0 folders, -0 folders"),
        ("scan", 1, 2, "  Indexed size: 1.5 KB -> 500 B (-1.0 KB)"),
        ("scan", 2, 0, "2024-01-01 00:00 - failed - 0 files, 0 folders, 0 errors"),
        ("scan", 2, 1, "  gone"),
    ]


def test_change_summary(spark):
    before = make(spark, "files", [file(1, 1, "budget", 5), file(2, 1, "report", 5), file(3, 1, "image", 4)])
    after = make(spark, "files", [file(2, 1, "report", 15), file(4, 1, "notes", 3), file(3, 1, "image", 4)])
    r = stats.has_changes(stats.change_summary(before, after, ["relative_path"])).first()
    assert (r.files_before, r.files_after, r.files_added, r.files_removed, r.files_changed, r.bytes_before, r.bytes_after) == (3, 3, 1, 1, 1, 14, 22)
    assert (r.bytes_added, r.bytes_removed, r.changed_bytes_before, r.changed_bytes_after, r.has_previous, r.has_changes) == (3, 5, 5, 15, True, True)
    nothing = stats.has_changes(stats.change_summary(before.limit(0), before.limit(0), ["relative_path"])).first()
    assert nothing.files_before == 0 and nothing.bytes_after == 0 and not nothing.has_changes and not nothing.has_previous


def test_upserts_keep_ids_and_number_new_rows_without_gaps(spark):
    kind = "id bigint, volume_id bigint, relative_path string, size_bytes bigint"
    current = spark.createDataFrame([(5, 1, "a", 1), (7, 1, "b", 2), (8, 2, None, 3)], kind)
    new = spark.createDataFrame([(0, 1, "a", 9), (0, 2, "z", 4), (0, 2, "y", 5), (0, 2, "y", 6), (0, 2, None, 7)], kind).drop("id")
    got = sorted(tuple(r) for r in changes.upsert(current, new).collect())
    assert got == [(5, 1, "a", 9), (7, 1, "b", 2), (8, 2, None, 7), (9, 2, "y", 6), (10, 2, "z", 4)]
    assert changes.upsert(current.limit(0), new.limit(0)).collect() == []
    many = spark.range(5000).selectExpr("1L AS volume_id", "cast(id AS string) AS relative_path", "id AS size_bytes")
    ids = [r.id for r in changes.upsert(current, many).where("id > 8").collect()]
    assert sorted(ids) == list(range(9, 5009))


def test_stale_items_go_but_roots_stay(spark):
    rows = [folder(1, None, "", scanned_at=None), folder(2, 1, "new", scanned_at=T), folder(3, 1, "old", scanned_at=datetime(2023, 1, 1)), folder(4, None, "x", 2)]
    df = make(spark, "folders", rows)
    assert {r.id for r in changes.finalize(df, 1, T, keep_root=True).collect()} == {1, 2, 4}
    assert {r.id for r in changes.finalize(df, 1, T).collect()} == {2, 4}


def test_deleting_a_volume(spark):
    names = ("volumes", "folders", "files", "volume_register")
    rows = {"volumes": [{"id": 1}, {"id": 2}], "folders": [folder(1, None, ""), folder(2, None, "", 2)], "files": [file(1, 1, "a"), file(2, 2, "b", volume=2)], "volume_register": [{"volume_id": 1}, {"volume_id": 2, "is_mirror": 1, "master_volume_id": 1}]}
    tables = {n: make(spark, n, rows[n]) for n in names}
    assert {n: df.count() for n, df in changes.delete_volume(tables, 2).items()} == dict.fromkeys(names, 1)
    with pytest.raises(ValueError):
        changes.delete_volume(tables, 1)
    assert changes.update_volume(tables["volumes"], 2, name="N", last_scan_at=T).where("id = 2").first()["name"] == "N"
    assert changes.normalized_location(" a ", " ") == ("", "") and changes.normalized_location(" a ", "b ") == ("a", "b")


def test_register(spark):
    vols = make(spark, "volumes", [{"id": i, "name": n} for i, n in ((1, "red"), (2, None), (3, "Blue"), (4, "RED"))])
    some = make(spark, "volume_register", [{"volume_id": 1, "drive_id": "AID-001"}, {"volume_id": 2, "drive_id": "Shelf B"}, {"volume_id": 3, "drive_id": "AID-1250", "is_mirror": 1, "master_volume_id": 1}])
    full = volumes.backfill_register(vols, some)
    assert volumes.next_drive_id(some).first()[0] == "AID-1251" and full.where("volume_id = 4").first()["drive_id"] == "AID-1251"
    assert volumes.next_drive_id(some.limit(0)).first()[0] == "AID-001"
    view = volumes.volume_view(vols, full)
    assert [r.id for r in view.collect()] == [2, 3, 1, 4] and view.where("id = 3").first()["master_drive_id"] == "AID-001"
    assert [r.drive_id for r in volumes.natural_order(view).collect()] == ["AID-001", "AID-1250", "AID-1251", "Shelf B"]
    assert [r.id for r in volumes.mirror_dependents(view, 1).collect()] == [3] and [r.id for r in volumes.master_options(view, 1).collect()] == [4, 2]
    assert [r.id for r in volumes.filter_volumes(view, "RED mirror").collect()] == [3]
    assert [r.id for r in volumes.filter_volumes(view, " blue  AID-1 ").collect()] == [3] and volumes.filter_volumes(view, "").count() == 4
    assert [(r.folded, r.n) for r in volumes.duplicate_names(vols, "name").collect()] == [("red", 2)]
    bad = make(spark, "volume_register", [{"volume_id": 1, "is_mirror": 1, "master_volume_id": 2}, {"volume_id": 2, "is_mirror": 1, "master_volume_id": 1}, {"volume_id": 3, "is_mirror": 1}, {"volume_id": 4, "is_mirror": 1, "master_volume_id": 4}])
    assert {r.volume_id: r.violation for r in volumes.mirror_violations(vols, bad).collect()} == {1: "master is a mirror", 2: "master is a mirror", 3: "no master", 4: "own master"}


def test_connected_volumes(spark):
    vols = make(spark, "volumes", [{"id": 1, "identity_kind": "k", "identity_token": "drive-A", "source_relative_path": "Archive"}, {"id": 2, "identity_kind": "k", "identity_token": "drive-b", "source_relative_path": "."}, {"id": 3}])
    mounts = spark.createDataFrame([(2, "/late", "k", "DRIVE-B"), (1, "/mnt/", "k", "Drive-B"), (3, "/x", "", ""), (4, "/m", "k", "drive-a")], "ordinal int, mount_root string, identity_kind string, identity_token string")
    got = {r.id: (r.found_path, r.connected) for r in volumes.connected_volumes(vols, mounts).collect()}
    assert got == {1: ("/m/Archive", True), 2: ("/mnt/", True), 3: (None, False)}
    assert [r.identity_token for r in volumes.connection_signature(mounts).first()["signature"]] == ["drive-a", "drive-b", "drive-b"]


def test_results_come_in_batches(spark):
    assert [len(b) for b in result_batches(spark.range(501))] == [500, 1]
    searches = LatestSearch(spark)
    first = searches.run(lambda: spark.range(2000))
    assert len(next(first)) == 500
    second = searches.run(lambda: spark.range(3))
    assert [len(b) for b in second] == [3] and list(first) == []
