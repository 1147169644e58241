from __future__ import annotations

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestack import schemas
from lodestack.errors import CatalogueInUse, InvalidCatalogue, UnsupportedCatalogue
from lodestack.operators import ingest
from lodestack.operators.volumes import default_register
from lodestack.sources.filesystem import modified, read_tree
from lodestack.sources.store import Store, probe
from tests.catalogue import file, folder, make


@pytest.fixture
def archive(spark, tmp_path):
    root = tmp_path / "drive"
    for path, text in (("Letters/answer.txt", "seven"), ("Letters/sums.csv", "4,5,6"), ("Slides/harbour.JPG", "tiff")):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    store = Store(spark, str(tmp_path / "cat"))
    vols = make(spark, "volumes", [{"id": 1, "name": "One", "source_path": str(root)}])
    store.create({"volumes": vols, "volume_register": default_register(vols)})
    return root, store


def stats_of(store):
    rows = store.tables()["folders"].collect()
    return {r.relative_path: (r.recursive_size_bytes, r.recursive_file_count, r.recursive_subfolder_count, r.direct_file_count, r.direct_subfolder_count) for r in rows}


def test_a_scan_and_what_a_second_one_changes(archive):
    root, store = archive
    first = ingest.scan_volume(store, 1)
    assert (first.status, first.files_seen, first.folders_seen, first.errors_count) == ("completed", 3, 3, 0)
    assert stats_of(store) == {"": (14, 3, 2, 0, 2), "Letters": (10, 2, 0, 2, 0), "Slides": (4, 1, 0, 1, 0)}
    before = {r.relative_path: r.id for r in store.tables()["files"].collect()}
    (root / "Letters/sums.csv").unlink()
    (root / "Letters/answer.txt").write_text("altered content")
    (root / "notes.md").write_text("new")
    asked = []
    second = ingest.scan_volume(store, 1, review=lambda s: asked.append(s) or True)
    s = second.summary
    assert (s["files_added"], s["files_removed"], s["files_changed"], s["bytes_before"], s["bytes_after"]) == (1, 1, 1, 14, 22) and len(asked) == 1
    after = {r.relative_path: (r.id, r.extension) for r in store.tables()["files"].collect()}
    assert after == {"Letters/answer.txt": (before["Letters/answer.txt"], "txt"), "Slides/harbour.JPG": (before["Slides/harbour.JPG"], "jpg"), "notes.md": (4, "md")}
    volume, entry = store.tables()["volumes"].first(), store.tables()["volume_register"].first()
    assert volume.indexed_file_count == 3 and volume.indexed_folder_count == 3 and volume.last_scan_at is not None and entry.latest_content_date is not None
    unchanged = ingest.scan_volume(store, 1, review=lambda s: pytest.fail("nothing to review"))
    assert unchanged.status == "completed" and store.tables()["scan_history"].count() == 3


def test_a_declined_or_cancelled_scan_leaves_the_catalogue(archive):
    root, store = archive
    ingest.scan_volume(store, 1)
    kept = stats_of(store)
    (root / "Letters/sums.csv").unlink()
    declined = ingest.scan_volume(store, 1, review=lambda s: False)
    assert declined.status == "discarded" and stats_of(store) == kept
    cancelled = ingest.scan_volume(store, 1, cancelled=lambda: True)
    assert cancelled.status == "cancelled" and store.tables()["files"].count() == 3
    rows = {r.id: (r.status, r.files_removed) for r in store.tables()["scan_history"].collect()}
    assert rows == {1: ("completed", 0), 2: ("discarded", 1), 3: ("cancelled", None)}


def two_drives(spark, tmp_path, **deep):
    for v in (1, 2):
        for path in ("a/x.txt", "a/b/y.txt"):
            (tmp_path / f"d{v}" / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / f"d{v}" / path).write_text("text")
    store = Store(spark, str(tmp_path / "cat"))
    vols = make(spark, "volumes", [{"id": v, "name": f"V{v}", "source_path": str(tmp_path / f"d{v}")} for v in (1, 2)])
    store.create({"volumes": vols, "volume_register": default_register(vols)})
    return store


def folders_of(store, version=None):
    return store._manifest(version or store.version())["tables"]


def test_a_scan_writes_only_its_own_volume(spark, tmp_path):
    store = two_drives(spark, tmp_path)
    ingest.scan_volume(store, 1)
    before = folders_of(store)
    ingest.scan_volume(store, 2)
    after = folders_of(store)
    for name in ("files", "folders"):
        assert after[name]["1"] == before[name]["1"] and set(after[name]) == {"1", "2"}
    ids = [r.id for r in store.tables()["files"].collect()]
    assert sorted(ids) == [1, 2, 3, 4] and store.highest("files") == 4
    assert {r.volume_id for r in store.tables(volume=2)["files"].collect()} == {2}
    store.delete_volume(1)
    gone = folders_of(store)
    assert gone["files"] == {"2": after["files"]["2"]} and {r.volume_id for r in store.tables()["files"].collect()} == {2}
    assert store.tables()["volumes"].count() == store.tables()["volume_register"].count() == store.tables()["scan_history"].count() == 1
    (tmp_path / "d2/new.txt").write_text("n")
    ingest.scan_volume(store, 2)
    assert {r.id for r in store.tables()["files"].collect()} == {3, 4, 5}


def test_vacuum_keeps_what_kept_versions_name(spark, tmp_path):
    store = two_drives(spark, tmp_path)
    for v in (1, 2, 1):
        ingest.scan_volume(store, v)
    spark.range(3).write.parquet(f"{store.path}/data/files-left-by-a-writer-who-gave-up")
    rows = {n: df.count() for n, df in store.tables().items()}
    assert store.vacuum(keep=1) >= 1  # versions; the folders are too young
    assert os.path.isdir(f"{store.path}/data/files-left-by-a-writer-who-gave-up")
    assert store.vacuum(keep=1, hours=0) > 5 and {n: df.count() for n, df in store.tables().items()} == rows
    named = {f.partition("/")[0] for p in folders_of(store).values() for f in ([p] if isinstance(p, str) else p.values())}
    assert set(os.listdir(f"{store.path}/data")) == named


def test_a_running_scan_says_so_and_two_volumes_scanned_at_once_are_both_kept(spark, tmp_path, monkeypatch):
    store = two_drives(spark, tmp_path)
    seen, real, inner = [], ingest.storage_of, []

    def meanwhile(path):
        if not inner:
            inner.append(True)
            seen.extend((r.volume_id, r.status, r.finished_at) for r in store.tables()["scan_history"].collect())
            inner.append(ingest.scan_volume(Store(spark, store.path), 2).status)
        return real(path)

    monkeypatch.setattr(ingest, "storage_of", meanwhile)
    assert ingest.scan_volume(store, 1).status == "completed" and inner[1] == "completed"
    assert seen == [(1, "running", None)]
    tables = store.tables()
    assert sorted((r.volume_id, r.status) for r in tables["scan_history"].collect()) == [(1, "completed"), (2, "completed")]
    assert tables["files"].count() == 4 and tables["files"].select("id").distinct().count() == 4 and tables["folders"].select("id").distinct().count() == 6
    assert all(r.last_scan_at is not None for r in tables["volumes"].collect())


def test_the_reading_can_be_watched_and_stopped(spark, tmp_path, monkeypatch):
    store = two_drives(spark, tmp_path)
    heard = []
    ingest.scan_volume(store, 1, progress=lambda *x: heard.append(x))
    assert {x[0] for x in heard} >= {"read", "merge"} and all(0 <= d <= n for _, d, n in heard)
    slow = spark.range(4, numPartitions=4).select(F.expr("reflect('java.lang.Thread', 'sleep', 60000L)"))
    monkeypatch.setattr(ingest, "read_tree", lambda *_: slow)
    asked = []
    began = datetime.now()
    stopped = ingest.scan_volume(store, 2, cancelled=lambda: asked.append(1) or len(asked) > 5)
    assert stopped.status == "cancelled" and (datetime.now() - began).seconds < 40
    assert {(r.volume_id, r.status) for r in store.tables()["scan_history"].collect()} == {(1, "completed"), (2, "cancelled")}


def test_a_failure_is_in_the_history_and_lost_storage_is_zeros(spark, tmp_path, monkeypatch):
    store = two_drives(spark, tmp_path)
    monkeypatch.setattr(ingest.shutil, "disk_usage", lambda _: (_ for _ in ()).throw(OSError("gone")))
    assert ingest.scan_volume(store, 1).status == "completed"
    assert {(r.id, r.capacity_bytes) for r in store.tables()["volumes"].collect()} == {(1, 0), (2, 0)}
    monkeypatch.setattr(ingest, "scanned_items", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest.scan_volume(store, 2)
    assert {(r.volume_id, r.status, r.message) for r in store.tables()["scan_history"].collect()} == {(1, "completed", None), (2, "failed", "ZeroDivisionError: division by zero")}


def test_a_drive_whose_content_lies_in_one_folder_is_read_in_parts(spark, tmp_path):
    from lodestack.sources.filesystem import TreeReader

    for i in range(20):
        (tmp_path / f"only/one/f{i:02}/g").mkdir(parents=True)
        (tmp_path / f"only/one/f{i:02}/g/x").write_text("x")
    parts = TreeReader(str(tmp_path), 8).partitions()
    assert len([p for p in parts if p.deep]) == 20 and {p.start for p in parts if not p.deep} == {"", "only", "only/one"}
    found = sorted((r.kind, r.relative_path) for r in read_tree(spark, str(tmp_path)).collect())
    assert len(found) == len(set(found)) == 1 + 2 + 20 * 3


def test_statistics_are_rebuilt_without_the_drive(spark, archive):
    root, store = archive
    ingest.scan_volume(store, 1)
    names = ["recursive_size_bytes", "recursive_file_count", "recursive_subfolder_count", "direct_file_count", "direct_subfolder_count"]
    kept = stats_of(store)
    store.publish({"folders": store.tables()["folders"].withColumns({n: F.lit(None).cast("bigint") for n in names})})
    os.rename(root, f"{root}-away")
    assert ingest.rebuild_statistics(store, 1) == 3 and stats_of(store) == kept
    assert ingest.scan_volume(store, 1).status == "failed"


def test_links_are_not_followed_and_hard_links_count_once(spark, tmp_path):
    root = tmp_path / "t"
    (root / "real").mkdir(parents=True)
    (root / "real/original.bin").write_text("payload")
    os.link(root / "real/original.bin", root / "real/linked.bin")
    os.symlink(root / "real", root / "way")
    os.symlink(root / "real/original.bin", root / "also")
    tree = read_tree(spark, str(root))
    assert sorted((r.kind, r.relative_path) for r in tree.collect()) == [("file", "real/linked.bin"), ("file", "real/original.bin"), ("folder", ""), ("folder", "real")]
    store = Store(spark, str(tmp_path / "cat"))
    vols = make(spark, "volumes", [{"id": 1, "source_path": str(root)}])
    store.create({"volumes": vols, "volume_register": default_register(vols)})
    ingest.scan_volume(store, 1)
    assert stats_of(store)[""][:2] == (7, 2)
    dates = ingest.content_dates_of(tree, "Europe/Malta").first()
    assert dates.earliest is not None and dates.earliest <= dates.latest


def test_times_are_utc_in_any_session_zone(spark, tmp_path):
    from lodestack.sources.filesystem import scanned_items

    (tmp_path / "a").write_text("x")
    os.utime(tmp_path / "a", (86400 * 365.0, 86400 * 365.0))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Lima")
        r = scanned_items(read_tree(spark, str(tmp_path)), 1, datetime(2024, 1, 1, 5))[1].first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert (r.modified_at, r.scanned_at) == (datetime(1971, 1, 1), datetime(2024, 1, 1, 5))


def test_what_cannot_be_read_is_an_error_row(spark, tmp_path):
    got = read_tree(spark, str(tmp_path / "none")).collect()
    assert [r.kind for r in got] == ["error"] and "No such file" in got[0].error
    assert modified(float("nan")) is None and modified(1e20) is None and modified(0).year == 1970


def test_versions_are_published_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "c"))
    assert probe(spark, store.path) == 2
    store.create()
    assert probe(spark, store.path) == 0 and store.version() == 1 and store.count_rows("files") == 0
    with pytest.raises(InvalidCatalogue):
        store.create()
    base = store.version()
    store.publish({"files": make(spark, "files", [file(1, 1, "a")])}, base)
    with pytest.raises(CatalogueInUse):
        store.publish({"files": make(spark, "files", [file(2, 1, "b")])}, base)
    assert store.tables(1)["files"].count() == 0 and store.tables()["files"].count() == 1
    with pytest.raises(ValueError):
        store.count_rows("sqlite_master")
    assert probe(spark, store.path, rows=True) == 0
    with pytest.raises(UnsupportedCatalogue):
        store.publish({}, schema=schemas.VERSION + 1)
    with pytest.raises(UnsupportedCatalogue):
        store.tables()
    assert probe(spark, store.path) == 3


def test_migration_of_old_tables(spark):
    old = {
        "volumes": make(spark, "volumes", [{"id": 4, "name": ""}, {"id": 2, "name": "B"}]).select("id", "name", "source_path", "capacity_bytes", "used_bytes", "free_bytes", "indexed_file_count", "indexed_folder_count", "last_scan_at", "created_at", "updated_at"),
        "folders": make(spark, "folders", [folder(1, None, "", 2)]).select("id", "volume_id", "parent_id", "name", "relative_path", "missing", "scanned_at", "modified_at"),
        "files": make(spark, "files", [file(1, 1, "a", 123, volume=2)]).drop("identity_device", "identity_inode"),
        "scan_history": make(spark, "scan_history", [{"id": 1}]).select("id", "volume_id", "started_at", "finished_at", "status", "files_seen", "folders_seen", "errors_count", "message"),
        "scan_errors": make(spark, "scan_errors", []),
    }
    new = schemas.migrate(old, 1)
    schemas.validate_schema(new)
    assert {r.id: (r.name, r.identity_kind) for r in new["volumes"].collect()} == {4: (None, ""), 2: ("B", "")}
    assert {r.volume_id: r.drive_id for r in new["volume_register"].collect()} == {2: "AID-001", 4: "AID-002"}
    assert new["folders"].first()["recursive_size_bytes"] is None
    with pytest.raises(UnsupportedCatalogue):
        schemas.migrate(old, 99)
    with pytest.raises(InvalidCatalogue):
        schemas.validate_schema(old)
    bad = make(spark, "files", [file(1, 1, "a")]).withColumn("name", F.lit(None).cast("string"))
    assert [(r.column, r.violations) for r in schemas.null_violations("files", bad).collect()] == [("name", 1)]
