from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lodestack.errors import InvalidCatalogue
from lodestack.operators import changes, register, volumes
from lodestack.operators.volumes import default_register
from lodestack.sources.store import Store
from tests.catalogue import make

NOW = datetime(2024, 5, 1, 12)


def pair(spark, *rows, entries=()):
    vols = make(spark, "volumes", [{"id": 1, "name": "One"}, {"id": 2, "name": "Two"}, {"id": 3}, *rows])
    reg = make(spark, "volume_register", [{"volume_id": 1, "drive_id": "AID-001"}, {"volume_id": 2, "drive_id": "AID-007"}, {"volume_id": 3, "drive_id": "box"}, *entries])
    return vols, reg


def bad(vols, reg):
    return sorted((r.volume_id, r.violation) for r in register.register_violations(vols, reg).collect())


def test_new_volumes_are_numbered_and_registered(spark):
    vols, reg = pair(spark)
    new = spark.createDataFrame([(" New ", " /mnt/x ", " uuid ", "t", "first"), (None, None, "uuid", None, None)], "name string, source_path string, identity_kind string, identity_token string, description string").withColumn("volume_id", F.lit(77))
    v, r = register.create_volumes(vols, reg, new, NOW)
    made = {x.id: x for x in v.where("id > 3").collect()}
    assert [(made[i].name, made[i].source_path, made[i].identity_kind, made[i].identity_token, made[i].capacity_bytes, made[i].created_at) for i in (4, 5)] == [(None, "", "", "", 0, NOW), ("New", "/mnt/x", "uuid", "t", 0, NOW)]
    entries = {x.volume_id: x for x in r.collect()}
    assert {i: (entries[i].drive_id, entries[i].status, entries[i].connector, entries[i].description, entries[i].date_added) for i in (4, 5)} == {4: ("AID-008", "Active", "Unknown", "", NOW.date()), 5: ("AID-009", "Active", "Unknown", "first", NOW.date())}
    assert bad(v, r) == [] and v.columns == vols.columns and r.columns == reg.columns
    assert [x.id for x in register.create_volumes(vols, reg, new.limit(1), NOW, highest=40)[0].where("id > 3").collect()] == [41]


def test_an_entry_is_given_whole_and_keeps_when_it_was_made(spark):
    _, reg = pair(spark)
    given = spark.createDataFrame([(1, "A", 0, 2, date(2021, 1, 1)), (2, None, 1, 1, date(2021, 1, 1)), (2, None, 1, 1, None), (9, " ", None, None, None)], "volume_id bigint, drive_id string, is_mirror int, master_volume_id bigint, mirror_date date").withColumn("extra", F.lit(1))
    out = {r.volume_id: r for r in register.upsert_register(reg, given, NOW).collect()}
    assert set(out) == {1, 2, 3, 9} and out[3].drive_id == "box"
    assert (out[1].drive_id, out[1].is_mirror, out[1].master_volume_id, out[1].mirror_date) == ("A", 0, None, None)
    assert (out[2].drive_id, out[2].is_mirror, out[2].master_volume_id, out[2].mirror_date) == ("AID-008", 1, 1, date(2021, 1, 1))
    assert out[9].drive_id == "AID-009" and out[9].created_at == NOW and out[1].created_at != NOW and out[1].updated_at == NOW
    assert register.upsert_register(reg, given.limit(0), NOW).count() == 3


def test_what_is_wrong_is_named(spark):
    day = date(2020, 1, 1)
    rows = [{"id": 4, "name": "ONE"}, {"id": 5}]
    entries = [
        {"volume_id": 4, "drive_id": "aid-001", "is_mirror": 1, "master_volume_id": 4, "date_added": date(2021, 1, 1), "mirror_date": day, "retired_date": day},
        {"volume_id": 8, "drive_id": " ", "is_mirror": 1, "master_volume_id": 4, "earliest_content_date": date(2022, 1, 1), "latest_content_date": day},
    ]
    assert bad(*pair(spark, *rows, entries=entries)) == [
        (1, "drive id taken"), (1, "name taken"), (4, "drive id taken"), (4, "mirrored before it was added"), (4, "name taken"), (4, "own master"), (4, "retired before it was added"),
        (5, "no entry"), (8, "content dates reversed"), (8, "master is a mirror"), (8, "no drive id"), (8, "unknown volume"),
    ]
    vols, reg = pair(spark)
    assert bad(vols, reg) == [] == bad(vols.limit(0), reg.limit(0))


def test_a_store_refuses_what_is_wrong(spark, tmp_path):
    store = Store(spark, str(tmp_path / "c"))
    vols, reg = pair(spark)
    store.create({"volumes": vols, "volume_register": reg})
    for changed in ({"volumes": vols.withColumn("name", F.lit("Same"))}, {"volume_register": reg.withColumn("drive_id", F.lit("X"))}, {"volume_register": reg.where("volume_id = 1")}):
        with pytest.raises(InvalidCatalogue):
            store.publish(changed)
    assert store.version() == 1
    mirror = register.upsert_register(reg, spark.createDataFrame([(2, 1, 1)], "volume_id bigint, is_mirror int, master_volume_id bigint"), NOW)
    store.publish({"volume_register": mirror})
    with pytest.raises(ValueError):
        store.delete_volume(1)
    store.delete_volume(2)
    assert {r.id for r in store.tables()["volumes"].collect()} == {1, 3}


def test_default_entries_count_up_from_one(spark):
    assert [r.drive_id for r in default_register(spark.range(1, 3)).orderBy("volume_id").collect()] == ["AID-001", "AID-002"]


def test_locations_and_storage(spark, monkeypatch):
    monkeypatch.setenv("HOME", "/home/someone")
    vols, _ = pair(spark)
    moved = changes.update_location(vols, 1, " ~/drive ", {"identity_kind": " k ", "identity_token": " t ", "identity_label": " L "}, NOW).where("id = 1").first()
    assert (moved.source_path, moved.identity_kind, moved.identity_token, moved.identity_label, moved.updated_at) == ("/home/someone/drive", "k", "t", " L ", NOW)
    sized = changes.update_storage(vols, 2, 9, 5, 4, NOW, NOW).where("id = 2").first()
    assert (sized.capacity_bytes, sized.used_bytes, sized.free_bytes, sized.last_scan_at) == (9, 5, 4, NOW)


def test_connection_looks_at_paths_and_at_saved_places(spark):
    vols = make(spark, "volumes", [{"id": i, "identity_kind": "k", "identity_token": t, "source_path": f"/s{i}", "source_relative_path": r} for i, t, r in ((1, "A", "in"), (2, "B", ""), (3, "C", "x"), (4, "D", ""), (5, "", ""))])
    mounts = spark.createDataFrame([(1, "/m1", "k", "a"), (2, "/m2", "k", "b")], "ordinal int, mount_root string, identity_kind string, identity_token string")
    existing = spark.createDataFrame([("/m1/in",), ("/m1/in",), ("/other",)], "path string")
    captured = spark.createDataFrame([("/s2", "k", "b"), ("/s3", "k", "c"), ("/s4", "k", "z"), ("/s5", "", "")], "source_path string, identity_kind string, identity_token string")
    got = {r.id: (r.mount_root, r.found_path, r.connected) for r in volumes.connected_volumes(vols, mounts, existing, captured).collect()}
    # 2 is plugged in, but its path is not there, so its saved place is not asked.
    assert got == {1: ("/m1", "/m1/in", True), 2: (None, None, False), 3: (None, "/s3", True), 4: (None, None, False), 5: (None, None, False)}
    items = spark.createDataFrame([(1, "a/./b"), (1, ""), (2, "a"), (9, "a"), (None, None)], "volume_id bigint, relative_path string")
    paths = volumes.physical_paths(items, volumes.connected_volumes(vols, mounts, existing, captured)).collect()
    assert sorted((r.volume_id or 0, r.physical_path or "", r.available) for r in paths) == [(0, "", False), (1, "/m1/in", True), (1, "/m1/in/a/b", True), (2, "", False), (9, "", False)]


def test_found_dates_fill_only_what_is_empty(spark):
    reg = make(spark, "volume_register", [{"volume_id": 1, "earliest_content_date": date(2000, 1, 1)}, {"volume_id": 2}, {"volume_id": 3}])
    found = spark.createDataFrame([(1, date(1999, 1, 1), date(2005, 1, 1)), (2, date(1998, 1, 1), None)], "volume_id bigint, earliest date, latest date")
    got = {r.volume_id: (r.earliest_content_date, r.latest_content_date) for r in register.fill_content_dates(reg, found).collect()}
    assert got == {1: (date(2000, 1, 1), date(2005, 1, 1)), 2: (date(1998, 1, 1), None), 3: (None, None)}


def test_paths_that_exist_are_captured_with_their_device(spark, tmp_path):
    from lodestack.sources.filesystem import captured_identities

    got = captured_identities(spark, [str(tmp_path), str(tmp_path), str(tmp_path / "none")]).collect()
    assert [(r.source_path, r.identity_kind, r.identity_token) for r in got] == [(str(tmp_path), "filesystem-device", str(tmp_path.stat().st_dev))]
    assert captured_identities(spark, []).count() == 0
