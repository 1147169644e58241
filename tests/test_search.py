from __future__ import annotations

import pytest

from lodestack.operators.search import RESULT, search
from lodestack.operators.volumes import default_register, volume_view
from tests.catalogue import file, folder, make


@pytest.fixture(scope="module")
def tables(spark):
    folders = [folder(1, None, ""), folder(2, 1, "Invoices"), folder(3, 2, "Invoices/Hal Far Site 301118"), folder(4, None, "", 2), folder(5, 4, "Music", 2), folder(6, 1, "éa", missing=1)]
    files = [
        file(1, 2, "Invoices/january.pdf"), file(2, 5, "Music/january.mp3", volume=2), file(3, 1, "100%_a\\b.txt"), file(4, 1, "100xxa.txt"), file(5, 1, "README"), file(6, 1, "Éa.TXT", missing=1),
        file(7, 1, "JANUARY"), file(8, 1, "x.tar.gz"), file(9, 3, "Invoices/Hal Far Site 301118/deep.bin"), file(1, 2, "Invoices/january.pdf"), file(10, 1, "a'b\"c.txt"),
    ]
    volumes = make(spark, "volumes", [{"id": 1, "name": "One"}, {"id": 2, "name": None}, {"id": 3, "name": "Three"}])
    view = volume_view(volumes, default_register(volumes))
    return make(spark, "files", files), make(spark, "folders", folders), view


def ids(tables, text, **options):
    return [(r.item_type, r.item_id) for r in search(*tables, text, **options).collect()]


def test_exact_name_then_parts(tables):
    assert ids(tables, "january") == [("file", 7), ("file", 2), ("file", 1)]
    assert search(*tables, "january").columns == RESULT


def test_letters_fold_only_in_ascii(tables):
    assert ids(tables, "éA") == [("folder", 6)] and ids(tables, "ÉA") == [("file", 6)]


def test_wildcards_quotes_and_backslashes_are_letters(tables):
    assert ids(tables, "100%_a\\") == [("file", 3)] and ids(tables, "a'b\"") == [("file", 10)] and ids(tables, "%") == [("file", 3)]


def test_dot_finds_extensions(tables):
    assert ids(tables, ".PDF") == [("file", 1)] and ids(tables, ".tar.gz") == [] and ids(tables, ".gz") == [("file", 8)]
    assert ids(tables, ".") == [("file", 7), ("file", 5)]


def test_paths_only_if_asked_and_folders_first(tables):
    assert ids(tables, "301118") == [("folder", 3)]
    assert ids(tables, "301118", include_paths=True) == [("folder", 3), ("file", 9)]
    assert ids(tables, "301118", include_paths=True, limit=1) == [("folder", 3)] and ids(tables, "january", limit=-2) == []


def test_missing_items_come_later_and_roots_are_found(tables):
    assert ids(tables, "txt")[-1] == ("file", 6)
    assert ids(tables, "root") == [("folder", 1), ("folder", 4)]


def test_blank_and_empty(spark, tables):
    assert ids(tables, "  ") == [] and ids(tables, " README ") == [("file", 5)]
    none = (make(spark, "files", []), make(spark, "folders", []), tables[2])
    assert ids(none, "a") == []


def test_volumes_without_an_entry_drop_out(spark, tables):
    files, folders, view = tables
    assert ids((files, folders, view.where("id <> 2")), "january") == [("file", 7), ("file", 1)]


def test_filters_run_at_the_scan(spark, tables, tmp_path):
    paths = [str(tmp_path / n) for n in ("files", "folders")]
    for df, p in zip(tables, paths, strict=False):
        df.write.parquet(p)
    df = search(spark.read.parquet(paths[0]), spark.read.parquet(paths[1]), tables[2], ".pdf")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "identity_inode" not in plan.split("ReadSchema")[1].split("\n")[0]
