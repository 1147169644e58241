from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lodestack.functions import catalogue as c
from lodestack.functions import text as t


def apply(spark, expression, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("name,want", [("a.txt", "txt"), ("A.JPG", "jpg"), (".bashrc", ""), ("x.", ""), ("..a", "a"), ("a..b", "b"), (".a.b", "b"), ("a.tar.gz", "gz"), ("plain", ""), ("", ""), ("é.ÉX", "éx")])
def test_extension(spark, name, want):
    assert apply(spark, c.extension_of, [name]) == [want]


def test_ascii_lower_and_strip(spark):
    assert apply(spark, t.ascii_lower, ["ÉabZ", None, ""]) == ["Éabz", None, ""]
    assert apply(spark, t.strip, ["\t a b \n", " x ", None]) == ["a b", "x", None]


def test_sizes(spark):
    values = [None, 0, 999, 1000, 1250, 1350, 999_999, 10**6, 10**12, 12345 * 10**12]
    assert apply(spark, c.format_size, values, "bigint") == ["0 B", "0 B", "999 B", "1.0 KB", "1.2 KB", "1.4 KB", "1000.0 KB", "1.0 MB", "1.0 TB", "12345.0 TB"]
    assert apply(spark, c.display_size, [None, 5], "bigint") == ["Unknown", "5 B"]
    assert apply(spark, c.display_count, [None, 1234567], "bigint") == ["Unknown", "1,234,567"]
    assert apply(spark, lambda x: c.size_delta(F.lit(1000), x), [1000, 500, 3000], "bigint") == ["0 B", "-500 B", "+2.0 KB"]


def test_percentage_full(spark):
    df = spark.createDataFrame([(25, 1000), (35, 1000), (0, 0), (None, 5), (9, None), (200, 100), (-5, 10)], "u bigint, c bigint")
    assert [r.p for r in df.select(c.percentage_full(F.col("u"), F.col("c")).alias("p")).collect()] == [2, 4, 0, 0, 0, 100, 0]


def test_paths(spark):
    paths = ["", "a", "a/b", "a/b/c.txt"]
    assert apply(spark, c.parent_path, paths) == [None, "", "a", "a/b"]
    assert apply(spark, c.last_segment, paths) == ["", "a", "b", "c.txt"]
    assert apply(spark, c.depth, paths) == [0, 1, 2, 3]
    assert apply(spark, c.display_path, ["", None, "a"]) == ["/", "/", "a"]
    assert apply(spark, lambda x: c.join_path(F.lit("/mnt/x/"), x), [None, "", ".", "./a//b", "a/b/"]) == ["/mnt/x/", "/mnt/x/", "/mnt/x/", "/mnt/x/a/b", "/mnt/x/a/b"]


def test_types(spark):
    values = ["mp4", ".PDF", "docx", "xyz", "", None, "7z", "sh", "md", "jpeg", "flac"]
    assert apply(spark, c.type_label, values) == ["Video", "PDF", "Office Document", "XYZ", "File", "File", "Archive", "Executable", "Text", "Image", "Audio"]
    assert apply(spark, c.category, ["mp4", "xyz", ""]) == ["video", "unknown", "unknown"]
    assert apply(spark, c.property_label, ["mp4", "pdf", "xyz", "docx", ""]) == ["MP4 video", "PDF file", "XYZ file", "DOCX office document", "File"]


def test_identities(spark):
    values = ["0", "-3", "7", str(2**63 - 1), str(2**63 + 7), str(2**64 - 1), str(2**64), None]
    assert apply(spark, lambda x: c.wrap_uint64(x.cast("decimal(38,0)")), values) == [None, None, 7, 2**63 - 1, 2**63 + 7 - 2**64, -1, None, None]


def test_drive_ids(spark):
    values = ["AID-001", "AID-1250", "AID-42", "aid-007", "Shelf B", "AID-010x", None]
    assert apply(spark, c.drive_sequence, values) == [1, 1250, None, None, None, None, None]
    assert apply(spark, c.suggested_drive_id, ["AID-001", "aid-042", "Archive Drive", "AID-42"]) == ["AID-001", "AID-042", None, None]
    df = spark.createDataFrame([(v,) for v in ["shelf", "AID-1250", "AID-002", "Box"]], "v string").orderBy(c.drive_sort_key(F.col("v")))
    assert [r.v for r in df.collect()] == ["AID-002", "AID-1250", "Box", "shelf"]
    named = spark.createDataFrame([("AID-001", "Red"), ("AID-002", None), (None, "Blue"), (None, "")], "d string, n string")
    assert [r.x for r in named.select(c.drive_reference(F.col("d"), F.col("n")).alias("x")).collect()] == ["AID-001 - Red", "AID-002", "Blue", "-"]


def test_times(spark):
    at = datetime(2024, 3, 1, 12, 0, 5, 7)
    assert apply(spark, c.time_text, [at, None], "timestamp_ntz") == ["2024-03-01T12:00:05.000007+0000", None]
    assert apply(spark, lambda x: c.parse_time(x).cast("timestamp_ntz"), ["2024-03-01T12:00:05.000007+0000", "2024-03-01", "", None]) == [at, None, None, None]
    assert apply(spark, lambda x: c.display_time(x, "Europe/Malta"), [at, None], "timestamp_ntz") == ["2024-03-01 13:00", "-"]
    assert apply(spark, c.iso_date, ["2024-02-29", " 20240229 ", "2024-2-9", "2023-02-29", "", None]) == [date(2024, 2, 29)] * 2 + [None] * 4
