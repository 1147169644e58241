"""Scalars of the catalogue as column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.text import strip

# Extensions by type, and the labels of the types.
TYPES = {
    "video": ("Video", "mp4 mov mkv avi wmv webm m4v"),
    "audio": ("Audio", "mp3 wav flac aac m4a ogg wma"),
    "image": ("Image", "jpg jpeg png tif tiff gif bmp webp heic"),
    "text": ("Text", "txt md markdown rst log csv json xml yaml yml"),
    "pdf": ("PDF", "pdf"),
    "office": ("Office Document", "doc docx xls xlsx ppt pptx odt ods odp rtf"),
    "archive": ("Archive", "zip rar 7z tar gz bz2 xz iso"),
    "executable": ("Executable", "exe msi app bat cmd com sh run deb rpm dmg"),
}
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]
DRIVE_ID = r"^AID-(\d{3,})$"
TIME_TEXT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def utc(at: datetime | Column | None) -> Column:
    """A UTC time without zone as a column, whatever zone the session or this machine is in."""
    if isinstance(at, Column):
        return at
    return F.lit(None if at is None else at.isoformat(sep=" ")).cast("timestamp_ntz")


def extension_of(name: Column) -> Column:
    """The last suffix of a file name in lower case without its dot; dot-files and a trailing dot have none."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1))


def bare_extension(extension: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(extension, F.lit(""))), r"^\.+", "")


def _by_type(extension: Column, what: int, otherwise: Column) -> Column:
    chain = F.when(extension == "", F.lit("File") if what == 0 else F.lit("unknown"))
    for key, (label, members) in TYPES.items():
        chain = chain.when(extension.isin(members.split()), label if what == 0 else key)
    return chain.otherwise(otherwise)


def type_label(extension: Column) -> Column:
    """One of eight labels, else the extension in capitals, ``File`` without one."""
    bare = bare_extension(extension)
    return _by_type(bare, 0, F.upper(bare))


def category(extension: Column) -> Column:
    return _by_type(bare_extension(extension), 1, F.lit("unknown"))


def property_label(extension: Column) -> Column:
    """``MP4 video``; ``PDF file`` where the label is the extension itself; ``File`` without one."""
    bare, label = bare_extension(extension), type_label(extension)
    shown = F.upper(bare)
    return F.when(bare == "", "File").when(F.upper(label) == shown, F.concat(shown, F.lit(" file"))).otherwise(F.concat(shown, F.lit(" "), F.lower(label)))


def format_size(size: Column) -> Column:
    """Decimal units with one place, half to even; the unit is chosen before rounding. Null counts as 0."""
    value = F.coalesce(size, F.lit(0)).cast("double")
    chain, divided = F.when(value < 1000, F.concat(value.cast("bigint").cast("string"), F.lit(" B"))), value
    for unit in SIZE_UNITS[1:]:
        divided = divided / F.lit(1000.0)
        text = F.concat(F.call_function("format_number", divided, F.lit("0.0")), F.lit(f" {unit}"))
        chain = chain.otherwise(text) if unit == "TB" else chain.when(divided < 1000, text)
    return chain


def percentage_full(used: Column, capacity: Column) -> Column:
    """0 to 100, half to even; 0 without a capacity."""
    share = F.rint(F.coalesce(used, F.lit(0)) / capacity * 100)
    return F.when(capacity.isNull() | (capacity == 0), 0).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), share))).cast("int")


def display_path(path: Column) -> Column:
    return F.when(F.coalesce(path, F.lit("")) == "", "/").otherwise(path)


def parent_path(path: Column) -> Column:
    """The path without its last segment; null for the root itself."""
    parts = F.split(path, "/")
    return F.when(path == "", None).otherwise(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def join_path(root: Column, relative: Column) -> Column:
    """Root and relative path with one slash between; empty and ``.`` segments of the relative path disappear."""
    parts = F.filter(F.split(F.coalesce(relative, F.lit("")), "/"), lambda p: (p != "") & (p != "."))
    tail = F.array_join(parts, "/")
    return F.when(tail == "", root).otherwise(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), tail))


def display_time(at: Column, zone: str = "UTC") -> Column:
    """Minutes in the given zone; ``-`` where unknown. The time is UTC without zone."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), at.cast("timestamp_ntz"))
    return F.coalesce(F.date_format(local, "yyyy-MM-dd HH:mm"), F.lit("-"))


def time_text(at: Column) -> Column:
    """The stored text form of a UTC time."""
    return F.concat(F.date_format(at, TIME_TEXT), F.lit("+0000"))


def parse_time(text: Column) -> Column:
    """A time from its stored text form, in UTC; null for anything else."""
    return F.try_to_timestamp(text, F.lit(f"{TIME_TEXT}Z"))


def iso_date(text: Column) -> Column:
    """A calendar date from ``yyyy-mm-dd`` or ``yyyymmdd``; null where blank or no such date."""
    bare = strip(text)
    dashed = F.when(bare.rlike(r"^\d{8}$"), F.regexp_replace(bare, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(bare)
    return F.when(dashed.rlike(r"^\d{4}-\d{2}-\d{2}$"), dashed.try_cast("date"))


def wrap_uint64(identity: Column) -> Column:
    """An unsigned 64-bit identity as a signed one; 0, negative and too large numbers are unknown."""
    wide = identity.cast("decimal(38,0)")
    limit, whole = F.lit(str(2**63)).cast("decimal(38,0)"), F.lit(str(2**64)).cast("decimal(38,0)")
    wrapped = F.when((wide <= 0) | (wide >= whole), None).when(wide < limit, wide).otherwise(wide - whole)
    return wrapped.cast("bigint")


def drive_sequence(drive_id: Column) -> Column:
    """The number of an ``AID-`` drive id; null for other ids."""
    return F.nullif(F.regexp_extract(drive_id, DRIVE_ID, 1), F.lit("")).try_cast("bigint")


def drive_sort_key(drive_id: Column) -> Column:
    """Numbered ids by number, then all others by their letters without case."""
    number = drive_sequence(drive_id)
    folded = F.lower(strip(drive_id))
    return F.struct(F.when(number.isNull(), 1).otherwise(0).alias("kind"), F.coalesce(number, F.lit(0)).alias("number"), folded.alias("text"))


def suggested_drive_id(label: Column) -> Column:
    """A label that has the form of a drive id, in capitals; else null."""
    text = F.upper(strip(label))
    return F.when(text.rlike(DRIVE_ID), text)


def drive_reference(drive_id: Column, name: Column, nothing: str = "-") -> Column:
    """``drive - name``, or whichever there is."""
    drive, label = F.nullif(F.coalesce(drive_id, F.lit("")), F.lit("")), F.nullif(F.coalesce(name, F.lit("")), F.lit(""))
    return F.coalesce(F.concat(drive, F.lit(" - "), label), drive, label, F.lit(nothing))


def display_size(size: Column) -> Column:
    return F.when(size.isNull(), "Unknown").otherwise(format_size(size))


def display_count(count: Column) -> Column:
    return F.when(count.isNull(), "Unknown").otherwise(F.format_number(count, 0))


def size_delta(before: Column, after: Column) -> Column:
    """The difference with its sign."""
    change = after - before
    return F.concat(F.when(change > 0, "+").when(change < 0, "-").otherwise(""), format_size(F.abs(change)))
