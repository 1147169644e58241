"""Small catalogues as literal rows."""

from __future__ import annotations

from datetime import datetime

from lodestack import schemas

T = datetime(2024, 1, 1)


def make(spark, name, rows):
    """Rows given as dicts; what is missing is null, or the type's nothing where null isn't allowed."""
    form, need = schemas.schema(name), schemas.required(name)
    nothing = {"string": "", "bigint": 0, "int": 0, "timestamp_ntz": T, "date": T.date()}
    values = [tuple(r.get(f.name, nothing[f.dataType.simpleString()] if f.name in need else None) for f in form) for r in rows]
    return spark.createDataFrame(values, form)


def folder(id, parent, path, volume=1, **more):
    return {"id": id, "volume_id": volume, "parent_id": parent, "name": path.rpartition("/")[2] or f"root{volume}", "relative_path": path} | more


def file(id, folder_id, path, size=1, volume=1, **more):
    name = path.rpartition("/")[2]
    extension = name.rpartition(".")[2].lower() if "." in name else ""
    return {"id": id, "volume_id": volume, "folder_id": folder_id, "name": name, "relative_path": path, "extension": extension, "size_bytes": size} | more
