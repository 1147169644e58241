"""A catalogue on disk: immutable Parquet folders and one small file per version that commits it.

Folders, files and scan errors lie in one folder per volume, so a scan writes its own volume's and names the others as
they are; the small tables are one folder each. Data are written first. The version then exists once its file, which
names every folder, has been created; creating it fails if another writer published the same number. Until then readers
see the former version. What a writer left who gave up, and versions that nobody reads any more, go with ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack import schemas
from lodestack.errors import CatalogueInUse, InvalidCatalogue, UnsupportedCatalogue
from lodestack.operators.register import check_register
from lodestack.session import create_exclusively, delete_unnamed, drop_path

#: Tables with a folder per volume.
BY_VOLUME = ("folders", "files", "scan_errors")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))] if self._fs.exists(self._at(folder)) else []

    def exists(self) -> bool:
        return self._fs.exists(self._at(f"{self.path}/_versions"))

    def version(self) -> int:
        """The number of the last published version; 0 for a folder without one."""
        return max([int(n) for n in self._names(f"{self.path}/_versions") if n.isdigit()], default=0)

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._at(f"{self.path}/_versions/{version}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            manifest = json.loads(text)
        except ValueError as error:
            raise InvalidCatalogue(f"version {version} of {self.path} can't be read") from error
        if "highest" not in manifest:
            raise UnsupportedCatalogue(f"version {version} of {self.path} has an older layout of folders")
        return manifest

    def _read(self, name: str, place: str | dict[str, str], columns: str | None) -> DataFrame:
        folders = [place] if isinstance(place, str) else sorted(place.values())
        reader = self.spark.read.schema(columns) if columns else self.spark.read
        if not folders:
            return self.spark.createDataFrame([], columns or schemas.schema(name))
        return reader.parquet(*[f"{self.path}/data/{f}" for f in folders])

    def tables(self, version: int | None = None, volume: int | None = None) -> dict[str, DataFrame]:
        """All tables of a version, by default the last. Older schemas are migrated as they are read.

        With a volume the large tables are read from that volume's folders only; the small ones stay whole.
        """
        number = self.version() if version is None else version
        if not number:
            raise InvalidCatalogue(f"no catalogue at {self.path}")
        manifest = self._manifest(number)
        if manifest["schema"] > schemas.VERSION:
            raise UnsupportedCatalogue(f"schema {manifest['schema']} is newer than {schemas.VERSION}")
        places = manifest["tables"]
        if volume is not None:
            places = {n: p if isinstance(p, str) else {v: f for v, f in p.items() if v == str(volume)} for n, p in places.items()}
        found = {name: self._read(name, place, manifest["columns"].get(name)) for name, place in places.items()}
        found = schemas.migrate(found, manifest["schema"]) if manifest["schema"] < schemas.VERSION else found
        schemas.validate_schema(found)
        return found

    def highest(self, name: str, version: int | None = None) -> int:
        """The highest id that a table has ever had, so that ids are not given again; 0 where it never had a row."""
        return self._manifest(self.version() if version is None else version)["highest"].get(name, 0)

    def places(self, volume: int, version: int) -> tuple[str | None, str | None]:
        """Where a version keeps the folders and files of a volume."""
        tables = self._manifest(version)["tables"]
        return tables["folders"].get(str(volume)), tables["files"].get(str(volume))

    def create(self, tables: dict[str, DataFrame] | None = None, overwrite: bool = False) -> dict[str, DataFrame]:
        """A new catalogue, empty or of the given tables. An existing one is refused unless it is to be overwritten."""
        if self.exists() and not overwrite:
            raise InvalidCatalogue(f"{self.path} holds a catalogue already")
        empty = {name: self.spark.createDataFrame([], schemas.schema(name)) for name in schemas.COLUMNS}
        return self.publish(empty | (tables or {}))

    def write(self, name: str, df: DataFrame, volume: int | None = None) -> dict:
        """Write a table, or a volume's part of one, without publishing it; what ``commit`` takes."""
        folder = f"{name}-{uuid.uuid4().hex}"
        path = f"{self.path}/data/{folder}"
        if name not in BY_VOLUME:
            df.write.parquet(path)
            place: str | dict[str, str] = folder
        elif volume is not None:
            (df.repartitionByRange("relative_path").sortWithinPartitions("relative_path") if "relative_path" in df.columns else df).write.parquet(path)
            place = {str(volume): folder}
        else:
            key = ["volume_id", "relative_path"] if "relative_path" in df.columns else ["volume_id"]
            df.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_volume", F.col("volume_id")).write.partitionBy("_volume").parquet(path)
            place = {n.partition("=")[2]: f"{folder}/{n}" for n in self._names(path) if n.startswith("_volume=")}
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
        highest = self._read(name, place, columns).agg(F.max("id")).first()[0] if "id" in df.columns else None
        return {"name": name, "place": place, "volume": volume, "columns": columns, "highest": highest or 0}

    def commit(self, written: list[dict], base: int, schema: int = schemas.VERSION, without: int | None = None) -> dict[str, DataFrame]:
        """The version after ``base``: written tables or parts in place of the former ones, all others as they were; the
        large tables without a volume where one is to go."""
        held = self._manifest(base) if base else {"tables": {}, "columns": {}, "highest": {}}
        places, columns, highest = dict(held["tables"]), dict(held["columns"]), dict(held["highest"])
        for w in written:
            name, place = w["name"], w["place"]
            places[name] = dict(places.get(name, {})) | place if w["volume"] is not None else place
            columns[name], highest[name] = w["columns"], max(highest.get(name, 0), w["highest"])
        if without is not None:
            places |= {n: {v: f for v, f in places[n].items() if v != str(without)} for n in BY_VOLUME}
        text = json.dumps({"schema": schema, "tables": places, "columns": columns, "highest": highest})
        if not create_exclusively(self.spark, f"{self.path}/_versions/{base + 1}", text):
            raise CatalogueInUse(f"version {base + 1} of {self.path} was published by another writer")
        return self.tables(base + 1)

    def publish(self, changed: dict[str, DataFrame], base: int | None = None, schema: int = schemas.VERSION, volume: int | None = None) -> dict[str, DataFrame]:
        """The next version: some tables new, the others as they were in ``base`` (the version they were derived from).

        With a volume, ``changed`` holds that volume's part of the large tables. Volumes and register are checked first:
        names and drive ids must be unique, mirrors have a master, and dates be in order.
        """
        base = self.version() if base is None else base
        if {"volumes", "volume_register"} & set(changed):
            former = self.tables(base) if base else {}
            check_register(*[changed[n] if n in changed else former[n] for n in ("volumes", "volume_register")])
        written = [self.write(name, df, volume if name in BY_VOLUME else None) for name, df in changed.items()]
        return self.commit(written, base, schema)

    def delete_volume(self, volume_id: int) -> dict[str, DataFrame]:
        """The next version without a volume; its folders are named no more, no other volume's rows are written. A master
        that mirrors depend on can't go."""
        base = self.version()
        tables = self.tables(base)
        if not tables["volume_register"].where(F.col("master_volume_id") == volume_id).isEmpty():
            raise ValueError("mirrors depend on this volume")
        keys = {"volumes": "id", "volume_register": "volume_id", "scan_history": "volume_id"}
        written = [self.write(n, tables[n].where(F.col(key) != volume_id)) for n, key in keys.items()]
        return self.commit(written, base, without=volume_id)

    def vacuum(self, keep: int = 10, hours: float = 48) -> int:
        """Delete versions before the last ``keep`` and every folder that no kept version names and that is older than the
        hours; how many folders and versions went. Readers of a version must have ended before it is deleted."""
        numbers = sorted(int(n) for n in self._names(f"{self.path}/_versions") if n.isdigit())
        old, kept = (numbers[:-keep], numbers[-keep:]) if keep > 0 else ([], numbers)
        named = [f for v in kept for p in self._manifest(v)["tables"].values() for f in ([p] if isinstance(p, str) else p.values())]
        for v in old:
            drop_path(self.spark, f"{self.path}/_versions/{v}")
        gone = delete_unnamed(self.spark, f"{self.path}/data", {f.partition("/")[0] for f in named}, hours)
        for folder in {f.partition("/")[0] for f in named if "/" in f}:
            parts = {f.partition("/")[2] for f in named if f.startswith(f"{folder}/")}
            gone += delete_unnamed(self.spark, f"{self.path}/data/{folder}", parts | {"_SUCCESS", "._SUCCESS.crc"}, hours)
        return gone + len(old)

    def count_rows(self, name: str) -> int:
        if name not in schemas.COLUMNS:
            raise ValueError(f"no such table: {name}")
        return self.tables()[name].count()


def probe(spark: SparkSession, path: str, rows: bool = False) -> int:
    """0 if a catalogue can be opened, 2 if there is none or it is out of reach, 3 if it is damaged or too new.

    With ``rows`` every file is read as well, and columns that must hold no null are looked at.
    """
    try:
        store = Store(spark, path)
        if not store.exists():
            return 2
        tables = store.tables()
    except (InvalidCatalogue, UnsupportedCatalogue):
        return 3
    except Exception:  # noqa: BLE001
        return 2
    if rows:
        try:
            if any(not schemas.null_violations(name, df).isEmpty() for name, df in tables.items() if name in schemas.COLUMNS):
                return 3
            for df in tables.values():
                df.write.format("noop").mode("overwrite").save()
        except Exception:  # noqa: BLE001
            return 3
    return 0
