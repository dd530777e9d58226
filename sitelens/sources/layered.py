"""Layered feature collections as a data source: a folder with one collection file per layer and task, and a manifest.

Files are GeoJSON collections of one layer, a feature a line. A write is not visible before its manifest, which replaces the one before
in one step; files of failed tasks or of the write before are deleted. A read has one partition per file; the option layers reads only
the files of the layers named there."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFEST = "manifest.json"
HEAD, TAIL = '{"type":"FeatureCollection","features":[\n', "\n]}\n"


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def _manifest(path: str) -> dict:
    system, base = _folder(path)
    at = f"{base}/{MANIFEST}"
    if system.get_file_info(at).type != fs.FileType.File:
        return {"layers": {}, "files": []}
    with system.open_input_stream(at) as f:
        return json.loads(f.read())


@dataclass
class _File(InputPartition):
    name: str
    layer: str

    def __init__(self, name: str, layer: str):
        super().__init__(name)
        self.name, self.layer = name, layer


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str, int]]


class _Reader(DataSourceReader):
    def __init__(self, path: str, layers: set[str] | None):
        self.path, self.layers = path, layers

    def partitions(self) -> list[InputPartition]:
        files = [_File(f["name"], f["layer"]) for f in _manifest(self.path)["files"] if self.layers is None or f["layer"] in self.layers]
        return files or [_File("", "")]

    def read(self, partition: _File) -> Iterator[tuple[str, str]]:
        if not partition.name:
            return
        system, base = _folder(self.path)
        with system.open_input_stream(f"{base}/{partition.name}") as raw:
            for line in _lines(raw):
                if line.startswith('{"type":"Feature"') and not line.startswith(HEAD.strip()):
                    yield partition.layer, line.removesuffix(",")


def _lines(raw: pa.NativeFile) -> Iterator[str]:
    held = b""
    while chunk := raw.read(1 << 20):
        *lines, held = (held + chunk).split(b"\n")
        yield from (x.decode() for x in lines)
    if held:
        yield held.decode()


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, base = _folder(self.path)
        system.create_dir(base, recursive=True)
        task = uuid.uuid4().hex
        files: dict[str, tuple[str, pa.NativeFile]] = {}
        counts: dict[str, int] = {}
        for batch in iterator:
            for layer, feature in zip(batch.column("layer").to_pylist(), batch.column("feature").to_pylist(), strict=True):
                if layer is None or feature is None:
                    continue
                if layer not in files:
                    name = f"{layer}-{task}.geojson"
                    files[layer] = name, system.open_output_stream(f"{base}/{name}")
                    counts[layer] = 0
                files[layer][1].write((("," + "\n" if counts[layer] else HEAD) + feature).encode())
                counts[layer] += 1
        for _, f in files.values():
            f.write(TAIL.encode())
            f.close()
        return _Written([(layer, name, counts[layer]) for layer, (name, _) in files.items()])

    def commit(self, messages: list[_Written | None]) -> None:
        system, base = _folder(self.path)
        system.create_dir(base, recursive=True)
        before = _manifest(self.path)
        new = [{"layer": layer, "name": name, "features": n} for m in messages if m for layer, name, n in m.files]
        files = new if self.overwrite else before["files"] + new
        layers: dict[str, int] = {}
        for f in files:
            layers[f["layer"]] = layers.get(f["layer"], 0) + f["features"]
        draft = f"{base}/.{MANIFEST}-{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            out.write(json.dumps({"layers": dict(sorted(layers.items())), "files": files}).encode())
        system.move(draft, f"{base}/{MANIFEST}")
        for f in before["files"] if self.overwrite else []:
            system.delete_file(f"{base}/{f['name']}")

    def abort(self, messages: list[_Written | None]) -> None:
        system, base = _folder(self.path)
        for m in messages:
            for _, name, _ in m.files if m else []:
                system.delete_file(f"{base}/{name}")


class LayerCollections(DataSource):
    """Format layer_collections: option path, and for reads layers (names with commas)."""

    @classmethod
    def name(cls) -> str:
        return "layer_collections"

    def schema(self) -> str:
        return "layer string, feature string"

    def reader(self, schema) -> DataSourceReader:
        layers = self.options.get("layers")
        return _Reader(self.options["path"], None if layers is None else set(layers.split(",")))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def write_layers(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    """features(layer, feature: GeoJSON text) as collections of their layers; rows without either are left out."""
    features.sparkSession.dataSource.register(LayerCollections)
    features.select("layer", "feature").write.format("layer_collections").option("path", path).mode(mode).save()


def read_layers(spark: SparkSession, path: str, layers: list[str] | None = None) -> DataFrame:
    """(layer, feature) of the collections in a folder, of some layers only where they are named."""
    spark.dataSource.register(LayerCollections)
    reader = spark.read.format("layer_collections").option("path", path)
    return (reader if layers is None else reader.option("layers", ",".join(layers))).load()


def manifest(path: str) -> dict:
    """What the last write left: features of each layer, and its files."""
    return _manifest(path)
