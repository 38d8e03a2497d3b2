"""Landed JSON responses as a data source of Spark: ``spark.read.format("landed_json")``, and as a stream of files.

A declaration names fields by dotted paths.  Files below a folder (a URI that driver and executors share) hold a response
per line; a partition is a run of files of bounded size, read by the task that gets it.  Filters on ``file`` (a name, its
beginning, or one of some names) leave out files before anything is read.  A stream goes on behind the last file name, so files must land
under names that grow."""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StringType, StructField, StructType

#: Bytes of the files that a task reads, unless the option part_bytes says otherwise.
PART_BYTES = 64 << 20
#: Lines of a batch.
LINES = 4_000


def at_path(value: object, path: str) -> str | None:
    """What stands at a dotted path of a JSON value, numbers being list places, as text; None where a step is missing or nothing is there."""
    for step in path.split("."):
        if isinstance(value, dict):
            value = value.get(step)
        elif isinstance(value, list) and step.isdigit() and int(step) < len(value):
            value = value[int(step)]
        else:
            return None
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


@dataclass
class Files(InputPartition):
    paths: list[str]


def _listed(folder: str) -> list[tuple[str, str, int]]:
    """Name, path and bytes of the files below a folder, by name; hidden files and marks are left out."""
    fs, root = pafs.FileSystem.from_uri(folder)
    found = [f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if f.is_file and f.base_name[0] not in "._"]
    return sorted((f.path[len(root) :].lstrip("/"), f.path, f.size) for f in found)


def _parts(files: list[tuple[str, str, int]], most: int) -> list[Files]:
    out, size = [], most
    for _, path, n in files:
        if size >= most:
            out.append(Files([]))
            size = 0
        out[-1].paths.append(path)
        size += n
    return out


class _Read:
    def __init__(self, options: dict, schema: StructType) -> None:
        self.folder, self.fields = options["path"], json.loads(options["fields"])
        self.names = [f.name for f in schema.fields]
        self.most = int(options.get("part_bytes", PART_BYTES))

    def rows(self, paths: list[str]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        kinds = pa.schema([(n, pa.string()) for n in self.names])
        for path in paths:
            held: list[dict] = []
            with fs.open_input_stream(path) as f:
                for line in io.TextIOWrapper(f, "utf-8", "replace", "\n"):
                    try:
                        value = json.loads(line)
                    except ValueError:  # what isn't JSON has no fields
                        value = None
                    held.append({"file": path[len(root) :].lstrip("/"), **{n: at_path(value, p) for n, p in self.fields.items()}})
                    if len(held) == LINES:
                        yield pa.RecordBatch.from_pylist(held, kinds)
                        held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, kinds)


class LandedReader(DataSourceReader, _Read):
    wanted = staticmethod(lambda name: True)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on ``file`` choose files; all others, and those too, are also left to Spark."""
        kept = []
        for f in filters:
            if getattr(f, "attribute", None) == ("file",):
                if isinstance(f, EqualTo):
                    kept.append(lambda name, v=f.value: name == v)
                elif isinstance(f, In):
                    kept.append(lambda name, v=frozenset(f.value): name in v)
                elif isinstance(f, StringStartsWith):
                    kept.append(lambda name, v=f.value: name.startswith(v))
            yield f
        self.wanted = lambda name: all(k(name) for k in kept)

    def partitions(self) -> list[Files]:
        return _parts([f for f in _listed(self.folder) if self.wanted(f[0])], self.most)

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        return self.rows(partition.paths if partition else [])


class LandedStream(DataSourceStreamReader, _Read):
    def initialOffset(self) -> dict:
        return {"behind": ""}

    def latestOffset(self) -> dict:
        files = _listed(self.folder)
        return {"behind": files[-1][0] if files else ""}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _parts([f for f in _listed(self.folder) if start["behind"] < f[0] <= end["behind"]], self.most)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.rows(partition.paths)


class LandedJson(DataSource):
    """Options: path (folder), fields (JSON of names and dotted paths), part_bytes.  Columns: file, then the fields as texts, null where nothing is."""

    @classmethod
    def name(cls) -> str:
        return "landed_json"

    def schema(self) -> StructType:
        return StructType([StructField("file", StringType()), *(StructField(n, StringType()) for n in json.loads(self.options["fields"]))])

    def reader(self, schema: StructType) -> LandedReader:
        return LandedReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> LandedStream:
        return LandedStream(dict(self.options), schema)


def landed(spark: SparkSession, folder: str, fields: dict[str, str], stream: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """The responses in a folder with their declared fields; filters on ``file`` are pushed down (the session's setting for that is switched on).

    Spark keeps one reader, with its filters, for each frame that is loaded: load it again for another filter in the same query."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedJson)
    source = spark.readStream if stream else spark.read
    return source.format("landed_json").option("path", folder).option("fields", json.dumps(fields)).option("part_bytes", part_bytes).load()
