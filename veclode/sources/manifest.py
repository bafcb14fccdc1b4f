"""The manifest: which directories make up a dataset, and what is in them. It is replaced in one step."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

NAME = "manifest.json"


@dataclass
class Vector:
    name: str
    shape: list[int]
    dtype: str
    parts: list[str]


@dataclass
class Manifest:
    rows: int = 0
    schema: str | None = None  # Spark's JSON of the table's schema
    dtypes: dict[str, str] = field(default_factory=dict)  # the columns' types as they came
    parts: list[str] = field(default_factory=list)
    vectors: list[Vector] = field(default_factory=list)
    streams: dict[str, int] = field(default_factory=dict)  # the last batch appended by each stream

    def vector(self, name: str) -> Vector | None:
        return next((v for v in self.vectors if v.name == name), None)


class Store:
    """Files below a dataset's path, in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{NAME}"))

    def load(self) -> Manifest:
        stream = self._fs.open(self._path(f"{self.path}/{NAME}"))
        try:
            raw = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if raw.pop("format", None) != 1:
            raise ValueError("Invalid manifest")
        return Manifest(**raw | {"vectors": [Vector(**v) for v in raw["vectors"]]})

    def save(self, manifest: Manifest) -> None:
        """Writes beside the manifest, then renames over it: readers see the old one or the new one."""
        new, old = self._path(f"{self.path}/.{uuid.uuid4().hex}.json"), self._path(f"{self.path}/{NAME}")
        out = self._fs.create(new, True)
        out.write(json.dumps({"format": 1, **asdict(manifest)}).encode())
        out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(context.makeQualified(new), context.makeQualified(old), options)

    def new_part(self, kind: str) -> str:
        """A fresh directory's name, relative to the dataset."""
        return f"{kind}/{uuid.uuid4().hex}"

    def full(self, parts: list[str]) -> list[str]:
        return [f"{self.path}/{p}" for p in parts]

    def listed(self) -> list[str]:
        """All parts that are there, of any version."""
        kinds = [f"{self.path}/{k}" for k in ("table", "vectors", "staged")]
        found = [s.getPath() for k in kinds if self._fs.exists(self._path(k)) for s in self._fs.listStatus(self._path(k))]
        return [f"{p.getParent().getName()}/{p.getName()}" for p in found]

    def drop(self, parts: list[str]) -> None:
        for p in self.full(parts):
            self._fs.delete(self._path(p), True)
