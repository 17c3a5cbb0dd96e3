"""Stages of a run declared with their inputs and parameters; what has been made of the same inputs is not made again.

A stage's fingerprint is that of its name, version, parameters and inputs; a source's is that of its files' names, sizes and
times. A result lies in <folder>/<stage>/<fingerprint>. Stages that are there are read, others made and written; clean()
removes the results that the present declaration does not name, which a reset of the run does with all of them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Stage:
    """work(inputs by name, parameters) gives a stage's rows; version is raised when work changes."""

    name: str
    work: Callable[[Mapping[str, DataFrame], Mapping[str, object]], DataFrame]
    inputs: Sequence[str]
    parameters: Mapping[str, object] = field(default_factory=dict)
    version: int = 1


class Workflow:
    """Stages over sources (name: path of parquet files), with results below folder; names are of one space and stages follow their inputs."""

    def __init__(self, spark: SparkSession, folder: str, sources: Mapping[str, str], stages: Sequence[Stage]):
        self.spark, self.folder, self.sources, self.stages = spark, folder.rstrip("/"), dict(sources), list(stages)
        seen = set(self.sources)
        for s in self.stages:
            if s.name in seen or not set(s.inputs) <= seen:
                raise ValueError(f"stage {s.name}: its name is taken, or an input comes later or is unknown: {sorted(set(s.inputs) - seen)}")
            seen.add(s.name)
        self._hadoop, self._conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        path = self._hadoop.fs.Path(name)
        return path.getFileSystem(self._conf), path

    def _files(self, name: str) -> list[tuple[str, int, int]]:
        fs, path = self._at(name)
        if not fs.exists(path):
            raise FileNotFoundError(name)
        found, it = [], fs.listFiles(path, True)
        while it.hasNext():
            x = it.next()
            found.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
        return sorted(found)

    def fingerprints(self) -> dict[str, str]:
        """Of every source and stage; no row is read."""
        print_ = lambda *parts: hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:24]
        out = {name: print_(self._files(path)) for name, path in self.sources.items()}
        for s in self.stages:
            out[s.name] = print_(s.name, s.version, dict(s.parameters), [out[i] for i in s.inputs])
        return out

    def _done(self, path: str) -> StructType | None:
        """The schema of a finished result."""
        fs, mark = self._at(f"{path}/_stage.json")
        if not fs.exists(mark):
            return None
        stream = fs.open(mark)
        try:
            return StructType.fromJson(json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def run(self) -> tuple[dict[str, DataFrame], list[str]]:
        """Results of all stages by name, and the names of those that had to be made. With nothing to make no job is started."""
        prints, made = self.fingerprints(), []
        frames: dict[str, DataFrame | None] = dict.fromkeys(self.sources)  # opened when a stage needs them
        for s in self.stages:
            path = f"{self.folder}/{s.name}/{prints[s.name]}"
            schema = self._done(path)
            if schema is None:
                for i in s.inputs:
                    if frames[i] is None:
                        frames[i] = self.spark.read.parquet(self.sources[i])
                rows = s.work({i: frames[i] for i in s.inputs}, s.parameters)
                rows.write.mode("overwrite").parquet(path)  # what a killed run has left is written over
                schema = rows.schema
                fs, mark = self._at(f"{path}/_stage.json")
                out = fs.create(mark, True)
                out.write(bytearray(json.dumps(schema.jsonValue()).encode()))
                out.close()
                made.append(s.name)
            frames[s.name] = self.spark.read.schema(schema).parquet(path)
        return {s.name: frames[s.name] for s in self.stages}, made

    def clean(self, *, all_: bool = False) -> list[str]:
        """Remove results of other fingerprints (with all_ every result) of the declared stages; returns their paths below folder."""
        prints, away = {} if all_ else self.fingerprints(), []
        for s in self.stages:
            fs, path = self._at(f"{self.folder}/{s.name}")
            for x in fs.listStatus(path) if fs.exists(path) else []:
                name = x.getPath().getName()
                if name != prints.get(s.name):
                    fs.delete(x.getPath(), True)
                    away.append(f"{s.name}/{name}")
        return sorted(away)
