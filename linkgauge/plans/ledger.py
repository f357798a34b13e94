"""Steps of a long job, each written once however often a driver tries it.

Every attempt at a step writes to a folder of its own. A step counts from the moment its entry is there: a small file that names
the attempt and what the driver needs to go on. Readers look at entries only, so what a failed or repeated
attempt left behind is never read. A job with a name keeps its ledger between drivers, and takes up where the last one stopped.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .loop import append, checkpoint_folder

ENTRY = ".entry"


class Attempt:
    """One try at a step. ``add`` writes rows; ``value`` goes into the step's entry."""

    def __init__(self, path: str):
        self.path, self.written, self.value = path, False, None

    def add(self, frame: DataFrame) -> None:
        append(frame, self.path)
        self.written = True


class Ledger:
    """The steps of one job, in the shared folder under ``name``, or under a name that nobody else has."""

    def __init__(self, spark: SparkSession, name: str | None = None):
        self.spark, self.named = spark, name is not None
        # the context adds a folder for each session, which a later driver would not find
        shared = checkpoint_folder(spark).rsplit("/", 1)[0]
        self.folder = f"{shared}/ledger-{name or uuid.uuid4().hex}"

    def _path(self, name: str) -> tuple[Any, Any]:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(context._jsc.hadoopConfiguration()), path

    @contextmanager
    def step(self, name: str) -> Iterator[Attempt]:
        """An attempt at a step, which counts once the block ends without an error."""
        attempt = Attempt(f"{self.folder}/{name}-{uuid.uuid4().hex}")
        yield attempt
        self._enter(name, {"path": attempt.path if attempt.written else None, "value": attempt.value})

    def _enter(self, name: str, entry: dict) -> None:
        # written aside and renamed, so that an entry is there whole or not at all; the first one stays
        files, aside = self._path(f"{name}-{uuid.uuid4().hex}.new")
        stream = files.create(aside, False)
        stream.write(json.dumps(entry).encode())
        stream.close()
        _, place = self._path(name + ENTRY)
        if files.exists(place) or not files.rename(aside, place):
            files.delete(aside, False)

    def entries(self) -> dict[str, dict]:
        """The entry of every finished step."""
        files, folder = self._path("")
        if not files.exists(folder):
            return {}
        found = {}
        for status in files.listStatus(folder):
            name = status.getPath().getName()
            if name.endswith(ENTRY):
                stream = files.open(status.getPath())
                found[name.removesuffix(ENTRY)] = json.loads(bytes(stream.readAllBytes()).decode())
                stream.close()
        return found

    def note(self, name: str, make: Callable[[], Any]) -> Any:
        """A value that the first driver settles and all later ones keep."""
        entry = self.entries().get(name)
        if entry is None:
            with self.step(name) as attempt:
                attempt.value = make()
            entry = self.entries()[name]
        return entry["value"]

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that the first driver writes and all later ones read."""
        entry = self.entries().get(name)
        if entry is None:
            with self.step(name) as attempt:
                attempt.add(make())
            entry = self.entries()[name]
        return self.spark.read.parquet(entry["path"])

    def read(self, schema: str, *prefixes: str) -> DataFrame:
        """The rows of all finished steps whose names begin with one of ``prefixes``."""
        paths = [e["path"] for name, e in self.entries().items() if name.startswith(prefixes) and e["path"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def belongs_to(self, **tables: DataFrame) -> None:
        """Raise if the job was begun on other tables. They are known by their rows, in whatever order."""
        if not self.named:
            return
        seen = {}
        for name, frame in tables.items():
            mark = F.xxhash64(*frame.columns)
            row = frame.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(mark).alias("xor"),
                            F.sum(mark.cast("decimal(38,0)")).cast("string").alias("sum")).first()
            seen[name] = [row["rows"], row["xor"], row["sum"]]
        if self.note("tables", lambda: seen) != seen:
            raise ValueError(f"{self.folder} holds a job on other tables")
