"""Tables that are replaced as a whole or not at all.

Nothing that readers see is ever written over. Every write goes to a folder of its own; a manifest, one
small file per version, names the folder of each table (of each batch, for growing tables), and readers
follow the newest version. A writer that fails before it publishes leaves the old tables as they were,
and a draft publishes many tables in one version, so they never disagree. There is one writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tidings.sources.sinks import write_table

_MANIFEST = "name STRING, batch INT, path STRING, version INT"


@dataclass(frozen=True)
class Place:
    """Folder of a table, or of one batch of a growing one, below the corpus folder."""

    name: str
    path: str
    batch: int | None = None


@dataclass(frozen=True)
class Layout:
    """The tables of a corpus below one folder."""

    root: str
    #: What a draft has written but not published; None outside drafts.
    staged: list[Place] | None = None

    def _published(self) -> tuple[int, list[Place]]:
        spark = SparkSession.active()
        try:
            rows = spark.read.schema(_MANIFEST).json(f"{self.root}/manifests").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        version = max((row["version"] for row in rows), default=-1)
        return version, [Place(r["name"], r["path"], r["batch"]) for r in rows if r["version"] == version]

    def places(self) -> list[Place]:
        """Where the tables are, as the newest manifest or this draft says."""
        return self._published()[1] if self.staged is None else self.staged

    def batches(self, name: str) -> set[int]:
        return {p.batch for p in self.places() if p.name == name and p.batch is not None}

    def has(self, name: str) -> bool:
        return any(p.name == name for p in self.places())

    def path(self, name: str) -> str:
        """Folder of a table that does not grow; a table that was never published has its plain name."""
        found = [p.path for p in self.places() if p.name == name]
        return f"{self.root}/{found[0] if found else name}"

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """A table; growing ones have the column ``batch``."""
        found = [p for p in self.places() if p.name == name]
        if not found or found[0].batch is None:
            return spark.read.parquet(self.path(name))
        paths = [f"{self.root}/{p.path}" for p in found]
        return spark.read.option("basePath", f"{self.root}/{name}").parquet(*paths).drop("build")

    def fresh(self, name: str, batch: int | None = None) -> Place:
        """A folder that nothing has been written to."""
        tail = "" if batch is None else f"/batch={batch}"
        return Place(name, f"{name}/build={uuid.uuid4().hex}{tail}", batch)

    def publish(self, *new: Place, anew: bool = False) -> None:
        """Let readers see new places: each takes that of its table or batch (``anew``: of all batches)."""
        names = {p.name for p in new}
        keys = {(p.name, p.batch) for p in new}
        version, now = (0, self.staged) if self.staged is not None else self._published()
        kept = [p for p in now if (p.name not in names if anew else (p.name, p.batch) not in keys)]
        if self.staged is not None:
            self.staged[:] = [*kept, *new]
            return
        self._write([*kept, *new], version + 1)

    def _write(self, places: list[Place], version: int) -> None:
        rows = [(p.name, p.batch, p.path, version) for p in places]
        manifest = SparkSession.active().createDataFrame(rows, _MANIFEST).coalesce(1)
        # A folder of this version can only be the rest of a writer that failed before its file stood.
        manifest.write.mode("overwrite").json(f"{self.root}/manifests/v={version}")

    def put(
        self, df: DataFrame, name: str, batch: int | None = None, anew: bool = False, partition_by: tuple[str, ...] = ()
    ) -> None:
        """Write a table, or one batch of it, and publish it."""
        place = self.fresh(name, batch)
        write_table(df, f"{self.root}/{place.path}", partition_by=partition_by)
        self.publish(place, anew=anew)

    def draft(self) -> Layout:
        """The tables as they are now, for changes that only this draft sees until ``commit``."""
        return replace(self, staged=list(self.places()))

    def commit(self) -> Layout:
        """Publish all changes of a draft at once."""
        corpus = replace(self, staged=None)
        version, before = corpus._published()
        if set(self.staged) != set(before):
            self._write(self.staged, version + 1)
        return corpus
