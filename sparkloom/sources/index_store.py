"""A versioned index of nodes that is synchronised with a corpus and can't be seen half-written.

Layout below one folder: ``nodes/version=N`` has the nodes that sync N inserted, ``manifest/version=N``
every source with its value and the version that holds its nodes, and ``CURRENT`` names the version
that readers take. A sync inserts the replacements first, then writes the manifest, then swaps the
pointer in one rename; stale nodes are cleared away last. Whatever stops it, readers see the old index
or the new one, whole, and the next sync begins from there.

Only changed sources are written again: a version's nodes stay where they are while any source of the
manifest points at them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.sync import manifest_diff

#: The steps of a sync, in order; ``before`` is called with each of them.
STEPS = ("insert", "manifest", "pointer", "clear")


class EmptyCorpus(RuntimeError):
    """Nothing to index: the index stays as it is."""


class IncompleteIndex(RuntimeError):
    """A read-only index has nothing to read."""


class IndexStore:
    """Nodes (source and others) and the manifest (source, value) of a corpus, in ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._file("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, name: str) -> object:
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def current(self) -> int | None:
        """The version that readers take; None before the first sync and where the pointer can't be read."""
        pointer = self._file("CURRENT")
        if not self._fs.exists(pointer):
            return None
        stream = self._fs.open(pointer)
        try:
            text = bytes(stream.readAllBytes()).decode(errors="replace").strip()
        finally:
            stream.close()
        return int(text) if text.isdigit() else None

    def _swap(self, version: int) -> None:
        fresh = self._file(f".CURRENT-{uuid.uuid4().hex}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(str(version), "ascii"))
        out.close()
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, self._file("CURRENT"), overwrite)

    def manifest(self, version: int | None = None) -> DataFrame | None:
        """(source, value, held): every source of the index and the version that holds its nodes."""
        version = self.current() if version is None else version
        return None if version is None else self.spark.read.parquet(f"{self.path}/manifest/version={version}")

    def nodes(self) -> DataFrame | None:
        """The index's nodes. Versions that no source points at are not opened; stale nodes of the others find no source."""
        manifest = self.manifest()
        if manifest is None:
            return None
        versions = [r["held"] for r in manifest.select("held").distinct().collect()]  # one a sync that still has nodes
        if not versions:
            return self.spark.read.option("basePath", f"{self.path}/nodes").parquet(f"{self.path}/nodes").where("false").drop("version")
        files = self.spark.read.option("basePath", f"{self.path}/nodes").parquet(*[f"{self.path}/nodes/version={v}" for v in versions])
        live = manifest.select("source", F.col("held").alias("version"))
        return files.join(live, ["source", "version"], "left_semi").drop("version")

    def changes(self, snapshot: DataFrame) -> DataFrame:
        """(source, change) of ``snapshot`` (source, value) against the manifest; all added before the first sync."""
        manifest = self.manifest()
        then = snapshot.where("false") if manifest is None else manifest.select("source", "value")
        return manifest_diff(snapshot.select("source", "value"), then, "source", "value")

    def sync(self, snapshot: DataFrame, load: Callable[[DataFrame], DataFrame], read_only: bool = False, before: Callable[[str], None] = lambda step: None) -> dict[str, int]:
        """Brings the index to ``snapshot`` (source, value): counts of what was added, modified and removed.

        ``load`` gives the nodes of the sources (source) it is handed. A read-only index is never
        written: it must have nodes, and differences are counted and left alone. An empty snapshot,
        and a first sync without a node, leave the index as it was and raise.
        """
        version = self.current()
        if read_only:
            if version is None or not self.nodes().limit(1).count():
                raise IncompleteIndex(f"no nodes in {self.path}")
            return {r["change"]: r["count"] for r in self.changes(snapshot).groupBy("change").count().collect()} | {"version": version}
        if not snapshot.limit(1).count():
            raise EmptyCorpus("no source in the corpus")
        changed = self.changes(snapshot)
        counts = {r["change"]: r["count"] for r in changed.groupBy("change").count().collect()}
        if version is not None and not counts:
            return {"version": version}
        fresh = 0 if version is None else version + 1
        renewed = changed.where("change <> 'removed'").select("source")
        before("insert")
        load(renewed).write.mode("overwrite").parquet(f"{self.path}/nodes/version={fresh}")
        if version is None and not self.spark.read.parquet(f"{self.path}/nodes/version={fresh}").limit(1).count():
            raise EmptyCorpus("the corpus gave no nodes")
        before("manifest")
        rows = snapshot.select("source", "value").join(renewed.withColumn("new", F.lit(True)), "source", "left")
        if version is None:
            rows = rows.withColumn("held", F.lit(fresh))
        else:
            old = self.manifest(version).select("source", F.col("held").alias("was"))
            rows = rows.join(old, "source", "left").withColumn("held", F.when(F.col("new"), fresh).otherwise(F.coalesce("was", F.lit(fresh))))
        rows.select("source", "value", "held").write.mode("overwrite").parquet(f"{self.path}/manifest/version={fresh}")
        before("pointer")
        self._swap(fresh)
        before("clear")
        self.clear()
        return counts | {"version": fresh}

    def clear(self) -> None:
        """Removes versions that no source points at, and manifests but the current one: what is left of earlier syncs."""
        current = self.current()
        if current is None:
            return
        live = {r["held"] for r in self.manifest(current).select("held").distinct().collect()}
        for folder, keep in (("nodes", live or {current}), ("manifest", {current})):
            for status in self._fs.listStatus(self._file(folder)):
                name = status.getPath().getName()
                if name.startswith("version=") and int(name.removeprefix("version=")) not in keep:
                    self._fs.delete(status.getPath(), True)
