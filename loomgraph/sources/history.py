"""Versions of a graph, one after the other, by any number of writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from loomgraph.operators.graph import Graph
from loomgraph.sources.commits import Log, Manifest
from loomgraph.sources.snapshots import read_snapshot, write_snapshot


class History:
    """A version's data is a snapshot in a folder of its own; a manifest names the folder and the version that it was made from.

    commit() applies a change to the latest version. Of two writers that start from the same version one is first; the other's change is
    applied anew to what the first one has written, so both changes are in the end there, each once. A batch of a stream is published
    once, however often it is run: after a stop between publishing and whatever comes next, it is found in the manifest.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, Log(spark, path)

    def version(self) -> int:
        """The latest version's number, 0 where there is none."""
        last = self.log.latest()
        return last.version if last else 0

    def read(self, version: int | None = None) -> Graph:
        """A version, or the latest; before the first one, an empty graph."""
        found = self.log.latest() if version is None else self.log.read(version)
        return self._graph(found)

    def _graph(self, manifest: Manifest | None) -> Graph:
        return read_snapshot(self.spark, manifest.content["folder"]) if manifest else Graph()

    def commit(self, change: Callable[[Graph], Graph], batch: tuple[str, int] | None = None) -> int:
        """The number of the new version, or of that which the batch had already."""
        made: list[str] = []

        def make(last: Manifest | None) -> dict:
            if made:  # another writer was faster
                self.log.drop(made.pop())
            folder = self.log.new_folder("graph")
            write_snapshot(change(self._graph(last)), folder)
            made.append(folder)
            return {"folder": folder}

        return self.log.commit(make, batch).version
