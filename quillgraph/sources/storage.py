"""Named values in a folder of any store that Spark opens, or in memory; and vector stores by kind."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quillgraph.functions.session import remove


class FolderStorage:
    """Texts and tables under names in one folder; errors are raised."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        if not name or name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"no name within the folder: {name!r}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        path, store = self._path(name)
        return store.exists(path)

    def get(self, name: str) -> str | None:
        """A text by name, null where there is none."""
        if not self.has(name):
            return None
        rows = self.spark.read.text(f"{self.folder}/{name}", wholetext=True).collect()
        return rows[0]["value"] if rows else ""

    def set(self, name: str, value: str) -> None:
        path, store = self._path(name)
        out = store.create(path, True)
        try:
            out.write(bytearray(value.encode()))
        finally:
            out.close()

    def delete(self, name: str) -> None:
        self._path(name)
        remove(self.spark, f"{self.folder}/{name}")

    def child(self, name: str) -> FolderStorage:
        self._path(name)
        return FolderStorage(self.spark, f"{self.folder}/{name}")

    def find(self, pattern: str) -> Iterator[tuple[str, dict[str, str]]]:
        """(name, named groups) of the files whose name under the folder fits, in order."""
        wanted, jvm = re.compile(pattern), self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.folder)
        store = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(top):
            return
        start, files, names = store.getFileStatus(top).getPath().toString(), store.listFiles(top, True), []
        while files.hasNext():
            names.append(files.next().getPath().toString()[len(start) + 1 :])
        for name in sorted(names):
            if m := wanted.search(name):
                yield name, m.groupdict()

    def write_table(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def read_table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


class MemoryStorage:
    """The same for one process: values in a dictionary, tables as they are, ``behind`` asked for what is missing."""

    def __init__(self, behind: FolderStorage | MemoryStorage | None = None):
        self.held: dict[str, Any] = {}
        self.behind = behind

    def has(self, name: str) -> bool:
        return name in self.held or bool(self.behind and self.behind.has(name))

    def get(self, name: str) -> str | None:
        return self.held[name] if name in self.held else self.behind.get(name) if self.behind else None

    def set(self, name: str, value: str) -> None:
        self.held[name] = value

    def delete(self, name: str) -> None:
        self.held.pop(name, None)

    def child(self, name: str) -> MemoryStorage:
        made = MemoryStorage(self.behind.child(name) if self.behind else None)
        made.held = {k[len(name) + 1 :]: v for k, v in self.held.items() if k.startswith(f"{name}/")}
        return made

    def find(self, pattern: str) -> Iterator[tuple[str, dict[str, str]]]:
        for name in sorted(self.held):
            if m := re.search(pattern, name):
                yield name, m.groupdict()

    write_table = set

    def read_table(self, name: str) -> DataFrame:
        return self.held[name] if name in self.held else self.behind.read_table(name)


STORAGES: dict[str, Callable[..., Any]] = {"folder": FolderStorage, "memory": lambda *_: MemoryStorage()}


def register_storage(kind: str, make: Callable[..., Any]) -> None:
    STORAGES[kind] = make


def open_storage(kind: str, *args: Any) -> Any:
    """A storage by its kind; kinds are registered by name."""
    if kind not in STORAGES:
        raise ValueError(f"unknown kind of storage {kind!r}")
    return STORAGES[kind](*args)


class VectorStore:
    """A table of (id, vector, attributes) in Parquet with searches over it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.only: list[Any] | None = None

    def load(self, df: DataFrame, overwrite: bool = True) -> None:
        from quillgraph.sources.files import write_vectors

        write_vectors(df, self.path, overwrite=overwrite)

    def filter_by_id(self, ids: list[Any]) -> VectorStore:
        """A view of the store for the searches that follow."""
        made = VectorStore(self.spark, self.path)
        made.only = list(ids)
        return made

    def rows(self) -> DataFrame:
        df = self.spark.read.parquet(self.path)
        return df if self.only is None else df.where(df["id"].isin(self.only))

    def by_vector(self, query: DataFrame, k: int, metric: str = "l2") -> DataFrame:
        from quillgraph.operators.vectors import knn

        return knn(self.rows(), query, k, metric)

    def by_text(self, text: str, embed, k: int, metric: str = "l2") -> DataFrame:
        from quillgraph.operators.vectors import knn_by_text

        return knn_by_text(self.rows(), text, embed, k, metric)


class IvfStore(VectorStore):
    """The same over an inverted-file index; searches open the lists that may hold an answer and are exact
    unless ``probes`` says how many lists to open. Each search writes its rows beside the index."""

    def __init__(self, spark: SparkSession, path: str, probes: int | None = None):
        super().__init__(spark, path)
        self.probes = probes

    def load(self, df: DataFrame, overwrite: bool = True) -> None:
        from quillgraph.operators.ivf import build

        build(df if overwrite else self.rows().unionByName(df.select("id", df["vector"].cast("array<double>").alias("vector"))), self.path)

    def filter_by_id(self, ids: list[Any]) -> IvfStore:
        made = IvfStore(self.spark, self.path, self.probes)
        made.only = list(ids)
        return made

    def rows(self) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/rows").select("id", "vector")
        return df if self.only is None else df.where(df["id"].isin(self.only))

    def by_vector(self, query: DataFrame, k: int, metric: str = "l2") -> DataFrame:
        from quillgraph.operators.ivf import IvfIndex, search

        if metric != "l2":
            raise ValueError(f"an inverted file is searched by l2, not {metric!r}")
        only = None if self.only is None else self.rows().select("id")
        folder = f"{self.path}/found-{uuid.uuid4().hex}"
        return search(IvfIndex(self.spark, self.path), query, k, folder, self.probes or 8, self.probes is None, only)

    def by_text(self, text: str, embed, k: int, metric: str = "l2") -> DataFrame:
        asked = self.spark.createDataFrame([(0, text)], "query_id int, q string").where("trim(q) <> ''")
        return self.by_vector(asked.select("query_id", embed(asked["q"]).alias("query_vector")), k, metric)


VECTOR_STORES: dict[str, Callable[..., Any]] = {"parquet": VectorStore, "ivf": IvfStore}


def register_vector_store(kind: str, make: Callable[..., Any]) -> None:
    VECTOR_STORES[kind] = make


def open_vector_store(kind: str, *args: Any) -> Any:
    if kind not in VECTOR_STORES:
        raise ValueError(f"unknown kind of vector store {kind!r}")
    return VECTOR_STORES[kind](*args)
