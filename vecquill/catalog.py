"""Named indexes below one root folder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from .engine import VectorEngine
from .sources.files import decode_chunks


def check_name(name: str) -> str:
    """Letters and digits of any script and underscores, at most 64
    characters, not underscores alone; else ValueError."""
    if not name or len(name) > 64 or not name.replace("_", "").isalnum():
        raise ValueError(f"invalid index name: {name!r}")
    return name


class IndexCatalog:
    """Creates, loads, lists and drops indexes. An unknown name is a KeyError,
    one that is already loaded a ValueError."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._loaded: dict[str, VectorEngine] = {}

    def __enter__(self) -> IndexCatalog:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        for engine in self._loaded.values():
            engine.close()
        self._loaded.clear()

    def __len__(self) -> int:
        return len(self._loaded)

    def list(self) -> list[str]:
        """Loaded names in the order in which they were loaded."""
        return list(self._loaded)

    def get(self, name: str) -> VectorEngine:
        if name not in self._loaded:
            raise KeyError(f"index not loaded: {name}")
        return self._loaded[name]

    def create(self, name: str, dim: int, **options) -> VectorEngine:
        if check_name(name) in self._loaded:
            raise ValueError(f"index exists: {name}")
        self._loaded[name] = VectorEngine(self.spark, f"{self.root}/{name}", dim, **options)
        return self._loaded[name]

    def load(self, name: str, **options) -> VectorEngine:
        """Open an index from its files; replaces a loaded one."""
        self._loaded[name] = VectorEngine(self.spark, f"{self.root}/{check_name(name)}", 0, **options)
        return self._loaded[name]

    def drop(self, name: str, destroy: bool = False) -> None:
        """Close; with ``destroy`` delete the files too."""
        engine = self.get(name)
        engine.destroy() if destroy else engine.close()
        del self._loaded[name]

    def status(self, name: str) -> dict:
        e = self.get(name)
        return {"index_name": name, "dim": e.dim, "has_index": e.has_index, "needs_rebuild": e.needs_rebuild()}

    def init(self, name: str, mode: str) -> None:
        self.get(name).init(mode)

    def ingest(self, name: str, external_id: str, vector) -> None:
        if not external_id:
            raise ValueError("missing external_id")
        self.get(name).ingest(external_id, vector)

    def ingest_batch(self, name: str, chunks: Iterable[bytes]) -> int:
        """Fixed-width rows in chunks; rows before a broken one stay."""
        engine, n = self.get(name), 0
        for external_id, vector in decode_chunks(chunks, engine.dim):
            engine.ingest(external_id, vector)
            n += 1
        return n

    def finalize(self, name: str, optimize: bool = False, **params) -> None:
        self.get(name).finalize(optimize, **params)

    def delete(self, name: str, external_ids: list[str], return_not_found: bool = False):
        if not external_ids:
            raise ValueError("external_ids must not be empty")
        return self.get(name).delete_items(external_ids, return_not_found)

    def rebuild(self, name: str, **params) -> None:
        self.get(name).rebuild_compact(**params)

    def optimize(self, name: str) -> None:
        self.get(name).optimize_graph()

    def search(self, name: str, q, k: int = 10, efs: int = 64) -> list[str]:
        return self.get(name).search(q, k, efs)
