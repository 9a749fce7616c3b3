"""Open registries of metrics, ranks, schedules and dataset readers.

Registration is explicit (``lehrplan.plans`` imports the built-in entries); ids are
unique, lookups of unknown ids raise, and tags can be filtered either on the driver
(`ids`) or as a DataFrame (`frame` + `tagged`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F


class DuplicateEntry(ValueError):
    pass


class MissingEntry(KeyError):
    pass


@dataclass(frozen=True)
class Entry:
    id: str
    build: Callable[..., Any]
    tags: tuple[str, ...] = ()
    config: dict[str, Any] = field(default_factory=dict)


class Registry:
    def __init__(self, name: str):
        self.name = name
        self._entries: dict[str, Entry] = {}

    def register(self, id: str, tags: Iterable[str] = (), **config: Any):
        """Decorator adding a function under ``id``; keyword arguments are its defaults."""
        def add(build: Callable[..., Any]) -> Callable[..., Any]:
            if id in self._entries:
                raise DuplicateEntry(f"{self.name} already has an entry '{id}'")
            self._entries[id] = Entry(id, build, tuple(tags), config)
            return build
        return add

    def get(self, id: str) -> Entry:
        if id not in self._entries:
            raise MissingEntry(f"{self.name} has no entry '{id}'; known: {', '.join(self)}")
        return self._entries[id]

    def ids(self, tags: Iterable[str] = ()) -> list[str]:
        """Ids whose entries carry all of ``tags``, in registration order."""
        wanted = set(tags)
        return [e.id for e in self._entries.values() if wanted <= set(e.tags)]

    def split(self, requested: Iterable[str]) -> tuple[list[str], list[str]]:
        """(known, unknown) ids; ``all`` stands for every registered id."""
        requested = list(requested)
        if requested == ["all"]:
            return self.ids(), []
        return ([r for r in requested if r in self._entries],
                [r for r in requested if r not in self._entries])

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(e.id, list(e.tags)) for e in self._entries.values()]
        return spark.createDataFrame(rows, "id string, tags array<string>")

    def __contains__(self, id: str) -> bool:
        return id in self._entries

    def __iter__(self) -> Iterator[str]:
        return iter(self._entries)

    def __len__(self) -> int:
        return len(self._entries)


def tagged(entries: DataFrame, tags: Iterable[str], column: str = "tags") -> DataFrame:
    """Rows whose tag array contains every wanted tag."""
    wanted = F.array(*[F.lit(t) for t in tags]).cast("array<string>")
    return entries.where(F.forall(wanted, lambda t: F.array_contains(F.col(column), t)))


def unknown(requested: DataFrame, registered: DataFrame, column: str = "id") -> DataFrame:
    """Requested ids without an entry, once each."""
    return requested.select(column).distinct().join(
        registered.select(column), column, "left_anti")


METRICS = Registry("metrics")
RANKS = Registry("ranks")
SCHEDULES = Registry("schedules")
DATASETS = Registry("datasets")
