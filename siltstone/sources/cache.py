"""Tables that are kept in Spark's storage memory, the least used given up first."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from zlib import crc32

from pyspark import StorageLevel
from pyspark.sql import DataFrame

SHARDS = 16


class TableCache:
    """Persisted tables by name, of at most ``capacity`` bytes in all.

    Names fall on shards by hash, each with its share of the capacity and its own
    order of use. A table that a reader has pinned is never given up; one beyond
    its shard's share is given up as soon as nobody pins it. What is persisted is
    only a copy: a lost executor means that blocks are computed anew.
    """

    def __init__(self, capacity: int, shards: int = SHARDS):
        self.share = capacity // shards
        self.shards: list[OrderedDict[str, list]] = [OrderedDict() for _ in range(shards)]  # name -> [table, bytes, pins]

    def _shard(self, name: str) -> OrderedDict[str, list]:
        return self.shards[crc32(name.encode()) % len(self.shards)]

    def get(self, name: str) -> DataFrame | None:
        """The table, pinned once more; None if it is not kept."""
        shard = self._shard(name)
        if name not in shard:
            return None
        shard.move_to_end(name)
        shard[name][2] += 1
        return shard[name][0]

    def insert(self, name: str, table: DataFrame, size: int) -> DataFrame:
        """Keep a table of about ``size`` bytes, pinned once; an older one of the name is given up."""
        self.evict(name)
        self._shard(name)[name] = [table.persist(StorageLevel.MEMORY_ONLY), size, 1]
        self._shrink(self._shard(name))
        return table

    def unpin(self, name: str) -> None:
        """One reader fewer."""
        shard = self._shard(name)
        if name in shard and shard[name][2]:
            shard[name][2] -= 1
            self._shrink(shard)

    def evict(self, name: str) -> bool:
        """Give a table up, pinned or not."""
        held = self._shard(name).pop(name, None)
        if held:
            held[0].unpersist()
        return held is not None

    def get_or_make(self, name: str, make: Callable[[], DataFrame], size: int) -> DataFrame:
        found = self.get(name)
        return self.insert(name, make(), size) if found is None else found

    def _shrink(self, shard: OrderedDict[str, list]) -> None:
        held = sum(x[1] for x in shard.values())
        for name in [n for n, x in shard.items() if not x[2]]:
            if held <= self.share:
                return
            held -= shard[name][1]
            self.evict(name)
