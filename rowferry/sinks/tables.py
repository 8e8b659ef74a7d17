"""Target tables as folders of Parquet versions.

A table is a folder with one subfolder per load: ``000001.full``, ``000002.add``, ... A ``full``
version replaces what came before it, an ``add`` version adds rows. The table is the last full
version and the adds after it. A version counts once Spark has put ``_SUCCESS`` into it, so a load
becomes visible in one step, a load that died leaves nothing behind, and readers of an older
version are not disturbed. Loads that only add rows never rewrite the table.

A version may carry the tag of the load that made it (``000002.add.run7-step2``): a load that is
repeated after a failure finds its tag and is not applied twice.

A table may be kept in buckets of its key's hash, each a partition folder of a version: ``_part=new-7``
replaces bucket 7, ``_part=add-7`` adds to it. An update then reads and writes only the buckets of the
keys it meets (``000003.part16k8f3a01bc``: of 16 buckets, by the keys that have this checksum).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.workspace import file_system

_VERSION = re.compile(r"(\d{6,})\.(full|add|part)(\d+k[0-9a-f]{8})?(?:\.(.+))?")
_PART = re.compile(r"_part=(new|add)-(\d+)")


class TableExists(Exception):
    pass


class TableMissing(Exception):
    pass


class StaleTable(Exception):
    """Another load changed the table meanwhile; nothing was published."""


@dataclass(frozen=True)
class Buckets:
    """A table's rows by the hash of their key, in ``count`` parts."""

    count: int
    keys: tuple[str, ...]

    @property
    def layout(self) -> str:
        return f"{self.count}k{zlib.crc32(','.join(self.keys).encode()):08x}"

    def number(self) -> Column:
        return F.pmod(F.hash(*self.keys), F.lit(self.count))

    def of(self, rows: DataFrame) -> list[int]:
        """The buckets that rows are in; at most ``count`` numbers."""
        return sorted(r[0] for r in rows.select(self.number()).distinct().collect())


@dataclass(frozen=True)
class Version:
    number: int
    mode: str
    layout: str | None
    tag: str | None
    path: str


class TableStore:
    """Tables under one root folder, addressed by schema and table name."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def folder(self, schema: str, table: str) -> str:
        return f"{self.root}/{schema}/{table}"

    def _children(self, schema: str, table: str) -> list[tuple[int, str, str | None, str | None, str, bool]]:
        """(number, mode, layout, tag, path, finished) of every version folder, by number."""
        folder = self.folder(schema, table)
        fs, path = file_system(self.spark, folder)
        if not fs.exists(path):
            return []
        _, markers = file_system(self.spark, f"{folder}/*/_SUCCESS")
        finished = {status.getPath().getParent().getName() for status in fs.globStatus(markers)}
        found = [(m, m[0]) for m in (_VERSION.fullmatch(s.getPath().getName()) for s in fs.listStatus(path)) if m]
        every = [(int(m[1]), m[2], m[3], m[4], f"{folder}/{name}", name in finished) for m, name in found]
        return sorted(every, key=lambda v: (v[0], v[4]))

    def versions(self, schema: str, table: str) -> list[Version]:
        """Finished versions, oldest first."""
        return [Version(*v[:5]) for v in self._children(schema, table) if v[5]]

    def exists(self, schema: str, table: str) -> bool:
        return bool(self.versions(schema, table))

    def has_tag(self, schema: str, table: str, tag: str) -> bool:
        return any(v.tag == tag for v in self.versions(schema, table))

    def _current(self, schema: str, table: str, buckets: Collection[int] | None = None) -> list[str]:
        """The folders that make up the table, or only some of its buckets."""
        found = self.versions(schema, table)
        if not found:
            raise TableMissing(f"{schema}.{table}")
        paths: list[str] = []
        replaced: set[int] = set()
        for version in reversed(found):
            if version.layout is None:
                paths.append(version.path)
            else:
                parts = self._parts(version)
                paths += [path for _, number, path in parts
                          if number not in replaced and (buckets is None or number in buckets)]
                replaced |= {number for kind, number, _ in parts if kind == "new"}
            if version.mode == "full":
                break
        return paths[::-1]

    def _parts(self, version: Version) -> list[tuple[str, int, str]]:
        fs, path = file_system(self.spark, version.path)
        names = [(s.getPath().getName(), s) for s in fs.listStatus(path)]
        return [(m[1], int(m[2]), f"{version.path}/{name}") for name, _ in names if (m := _PART.fullmatch(name))]

    def layout(self, schema: str, table: str) -> str | None:
        """How the table is kept in buckets; None if it is not."""
        found = self.versions(schema, table)
        return found[-1].layout if found else None

    def read(self, schema: str, table: str, paths: Sequence[str] | None = None, *,
             buckets: Collection[int] | None = None) -> DataFrame:
        """The table, or only the given paths of its versions, or only some of its buckets."""
        newest = self.versions(schema, table)
        paths = list(paths) if paths else self._current(schema, table, buckets)
        layout = self.spark.read.parquet(paths[0] if paths else newest[-1].path).schema
        layout = T.StructType([f for f in layout.fields if f.name != "_part"])
        if not paths:
            return self.spark.createDataFrame([], layout)
        return self.spark.read.schema(layout).parquet(*paths)

    def newest(self, schema: str, table: str) -> int:
        """The number of the last finished version, 0 without one."""
        return max((v.number for v in self.versions(schema, table)), default=0)

    def publish(
        self, schema: str, table: str, rows: DataFrame, *, mode: str = "full", tag: str | None = None,
        base: int | None = None, buckets: Buckets | None = None, replaced: Collection[int] = (),
    ) -> int:
        """Write ``rows`` as the next version; gives its number of rows.

        Writes nothing when a version with this tag is there already; the number is then that one's.
        ``base`` is the ``newest`` version that ``rows`` were computed from. If another load has
        published since, before or during the write, this one is withdrawn: its rows would undo the other's.
        With ``buckets`` the rows are kept by them; mode ``part`` replaces the buckets in ``replaced``
        and adds to the others.
        """
        if mode not in ("full", "add", "part") or (mode == "part") != (buckets is not None and mode != "full"):
            raise ValueError("mode is full or add, or part with buckets")
        children = self._children(schema, table)
        if tag:
            for version in (Version(*c[:5]) for c in children if c[5]):
                if version.tag == tag:
                    return self.spark.read.parquet(version.path).count()
        taken = [c[0] for c in children]
        name = f"{max(taken, default=0) + 1:06d}.{mode}" + (buckets.layout if buckets else "") + (f".{tag}" if tag else "")
        if base is not None and self.newest(schema, table) != base:
            raise StaleTable(f"{schema}.{table}")
        place = f"{self.folder(schema, table)}/{name}"
        written = Observation()
        rows = rows.observe(written, F.count(F.lit(1)).alias("rows"))
        if buckets is None:
            rows.write.mode("error").parquet(place)
        else:
            number = buckets.number()
            new = F.lit(mode == "full") | number.isin(list(replaced))
            part = F.concat_ws("-", F.when(new, "new").otherwise("add"), number)
            (rows.withColumn("_part", part).repartition("_part").write.partitionBy("_part").mode("error").parquet(place))
        if base is not None and any(v.number > base and v.path != place for v in self.versions(schema, table)):
            self.drop_versions([place])
            raise StaleTable(f"{schema}.{table}")
        return written.get.get("rows", 0)

    def create(self, schema: str, table: str, layout: T.StructType) -> None:
        """An empty table; refused when it exists."""
        if self.exists(schema, table):
            raise TableExists(f"{schema}.{table}")
        loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in layout.fields])
        self.publish(schema, table, self.spark.createDataFrame([], loose))

    def ensure(self, schema: str, table: str, layout: T.StructType) -> dict[str, bool]:
        """Create the table unless it is there."""
        there = self.exists(schema, table)
        if not there:
            self.create(schema, table, layout)
        return {"created": not there, "skipped_existing": there}

    def copy_structure(self, schema: str, table: str, new_schema: str, new_table: str) -> None:
        """An empty table with the columns of another one."""
        if self.exists(new_schema, new_table):
            raise TableExists(f"{new_schema}.{new_table}")
        self.create(new_schema, new_table, self.read(schema, table).schema)

    def compact(self, schema: str, table: str) -> int:
        """Rewrite the table as one full version, without buckets."""
        return self.publish(schema, table, self.read(schema, table))

    def drop(self, schema: str, table: str) -> None:
        """Delete a table with all its versions."""
        fs, path = file_system(self.spark, self.folder(schema, table))
        fs.delete(path, True)

    def drop_old_versions(self, schema: str, table: str) -> int:
        """Delete the versions that the current table no longer reads; gives their number.

        Only for a table that nobody is reading in an older state.
        """
        current = {re.sub(r"/_part=[^/]+$", "", path) for path in self._current(schema, table)}
        newest = max(v.number for v in self.versions(schema, table))
        old = [c for c in self._children(schema, table) if c[4] not in current and c[0] < newest]
        self.drop_versions([c[4] for c in old])
        return len(old)

    def drop_versions(self, paths: Sequence[str]) -> None:
        for path in paths:
            fs, where = file_system(self.spark, path)
            fs.delete(where, True)
