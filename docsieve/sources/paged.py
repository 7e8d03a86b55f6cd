"""A paged list of approvals as a Spark data source: a pull with a limit, a point lookup, and a stream of new pages.

What holds the pages is a gateway: any object with ``sizes()`` (rows of each page, in order), ``page(n)`` (its rows as
dicts) and ``find(key)`` (a row or None). It is named by an option, so that executors make their own.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from importlib import import_module
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType


class ApprovalNotFound(LookupError):
    """A point lookup for a key that the gateway does not have."""


class FolderGateway:
    """Pages as JSON lines in a folder that all nodes mount; ``sizes.json`` lists them with their rows and key ranges."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.key = Path(options["path"]), options["key"]

    def _pages(self) -> list[dict]:
        listed = self.folder / "sizes.json"
        return json.loads(listed.read_text()) if listed.exists() else []

    def sizes(self) -> list[int]:
        return [p["rows"] for p in self._pages()]

    def page(self, n: int) -> Iterator[dict]:
        with (self.folder / self._pages()[n]["name"]).open(encoding="utf-8") as f:
            yield from map(json.loads, f)

    def find(self, key: object) -> dict | None:
        """Looks only into pages whose range of keys has the key."""
        near = [n for n, p in enumerate(self._pages()) if p["first"] <= key <= p["last"]]
        return next((row for n in near for row in self.page(n) if row[self.key] == key), None)


@dataclass
class Pages(InputPartition):
    """Pages ``start`` to ``stop`` - 1, the last cut to ``rows`` rows in all; or the row of a key."""

    start: int
    stop: int
    rows: int | None = None
    key: object = None


def _gateway(options: dict[str, str]) -> object:
    module, _, name = options.get("gateway", f"{__name__}:FolderGateway").partition(":")
    return getattr(import_module(module), name)(dict(options))


def _read(gateway: object, names: Sequence[str], part: Pages) -> Iterator[tuple]:
    row = lambda r: tuple(r.get(n) for n in names)
    if part.key is not None:
        found = gateway.find(part.key)
        if found is None:
            raise ApprovalNotFound(f"no approval {part.key}")
        yield row(found)
        return
    left = part.rows
    for n in range(part.start, part.stop):
        for r in gateway.page(n):
            if left is not None:
                if not left:
                    return
                left -= 1
            yield row(r)


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.options, self.key = schema.fieldNames(), dict(options), None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """An equality on the key becomes a lookup; all else is left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == (self.options["key"],) and self.key is None:
                self.key = f.value
            else:
                yield f

    def partitions(self) -> list[Pages]:
        """A task for each page; pages behind the limit are not asked for. A limit below one gives nothing."""
        if self.key is not None:
            return [Pages(0, 0, None, self.key)]
        left, out = int(self.options["limit"]) if "limit" in self.options else None, []
        for n, size in enumerate(_gateway(self.options).sizes()):
            if left is not None and left <= 0:
                break
            out.append(Pages(n, n + 1, left if left is not None and left < size else None))
            left = None if left is None else left - size
        return out or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return _read(_gateway(self.options), self.names, partition)


class PagedStream(DataSourceStreamReader):
    """Offsets are numbers of pages; a page is final once the gateway lists it."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.options = schema.fieldNames(), dict(options)

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": len(_gateway(self.options).sizes())}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return [Pages(n, n + 1) for n in range(start["pages"], end["pages"])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return _read(_gateway(self.options), self.names, partition)

    def commit(self, end: dict) -> None:
        pass


class PagedApprovals(DataSource):
    """Format ``paged``. Options: key (the column of lookups), limit, gateway (module:name), and those of the gateway."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, self.options)

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedApprovals)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def pending(spark: SparkSession, schema: str, limit: int | None = None, **options: str) -> DataFrame:
    """The first ``limit`` rows of the list in its order, repeats among them and all; every row without a limit."""
    register(spark)
    own = options if limit is None else {**options, "limit": str(limit)}
    return spark.read.format("paged").schema(schema).options(**own).load()


def lookup(spark: SparkSession, schema: str, value: object, **options: str) -> DataFrame:
    """The row of a key, by one request; reading it fails with ``ApprovalNotFound`` if there is none."""
    return pending(spark, schema, **options).filter(F.col(options["key"]) == F.lit(value))


def export(rows: DataFrame, key: str, folder: str, pages: int) -> None:
    """Write ``rows`` as pages in the order of a key, for a folder gateway. Rows stay on the executors; the driver sees
    one row a page."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(pages, key).sortWithinPartitions(key)
    dealt.write.json(folder)
    sizes = spark.read.schema(rows.schema).json(folder).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last")).collect()
    listed = sorted((r["f"].rsplit("/", 1)[-1], r["rows"], r["first"], r["last"]) for r in sizes)
    Path(folder, "sizes.json").write_text(json.dumps([dict(zip(("name", "rows", "first", "last"), x, strict=True)) for x in listed]))
