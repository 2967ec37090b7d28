"""Market data providers as Spark data sources: ``spark.read.format(...)`` and ``spark.readStream``.

A provider is a ``Feed``: it names its slices of ticks and reads one of them. Spark plans the slices
as partitions, so they are fetched side by side on the executors; filters on symbol and time are
pushed to the feed, which drops slices and rows by them. Streams take what has come between two
points in time, so an offset is a time and a restart reads the same rows again.
"""

from __future__ import annotations

import calendar
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

TICKS = "symbol string, ts timestamp, seq long, price double"
ARROW = pa.schema([("symbol", pa.string()), ("ts", pa.timestamp("us", tz="UTC")), ("seq", pa.int64()), ("price", pa.float64())])
FAR_BACK, FAR_AHEAD = -(2**62), 2**62


def micros(x: datetime) -> int:
    """Microseconds since 1970 of a time; one without a zone is UTC."""
    return calendar.timegm(x.utctimetuple()) * 1_000_000 + x.microsecond


@dataclass(frozen=True)
class Wanted:
    """Which ticks are asked for: symbols (None: all) and times from low to below high, in microseconds."""

    symbols: frozenset[str] | None = None
    low: int = FAR_BACK
    high: int = FAR_AHEAD

    def among(self, symbols: Iterable[str]) -> Wanted:
        found = frozenset(symbols)
        return Wanted(found if self.symbols is None else self.symbols & found, self.low, self.high)

    def between(self, low: int = FAR_BACK, high: int = FAR_AHEAD) -> Wanted:
        return Wanted(self.symbols, max(self.low, low), min(self.high, high))

    def takes(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows of a batch of ``ARROW`` that are asked for; a tick without a time is never."""
        at = batch.column("ts").cast(pa.int64())
        keep = pc.and_(pc.greater_equal(at, self.low), pc.less(at, self.high))
        if self.symbols is not None:
            keep = pc.and_(keep, pc.is_in(batch.column("symbol"), pa.array(sorted(self.symbols), pa.string())))
        return batch.filter(keep)


class Feed(Protocol):
    """A provider. It is sent to executors, so it holds what it needs to connect, not a connection."""

    def slices(self, wanted: Wanted) -> list[Any]:
        """Parts that can be read apart and may hold what is wanted."""
        ...

    def read(self, part: Any, wanted: Wanted) -> Iterator[pa.RecordBatch]:
        """The wanted ticks of one part, as batches of ``ARROW``."""
        ...

    def latest(self) -> int | None:
        """The time of the newest tick, in microseconds."""
        ...


@dataclass
class ParquetFeed:
    """A feed over Parquet files of ticks, a row group a slice; ``columns`` names the table's own symbol, ts, seq and price.

    Row groups whose statistics exclude the wanted times or symbols are not planned at all.
    """

    path: str
    columns: tuple[str, str, str, str] = ("symbol", "ts", "seq", "price")

    def _groups(self) -> Iterator[tuple[str, int, dict[str, Any]]]:
        for fragment in ds.dataset(self.path, format="parquet").get_fragments():
            for group in fragment.row_groups:
                yield fragment.path, group.id, group.statistics or {}

    def slices(self, wanted: Wanted) -> list[tuple[str, int]]:
        symbol, ts = self.columns[:2]
        out = []
        for path, group, known in self._groups():
            low, high = (micros(known[ts][k]) if known.get(ts) and known[ts][k] is not None else None for k in ("min", "max"))
            first, last = (known[symbol][k] if known.get(symbol) else None for k in ("min", "max"))
            in_time = low is None or (low < wanted.high and high >= wanted.low)
            in_names = wanted.symbols is None or first is None or any(first <= s <= last for s in wanted.symbols)
            if in_time and in_names:
                out.append((path, group))
        return out

    def read(self, part: tuple[str, int], wanted: Wanted) -> Iterator[pa.RecordBatch]:
        path, group = part
        (fragment,) = ds.dataset(path, format="parquet").get_fragments()
        symbol, ts, seq, price = self.columns
        for batch in fragment.subset(row_group_ids=[group]).to_batches(columns=list(dict.fromkeys(self.columns))):
            at = batch.column(ts).cast(pa.timestamp("us")).cast(pa.int64()).cast(pa.timestamp("us", tz="UTC"))
            own = [batch.column(symbol).cast(pa.string()), at, batch.column(seq).cast(pa.int64()), batch.column(price).cast(pa.float64())]
            yield wanted.takes(pa.RecordBatch.from_arrays(own, schema=ARROW))

    def latest(self) -> int | None:
        ts = self.columns[1]
        return max((micros(known[ts]["max"]) for _, _, known in self._groups() if known.get(ts) and known[ts]["max"] is not None), default=None)


class Slice(InputPartition):
    """One slice of a feed and what is wanted of it."""

    def __init__(self, part: Any, wanted: Wanted):
        super().__init__(0)
        self.part, self.wanted = part, wanted


class FeedReader(DataSourceReader):
    """Batch reader: a partition a slice, with symbol and time filters pushed to the feed."""

    def __init__(self, feed: Feed):
        self.feed, self.wanted = feed, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes filters on symbol and ts, which the feed applies exactly, and hands the others back."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name == "symbol" and isinstance(f, EqualTo):
                self.wanted = self.wanted.among([f.value])
            elif name == "symbol" and isinstance(f, In):
                self.wanted = self.wanted.among(x for x in f.value if x is not None)
            elif name == "ts" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.wanted = self.wanted.between(low=micros(f.value) + isinstance(f, GreaterThan))
            elif name == "ts" and isinstance(f, (LessThan, LessThanOrEqual)):
                self.wanted = self.wanted.between(high=micros(f.value) + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[Slice]:
        return [Slice(part, self.wanted) for part in self.feed.slices(self.wanted)] or [Slice(None, self.wanted)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition.part is None else self.feed.read(partition.part, partition.wanted)


class FeedStreamReader(DataSourceStreamReader):
    """Stream reader: offsets are times in microseconds, a batch holds the ticks after one and up to the next."""

    def __init__(self, feed: Feed, start: int):
        self.feed, self.start = feed, start

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        latest = self.feed.latest()
        return {"after": self.start if latest is None else max(latest, self.start)}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        wanted = Wanted(low=start["after"] + 1, high=end["after"] + 1)
        return [Slice(part, wanted) for part in self.feed.slices(wanted)] or [Slice(None, wanted)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition.part is None else self.feed.read(partition.part, partition.wanted)

    def commit(self, end: dict) -> None:
        """Feeds keep their ticks; nothing is to be let go."""


def register_feed(spark: SparkSession, name: str, feed: Feed) -> str:
    """Makes ``feed`` readable as ``spark.read.format(name)`` and ``spark.readStream.format(name)``; returns the name.

    The stream's option ``after`` (a time in ISO form, UTC) leaves out earlier ticks.
    """

    class FeedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return TICKS

        def reader(self, schema: Any) -> FeedReader:
            return FeedReader(feed)

        def streamReader(self, schema: Any) -> FeedStreamReader:  # noqa: N802
            after = self.options.get("after")
            return FeedStreamReader(feed, micros(datetime.fromisoformat(after)) if after else FAR_BACK)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)
    return name
