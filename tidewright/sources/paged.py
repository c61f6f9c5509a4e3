"""Paged services as a data source: pages go forward or back in time, by a cursor, with a coarser series to fall back on."""

import importlib
import json
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: fetch(symbol, start, end, limit, cursor) -> rows of one page in rising order, and the cursor of the next page (None at the end).
Fetch = Callable[[str, int, int, int, object], tuple[list[dict], object]]
LINE_BYTES = 1 << 14


class LineFile:
    """JSON lines in rising order of time, in a file that is never read twice: the place of a time is found by halving, pages follow by offset."""

    def __init__(self, source):
        self.source, self.size = source, source.size()

    def line_at(self, offset: int) -> tuple[int, bytes]:
        """Start and bytes of the first line that begins at or after offset; empty at the end."""
        at, held = max(0, offset - 1), b""
        self.source.seek(at)
        skip = offset > 0
        while True:
            part = self.source.read(LINE_BYTES)
            held += part
            if skip and (end := held.find(b"\n")) >= 0:
                at, held, skip = at + end + 1, held[end + 1 :], False
            if not skip and b"\n" in held:
                return at, held[: held.index(b"\n")]
            if not part:
                return (self.size, b"") if skip else (at, held)

    def place(self, time: int) -> int:
        """Offset of the first line of at least a time."""
        low, high = 0, self.size
        while low < high:
            middle = (low + high) // 2
            start, line = self.line_at(middle)
            if line.strip() and int(json.loads(line)["time"]) < time:
                low = start + len(line) + 1
            else:
                high = middle
        return min(self.line_at(low)[0] if low < self.size else self.size, self.size)

    def forward(self, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        """(offset, line) of the lines that begin in [start, end)."""
        self.source.seek(start)
        held, at = b"", start
        while at < end:
            while b"\n" not in held and (part := self.source.read(LINE_BYTES)):
                held += part
            line, _, held = held.partition(b"\n")
            if not line and at >= self.size:
                return
            yield at, line
            at += len(line) + 1

    def back(self, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        """(offset, line) of the lines that begin in [start, end), the last first."""
        held, at = b"", end
        while at > start or held:
            if at > start and b"\n" not in held.rstrip(b"\n"):
                step = min(LINE_BYTES, at - start)
                self.source.seek(at - step)
                held, at = self.source.read(step) + held, at - step
                continue
            body = held.rstrip(b"\n") if held.endswith(b"\n") else held
            cut = body.rfind(b"\n") + 1
            if body[cut:]:
                yield at + cut, body[cut:]
            held = held[:cut]


def line_pages(path: str, backward: bool) -> Fetch:
    """Pages from JSON lines in {path}/{symbol}.json, ordered by time; stands in for a network service. Each row has its offset as `at`, the order of arrival. A symbol without file has no rows."""
    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    held: dict[tuple, tuple[LineFile, Iterator]] = {}

    def fetch(symbol, start, end, limit, cursor):
        key = (symbol, start, end)
        if cursor is None:
            name = f"{root}/{symbol}.json"
            if system.get_file_info(name).type == fs.FileType.NotFound:
                return [], None
            file = LineFile(system.open_input_file(name))
            bounds = file.place(start), file.place(end)
            held[key] = file, (file.back if backward else file.forward)(*bounds)
        rows = []
        for at, line in held[key][1]:
            if line.strip():
                rows.append(json.loads(line) | {"symbol": symbol, "at": at})
            if len(rows) == limit:
                return (rows[::-1] if backward else rows), len(rows)
        held.pop(key)[0].source.close()
        return (rows[::-1] if backward else rows), None

    return fetch


class Slice(InputPartition):
    def __init__(self, symbol: str, start: int, end: int):
        self.symbol, self.start, self.end = symbol, start, end


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, fields: list[str]):
        self.options, self.fields = options, fields

    def partitions(self):
        """One for each symbol and slice of time, so that pages are fetched by many tasks."""
        start, end, width = (int(self.options[k]) for k in ("start", "end", "slice"))
        return [Slice(s, a, min(a + width, end)) for s in self.options["symbols"].split(",") for a in range(start, end, width)]

    def fetchers(self) -> list[Fetch]:
        """One for each path, the finest first: of a function named module:function, called with path and direction, or from files."""
        make = line_pages
        if named := self.options.get("fetcher"):
            module, _, name = named.partition(":")
            make = getattr(importlib.import_module(module), name)
        backward = self.options.get("direction", "forward") == "backward"
        return [make(p, backward) for p in [self.options["path"], *filter(None, self.options.get("fallback", "").split(","))]]

    def read(self, part: Slice) -> Iterator[tuple]:
        """Rows with start <= time < end, page by page from the first series that has any in this slice; level says which. An empty page isn't the end as long as there is a cursor."""
        limit = int(self.options.get("page", 1000))
        for level, fetch in enumerate(self.fetchers()):
            cursor, found = None, False
            while True:
                rows, cursor = fetch(part.symbol, part.start, part.end, limit, cursor)
                for r in rows:
                    found = True
                    yield tuple((r | {"level": level}).get(f) for f in self.fields)
                if cursor is None:
                    break
            if found:
                return


class PagedSource(DataSource):
    """spark.read.format("paged"): options path, symbols (comma-separated), start, end and slice (in the unit of time), page (rows), direction (forward, backward), fallback (paths of coarser series, comma-separated), fetcher (module:function), and schema by .schema()."""

    @classmethod
    def name(cls):
        return "paged"

    def schema(self):
        return "symbol string, time long, open double, high double, low double, close double, volume double, at long"

    def reader(self, schema):
        return PagedReader(dict(self.options), schema.names)


def paged(spark: SparkSession, path: str, symbols: list[str], start: int, end: int, width: int, schema: str | None = None, page: int = 1000, **options: str) -> DataFrame:
    """Rows of symbols with start <= time < end, read in slices of width."""
    spark.dataSource.register(PagedSource)
    reader = spark.read.format("paged").options(path=path, symbols=",".join(symbols), start=start, end=end, slice=width, page=page, **options)
    return (reader.schema(schema) if schema else reader).load()


