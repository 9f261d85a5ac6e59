"""Published indicator lists and a user's own feeds as a Spark data source, declared and not programmed.

``spark.read.format("indicator_list").options(**ListDefinition(...).options()).load(path)`` reads the files below
``path`` (an address of the file systems that pyarrow knows); the same with ``readStream`` takes files in order of
their time of change. A partition is a file, or a block of a long file of lines. Every line becomes indicators or one
rejected row that says why; comments, blank lines and names of the machine itself give none.
"""

from __future__ import annotations

import csv
import io
import ipaddress
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "list string, category string, confidence double, kind string, value string, note string, reject string, file string, line long"
BLOCK = 64 << 20
#: Names that lists of hosts carry for the machine itself, and the addresses before a blocked name.
OWN_NAMES = ("localhost", "localhost.localdomain", "broadcasthost", "local", "ip6-localhost")
SINKS = ("0.0.0.0", "127.0.0.1", "::1", "::", "255.255.255.255")


@dataclass(frozen=True)
class ListDefinition:
    """What a list is and how its lines are read.

    ``form`` is ``lines`` (fields between blanks, or ``delimiter``) or ``csv`` (quoted fields). ``column`` holds the
    indicator, ``note_column`` what is said of it.
    """

    name: str
    form: str = "lines"
    column: int = 0
    note_column: int | None = None
    delimiter: str | None = None
    skip_header: bool = False
    category: str | None = None
    confidence: float | None = None

    def options(self) -> dict[str, str]:
        return {k: str(v) for k, v in asdict(self).items() if v is not None}

    @classmethod
    def of(cls, options: dict[str, str]) -> ListDefinition:
        o = {k.lower(): v for k, v in options.items()}
        if o.get("form", "lines") not in ("lines", "csv"):
            raise ValueError(f"form of a list is lines or csv, not {o['form']}")
        whole = lambda k, d=None: int(o[k]) if k in o else d
        sure = float(o["confidence"]) if "confidence" in o else None
        return cls(o.get("name", "list"), o.get("form", "lines"), whole("column", 0), whole("note_column"), o.get("delimiter"), o.get("skip_header", "").lower() == "true", o.get("category"), sure)


def indicators(token: str) -> list[tuple[str, str]]:
    """(kind, value) of a token: an AS number, a URL and its host, an address, a network, a digest, or else a host."""
    token = token.strip().strip('"').strip()
    if not token:
        return []
    if m := re.fullmatch(r"(?i)asn?([0-9]+)", token):
        return [("asn", m[1])]
    if re.match(r"(?i)[a-z][a-z0-9+.-]*://", token):
        host = urlsplit(token).hostname
        return [("url", token), *([("host", host.lower())] if host else [])]
    try:
        return [("network", str(ipaddress.ip_network(token, strict=False)))] if "/" in token else [("ip", str(ipaddress.ip_address(token)))]
    except ValueError:
        pass
    if re.fullmatch(r"[0-9a-fA-F]+", token) and len(token) in (32, 40, 64):
        return [("hash", token.lower())]
    return [("host", token.lower().rstrip("."))]


def fields(line: str, d: ListDefinition) -> list[str]:
    """The fields of a line that is no comment; a blocked name stands for the whole of its hosts line."""
    if d.form == "csv":
        return next(csv.reader([line], delimiter=d.delimiter or ","), [])
    line = re.split(r"\s#", line, maxsplit=1)[0].strip()
    parts = line.split()
    if len(parts) > 1 and parts[0] in SINKS:
        return [""] * d.column + [parts[1]]
    return line.split(d.delimiter) if d.delimiter else parts


def rows(lines: Iterator[str], d: ListDefinition, file: str, first: int = 1, header: bool = True) -> Iterator[tuple]:
    """Rows of SCHEMA for the lines of a file; ``header``: whether its first line is among them."""
    for number, raw in enumerate(lines, first):
        line = raw.strip()
        if not line or line.startswith(("#", ";", "//")):
            continue
        if d.skip_header and header:
            header = False
            continue
        found, note, why = [], None, None
        try:
            parts = fields(line, d)
        except csv.Error as e:
            parts, why = [], f"csv: {e}"
        if not why and len(parts) <= d.column:
            why = "too few fields"
        elif not why and parts[d.column].strip().lower() in OWN_NAMES:
            continue
        elif not why:
            found = indicators(parts[d.column])
            note = parts[d.note_column].strip() or None if d.note_column is not None and len(parts) > d.note_column else None
            why = None if found else "no indicator"
        for kind, value in found or [(None, None)]:
            yield d.name, d.category, d.confidence, kind, value, note, why, file, number


class _Block(InputPartition):
    def __init__(self, path: str, start: int, stop: int | None):
        self.path, self.start, self.stop = path, start, stop


def _files(path: str) -> list[tuple[int, str, int]]:
    """(time of change, path, bytes) of the files below a path, in order; hidden ones and Spark's marks left out."""
    system, inside = fs.FileSystem.from_uri(path)
    info = system.get_file_info(inside)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inside, recursive=True))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and not re.match(r"[._]", f.base_name))


class _Read:
    def __init__(self, options: dict[str, str]):
        self.path, self.definition = options["path"], ListDefinition.of(options)

    def blocks(self, files: list[tuple[int, str, int]]) -> list[InputPartition]:
        whole = self.definition.form == "csv" or self.definition.skip_header
        cut = lambda f, size: [_Block(f, at, at + BLOCK) for at in range(0, size, BLOCK)] if not whole and size > BLOCK else [_Block(f, 0, None)]
        return [b for _, f, size in files for b in cut(f, size)]

    def read(self, block: _Block) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(block.path) as source, io.BufferedReader(source, 1 << 20) as f:
            at = max(0, block.start - 1)
            f.seek(at)

            def lines() -> Iterator[str]:
                here = at + (len(f.readline()) if block.start else 0)  # the line that began before is the block's before
                while block.stop is None or here < block.stop:
                    raw = f.readline()
                    if not raw:
                        return
                    here += len(raw)
                    yield raw.decode("utf-8", "replace")

            yield from rows(lines(), self.definition, block.path, header=block.start == 0)


class _Reader(_Read, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.blocks(_files(self.path))


class _StreamReader(_Read, DataSourceStreamReader):
    """Offsets are the time of change and the name of the last file taken; files must not be changed once they are there."""

    def initialOffset(self) -> dict:
        return {"changed": -1, "file": ""}

    def latestOffset(self) -> dict:
        files = _files(self.path)
        return {"changed": files[-1][0], "file": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        mark = lambda o: (o["changed"], o["file"])
        return self.blocks([f for f in _files(self.path) if mark(start) < f[:2] <= mark(end)])


class ListDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "indicator_list"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(dict(self.options))


def read_list(spark: SparkSession, path: str, definition: ListDefinition, stream: bool = False):
    """The rows of a list, as a table or as a stream of its files."""
    spark.dataSource.register(ListDataSource)
    reader = spark.readStream if stream else spark.read
    return reader.format("indicator_list").options(**definition.options()).load(path)
