"""FASTA as a Spark data source: ``spark.read.format("covarix_fasta").load(path)``, and the same for streams.

Files are cut into byte ranges, a task each; a record belongs to the range in
which its ``>`` begins a line, and its task reads on beyond the range's end. So a
large file is read by many tasks, whatever the lengths of its records. Columns:
``file``, ``start`` (the byte of the record's ``>``), ``header``, ``accession``,
``description``, ``sequence`` (lines stripped, upper-cased and joined). ``file`` and
``start`` order the records; ``numbered`` gives them ids from 0 by a range
partitioning. Text before the first record and blank lines are skipped, an empty
header stays, and either line end may be used.

The option ``columns`` (names with commas) reads only those; without ``sequence``
no residue is kept. Paths are a file, a folder or a glob, of any store that
Arrow's file systems know. The stream reads the files that are new since its last
batch, each whole, in the order of their names; its offset is the names read.
Files are written once and not changed afterwards.

Defined cases: an empty file has no records; a file that does not exist is an
error; names that begin with ``.`` or ``_`` are no input.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..shared import ranked

RANGE_BYTES = 64 << 20
CHUNK = 4 << 20
ROWS = 1_000
COLUMNS = {"file": StringType(), "start": LongType(), "header": StringType(), "accession": StringType(), "description": StringType(), "sequence": StringType()}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def files_of(path: str) -> list[tuple[str, int]]:
    """Names and sizes of a file, of a folder's files or of a glob's, by name."""
    store, at = _store(path)
    head = re.split(r"[*?\[]", at, maxsplit=1)[0]
    if head != at:
        found = [f for f in store.get_file_info(fs.FileSelector(posixpath.dirname(head) or "/", recursive=True)) if fnmatch.fnmatchcase(f.path, at)]
    else:
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = store.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
    return sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_")))


@dataclass
class Range(InputPartition):
    """Bytes ``low`` to ``high`` of a file."""

    file: str
    low: int
    high: int


def ranges(files: list[tuple[str, int]], size: int) -> list[Range]:
    return [Range(name, low, min(n, low + size)) for name, n in files for low in range(0, n, size)]


def lines(source, low: int) -> Iterator[tuple[int, bytes]]:
    """Lines with their first bytes' places, from the first line that begins at or after ``low``."""
    source.seek(max(0, low - 1))
    at, held = max(0, low - 1), []
    skip = low > 0  # the byte before tells whether a line begins here
    while chunk := source.read(CHUNK):
        held.append(chunk)
        if b"\n" not in chunk:
            continue
        *whole, rest = b"".join(held).split(b"\n")
        held = [rest]
        for line in whole:
            if not skip:
                yield at, line
            skip = False
            at += len(line) + 1
    if (last := b"".join(held)) and not skip:
        yield at, last


def records(source, part: Range, sequences: bool = True) -> Iterator[tuple[int, str, list[str]]]:
    """``(start, header, lines)`` of the records that begin in a range."""
    start, header, held = -1, "", []
    for at, line in lines(source, part.low):
        if line.startswith(b">"):
            if start >= 0:
                yield start, header, held
            if at >= part.high:
                return
            start, header, held = at, line[1:].decode("utf-8", "replace").strip(), []
        elif start < 0:
            if at >= part.high:
                return
        elif sequences and (text := line.decode("utf-8", "replace").strip()):
            held.append(text.upper())
    if start >= 0:
        yield start, header, held


def _row(file: str, start: int, header: str, held: list[str], columns: list[str]) -> tuple:
    at = header.find(" | ")
    words = header.split()
    whole = {"file": file, "start": start, "header": header, "accession": words[0] if words else "", "description": header[at + 3 :].strip() if at >= 0 else header, "sequence": "".join(held)}
    return tuple(whole[c] for c in columns)


class _Reading:
    """What the batch and the stream reader share: rows of a range in Arrow batches."""

    def __init__(self, path: str, columns: list[str], size: int):
        self.path, self.columns, self.size = path, columns, size

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        types = [pa.int64() if c == "start" else pa.string() for c in self.columns]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=self.columns)

        held: list[tuple] = []
        chars = 0
        with store.open_input_file(partition.file) as source:
            for start, header, text in records(source, partition, "sequence" in self.columns):
                held.append(_row(partition.file, start, header, text, self.columns))
                chars += sum(map(len, text))
                if len(held) >= ROWS or chars >= CHUNK:
                    yield batch(held)
                    held, chars = [], 0
        if held:
            yield batch(held)


class FastaReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Range]:
        return ranges(files_of(self.path), self.size)


class FastaStreamReader(_Reading, DataSourceStreamReader):
    """Offsets hold the names of all files read so far."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": []}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": [name for name, _ in files_of(self.path)]}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        new = set(end["files"]) - set(start["files"])
        return ranges([f for f in files_of(self.path) if f[0] in new], self.size)

    def commit(self, end: dict) -> None:
        pass


class FastaSource(DataSource):
    """``columns``: names with commas, all by default; ``rangeBytes``: bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "covarix_fasta"

    def _columns(self) -> list[str]:
        names = [c.strip() for c in self.options.get("columns", ",".join(COLUMNS)).split(",")]
        if unknown := set(names) - set(COLUMNS):
            raise ValueError(f"no such columns: {sorted(unknown)}")
        return names

    def schema(self) -> StructType:
        return StructType([StructField(c, COLUMNS[c]) for c in self._columns()])

    def _made(self, kind):
        return kind(self.options["path"], self._columns(), int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE_BYTES))))

    def reader(self, schema: StructType) -> FastaReader:
        return self._made(FastaReader)

    def streamReader(self, schema: StructType) -> FastaStreamReader:  # noqa: N802
        return self._made(FastaStreamReader)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaSource)


def numbered(records: DataFrame) -> DataFrame:
    """``records`` with ``seq_id`` from 0, by file and place in it."""
    return ranked(records, "seq_id", "file", "start")
