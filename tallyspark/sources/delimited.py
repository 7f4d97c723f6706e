"""Delimited text in files and ZIP archives as a Spark data source.

A partition is one entry of an archive, or a range of bytes of a plain file; each is read as a stream, so neither an archive nor a file is ever whole in a row or a task. A
quoted cell may hold line ends, so where a range's first record starts depends on the quotes before it: `read_delimited_files` counts
the quotes of every range in a job of its own, and the parity of those before a range says whether it starts inside quotes. What the driver holds is one bit a range.

Columns are those of the first file's header, as text, matched by name in the others; a cell that a row lacks is empty. Beside them: `_file`, `_entry` (null in plain files), `_at` (the
record's place in bytes), `_columns` (its number of cells), `_column_count_mismatch`, and `_malformed` (reasons joined by commas, else null): `unclosed_quote`, `text_after_closing_quote`,
`quote_after_closing_quote`. Such rows are kept. Rows without any text are not rows.

Paths are those that pyarrow's file systems open: local and mounted folders, and the stores of a cluster that it has drivers for.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyspark.sources.snapshots import DELIMITERS, clean_header

EXTENSIONS = ("csv", "tsv", "txt")
RANGE_BYTES, CHUNK, ROWS = 64 << 20, 1 << 20, 10_000
ENDS = re.compile(rb"\r\n|\n|\r")
META = {"_file": T.StringType(), "_entry": T.StringType(), "_at": T.LongType(), "_columns": T.IntegerType(), "_column_count_mismatch": T.BooleanType(), "_malformed": T.StringType()}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def files_below(path: str, extensions: tuple[str, ...] = EXTENSIONS) -> list[tuple[str, int]]:
    """Archives and text files below a folder (or the one file), in order of their names, with sizes; hidden ones left out."""
    fs, at = file_system(path)
    info = fs.get_file_info(at)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
    names = [(f.path, f.size) for f in found if f.type == pafs.FileType.File and not re.search(r"(^|/)[._]", f.path[len(at) :])]
    return sorted((p, n) for p, n in names if p.rsplit(".", 1)[-1].lower() in (*extensions, "zip"))


@dataclass
class Piece(InputPartition):
    path: str
    entry: str | None = None
    start: int = 0
    end: int | None = None
    quoted: bool = False

    def __post_init__(self):
        super().__init__(0)


def pieces_of(path: str, range_bytes: int, extensions: tuple[str, ...], quoted: str = "") -> list[Piece]:
    """Entries of archives and ranges of files. quoted: a 0 or 1 for each range, in order; without it a file is one range."""
    out, flags = [], iter(quoted)
    for p, size in files_below(path, extensions):
        if p.lower().endswith(".zip"):
            fs, at = file_system(p)
            with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:  # reads the directory at the archive's end
                out += [Piece(p, i.filename) for i in sorted(z.infolist(), key=lambda i: i.filename) if i.filename.rsplit(".", 1)[-1].lower() in extensions]
        elif not quoted:
            out.append(Piece(p))
        else:
            out += [Piece(p, None, s, min(s + range_bytes, size), next(flags) == "1") for s in range(0, max(size, 1), range_bytes)]
    return out


def lines_of(stream, at: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Place, bytes and line end of each line; lines end with CR, LF or both."""
    held, last = b"", False
    while not last:
        more = stream.read(CHUNK)
        last, held, begin = not more, held + more, 0
        for m in ENDS.finditer(held):
            if m.end() == len(held) and held.endswith(b"\r") and not last:
                break  # a line feed may follow
            yield at + begin, held[begin : m.start()], m.group()
            begin = m.end()
        held, at = held[begin:], at + begin
    if held:
        yield at, held, b""


def records_of(lines: Iterator[tuple[int, bytes, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of records: lines, joined by their ends while a quote is open."""
    parts: list[bytes] = []
    place, inside = 0, False
    for at, line, end in lines:
        place = place if parts else at
        inside ^= line.count(b'"') % 2 == 1
        parts += [line, end] if inside else [line]
        if not inside:
            yield place, b"".join(parts)
            parts = []
    if parts:
        yield place, b"".join(parts)


def cells_of(record: str, delimiter: str) -> tuple[list[str], list[str]]:
    """Cells of a record, and what is wrong with it."""
    if '"' not in record:
        return record.split(delimiter), []
    cells, cell, reasons = [], [], []
    inside = closed = False
    i, n = 0, len(record)
    while i < n:
        c = record[i]
        i += 1
        if inside:
            if c != '"':
                cell.append(c)
            elif i < n and record[i] == '"':
                cell.append(c)
                i += 1
            else:
                inside, closed = False, True
        elif c == delimiter:
            cells.append("".join(cell))
            cell, closed = [], False
        elif closed and c.isspace():
            continue
        else:
            if closed:
                reasons.append("quote_after_closing_quote" if c == '"' else "text_after_closing_quote")
                closed = False
            if c == '"':
                inside = True
            else:
                cell.append(c)
    cells.append("".join(cell))
    if inside:
        reasons.append("unclosed_quote")
    return cells, list(dict.fromkeys(reasons))


def delimiter_of(header: str) -> str:
    """The first delimiter of a header outside quotes; a comma if it has none."""
    inside = False
    for c in header:
        inside ^= c == '"'
        if not inside and c in DELIMITERS:
            return c
    return ","


def header_of(record: bytes, delimiter: str | None) -> tuple[list[str], str]:
    text = record.decode("utf-8-sig", "replace")
    delimiter = delimiter or delimiter_of(text)
    return [clean_header(c) for c in cells_of(text, delimiter)[0]], delimiter


def opened(piece: Piece):
    """The stream of an entry, or of a file, and what must be closed."""
    fs, at = file_system(piece.path)
    raw = fs.open_input_file(at)
    if piece.entry is None:
        return raw, [raw]
    z = zipfile.ZipFile(raw)
    stream = z.open(piece.entry)
    return stream, [stream, z, raw]


def rows_of(piece: Piece, delimiter: str | None) -> Iterator[tuple[list[str], int, list[str], list[str]]]:
    """Header names, place, cells and reasons of the records that start in a piece."""
    stream, closing = opened(piece)
    try:
        records = records_of(lines_of(stream, 0))
        first = next(records, None)
        if first is None:
            return
        names, delimiter = header_of(first[1], delimiter)
        if piece.start:
            # from the byte before, which may be a line's end, or a quote that the parity counts
            stream.seek(piece.start - 1)
            inside = piece.quoted ^ (stream.read(1) == b'"')
            stream.seek(piece.start - 1)
            lines = lines_of(stream, piece.start - 1)
            for _, line, _ in lines:  # the record that goes on from there is another piece's
                inside ^= line.count(b'"') % 2 == 1
                if not inside:
                    break
            records = records_of(lines)
        for at, record in records:
            if piece.end is not None and at >= piece.end:
                return
            cells, reasons = cells_of(record.decode("utf-8", "replace"), delimiter)
            if cells != [""]:
                yield names, at, cells, reasons
    finally:
        for c in closing:
            c.close()


class DelimitedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.names, self.options = schema.fieldNames(), dict(options)

    def partitions(self) -> list[Piece]:
        o = self.options
        return pieces_of(o["path"], int(o.get("rangebytes", RANGE_BYTES)), tuple(o.get("extensions", ",".join(EXTENSIONS)).split(",")), o.get("quoted", ""))

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        own = [n for n in self.names if n not in META]
        kinds = [pa.string()] * len(own) + [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*own, *META])

        at_of: dict[str, int] = {}
        for names, at, cells, reasons in rows_of(piece, self.options.get("delimiter")):
            at_of = at_of or {n: i for i, n in enumerate(names)}
            values = [cells[at_of[n]] if n in at_of and at_of[n] < len(cells) else "" for n in own]
            held.append((*values, piece.path, piece.entry, at, len(cells), len(cells) != len(names), ",".join(reasons) or None))
            if len(held) == ROWS:
                yield batch()
                held = []
        if held:
            yield batch()


class DelimitedSource(DataSource):
    """spark.read.format("tally_delimited").load(path). Options: delimiter, rangeBytes, quoted, extensions."""

    @classmethod
    def name(cls) -> str:
        return "tally_delimited"

    def schema(self) -> T.StructType:
        extensions = tuple(self.options.get("extensions", ",".join(EXTENSIONS)).split(","))
        names: list[str] = []
        for piece in pieces_of(self.options["path"], RANGE_BYTES, extensions):
            stream, closing = opened(piece)
            first = next(records_of(lines_of(stream, 0)), None)
            for c in closing:
                c.close()
            if first is not None:
                names = list(dict.fromkeys(header_of(first[1], self.options.get("delimiter"))[0]))
                break
        return T.StructType([*[T.StructField(n, T.StringType()) for n in names], *[T.StructField(n, k) for n, k in META.items()]])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return DelimitedReader(schema, self.options)


def quote_states(spark: SparkSession, path: str, range_bytes: int, extensions: tuple[str, ...] = EXTENSIONS) -> str:
    """For each range of the plain files below path, in order, whether it starts inside quotes: ranges are counted in tasks, one bit of each comes to the driver."""
    ranges = [(i, p, s, min(s + range_bytes, size)) for i, (p, size) in enumerate(f for f in files_below(path, extensions) if not f[0].lower().endswith(".zip")) for s in range(0, max(size, 1), range_bytes)]
    if not ranges:
        return ""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            odd = []
            for p, s, e in zip(b["path"], b["start"].tolist(), b["end"].tolist()):
                fs, at = file_system(p)
                with fs.open_input_file(at) as f:
                    f.seek(s)
                    n = 0
                    while s < e and (chunk := f.read(min(CHUNK, e - s))):
                        n, s = n + chunk.count(b'"'), s + len(chunk)
                odd.append(n % 2 == 1)
            yield b[["file", "start"]].assign(odd=odd)

    rows = spark.createDataFrame(ranges, "file int, path string, start long, end long").repartition(min(len(ranges), 4 * spark.sparkContext.defaultParallelism), "file", "start")
    odd = {(r["file"], r["start"]): r["odd"] for r in rows.mapInPandas(count, "file int, start long, odd boolean").collect()}
    out, file, state = [], None, False
    for i, _, s, _ in ranges:
        state = False if i != file else state
        out.append("1" if state else "0")
        state, file = state ^ odd[i, s], i
    return "".join(out)


def read_delimited_files(spark: SparkSession, path: str, delimiter: str | None = None, range_bytes: int = RANGE_BYTES, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Rows of all archives and files below path; see the module."""
    spark.dataSource.register(DelimitedSource)
    reader = spark.read.format("tally_delimited").option("rangeBytes", range_bytes).option("extensions", ",".join(extensions)).option("quoted", quote_states(spark, path, range_bytes, extensions))
    return (reader.option("delimiter", delimiter) if delimiter else reader).load(path)


def write_files(rows: DataFrame, folder: str) -> None:
    """Write rows (file, entry, seq, line) to files below folder, in order of entry and seq; a file whose name ends in .zip becomes an archive of its entries.

    A file is one task's stream. It is moved to its name when it is whole, so a task that runs again does no harm.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        name = entry = sink = z = text = None
        part, done = "", []

        def close_entry() -> None:
            nonlocal text
            if text is not None:
                text.close()
                text = None

        def close_file() -> None:
            nonlocal z, sink
            close_entry()
            if z is not None:
                z.close()
                z = None
            if sink is not None:
                if not sink.closed:
                    sink.close()
                fs.move(part, f"{root}/{name}")
                done.append(name)
                sink = None

        for b in batches:
            for f, e, line in zip(b["file"], b["entry"], b["line"]):
                if f != name:
                    close_file()
                    name, entry, part = f, None, f"{root}/.{uuid.uuid4().hex}"
                    sink = fs.open_output_stream(part)
                    if f.lower().endswith(".zip"):
                        z = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
                if z is not None and e != entry:
                    close_entry()
                    entry, text = e, io.TextIOWrapper(z.open(e, "w"), encoding="utf-8", newline="")
                if text is not None:
                    text.write(line)
                else:
                    sink.write(line.encode())
        close_file()
        yield pd.DataFrame({"file": done})

    rows.select("file", "entry", "seq", "line").repartition("file").sortWithinPartitions("file", "entry", "seq").select("file", "entry", "line").mapInPandas(run, "file string").write.format("noop").mode("overwrite").save()


def base_name(column: str):
    return F.element_at(F.split(column, "/"), -1)


