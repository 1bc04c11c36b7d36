"""``spark.read.format("tns")`` and ``df.write.format("tns")``: tensors as text, read by byte ranges and written with a commit.

Files are reached through pyarrow's file systems: local and mounted paths, and the stores that it knows by their URI.
``text.read_tns`` reads the same files by Spark's own text source, from any store that Spark reaches.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv, fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tensorloom.errors import ShapeMismatchError, TensorValueError
from tensorloom.tensor import SparseTensor, mode_names, schema

#: Bytes of a split, unless the option ``splitBytes`` says otherwise, and of a piece of it that is parsed at once.
SPLIT_BYTES, PIECE_BYTES = 64 << 20, 8 << 20
#: Names that start so are no data.
HIDDEN = ("_", ".")
HEADER_NAME, DONE_NAME = "00000-header.tns", "_SUCCESS"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def data_files(store: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """The file, or the folder's files that aren't hidden, by name."""
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [info]
    if info.type == fs.FileType.NotFound:
        return []
    found = store.get_file_info(fs.FileSelector(path))
    return sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(HIDDEN)), key=lambda f: f.base_name)


def header_of(store: fs.FileSystem, file: fs.FileInfo) -> tuple[tuple[int, ...], int]:
    """The sizes that a file's first two lines give (blank ones aside), and the byte after them."""
    lines, at = [], 0
    with store.open_input_stream(file.path) as f:
        rest = b""
        while len(lines) < 2:
            block = f.read(1 << 16)
            whole, cut, rest = (rest + block).rpartition(b"\n") if block else (rest, b"", b"")
            for line in (whole + cut).splitlines(keepends=True) or []:
                if len(lines) < 2:
                    at += len(line)
                    if line.strip():
                        lines.append(line.split())
            if not block:
                break
    try:
        (n,), ndims = (int(w) for w in lines[0]), tuple(int(w) for w in lines[1])
    except (ValueError, IndexError) as e:
        raise TensorValueError("the first two lines don't give the modes and their sizes") from e
    if n != len(ndims) or n < 1:
        raise TensorValueError(f"{len(ndims)} sizes for {n} modes")
    return ndims, at


def sizes_of(option: str) -> tuple[int, ...]:
    return tuple(int(w) for w in re.split(r"[\s,x]+", option.strip()))


@dataclass
class Split(InputPartition):
    """The lines of a file that start at the bytes ``start`` (inclusive) to ``end`` (exclusive)."""

    path: str
    start: int
    end: int


def pieces(stream, start: int, end: int, piece: int = PIECE_BYTES) -> Iterator[bytes]:
    """The whole lines that start in [start, end), some megabytes at a time. A line belongs to the split of its first byte."""
    if start:
        stream.seek(start - 1)
        at, before = start - 1, b""
        while b"\n" not in before:  # the line that goes on from the split before
            before = stream.read(1 << 12)
            if not before:
                return
            at += len(before)
        skipped = before.index(b"\n") + 1
        at += skipped - len(before)
        stream.seek(at)
    else:
        at = 0
    rest = b""
    while at < end:
        block = stream.read(min(piece, end - at))
        if not block:
            break
        at += len(block)
        whole, cut, rest = (rest + block).rpartition(b"\n")
        if cut:
            yield whole + cut
    if at < start:
        return
    while rest:  # the last line may end beyond the split
        block = stream.read(1 << 12)
        line, cut, _ = block.partition(b"\n")
        rest += line
        if cut or not block:
            yield rest
            return


def parsed(lines: bytes, nmodes: int, start_index: int, strict: bool) -> pa.RecordBatch:
    """The entries of ``lines``, indices from 0, without explicit zeros. strict: a malformed line raises; else it is left out."""
    names, ints = [*mode_names(nmodes), "v"], {m: pa.int64() for m in mode_names(nmodes)}
    clean = re.sub(rb"(?m)^ | $", b"", re.sub(rb"[ \t\r\f\v]+", b" ", lines))
    if not clean.strip():
        return pa.RecordBatch.from_pylist([], pa.schema([(n, ints.get(n, pa.float64())) for n in names]))
    try:
        table = csv.read_csv(
            io.BytesIO(clean), csv.ReadOptions(column_names=names, block_size=max(1 << 20, len(clean) + 1)), csv.ParseOptions(delimiter=" ", quote_char=False),
            csv.ConvertOptions(column_types=ints | {"v": pa.float64()}, null_values=[]),
        )
    except pa.ArrowInvalid:
        table = _line_by_line(clean, names, strict)
    low = pc.fill_null(pc.less(pc.min_element_wise(*(table.column(m) for m in names[:-1])), start_index), False)
    if pc.any(low).as_py():
        if strict:
            raise TensorValueError(f"an index is below {start_index}")
        table = table.filter(pc.invert(low))
    table = table.filter(pc.not_equal(table.column("v"), 0.0))
    columns = [pc.subtract(table.column(m), start_index) for m in names[:-1]] + [table.column("v")]
    return pa.Table.from_arrays(columns, names=names).combine_chunks().to_batches()[0] if len(table) else parsed(b"", nmodes, start_index, strict)


def _line_by_line(lines: bytes, names: Sequence[str], strict: bool) -> pa.Table:
    rows = []
    for line in lines.split(b"\n"):
        words = line.split()
        if not words:
            continue
        try:
            if len(words) != len(names):
                raise ValueError
            rows.append((*map(int, words[:-1]), float(words[-1])))
        except ValueError as e:
            if strict:
                raise TensorValueError(f"malformed entry: {line.decode(errors='replace')}") from e
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table({n: pa.array(c, pa.float64() if n == "v" else pa.int64()) for n, c in zip(names, columns)})


class TnsReader(DataSourceReader):
    """Splits of ``splitBytes``; the header is that of the first file by name, unless the option ``ndims`` says there is none."""

    def __init__(self, nmodes: int, options: dict):
        self.nmodes, self.path, self.headless = nmodes, options["path"], "ndims" in options
        self.split, self.start_index = int(options.get("splitbytes", SPLIT_BYTES)), int(options.get("startindex", 1))
        self.strict = options.get("strict", "true").lower() == "true"

    def partitions(self) -> Sequence[InputPartition]:
        store, path = located(self.path)
        out = []
        for k, f in enumerate(data_files(store, path)):
            first = 0 if k or self.headless else header_of(store, f)[1]
            out += [Split(f.path, at, min(at + self.split, f.size)) for at in range(first, f.size, self.split)]
        return out or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = located(self.path)
        with store.open_input_file(partition.path) as f:
            for lines in pieces(f, partition.start, partition.end):
                yield parsed(lines, self.nmodes, self.start_index, self.strict)


@dataclass
class Written(WriterCommitMessage):
    """A task's file in the staging folder; none, if it had no rows."""

    name: str | None


class TnsWriter(DataSourceArrowWriter):
    """Tasks write to a staging folder, each attempt its own file; the commit moves the files of the attempts that count,
    writes the header and last ``_SUCCESS``. An abort leaves what was there before."""

    def __init__(self, nmodes: int, options: dict, overwrite: bool):
        if "ndims" not in options:
            raise TensorValueError("the option ndims must give the modes' sizes")
        self.ndims, self.path, self.overwrite = sizes_of(options["ndims"]), options["path"], overwrite
        if len(self.ndims) != nmodes:
            raise ShapeMismatchError(f"{len(self.ndims)} sizes for {nmodes} modes")
        self.start_index, self.job = int(options.get("startindex", 1)), uuid.uuid4().hex
        store, path = located(self.path)
        old = data_files(store, path)
        if old and not overwrite and header_of(store, old[0])[0] != self.ndims:
            raise ShapeMismatchError(f"{header_of(store, old[0])[0]} are the sizes that are there")

    @property
    def _staging(self) -> str:
        return f"{located(self.path)[1]}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, name, out = located(self.path)[0], f"part-{uuid.uuid4().hex}.tns", None
        try:
            for batch in iterator:
                if not len(batch):
                    continue
                if out is None:
                    store.create_dir(self._staging)
                    out = store.open_output_stream(f"{self._staging}/{name}")
                words = [pc.cast(pc.add(batch.column(m), self.start_index), pa.string()) for m in mode_names(len(self.ndims))]
                words.append(pa.array(np.char.mod("%.6f", batch.column("v").to_numpy(zero_copy_only=False)), pa.string()))
                lines = pc.binary_join_element_wise(*words, "\t")
                out.write(("\n".join(lines.to_pylist()) + "\n").encode())
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = located(self.path)
        store.create_dir(path)
        old = [f.path for f in data_files(store, path)]
        if self.overwrite:
            for f in old:
                store.delete_file(f)
        if self.overwrite or not old:
            with store.open_output_stream(f"{path}/{HEADER_NAME}") as f:
                f.write(f"{len(self.ndims)}\n{' '.join(map(str, self.ndims))}\n".encode())
        for m in messages:
            if m is not None and m.name:
                store.move(f"{self._staging}/{m.name}", f"{path}/{m.name}")
        self._clear()
        with store.open_output_stream(f"{path}/{DONE_NAME}"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store = located(self.path)[0]
        if store.get_file_info(self._staging).type == fs.FileType.Directory:
            store.delete_dir(self._staging)


class TnsSource(DataSource):
    """Options: path; startIndex (1); ndims, sizes of a file without header, or those to write; strict (true); splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "tns"

    def _ndims(self) -> tuple[int, ...]:
        if "ndims" in self.options:
            return sizes_of(self.options["ndims"])
        store, path = located(self.options["path"])
        files = data_files(store, path)
        if not files:
            raise TensorValueError(f"no files in {self.options['path']}")
        return header_of(store, files[0])[0]

    def schema(self) -> StructType:
        return schema(len(self._ndims()))

    def reader(self, schema: StructType) -> TnsReader:
        return TnsReader(len(schema.fields) - 1, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> TnsWriter:
        return TnsWriter(len(schema.fields) - 1, {k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``format("tns")`` known to the session."""
    spark.dataSource.register(TnsSource)


def load(spark: SparkSession, path: str, start_index: int = 1, ndims: Sequence[int] | None = None, strict: bool = True, split_bytes: int = SPLIT_BYTES) -> SparseTensor:
    """A tensor from ``format("tns")``."""
    register(spark)
    reader = spark.read.format("tns").option("startIndex", start_index).option("strict", str(strict).lower()).option("splitBytes", split_bytes)
    if ndims is None:
        store, where = located(path)
        files = data_files(store, where)
        if not files:
            raise TensorValueError(f"no files in {path}")
        sizes = header_of(store, files[0])[0]
    else:
        sizes, reader = tuple(ndims), reader.option("ndims", " ".join(map(str, ndims)))
    return SparseTensor(reader.load(path), sizes)


def save(x: SparseTensor, path: str, start_index: int = 1, mode: str = "append") -> None:
    """A tensor by ``format("tns")``: its entries dealt out by ranges and sorted within files; mode append or overwrite."""
    register(x.df.sparkSession)
    ranged = x.df.repartitionByRange(*x.modes).sortWithinPartitions(*x.modes)
    ranged.write.format("tns").mode(mode).option("startIndex", start_index).option("ndims", " ".join(map(str, x.ndims))).save(path)
