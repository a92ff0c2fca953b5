"""NumPy archives (.npz) as a Spark data source, for reading and for writing.

Reading: ``spark.read.format("npz").schema(...).option("path", ...).load()``. Each column of the schema is a member of the archives, and no other member
is read. ``file`` is the archive's name and ``ord`` the row's place in it, unless it has members of these names. A member without dimensions holds
for each row, one with two gives arrays, one that is missing gives nulls (an error where option ``required`` names it). Small archives share
a task, large ones are cut into ranges of rows, and a task holds one block of rows at a time.

Writing: ``df.write.format("npz")``; :func:`write_archives` deals rows to tasks first. Files are written beside the target and moved
there when all tasks are done, so that a failed write leaves nothing.
"""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BLOCK = 16_384


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system and the path in it; ``file:/x`` and a plain absolute path are local."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


class _Member:
    """One array of an archive, read by ranges of rows."""

    def __init__(self, archive: zipfile.ZipFile, name: str):
        self.archive, self.name = archive, f"{name}.npy"
        with archive.open(self.name) as f:
            version = np.lib.format.read_magic(f)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            self.shape, self.by_column, self.dtype = read(f)
            self.start = f.tell()
        if self.dtype.hasobject:
            raise ValueError(f"{archive.filename or 'archive'}: member {name} holds Python objects")
        self.open = None

    def rows(self, begin: int, end: int) -> np.ndarray:
        if not self.shape or (self.by_column and len(self.shape) > 1):
            with self.archive.open(self.name) as f:
                whole = np.lib.format.read_array(f, allow_pickle=False)
            return np.broadcast_to(whole, (end - begin,)) if not self.shape else whole[begin:end]
        if self.open is None:
            self.open = self.archive.open(self.name)
        width = self.dtype.itemsize * int(np.prod(self.shape[1:], dtype=np.int64))
        self.open.seek(self.start + begin * width)
        return np.frombuffer(self.open.read((end - begin) * width), self.dtype).reshape(-1, *self.shape[1:])


def _length(name: str, archive: zipfile.ZipFile, wanted: list[str]) -> int:
    """Rows of an archive: the length of the wanted members, or of the first one that has a length."""
    have = [n.removesuffix(".npy") for n in archive.namelist()]
    lengths = {}
    for n in [w for w in wanted if w in have] or have:
        shape = _Member(archive, n).shape
        if shape:
            lengths[n] = shape[0]
            if not set(wanted) & set(have):
                break
    if not lengths and set(wanted) & set(have):
        return _length(name, archive, [])
    if len(set(lengths.values())) > 1:
        raise ValueError(f"{name}: members of unequal lengths {lengths}")
    return next(iter(lengths.values()), 1 if have else 0)


@dataclass
class Ranges(InputPartition):
    """Ranges of rows of archives: (path, first row, row after the last or None for all)."""

    parts: list[tuple[str, int, int | None]]


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, required: list[str], split: int):
        self.schema, self.path, self.required, self.split = schema, path, required, split
        self.wanted = [f.name for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        """Archives up to ``split`` bytes are put together by their sizes; of larger ones the headers alone are read here."""
        files, base = _place(self.path)
        info = files.get_file_info(base)
        found = [info] if info.type == fs.FileType.File else sorted(files.get_file_info(fs.FileSelector(base, recursive=True)), key=lambda i: i.path)
        out, held, size = [], [], 0
        for f in found:
            inner = f.path[len(base) :]
            if f.type != fs.FileType.File or not f.path.endswith(".npz") or any(p.startswith(("_", ".")) for p in inner.split("/")[:-1]):
                continue
            if f.size > self.split:
                with files.open_input_file(f.path) as source, zipfile.ZipFile(source) as archive:
                    n = _length(f.path, archive, self.wanted)
                step = max(1, -(-n // -(-f.size // self.split)))
                out += [Ranges([(f.path, k, min(n, k + step))]) for k in range(0, n, step)]
                continue
            if held and size + f.size > self.split:
                out.append(Ranges(held))
                held, size = [], 0
            held.append((f.path, 0, None))
            size += f.size
        return out + ([Ranges(held)] if held else []) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(self.schema)
        files, _ = _place(self.path)
        for path, begin, end in partition.parts:
            with files.open_input_file(path) as source, zipfile.ZipFile(source) as archive:
                have = {n.removesuffix(".npy") for n in archive.namelist()}
                if missing := [r for r in self.required if r not in have]:
                    raise ValueError(f"{posixpath.basename(path)} lacks {', '.join(missing)}")
                stop = _length(path, archive, self.wanted) if end is None else end
                members = {w: _Member(archive, w) for w in self.wanted if w in have}
                for k in range(begin, stop, BLOCK):
                    to = min(stop, k + BLOCK)
                    columns = []
                    for field in kind:
                        if field.name in members:
                            got = members[field.name].rows(k, to)
                            columns.append(pa.array(list(got) if got.ndim > 1 else got).cast(field.type))
                        elif field.name == "ord":
                            columns.append(pa.array(np.arange(k, to)).cast(field.type))
                        elif field.name == "file":
                            columns.append(pa.array([posixpath.basename(path)] * (to - k)))
                        else:
                            columns.append(pa.nulls(to - k, field.type))
                    yield pa.RecordBatch.from_arrays(columns, schema=kind)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    """Rows that come in order of ``by`` as archives of at most ``rows`` rows with one value of ``by`` each; these columns become members without dimensions.
    Null numbers are NaN in columns of doubles; any other null is an error, and so are arrays of unequal lengths in a file."""

    def __init__(self, path: str, by: list[str], rows: int, overwrite: bool):
        self.path, self.by, self.rows, self.overwrite, self.job = path, by, rows, overwrite, uuid.uuid4().hex[:12]

    def _aside(self, base: str) -> str:
        return f"{base.rstrip('/')}/_writing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, base = _place(self.path)
        task = TaskContext.get()
        aside = f"{self._aside(base)}/{task.taskAttemptId()}"
        held: list[pa.RecordBatch] = []
        count, current, out = 0, None, []

        def flush() -> None:
            nonlocal held, count
            if count:
                name = f"{'_'.join(quote(str(v), safe='') for v in current or ('part',))}-{self.job}-{task.partitionId():05d}-{len(out):05d}.npz"
                content = io.BytesIO()
                np.savez(content, **self._arrays(pa.Table.from_batches(held)))
                files.create_dir(aside)
                with files.open_output_stream(f"{aside}/{name}") as sink:
                    sink.write(content.getvalue())
                out.append(f"{task.taskAttemptId()}/{name}")
            held, count = [], 0

        for batch in iterator:
            keys = list(zip(*(batch.column(c).to_pylist() for c in self.by), strict=True)) if self.by else [()] * batch.num_rows
            begin = 0
            while begin < batch.num_rows:
                if count == self.rows or keys[begin] != current:
                    flush()
                    current = keys[begin]
                end = begin
                while end < batch.num_rows and keys[end] == current and count + end - begin < self.rows:
                    end += 1
                held.append(batch.slice(begin, end - begin))
                count += end - begin
                begin = end
        flush()
        return Written(out)

    def _arrays(self, rows: pa.Table) -> dict[str, np.ndarray]:
        out = {}
        for name, column in zip(rows.column_names, rows.columns, strict=True):
            column = column.combine_chunks()
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            if column.null_count and not pa.types.is_floating(column.type):
                raise ValueError(f"column {name} has nulls, which an archive can't hold")
            if pa.types.is_list(column.type):
                array = np.array(column.to_pylist(), column.type.value_type.to_pandas_dtype())  # unequal lengths are an error
            elif pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                array = np.array(column.to_pylist(), str)
            else:
                array = column.to_numpy(zero_copy_only=False)
            out[name] = array[0] if name in self.by else array
        return out

    def commit(self, messages: list[Written | None]) -> None:
        files, base = _place(self.path)
        files.create_dir(base)
        for name in [n for m in messages if m for n in m.files]:
            files.move(f"{self._aside(base)}/{name}", f"{base}/{posixpath.basename(name)}")
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(base)):
                if f.path.endswith(".npz") and f"-{self.job}-" not in posixpath.basename(f.path):
                    files.delete_file(f.path)
        self._clear(files, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_place(self.path))

    def _clear(self, files: fs.FileSystem, base: str) -> None:
        if files.get_file_info(self._aside(base)).type == fs.FileType.Directory:
            files.delete_dir(self._aside(base))


class ArchiveSource(DataSource):
    """Options: ``path``; for reading ``required`` (members, by commas) and ``split_bytes`` (128 MiB); for writing ``by`` (columns, by commas) and ``rows`` (65,536)."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> StructType:
        raise ValueError("give the columns to read by .schema(...)")

    def _names(self, option: str) -> list[str]:
        return [n for n in self.options.get(option, "").split(",") if n]

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(schema, self.options["path"], self._names("required"), int(self.options.get("split_bytes", 128 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], self._names("by"), int(self.options.get("rows", 65_536)), overwrite)


def read_archives(spark: SparkSession, path: str, schema: str, required: str = "", split_bytes: int = 128 << 20) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("npz").schema(schema).option("required", required).option("split_bytes", split_bytes).option("path", path).load()


def write_archives(rows: DataFrame, path: str, by: list[str], order: list[str], parts: int = 16, file_rows: int = 65_536) -> None:
    """Archives by ``by``, each in order of ``order``. Rows of one key are dealt to ``parts`` tasks by a hash of ``order``, so a key with
    most of the rows is spread over tasks and files."""
    rows.sparkSession.dataSource.register(ArchiveSource)
    deal = F.pmod(F.xxhash64(*order), F.lit(parts))
    dealt = rows.withColumn("_part", deal).repartition(*by, "_part").sortWithinPartitions(*by, "_part", *order).drop("_part")
    dealt.write.format("npz").option("by", ",".join(by)).option("rows", file_rows).option("path", path).mode("overwrite").save()
