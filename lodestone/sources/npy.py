"""Array files as a data source: spark.read.format("npy"), df.write.format("npy"), once register() has been called.

Reading: path is an array file, or a folder that this source has written. An array file gives (id, vector), the id being the row's number; it is read by ranges of
rows_per_partition rows, of which only the bytes are fetched. Any file system that pyarrow knows will do; all executors must reach it.

Writing: rows(id, vector) go to pairs of files of up to rows_per_file rows, named after the attempt that wrote them, and a manifest that names the pairs of the attempts
that were committed comes last. Readers go by the manifest alone: files of a task that was lost or ran twice are no part of the table, and are removed. Overwriting
puts a new manifest in place before old files go, so that a failed job leaves the old table.

Cases: null ids or vectors, vectors with nulls and vectors of different lengths are errors; components that aren't finite are kept; an empty table is a manifest without files. Extra columns
are an error, as names are the format's own."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "id long, vector array<float>"
MANIFEST = "manifest.json"
ROWS_PER_PARTITION, ROWS_PER_FILE, BATCH = 100_000, 65_536, 4096


def _open(path: str):
    """The file system and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _header(file) -> tuple[int, tuple, np.dtype]:
    """Where the rows begin, the array's shape and its type. Arrays in columns' order are an error, as a row isn't in one place."""
    version = np.lib.format.read_magic(file)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
    if read is None:
        raise ValueError(f"array files of version {version} are not known")
    shape, fortran, dtype = read(file)
    if (fortran and len(shape) > 1) or dtype.hasobject:
        raise ValueError("arrays must be in rows' order and hold numbers")
    return file.tell(), shape, dtype


@dataclass
class Rows(InputPartition):
    vectors: str
    ids: str | None
    lo: int
    hi: int


def _range(system, path: str, lo: int, hi: int) -> np.ndarray:
    """Rows lo to hi of an array file; only their bytes are read."""
    with system.open_input_file(path) as f:
        begin, shape, dtype = _header(f)
        width = int(np.prod(shape[1:], dtype=np.int64))
        f.seek(begin + lo * width * dtype.itemsize)
        data = f.read((hi - lo) * width * dtype.itemsize)
    return np.frombuffer(data, dtype).reshape(hi - lo, *shape[1:])


class NpyReader(DataSourceReader):
    def __init__(self, path: str, step: int):
        self.path, self.step = path, step

    def partitions(self) -> list[Rows]:
        from pyarrow import fs

        system, at = _open(self.path)
        kind = system.get_file_info(at).type
        if kind == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if kind == fs.FileType.File:
            with system.open_input_file(at) as f:
                _, shape, _ = _header(f)
            if len(shape) != 2:
                raise ValueError("the array must have two dimensions")
            held = [(at, None, shape[0])]
        else:
            with system.open_input_stream(posixpath.join(at, MANIFEST)) as f:
                held = [(posixpath.join(at, x["vectors"]), posixpath.join(at, x["ids"]), x["n"]) for x in json.loads(f.read())["files"]]
        parts = [Rows(v, i, lo, min(lo + self.step, n)) for v, i, n in held for lo in range(0, n, self.step)]
        return parts or [Rows("", None, 0, 0)]

    def read(self, partition: Rows) -> Iterator:
        import pyarrow as pa

        system, _ = _open(self.path)
        for lo in range(partition.lo, partition.hi, BATCH):
            hi = min(lo + BATCH, partition.hi)
            x = np.ascontiguousarray(_range(system, partition.vectors, lo, hi), np.float32)
            ids = np.arange(lo, hi) if partition.ids is None else _range(system, partition.ids, lo, hi).astype(np.int64)
            ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)) if x.shape[1] else pa.array(np.zeros(len(x) + 1, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["id", "vector"])


@dataclass
class Wrote(WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, rows: int):
        self.path, self.overwrite, self.rows, self.job = path, overwrite, rows, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Wrote:
        import pyarrow as pa
        from pyspark import TaskContext

        system, at = _open(self.path)
        system.create_dir(at)
        context, out, held, n = TaskContext.get(), Wrote(), [], 0
        attempt = f"{self.job}-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"

        def put():
            nonlocal held, n
            if n:
                ids, v = (np.concatenate(x) for x in zip(*held))
                one = {"n": n, "dim": v.shape[1], **{k: f"{attempt}-{len(out.files):04d}-{k}.npy" for k in ("vectors", "ids")}}
                for name, x in (("vectors", v), ("ids", ids)):
                    with system.open_output_stream(posixpath.join(at, one[name])) as f:
                        np.lib.format.write_array(f, x, allow_pickle=False)
                out.files.append(one)
            held, n = [], 0

        for batch in iterator:
            for lo in range(0, batch.num_rows, BATCH):
                ids, v = (batch.slice(lo, BATCH).column(batch.schema.get_field_index(c)) for c in ("id", "vector"))
                x = v.flatten()
                dim = len(x) // len(v)
                lengths = np.diff(v.offsets.to_numpy()) if not v.null_count else np.zeros(0)
                if ids.null_count or v.null_count or x.null_count or (lengths != dim).any() or (held and held[0][1].shape[1] != dim):
                    raise ValueError("ids and vectors must not be null, and vectors must be of one length")
                held.append((ids.cast(pa.int64()).to_numpy(), x.to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(v), dim)))
                n += len(v)
                if n >= self.rows:
                    put()
        put()
        return out

    def _manifest(self, system, at: str) -> list[dict]:
        try:
            with system.open_input_stream(posixpath.join(at, MANIFEST)) as f:
                return json.loads(f.read())["files"]
        except FileNotFoundError:
            return []

    def commit(self, messages: list) -> None:
        system, at = _open(self.path)
        system.create_dir(at)
        before = self._manifest(system, at)
        made = [x for m in messages if m is not None for x in m.files]
        kept = made if self.overwrite else before + made
        if len({x["dim"] for x in kept}) > 1:
            self.abort(messages)
            raise ValueError("vectors of another dimension")
        fresh = posixpath.join(at, f"{self.job}.json")
        with system.open_output_stream(fresh) as f:
            f.write(json.dumps({"version": 1, "files": kept}).encode())
        system.move(fresh, posixpath.join(at, MANIFEST))
        self._remove(system, at, {x[k] for x in kept for k in ("vectors", "ids")}, {x[k] for x in before for k in ("vectors", "ids")})

    def abort(self, messages: list) -> None:
        system, at = _open(self.path)
        self._remove(system, at, set(), set())

    def _remove(self, system, at: str, kept: set[str], before: set[str]) -> None:
        """Removes the files of this job, and those of the table before, that are not kept. Files of other jobs stay."""
        from pyarrow import fs

        for x in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if x.base_name not in kept and (x.base_name.startswith(self.job) or x.base_name in before):
                system.delete_file(x.path)


class NpySource(DataSource):
    """Options: path, rows_per_partition (reading), rows_per_file (writing)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("rows_per_partition", ROWS_PER_PARTITION)))

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        if sorted(schema.names) != ["id", "vector"]:
            raise ValueError("array files hold id and vector")
        return NpyWriter(self.options["path"], overwrite, int(self.options.get("rows_per_file", ROWS_PER_FILE)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)
