"""Matrix files (.npy) as vectors: a Python data source that plans chunks from the headers and reads slices.

A folder of files is one matrix, its files one after the other by name; a sample's id is its number in that order. Nothing
but headers is read to plan: their shapes give the number and length of the vectors, and every partition is a range of
samples of at most `partition_mb` megabytes of doubles. Samples may be rows or columns of the files, and these in C or
Fortran order: where a sample's numbers lie together, a slice is one read, else it is one read for each coordinate.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "id long, x array<double>"
#: Bytes of doubles in one Arrow batch.
BATCH_BYTES = 8 << 20
#: Headers of files are read by so many threads of the driver.
HEADER_THREADS = 32


def open_path(path: str):
    """File system and path within it, for any URI that Arrow knows (file, hdfs, s3, gs), or a local path."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = path.replace("file:", "file://", 1)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Header:
    """What a file's first bytes say: samples and their length, the type of a number, where numbers begin and how they lie."""

    def __init__(self, system, path: str, columns: bool):
        with system.open_input_file(path) as f:
            head = io.BytesIO(f.read(min(f.size(), 1 << 16)))
            size = f.size()
        try:
            version = np.lib.format.read_magic(head)
            shape, fortran, self.dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
        except ValueError as e:
            raise ValueError(f"{path} is no matrix file: {e}") from None
        if len(shape) != 2 or self.dtype.kind not in "fiu":
            raise ValueError(f"{path} holds {self.dtype} of shape {shape}, not a matrix of numbers")
        self.path, self.start = path, head.tell()
        self.n, self.p = shape[::-1] if columns else shape
        #: Whether a sample's numbers lie together.
        self.together = fortran == columns or 1 in shape
        if size < self.start + self.n * self.p * self.dtype.itemsize:
            raise ValueError(f"{path} is cut off")


def headers(path: str, columns: bool = False) -> list[Header]:
    """The headers of a file or of a folder's .npy files by name; ValueError if there is none or their vectors differ in length."""
    from pyarrow import fs

    system, root = open_path(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.Directory:
        names = sorted(x.path for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and x.base_name.endswith(".npy") and x.base_name[0] not in "._")
    else:
        names = [root] if info.type == fs.FileType.File else []
    if not names:
        raise ValueError(f"no matrix files at {path}")
    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        found = list(pool.map(lambda name: Header(system, name, columns), names))
    lengths = {h.p for h in found}
    if len(lengths) > 1:
        raise ValueError(f"vectors of {min(lengths)} to {max(lengths)} entries")
    return found


def matrix_file_shape(path: str, samples: str = "rows") -> tuple[int, int]:
    """(number of samples, entries of each), from the headers alone."""
    found = headers(path, samples == "columns")
    return sum(h.n for h in found), found[0].p


def chunk_rows(n: int, p: int, mb: float) -> int:
    """Samples that fit in mb megabytes of doubles, one at least and n at most."""
    return max(1, min(n, int(mb * 2**20) // (8 * p)))


class Slices(InputPartition):
    """Ranges of samples: (file number, first sample in it, samples, id of the first)."""

    def __init__(self, ranges: list[tuple[int, int, int, int]]):
        super().__init__(tuple(ranges))


class NpySource(DataSource):
    """`spark.read.format("npy").load(path)`: (id, x). Options: samples (rows or columns), partition_mb (default 128).

    Written, (id, x) becomes files of at most partition_mb, in the order of partitions and of rows in them; ids aren't kept.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options, [f.name for f in schema.fields], overwrite)


class NpyReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.columns = options.get("path", ""), options.get("samples", "rows") == "columns"
        self.mb = float(options.get("partition_mb", "128"))

    def partitions(self):
        self.files = headers(self.path, self.columns)
        most = chunk_rows(max(1, sum(h.n for h in self.files)), max(1, self.files[0].p), self.mb)
        packs: list[list[tuple[int, int, int, int]]] = []
        room, before = 0, 0
        for k, h in enumerate(self.files):
            at = 0
            while at < h.n:
                if not room:
                    packs.append([])
                    room = most
                take = min(room, h.n - at)
                packs[-1].append((k, at, take, before + at))
                at, room = at + take, room - take
            before += h.n
        return [Slices([(self.files[k], *r) for k, *r in pack]) for pack in packs] or [Slices([])]

    def read(self, partition) -> Iterator:
        import pyarrow as pa

        system, _ = open_path(self.path)
        for h, first, count, id_ in partition.value:
            with system.open_input_file(h.path) as f:
                for x in self.rows(f, h, first, count):
                    ids = pa.array(np.arange(id_, id_ + len(x)))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * h.p), pa.array(x.astype(np.float64, copy=False).ravel()))
                    yield pa.RecordBatch.from_arrays([ids, lists], ["id", "x"])
                    id_ += len(x)

    @staticmethod
    def rows(f, h: Header, first: int, count: int) -> Iterator[np.ndarray]:
        """Samples first to first + count as matrices of rows, some BATCH_BYTES each."""
        item, step = h.dtype.itemsize, max(1, BATCH_BYTES // (8 * max(1, h.p)))

        def numbers(at: int, n: int) -> np.ndarray:
            f.seek(h.start + at * item)
            return np.frombuffer(f.read(n * item), h.dtype)

        if h.together:
            for at in range(first, first + count, step):
                n = min(step, first + count - at)
                yield numbers(at * h.p, n * h.p).reshape(n, h.p)
            return
        every = np.empty((count, h.p))  # at most partition_mb, of which each read brings one coordinate
        for j in range(h.p):
            every[:, j] = numbers(j * h.n + first, count)
        for at in range(0, count, step):
            yield every[at : at + step]


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class NpyWriter(DataSourceArrowWriter):
    """Each task writes its files under names of its own; the driver gives those of the tasks that count their final names."""

    def __init__(self, options, names: list[str], overwrite: bool):
        self.path, self.mb, self.overwrite = options.get("path", ""), float(options.get("partition_mb", "128")), overwrite
        self.x = names.index("x")

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, root = open_path(self.path)
        system.create_dir(root, recursive=True)
        held, files = [], []

        def flush() -> None:
            # The name holds partition and attempt, so that a task run twice doesn't write into its other self's files.
            name = f"{root}/_part-{context.partitionId():06d}-{len(files):06d}-{context.taskAttemptId()}.npy"
            with system.open_output_stream(name) as out:
                body = io.BytesIO()
                np.lib.format.write_array(body, np.concatenate(held), allow_pickle=False)
                out.write(body.getbuffer())
            files.append(name)
            held.clear()

        for batch in iterator:
            column = batch.column(self.x)
            if not batch.num_rows:
                continue
            lengths = np.unique(np.diff(column.offsets.to_numpy())) if not column.null_count else ()
            if len(lengths) != 1 or (held and held[0].shape[1] != lengths[0]) or column.flatten().null_count:
                raise ValueError("a matrix file needs vectors of one length, without nulls")
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            most = chunk_rows(1 << 62, max(1, x.shape[1]), self.mb)
            while len(x):
                room = most - sum(map(len, held))
                held.append(x[:room])
                x = x[room:]
                if sum(map(len, held)) == most:
                    flush()
        if held:
            flush()
        return Written(files)

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, root = open_path(self.path)
        new = [name for m in messages if m is not None for name in m.files]
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(root)):
                if x.type == fs.FileType.File and x.base_name.startswith("part-") and x.base_name.endswith(".npy"):
                    system.delete_file(x.path)
        for name in new:
            head, base = name.rsplit("/", 1)
            system.move(name, f"{head}/{base[1:].rsplit('-', 1)[0]}.npy")

    def abort(self, messages) -> None:
        system, _ = open_path(self.path)
        for m in messages:
            for name in m.files if m is not None else ():
                system.delete_file(name)


def read_matrix(spark: SparkSession, path: str, samples: str = "rows", partition_mb: float = 128) -> DataFrame:
    """(id, x) of the matrix files at `path`, in partitions of at most partition_mb; no setting of the session changes."""
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("samples", samples).option("partition_mb", str(partition_mb)).load(path)


def write_matrix(vectors: DataFrame, path: str, partition_mb: float = 128) -> None:
    """Writes the vectors (id, x) as matrix files in the order of their ids, which a range partitioning brings about.

    Replaces what an earlier call has written there. Vectors that are null, hold nulls or differ in length within a
    task are refused with ValueError; those that differ between files are refused when they are read.
    """
    vectors.sparkSession.dataSource.register(NpySource)
    ordered = vectors.select("id", "x").repartitionByRange("id").sortWithinPartitions("id")
    ordered.write.format("npy").option("partition_mb", str(partition_mb)).mode("overwrite").save(path)
