"""Helpers shared by the training-data operators: shared storage, batch slicing and hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
#: Where the C library has it.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Words are runs of characters other than ASCII white space.
WORD = re.compile("[^\x20\x09-\x0d]+")
#: What str.split() takes for white space besides those six.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: ASCII capital letters to small ones; other characters stay.
LOWER_ASCII = {c: c + 32 for c in range(65, 91)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and Spark runs on this
    machine alone, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='tesserine-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df, written as Parquet to the shared folder and read again: lineage ends in durable files."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files behind a table made by written() once nothing reads them any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches to about BATCH_BYTES in this session: with the 64 MB that they are else, rows of texts take that
    several times over in both a task's JVM and its Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if (spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m"))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def released() -> None:
    """Returns the memory that this worker has freed to the system: workers outlive their tasks, and what they hold on to
    is missing in the next stage."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def unused(df: DataFrame, name: str) -> str:
    """A column name like the given one that no column of df has, in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI (file:, hdfs:, s3: and what else Arrow reads); executors use it for raw files."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if re.match("file:/[^/]", uri) else uri)


def publish(uri: str, data: bytes | Iterable[bytes]) -> int:
    """Writes a file under a temporary name, then moves it into place, so that readers never see part of one."""
    files, path = open_fs(uri)
    part, size = f"{path}.{uuid.uuid4().hex}", 0
    with files.open_output_stream(part, compression=None) as out:
        for block in [data] if isinstance(data, bytes) else data:
            out.write(block)
            size += len(block)
    files.move(part, path)
    return size


def fetch(uri: str) -> bytes:
    files, path = open_fs(uri)
    with files.open_input_stream(path, compression=None) as f:
        return f.read()


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in row slices of about max_bytes of the column; a longer row is a slice of its own, whole."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), dtype=np.int64)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if x is None else x for x in batch[column].to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    high = np.right_shift(x, np.uint64(30), out=np.empty_like(x))
    x ^= high
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, np.uint64(27), out=high)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(31), out=high)
    return x


def hash_strings(words: Iterable[str]) -> np.ndarray:
    """64-bit hashes of strings."""
    h = xxhash.xxh3_64_intdigest
    return np.array([h(w) for w in words], dtype=np.uint64)


class Tokens:
    """The tokens of a slice of texts: distinct strings, each token's index among them, and each text's token range."""

    __slots__ = ("bounds", "codes", "words")

    def __init__(self, lists: list[list[str]]):
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        self.bounds = np.concatenate([[0], np.cumsum(lengths)])
        self.words = list(dict.fromkeys(chain.from_iterable(lists)))
        at = dict(zip(self.words, range(len(self.words)), strict=True)).__getitem__
        self.codes = np.fromiter(map(at, chain.from_iterable(lists)), np.int64, int(self.bounds[-1]))

    @property
    def owner(self) -> np.ndarray:
        """The text of each token."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i]+1, ... of each range, one range after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def words(text: str) -> list[str]:
    """The runs of characters other than ASCII white space."""
    return WORD.findall(text) if OTHER_SPACE.search(text) else text.split()


def annotate(df: DataFrame, make: Callable[[], Callable[[list[str | None]], list[pa.Array]]], extra: dict[str, str], text: str = "text") -> DataFrame:
    """The rows of df with further columns that depend on the text; make() gives a task its function of a list of texts.

    All columns pass through, in one pass without a shuffle; a column of df with the name of a further one goes."""
    names = [c for c in df.columns if c not in extra]
    schema = T.StructType([*(df.schema[c] for c in names), *(T.StructField(c, T._parse_datatype_string(t)) for c, t in extra.items())])
    given = text if text in names else f"{text}__given"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for part in slices(batches, given, 2 << 20):
            yield pa.RecordBatch.from_arrays([*(part[c] for c in names), *f(part[given].to_pylist())], [*names, *extra])
        released()

    rest = [] if given in names else [F.col(f"`{text}`").alias(given)]
    return df.select(*(F.col(f"`{c}`") for c in names), *rest).mapInArrow(run, schema)


def crc_mod(column: str, modulus: int) -> "F.Column":
    """crc32 of the id as text, modulo: the fixed fold of a row (null ids count as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def parts_for(df: DataFrame, bytes_per_part: int, column: str = "text", least: int = 8) -> int:
    """A partition count that follows the bytes of a text column."""
    total = df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0
    return max(least, -(-total // bytes_per_part))
