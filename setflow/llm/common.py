"""Shared pieces of the operators: shared-folder tables, names, and hashing of words and bytes with numpy."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
MASK = (1 << 64) - 1
#: Bytes of text that one Arrow batch may carry to Python.
BATCH_BYTES = 4 << 20
#: Bytes hashed at once; longer texts are hashed slice by slice.
SLICE = 1 << 18


def bounded_batches(spark: SparkSession) -> None:
    """Batches to Python end at BATCH_BYTES, so that long texts don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on a local master a folder of our own."""
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(found)
        return found
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="setflow-")
        sc.setCheckpointDir(_own[sc.applicationId])
    return _own[sc.applicationId]


_tables: list[tuple[SparkSession, str]] = []


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, and gives the planner the true size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/setflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of queries that have ended: it does when the driver's JVM collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Remove a table of materialise() that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, folder)


@atexit.register
def _clean() -> None:
    for spark, path in _tables:
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns of these names in any case; an operator's output columns replace the input's."""
    gone = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in gone))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: the measure from which shuffles are sized."""
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def next_pow2(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


def release() -> None:
    """Give memory that a task no longer uses back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


# --- numpy hashing -----------------------------------------------------------------------------

_U = np.uint64
_BASE = {"byte": (0x9E6C63D0876A9A35, 0xB17A4F2C91D3E585), "word": (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)}
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = next_pow2(n)
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            t = np.ones(size, _U)
            done = 1
            while done < size:
                t[done : 2 * done] = t[:done] * _U(pow(b, done, 1 << 64))
                done *= 2
            out.append(t)
        got = _powers[base] = (out[0], out[1])
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def rolling(values: np.ndarray, window: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of every window of consecutive values, mixed."""
    n = len(values) - window + 1
    if n <= 0:
        return np.empty(0, _U)
    out = np.empty(n, _U)
    for a in range(0, n, SLICE):
        b = min(n, a + SLICE)
        part = values[a : b + window - 1].astype(_U, copy=False)
        power, inverse = _power_table(base, max(len(part), SLICE if n > SLICE else 1))
        sums = np.empty(len(part) + 1, _U)
        sums[0] = 0
        np.cumsum(part * power[: len(part)], out=sums[1:])
        out[a:b] = (sums[window:] - sums[: b - a]) * inverse[: b - a]
    return mix(out)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Texts:
    """The UTF-8 bytes of a column of texts, without copying them; a null text is empty."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):  # more than 2 GB
            column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks])
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        self.nulls = column.is_null().to_numpy(zero_copy_only=False)
        self.n = len(column)
        if self.n == 0 or column.buffers()[1] is None:
            self.offsets, self.data = np.zeros(self.n + 1, np.int64), np.empty(0, np.uint8)
        else:
            self.offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + self.n + 1]
            self.data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        if self.nulls.any() and self.n:  # a null may still span bytes
            lengths = np.where(self.nulls, 0, np.diff(self.offsets))
            if not np.array_equal(lengths, np.diff(self.offsets)):
                keep = np.repeat(~self.nulls, np.diff(self.offsets))
                self.data = self.data[self.offsets[0] : self.offsets[-1]][keep]
                self.offsets = np.concatenate([[0], np.cumsum(lengths)])

    def __getitem__(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()

    def groups(self, most: int = SLICE) -> Iterator[tuple[int, int]]:
        """Runs of texts of at most `most` bytes together, or one longer text."""
        a = 0
        while a < self.n:
            b = int(np.searchsorted(self.offsets, self.offsets[a] + most, side="right")) - 1
            b = min(max(b, a + 1), self.n)
            yield a, b
            a = b

    def bytes_of(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of texts a to b, and the b - a + 1 offsets of the texts in them."""
        base = self.offsets[a]
        return self.data[base : self.offsets[b]], self.offsets[a : b + 1] - base


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it (one more entry than texts)."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE["byte"][0]) -> np.ndarray:
    """A 64-bit hash of every word: Rabin-Karp over its bytes, mixed with its length."""
    out = np.empty(len(starts), _U)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE, side="right")))
        low = starts[a]
        part = data[low : ends[b - 1]]
        power, inverse = _power_table(base, max(len(part), SLICE))
        sums = np.empty(len(part) + 1, _U)
        sums[0] = 0
        np.cumsum(part * power[: len(part)] + power[: len(part)], out=sums[1:])
        s, e = starts[a:b] - low, ends[a:b] - low
        out[a:b] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(_U) * _U(0x9E3779B97F4A7C15))
        a = b
    return out


def window_mask(counts: np.ndarray, window: int) -> np.ndarray:
    """Over all windows of the concatenation, those within one text; counts: values before each text."""
    n = counts[-1] - window + 1
    if n <= 0:
        return np.zeros(0, bool)
    good = np.ones(n, bool)
    for at in counts[1:-1]:  # a window may not reach over the end of a text
        good[max(0, at - window + 1) : at] = False
    return good


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n values lie in a window that starts at one of these places."""
    steps = np.zeros(n + 1, np.int32)
    steps[:-1][starts] += 1
    np.subtract.at(steps, starts + window, 1) if len(starts) else None
    return np.cumsum(steps[:-1]) > 0


def runs(flags: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true flags; runs end where a text ends."""
    n = len(flags)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[counts] = True
    s, e = flags.copy(), flags.copy()
    s[1:] &= ~flags[:-1] | edge[1:n]
    e[:-1] &= ~flags[1:] | edge[1:n]
    return np.flatnonzero(s), np.flatnonzero(e) + 1


# --- packed sets of hashes ----------------------------------------------------------------------


def pack(sorted_values: np.ndarray) -> bytes:
    """A sorted array of 64-bit values: six bytes each, and a count for each value of the upper two."""
    hi, n = np.unique(sorted_values >> _U(48), return_counts=True)
    low = np.ascontiguousarray(sorted_values, "<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return np.uint32(len(hi)).tobytes() + hi.astype("<u2").tobytes() + n.astype("<u4").tobytes() + low.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    k = int(np.frombuffer(blob, "<u4", 1)[0])
    hi = np.frombuffer(blob, "<u2", k, 4).astype(_U)
    n = np.frombuffer(blob, "<u4", k, 4 + 2 * k)
    low = np.frombuffer(blob, np.uint8, offset=4 + 6 * k).reshape(-1, 6)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :6] = low
    return out.view("<u8").ravel() | np.repeat(hi << _U(48), n)


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the sorted table."""
    if len(table) == 0:
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values
