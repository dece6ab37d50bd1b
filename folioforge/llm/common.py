"""What the operators share: columns by exact name, written tables in the shared folder, word hashes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, CalendarIntervalType, DataType, MapType, StructType, VariantType

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``columns`` maps our names to those of ``df``. Names match exactly first, so extra columns
    that clash with ours, or differ from them in case only, do no harm. A missing column is null."""
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    places = {alias: place_of(df, name) for alias, name in columns.items()}
    return flat.select(*[(F.lit(None) if at is None else F.col(f"_{at}")).alias(alias) for alias, at in places.items()])


def place_of(df: DataFrame, name: str) -> int | None:
    """Where a column stands: by its exact name, else by its name in any case."""
    names = df.columns
    if name in names:
        return names.index(name)
    lower = [n.lower() for n in names]
    return lower.index(name.lower()) if name.lower() in lower else None


def comparable(df: DataFrame, columns: list[str]) -> list[Column]:
    """``columns`` of ``df`` as values that can be ordered: what holds a map, or has no order of its own, as JSON."""

    def ordered(kind: DataType) -> bool:
        if isinstance(kind, ArrayType):
            return ordered(kind.elementType)
        if isinstance(kind, StructType):
            return all(ordered(f.dataType) for f in kind)
        return not isinstance(kind, (MapType, VariantType, CalendarIntervalType))

    kinds = {f.name: f.dataType for f in df.schema}
    told = lambda c: F.col(c) if ordered(kinds[c]) else F.to_json(F.struct(F.col(c)))
    return [told(c).alias(f"_k{i}") for i, c in enumerate(columns)]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file:///tmp/checkpoints/folioforge"  # one machine: tests
    return found.rstrip("/")


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/folioforge-{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append((spark, path))
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch path that nothing will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _SCRATCH:
        try:
            discard(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            return


_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, records: int = 1000) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and lost executors take nothing with them.
    Python workers get at most ``records`` rows at once meanwhile; the session keeps its own limit."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(_RECORDS)
    spark.conf.set(_RECORDS, str(records))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_RECORDS, before)
    out = df.sparkSession.read.parquet(path)
    out._scratch_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Remove written tables that nothing will read again."""
    for table in tables:
        discard(table.sparkSession, table._scratch_path)


def sliced(run: Callable, records: int = 1000, tidy: bool = False) -> Callable:
    """``run`` over Arrow batches of at most so many rows. Spark bounds a batch's bytes; what a function
    derives from one is bounded here, and no setting of the session changes. ``tidy``: the worker gives back what it has freed."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batch.slice(at, records) for batch in batches for at in range(0, batch.num_rows, records))
        if tidy:
            give_back()

    return go


def give_back() -> None:
    """Workers outlive their tasks: what a task has freed goes back to the machine, not to the next task of this worker only."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def slim(table: DataFrame) -> DataFrame:
    """A side of a join that has one short row a key, or few: it is hashed, and the other side need not be sorted."""
    return table.hint("shuffle_hash")


#: A bitmap of this many rows of 64 words of 64 bits says which keys another table may hold.
MARK_ROWS = 1 << 10


def _mark(key: Column | str) -> dict[str, Column]:
    place = F.pmod(F.xxhash64(key), F.lit(MARK_ROWS << 12))
    return {"_row": F.shiftright(place, 12), "_word": F.shiftright(place, 6).bitwiseAND(F.lit(63)).cast("int"), "_bit": place.bitwiseAND(F.lit(63)).cast("int")}


def marked(rows: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` with ``_maybe``: false only where ``key`` is surely not in ``keys``. The bitmap has a
    fixed size, half a megabyte, and is broadcast; an exact join may follow on the rows that are left."""
    words = keys.select(*[c.alias(n) for n, c in _mark(key).items()]).groupBy("_row", "_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    held = words.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_m"))  # 64 words a row
    bits = held.select("_row", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0).cast("long"))).alias("_words"))  # MARK_ROWS rows at most
    told = rows.withColumns(_mark(key)).join(F.broadcast(bits), "_row", "left")
    return told.withColumn("_maybe", F.coalesce(F.getbit(F.get("_words", "_word"), "_bit") == 1, F.lit(False))).drop("_row", "_word", "_bit", "_words")


#: Keys that hold more than this share of all rows are hot; there are fewer than its inverse.
HOT_SHARE = 1000


def with_groups(rows: DataFrame, groups: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows``, ``total`` in number, with what ``groups`` says of their ``key``, null where it says nothing. ``groups`` has one
    row a key, with the number of its rows in ``n``. Fewer than HOT_SHARE keys are hot: those are broadcast, so their rows
    stay where they are; the other rows meet their key's by a shuffle."""
    is_hot = F.col(n) * HOT_SHARE > F.lit(total)
    hot, cold = F.broadcast(groups.filter(is_hot)), groups.filter(~is_hot)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, "left"))


# --------------------------------------------------------------------------- hashes of words

_A = 0x9E3779B97F4A7C15
_K = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_KINV = pow(_K, -1, 1 << 64)
_BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64 bits, in place where it can."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    """``mix`` of one Python integer."""
    x &= (1 << 64) - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ((1 << 64) - 1)
    return x ^ (x >> 31)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_A))
_BYTES[65:91] = _BYTES[97:123]  # A-Z hash as a-z
_BYTES[_SPACE] = 0
_POW: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["up"]) < n:
        for name, base in (("up", _K), ("down", _KINV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POW[name] = np.cumprod(p)
    return _POW["up"], _POW["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row starts (one more at the end). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of each row, in order, a 64-bit hash with A-Z lowered; and where each row starts in them."""
    data, rows = text_bytes(column)
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[rows] = True
    hashes, starts, at = [], [], 0
    while at < n:
        end = min(n, at + _BLOCK)
        while end < n and not (_SPACE[data[end]] or first[end]):  # never inside a word
            end += 1
        part = data[at:end]
        space = _SPACE[part]
        begins = ~space
        begins[1:] &= space[:-1] | first[at + 1 : end]
        where = np.flatnonzero(begins)
        if len(where):
            up, down = _powers(len(part))
            value = _BYTES[part]
            value *= up[: len(part)]
            found = np.add.reduceat(value, where)
            found *= down[where]
            hashes.append(mix(found))
            starts.append(where + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    begin = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(begin, rows).astype(np.int64)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive words: entry i covers words i to i+k-1."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    n = len(hashes) - k + 1
    out = np.full(n, k * _A & ((1 << 64) - 1), np.uint64)
    factor = _K
    for j in range(k):
        out += hashes[j : j + n] * np.uint64(factor)
        factor = factor * _K & ((1 << 64) - 1)
    return mix(out)
