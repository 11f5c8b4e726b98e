"""Shared plumbing: input columns, written intermediate tables, word hashing, graph components.

Intermediate tables are Parquet files under ``spark.checkpoint.dir`` so that a lost executor never
costs more than the current step; a private folder is used only where that setting is absent.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of text handled at a time inside a Python worker.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Keep only the named columns, under fixed names, so extra columns can never clash."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def with_rest(df: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """doc_id, text and, to ``carry`` them along, one struct ``rest`` of all other columns, whatever their names."""
    wanted = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    others = [c for c in df.columns if c not in (id_col, text_col)]
    if carry:
        wanted.append(F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest") if others else F.lit(None).cast("int").alias("rest"))
    return df.select(*wanted)


def schema_with(df: DataFrame, skip: int, first: str) -> StructType:
    """The schema ``first``, then the columns of ``df`` after its first ``skip``."""
    made = StructType.fromDDL(first)
    return StructType([*made.fields, *df.schema.fields[skip:]])


class Scratch:
    """Written intermediate tables of one operator run, in the shared folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            base = _local_base(spark)
        self.root = f"{base.rstrip('/')}/lakequill-{label}-{uuid.uuid4().hex[:12]}"
        self._written: list[str] = []
        _open.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a reader of the copy; the lineage ends here."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:6]}"
        schema = df.schema
        df.write.parquet(path)
        self._written.append(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Delete written tables that no later step reads."""
        read = _paths(frames)
        for path in [p for p in self._written if _bare(p) in read]:
            self._written.remove(path)
            self._delete(path)

    def only(self, *frames: DataFrame) -> None:
        """Delete all written tables but those that ``frames`` read."""
        read = _paths(frames)
        for path in [p for p in self._written if _bare(p) not in read]:
            self._written.remove(path)
            self._delete(path)
        self.release()

    def close(self) -> None:
        """Delete all that was written; frames that read it are void."""
        if self in _open:
            _open.remove(self)
        self._written.clear()
        self._delete(self.root)

    def read_by(self, frame: DataFrame) -> bool:
        return any(p.startswith(_bare(self.root) + "/") for p in _paths([frame]))

    def release(self) -> None:
        """Let Spark remove shuffle files of steps that are over."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


#: Scratch folders in use, oldest first.
_open: list[Scratch] = []


def opened() -> tuple[Scratch, ...]:
    return tuple(_open)


@atexit.register
def _forget_all() -> None:
    for scratch in opened():
        try:
            scratch.close()
        except Exception:  # noqa: BLE001  the session has ended before this process
            return


def _bare(path: str) -> str:
    """A path without scheme and authority."""
    return re.sub("^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?", "", path)


def _paths(frames) -> set[str]:
    """Folders of the files that frames read."""
    return {_bare(unquote(f.rsplit("/", 1)[0])) for frame in frames for f in frame.inputFiles()}


def _local_base(spark: SparkSession) -> str:
    """Own folder, for sessions of one machine that name none (tests, local mode)."""
    have = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if have:
        return have
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="lakequill-")
    spark.sparkContext.setCheckpointDir(base)
    return base


#: Bytes of text hashed at once; arrays of eight bytes for each stay in a core's cache.
CHUNK_BYTES = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        made = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers = tuple(made)
    return _powers


def _byte_codes(fold_case: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts: hash, byte range, and which belong to which text.

    ``hashes`` are 64-bit polynomial hashes over all texts at once; with ``fold_case`` A-Z count as a-z.
    Words of text ``i`` are those from ``first[i]`` up to ``first[i + 1]``; its bytes start at ``at[i]``.
    """

    _space = np.zeros(256, bool)
    _space[[9, 10, 11, 12, 13, 32]] = True
    _codes = None

    def __init__(self, texts: list[bytes | None], fold_case: bool = False):
        if Words._codes is None:
            Words._codes = {f: _byte_codes(f) for f in (False, True)}
        self._fold = fold_case
        self.joined = b"\n".join(t or b"" for t in texts)
        lengths = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
        self.at = np.concatenate(([0], np.cumsum(lengths + 1)))
        self.buffer = buf = np.frombuffer(self.joined, np.uint8)
        gap = np.ones(len(buf) + 2, np.int8)
        gap[1:-1] = self._space[buf]
        turns = np.diff(gap)
        self.starts, self.ends = np.flatnonzero(turns == -1), np.flatnonzero(turns == 1)
        up, down = power_tables(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(Words._codes[fold_case][buf] * up[: len(buf)], out=sums[1:])
        raw = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        self._sums, self._down = sums, down
        self.hashes = mix(raw ^ (self.ends - self.starts).astype(np.uint64) * np.uint64(_BASE))
        self.first = np.searchsorted(self.starts, self.at)

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]

    def second(self) -> np.ndarray:
        """Another hash of each word, independent of ``hashes``: both together are 128 bits."""
        sums = np.zeros(len(self.buffer) + 1, np.uint64)
        up = power_tables(len(self.buffer) + 1)[0]
        np.cumsum(mix(Words._codes[self._fold] ^ np.uint64(0xA0761D6478BD642F))[self.buffer] * up[: len(self.buffer)], out=sums[1:])
        raw = (sums[self.ends] - sums[self.starts]) * self._down[self.starts]
        return mix(raw ^ (self.ends - self.starts).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))

    def prefixes(self, size: int) -> np.ndarray:
        """Hash of the first ``size`` bytes of each word; of the whole word if it is shorter."""
        ends = np.minimum(self.ends, self.starts + size)
        return mix((self._sums[ends] - self._sums[self.starts]) * self._down[self.starts])

    def code_points(self) -> np.ndarray:
        """Code points of each word."""
        marks = np.zeros(len(self.buffer) + 1, np.int64)
        np.cumsum((self.buffer & 0xC0) != 0x80, out=marks[1:])
        return marks[self.ends] - marks[self.starts]


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cut batches so that each part holds about ``limit`` bytes of text, or a single longer text."""
    for batch in slices(batches):
        texts = as_bytes(batch.column(batch.schema.get_field_index(text)))
        start = size = 0
        for i, value in enumerate(texts):
            size += len(value or b"") + 1
            if size >= limit:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def split_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: ``bytes.split`` cuts at exactly these six characters."""
    return text.split() if text else []


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Rolling polynomial hash of every run of ``size`` words, mixed; empty if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    acc = words[:n].copy()
    for j in range(1, size):
        acc *= base
        acc += words[j : j + n]
    return mix(acc)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def rows_by_key(
    batches: Iterator[pa.RecordBatch], key: str, handle: Callable[[pa.Table], pa.RecordBatch | None]
) -> Iterator[pa.RecordBatch]:
    """Give ``handle`` whole runs of equal ``key`` from a partition that is sorted by it.

    Several short runs come together. Callers bound the length of a run beforehand.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        keys = held.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1], "left")) if keys[0] <= keys[-1] else 0
        if last:
            if (out := handle(held.slice(0, last))) is not None:
                yield out
            held = held.slice(last)
    if held is not None and held.num_rows:
        if (out := handle(held)) is not None:
            yield out


def key_filter(keys: DataFrame, bits: int):
    """A bitmap of the first column of ``keys``, of 2 ** ``bits`` slots, for every task: it may let others pass, never leaves one of them out."""
    keys = keys.select(F.col(keys.columns[0]).alias("k"))
    slot = F.pmod(F.col("k"), F.lit(1 << bits))
    words = keys.select(F.shiftright(slot, 6).alias("w"), F.expr("shiftleft(1L, cast(pmod(k, 64) as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()  # at most 2 ** (bits - 6) rows
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bitmap)


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned ``keys`` a bitmap of ``key_filter`` lets pass."""
    slots = (keys & np.uint64(64 * len(bitmap) - 1)).astype(np.int64)
    return bitmap[slots >> 6] >> (slots & 63) & 1 == 1


#: Slots of the broadcast bitmap of ids that have a match, 2 ** ID_BITS bits: 16 million ids in a row have one each.
ID_BITS = 24


def left_join_few(docs: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with the columns of ``rows`` by ``key`` or nulls; no text is shuffled for documents that a bitmap of the keys of ``rows`` shows to have none."""
    slot = f"pmod(`{key}`, {1 << ID_BITS})"
    word, bit = F.expr(f"shiftright({slot}, 6)").alias("__w"), F.expr(f"shiftleft(1L, cast({slot} & 63 as int))").alias("__bit")
    bits = rows.select(word, bit).groupBy("__w").agg(F.bit_or("__bit").alias("__bits"))
    # At most 2 ** (ID_BITS - 6) rows.
    flagged = docs.withColumns({"__w": word, "__bit": bit}).join(F.broadcast(bits), "__w", "left")
    has = F.coalesce(F.expr("__bits & __bit <> 0"), F.lit(False))
    some, rest = (flagged.where(c).select(*(F.col(f"`{n}`") for n in docs.columns)) for c in (has, ~has))
    return some.join(rows, key, "left").unionByName(rest, allowMissingColumns=True)


#: Edges up to which one task folds them all (some 50 MB there); more take rounds of joins.
TASK_EDGES = 1_000_000


def _fold_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of all edges (u, v): ids hang on the least that a neighbour hangs on until nothing moves."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    ends = np.concatenate([b.column(c).to_numpy() for c in (0, 1) for b in held])
    ids, at = np.unique(ends, return_inverse=True)
    a, b = at[: len(at) // 2], at[len(at) // 2 :]
    home = np.arange(len(ids))
    while True:
        x, y = home[a], home[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(home, np.maximum(x, y), np.minimum(x, y))
        while (further := home[home] != home).any():
            home[further] = home[home[further]]
    for start in range(0, len(ids), 1 << 16):
        part = slice(start, start + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(ids[home[part]])], ["id", "component"])


def components(scratch: Scratch, edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(a, b)``: (id, component), component the smallest id reachable.

    Alternating large-star and small-star rounds (each a few joins and aggregations on the edge
    table) until the edges are stars; ids without an edge are not returned. Work per
    round is proportional to the edges, whatever the size of a component.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    written = scratch.write(now, "edges")
    if written.count() <= TASK_EDGES:
        # Rounds are dozens of stages, whose tasks cost far more than so few edges.
        return scratch.write(written.coalesce(1).mapInArrow(_fold_edges, "id long, component long"), "components")
    for _ in range(max_rounds):
        # Stars: every id hangs on one other, which hangs on none.
        ids = written.groupBy("u").agg(F.count("*").alias("n"), F.first("v").alias("v"))
        crooked = ids.where("n > 1").select("u").unionByName(ids.select(F.col("v").alias("u")).join(ids.select("u"), "u", "left_semi"))
        if crooked.isEmpty():
            break
        both = written.unionByName(written.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join deals both sides anew and adaptive execution can split the edges of a hub.
        low = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = low
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = scratch.write(small, "edges")
        scratch.drop(written, least)
        written = after
    else:
        raise RuntimeError("components did not settle")
    out = written.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.unionByName(written.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
