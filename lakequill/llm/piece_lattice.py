"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut wherever no piece can cross: between two characters that are neighbours in no piece. Only *distinct* chunks
are segmented: their substrings up to the longest piece are exploded, equi-joined to the piece table, the edges
grouped by chunk, and folded by Spark's higher-order ``aggregate``: Viterbi over positions for unigram models; for BPE
models the fold replays the merges over the same edges, as the best sum of scores is not what BPE makes. Decoding looks
pieces up by id and joins them in order.

Ids of frequent chunks come from a bounded table that every task holds; the others are holes in a document's ids, which
a join fills: the ids of many rows go packed, as one block, and each rare chunk of a block meets the vocabulary once. So every text is read twice: to count its chunks, and to write its ids.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import Scratch, mix, power_tables, signed, slices, text_chunks

SPACE = "▁"
#: Chunks (the most frequent ones) held by every task.
FREQUENT_CHUNKS = 100_000
#: Distinct chunks counted by a task before it passes counts on.
COUNTED_CHUNKS = 200_000
#: Bytes of text whose ids are packed and go together.
BLOCK_BYTES = 1 << 18
#: Longer chunks, whose fold would take time by the square of their length and more bits than a number has, are merged by a heap in the
#: same order (no chunk of the test tables is half as long).
LATTICE_CHARS = 60
#: Pieces of a model, at most: its table is broadcast.
MAX_PIECES = 1_000_000


class Model(NamedTuple):
    kind: str  # "bpe" or "unigram"
    pieces: dict[str, tuple[int, float]]
    all_pieces: list[tuple[str, int]]  # text and type by id
    unknown: int
    byte_ids: dict[int, int]  # byte -> id, empty without byte fallback
    dummy_prefix: bool
    unknown_text: str = " \u2047 "

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))


def load_model(path: str) -> Model:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    if len(proto.pieces) > MAX_PIECES:
        raise ValueError(f"the model has over {MAX_PIECES} pieces")
    normalizer = proto.normalizer_spec
    if normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces or not normalizer.escape_whitespaces:
        raise ValueError("only identity normalisation with escaped spaces is supported")
    kind = {1: "unigram", 2: "bpe"}.get(proto.trainer_spec.model_type)
    if kind is None:
        raise ValueError("only unigram and BPE models are supported")
    pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
    byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
    unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
    return Model(kind, pieces, [(p.piece, p.type) for p in proto.pieces], unknown, byte_ids, normalizer.add_dummy_prefix, proto.trainer_spec.unk_surface)


class Cutter:
    """Cuts texts where no piece crosses: a table of classes of characters, and which classes are neighbours in pieces."""

    def __init__(self, model: Model):
        self.prefix = SPACE if model.dummy_prefix else ""
        inside = sorted({c for p in model.pieces if len(p) > 1 for c in p})
        number = {c: n for n, c in enumerate(inside, 1)}
        self.classes = np.zeros(max(map(ord, inside), default=0) + 2, np.int32)  # the last one is for all beyond
        self.classes[[ord(c) for c in inside]] = np.arange(1, len(inside) + 1)
        self.met = np.zeros((len(inside) + 1, len(inside) + 1), bool)
        for piece in model.pieces:
            for a, b in itertools.pairwise(piece):
                self.met[number[a], number[b]] = True

    def chunks(self, text: bytes | None) -> list[str]:
        """The chunks of a text, spaces marked; none of an empty one."""
        marked = (text or b"").decode("utf-8", "replace").replace(" ", SPACE)
        if not marked:
            return []
        marked = self.prefix + marked
        codes = np.frombuffer(marked.encode("utf-32-le"), "<u4")
        kinds = self.classes[np.minimum(codes, len(self.classes) - 1)]
        cuts = (np.flatnonzero(~self.met[kinds[:-1], kinds[1:]]) + 1).tolist()
        return [marked[a:b] for a, b in zip([0, *cuts], [*cuts, len(marked)], strict=True)]


def symbol_ids(symbol: str, model: Model) -> list[int]:
    if symbol in model.pieces:
        return [model.pieces[symbol][0]]
    return [model.byte_ids[b] for b in symbol.encode("utf-8", "surrogatepass")] if model.byte_ids else [model.unknown]


def merge_chunk(chunk: str, model: Model) -> list[int]:
    """BPE of one chunk by a heap of merges: best score first, the leftmost of equals."""
    n = len(chunk)
    right, left, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list = []

    def offer(a: int) -> None:
        b = right[a]
        if b < n and (found := model.pieces.get(chunk[a : end[b]])):
            heapq.heappush(heap, (-found[1], a, end[b]))

    for a in range(n - 1):
        offer(a)
    alive = [True] * n
    while heap:
        _, a, stop = heapq.heappop(heap)
        b = right[a] if alive[a] else n
        if b >= n or end[b] != stop or end[a] != b:
            continue
        alive[b] = False
        end[a], right[a] = stop, right[b]
        if right[a] < n:
            left[right[a]] = a
        offer(a)
        if left[a] >= 0:
            offer(left[a])
    out, a = [], 0
    while a < n:
        out += symbol_ids(chunk[a : end[a]], model)
        a = right[a]
    return out


#: Chunks that a task folds, about.
TASK_CHUNKS = 50_000


def _piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """(piece, edge): what an edge has of its piece. For BPE a number, the order of merging above 20 bits of the id; else id and score."""
    if model.kind == "bpe":
        order = {score: n for n, score in enumerate(sorted({s for _, s in model.pieces.values()}, reverse=True))}
        return spark.createDataFrame([(p, order[s] << 36 | i) for p, (i, s) in model.pieces.items()], "piece string, code long")
    return spark.createDataFrame([(p, i, float(s)) for p, (i, s) in model.pieces.items()], "piece string, id int, score double")


def _edges(spark: SparkSession, chunks: DataFrame, model: Model) -> DataFrame:
    """chunk, n, and its ``edges``: for BPE numbers of order, start, end and id (20, 8, 8 and 20 bits), else structs (score, back, s, e, id)."""
    pieces = F.broadcast(_piece_table(spark, model))  # at most MAX_PIECES rows
    # Dealt once, before the substrings are made: they are grouped where they are. The number is fixed, as few bytes are much work here.
    tasks = max(spark.sparkContext.defaultParallelism, -(-chunks.count() // TASK_CHUNKS))
    starts = chunks.where("length(chunk) > 0").repartition(tasks, "chunk").select("chunk", "n", F.explode(F.expr("sequence(0, length(chunk) - 1)")).alias("s"))
    rows = starts.select("chunk", "n", "s", F.explode(F.expr(f"sequence(s + 1, least(s + {model.longest}, length(chunk)))")).alias("e"))
    rows = rows.withColumn("piece", F.expr("substring(chunk, s + 1, e - s)"))
    joined = rows.join(pieces, "piece", "left")
    if model.kind == "bpe":
        known, edge = "code is not null", F.expr("code + shiftleft(cast(s AS BIGINT), 28) + shiftleft(cast(e AS BIGINT), 20)")
    else:
        known, edge = "id is not null", F.struct("score", (-F.col("s")).alias("back"), "s", "e", "id")
    # One row of each chunk stays even if none of its substrings is a piece.
    joined = joined.where(f"{known} or (s = 0 and e = 1)").select("chunk", "n", F.when(F.expr(known), edge).alias("edge"))
    return joined.groupBy("chunk").agg(F.first("n").alias("n"), F.collect_list("edge").alias("edges"))


_START, _END, _ID = "cast(shiftright(x, 28) & 255 AS INT)", "cast(shiftright(x, 20) & 255 AS INT)", "cast(x & 1048575 AS INT)"

#: Edges of two characters or more, with bits from start to end (``m``) and those of both (``ends``).
_BPE_WIDE = f"""
transform(filter(edges, x -> {_END} - {_START} > 1), x -> named_struct('x', x,
  'm', shiftleft(shiftleft(1L, {_END} - {_START} + 1) - 1L, {_START}), 'ends', shiftleft(1L, {_START}) | shiftleft(1L, {_END})))
"""

#: Fold of BPE: the first edge in order that joins two neighbours goes in; bits are set where symbols begin and end.
_BPE_CUTS = """
aggregate(sequence(1, greatest(1, size(wide))),
  named_struct('cuts', shiftleft(1L, length(chunk) + 1) - 1L, 'on', size(wide) > 0),
  (acc, step) -> if(NOT acc.on, acc,
    transform(array(array_min(filter(wide, x -> (acc.cuts & x.ends) = x.ends AND bit_count(acc.cuts & x.m) = 3))),
      x -> if(x IS NULL, named_struct('cuts', acc.cuts, 'on', false),
        named_struct('cuts', (acc.cuts & ~x.m) | x.ends, 'on', true)))[0]),
  acc -> filter(sequence(0, length(chunk)), i -> (shiftright(acc.cuts, i) & 1L) = 1L))
"""

#: Fold of Viterbi: best[p] is the best sum up to p, and where its last edge starts (``back`` is that, negated: of equal sums the longer edge).
_VITERBI_CUTS = """
aggregate(sequence(1, length(chunk)),
  array(named_struct('sum', 0D, 'back', 0)),
  (best, p) -> concat(best, array(array_max(concat(
      if(exists(edges, x -> x.e = p AND x.s = p - 1), array(), array(named_struct('sum', best[p - 1].sum + {unknown}D, 'back', 1 - p))),
      transform(filter(edges, x -> x.e = p), x -> named_struct('sum', best[x.s].sum + x.score, 'back', x.back)))))),
  best -> aggregate(sequence(1, length(chunk)), array(length(chunk)),
    (cuts, step) -> if(cuts[0] = 0, cuts, concat(array(-best[cuts[0]].back), cuts)), cuts -> cuts))
"""


def segment(spark: SparkSession, chunks: DataFrame, model: Model) -> DataFrame:
    """(chunk, n, ids) of distinct chunks of at most LATTICE_CHARS characters."""
    lowest = min((s for _, s in model.pieces.values()), default=0.0)
    cuts = _BPE_CUTS if model.kind == "bpe" else _VITERBI_CUTS.replace("{unknown}", repr(lowest - 10.0))
    if model.byte_ids:
        first = model.byte_ids[0]
        if any(i != first + b for b, i in model.byte_ids.items()):
            raise ValueError("byte pieces must have ids in a row")
        code = "encode(substring(chunk, a + 1, 1), 'UTF-8')"
        fallback = f"transform(sequence(1, octet_length({code})), k -> cast(conv(hex(substring({code}, k, 1)), 16, 10) AS INT) + {first})"
    else:
        fallback = f"array({model.unknown})"
    if model.kind == "bpe":
        whole = f"transform(filter(edges, x -> (shiftright(x, 20) & 65535) = 256 * a + cuts[i + 1]), x -> array({_ID}))"
        made = _edges(spark, chunks, model).withColumn("wide", F.expr(_BPE_WIDE))
    else:
        whole = "transform(filter(edges, x -> x.s = a AND x.e = cuts[i + 1]), x -> array(x.id))"
        made = _edges(spark, chunks, model)
    ids = f"flatten(transform(slice(cuts, 1, size(cuts) - 1), (a, i) -> coalesce(get({whole}, 0), {fallback})))"
    return made.withColumn("cuts", F.expr(cuts)).select("chunk", "n", F.expr(ids).alias("ids"))


class Pieces:
    """Bytes of every piece by id, and how ids become text."""

    def __init__(self, model: Model):
        names = {2: model.unknown_text.encode(), 3: b""}
        made = [bytes([int(p[1:-1], 16)]) if kind == 6 else names.get(kind, p.replace(SPACE, " ").encode()) for p, kind in model.all_pieces]
        self.table, self.prefix = pa.array(made, pa.binary()), b" " if model.dummy_prefix else b""

    def texts(self, ids: pa.ListArray, start: bool = True) -> list[bytes]:
        """The decoded text of each list; of those that ``start`` a text without the space that encoding puts before it."""
        first = ids.offsets.to_numpy()
        taken = self.table.take(ids.values.slice(first[0], first[-1] - first[0]))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(first - first[0], pa.int32()), taken), b"").to_pylist()
        texts = (t.removeprefix(self.prefix) for t in joined) if start else joined
        return [t if t.isascii() else t.decode("utf-8", "replace").encode() for t in texts]


def decode(spark: SparkSession, encoded: DataFrame, model: Model, key: list[str], ids: str = "ids") -> DataFrame:
    """(key..., text): pieces looked up by id, put together in order, spaces unmarked, runs of byte pieces as UTF-8.

    An empty or null list of ids gives the empty text; an id that is not the model's raises.
    """
    pieces = Pieces(model)
    rows = encoded.select(*(F.col(f"`{c}`") for c in key), F.coalesce(F.col(f"`{ids}`").cast("array<int>"), F.array().cast("array<int>")).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            texts = pa.array([t.decode() for t in pieces.texts(batch.column(len(key)))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], texts], [*key, "text"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[: len(key)], StructField("text", StringType())]))


def vocabulary(docs: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """(chunk, n, ids) of every distinct chunk of ``docs(doc_id, text)``, n its occurrences."""
    cutter = Cutter(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["chunk", "n"])
            found.clear()
            return made

        for _, texts in text_chunks(batches):
            for text in texts:
                found.update(cutter.chunks(text))
            if len(found) > COUNTED_CHUNKS:
                yield out()
        yield out()

    counts = docs.select("text").mapInArrow(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    counts = scratch.write(counts, "chunks")
    scratch.release()
    made = segment(scratch.spark, counts.where(F.length("chunk") <= LATTICE_CHARS), model)

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = merge_chunk if model.kind == "bpe" else viterbi_chunk
            ids = [fold(c, model) for c in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["chunk", "n", "ids"])

    longer = counts.where(F.length("chunk") > LATTICE_CHARS).mapInArrow(long, "chunk string, n long, ids array<int>")
    known = scratch.write(made.unionByName(longer), "vocabulary")
    scratch.drop(counts)
    scratch.release()
    return known


def viterbi_chunk(chunk: str, model: Model) -> list[int]:
    lowest = min(s for _, s in model.pieces.values()) - 10.0
    best: list[tuple[float, int]] = [(0.0, 0)]
    for p in range(1, len(chunk) + 1):
        options = []
        for s in range(max(0, p - model.longest), p):
            found = model.pieces.get(chunk[s:p])
            if found or p - s == 1:
                options.append((best[s][0] + (found[1] if found else lowest), -s))
        best.append(max(options))
    out, p = [], len(chunk)
    while p:
        s = -best[p][1]
        out.append(symbol_ids(chunk[s:p], model))
        p = s
    return [i for part in reversed(out) for i in part]


def _id_type(model: Model) -> np.dtype:
    """Type of written ids; its highest number is a hole, the place of a chunk that a join fills."""
    return np.dtype("<u2" if len(model.all_pieces) < 0xFFFF else "<u4")


def _pack(values: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(values.tobytes(), asbytes=True) if len(values) else b""


def _unpack(data: bytes, many: int, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(data, many * kind.itemsize, asbytes=True) if many else b"", kind)


#: Place of a hole's chunk among those of its block.
_PLACE = np.dtype("<u4")


def _rows(spark: SparkSession, docs: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """(docs, sizes, ids, places, plain, fills) of blocks of rows of ``docs(doc_id, text)``, packed, as they are written and shuffled once.

    ``ids`` are numbers of ``_id_type`` (``sizes`` many of each row) with a hole for the occurrences of rarer chunks, ``fills`` the ids of
    the distinct ones of these and ``places`` which of them is in each hole; ``plain`` are the SHA-256 of the texts that the ids stand for.
    """
    known, kind = vocabulary(docs, model, scratch), _id_type(model)
    top = known.orderBy(F.desc("n"), "chunk").limit(FREQUENT_CHUNKS).select("chunk", "ids").toArrow()  # bounded
    frequent = dict(zip(top.column(0).to_pylist(), (np.asarray(v, kind).tobytes() for v in top.column(1).to_pylist()), strict=True))
    del top
    held = spark.sparkContext.broadcast(frequent)
    cutter, hole = Cutter(model), b"\xff" * kind.itemsize
    schema = "block long, docs array<long>, sizes array<int>, ids binary, places binary, plain array<binary>, holes array<string>"
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 36
        known = held.value
        for batch, texts in text_chunks(batches, limit=BLOCK_BYTES):
            ids, sizes, places, plain = [], [], [], []
            holes: dict[str, int] = {}
            for text in texts:
                chunks = cutter.chunks(text)
                found = [known.get(c, hole) for c in chunks]
                ids.append(b"".join(found))
                sizes.append(len(ids[-1]) // kind.itemsize)
                places += [holes.setdefault(c, len(holes)) for c, f in zip(chunks, found, strict=True) if f is hole]
                plain.append(hashlib.sha256((text or b"").replace(SPACE.encode(), b" ")).digest())
            row = [block, batch.column(0).to_pylist(), sizes, _pack(np.frombuffer(b"".join(ids), kind)), _pack(np.array(places, _PLACE)), plain, list(holes)]
            block += 1
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    # Written once: a block's number is the same for all readers.
    runs = scratch.write(docs.mapInArrow(run, schema), "runs")
    rare = runs.select("block", F.posexplode("holes").alias("p", "chunk")).join(known.select("chunk", F.col("ids").alias("fill")), "chunk")
    fills = scratch.write(rare.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("p", "fill"))).alias("fills")).select("block", F.col("fills.fill").alias("fills")), "fills")
    scratch.drop(known)
    scratch.release()
    return runs.drop("holes").join(fills, "block", "left").select("docs", "sizes", "ids", "places", "plain", "fills")


def _whole(batch: pa.RecordBatch, row: int, model: Model) -> tuple[pa.Array, pa.ListArray, pa.Array]:
    """Of one block of ``_rows`` the rows' doc_id, their ids, holes filled, and ``plain``."""
    docs, sizes, ids, places, plain, fills = (batch.column(i)[row] for i in range(6))
    kind = _id_type(model)
    edges = np.concatenate(([0], np.cumsum(sizes.values.to_numpy(zero_copy_only=False), dtype=np.int64)))
    flat = _unpack(ids.as_py(), int(edges[-1]), kind)
    at = np.flatnonzero(flat == np.iinfo(kind).max)
    if len(at):
        first = fills.values.offsets.to_numpy().astype(np.int64)
        values = fills.values.values.slice(first[0], first[-1] - first[0]).to_numpy(zero_copy_only=False).astype(kind)
        first -= first[0]
        which = _unpack(places.as_py(), len(at), _PLACE)
        long = np.diff(first)[which]
        many = np.ones(len(flat), np.int64)
        many[at] = long
        starts = np.concatenate(([0], np.cumsum(many)))
        inside = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
        taken = np.repeat(flat, many)
        taken[np.repeat(starts[at], long) + inside] = values[np.repeat(first[which], long) + inside]
        flat, edges = taken, starts[edges]
    if not model.byte_ids and len(flat):
        # Neighbouring unknown characters of a row are one unknown.
        stays = np.concatenate(([True], (flat[1:] != model.unknown) | (flat[:-1] != model.unknown)))
        stays[edges[:-1][edges[:-1] < len(flat)]] = True
        flat, edges = flat[stays], np.concatenate(([0], np.cumsum(stays)))[edges]
    return docs.values, pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.astype(np.int32))), plain.values


def encode(spark: SparkSession, docs: DataFrame, model: Model, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row.

    Null and empty texts have no ids. Repeated rows are rows of their own; a null id is carried through; an empty table gives
    an empty one.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([*_whole(batch, row, model)[:2]], ["doc_id", "ids"])

    return _rows(spark, docs, model, scratch).mapInArrow(run, "doc_id long, ids array<int>")


def _list_hashes(lists: pa.ListArray) -> np.ndarray:
    """64-bit hash of each list of ids."""
    first = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)[first[0] : first[-1]].astype(np.uint64)
    first = first - first[0]
    many = np.diff(first)
    inside = np.arange(len(flat)) - np.repeat(first[:-1], many)
    terms = (flat + np.uint64(1)) * power_tables(int(inside.max(initial=0)) + 1)[0][inside]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    return mix((sums[first[1:]] - sums[first[:-1]]) ^ many.astype(np.uint64))


def encode_and_decode(spark: SparkSession, docs: DataFrame, model: Model, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", outputs: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_digest and round_trip of every row, and with ``outputs`` its ids and the text decoded from them.

    The ids of a row are put together as :func:`encode` does and decoded as a whole. ``ids_digest`` is a 64-bit hash of the ids in
    their order; ``round_trip``: the decoded text is the row's, space marks being spaces. Rows as in :func:`encode`.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    pieces = Pieces(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row in ((batch, row) for batch in batches for row in range(batch.num_rows)):
            ids, lists, plain = _whole(batch, row, model)
            texts = pieces.texts(lists)
            right = [hashlib.sha256(t).digest() == p for t, p in zip(texts, plain.to_pylist(), strict=True)]
            arrays = [ids, pa.array(np.diff(lists.offsets.to_numpy()).astype(np.int64)), pa.array(signed(_list_hashes(lists))), pa.array(right, pa.bool_())]
            if outputs:
                arrays += [lists, pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_tokens long, ids_digest long, round_trip boolean" + (", ids array<int>, text string" if outputs else "")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return _rows(spark, docs, model, scratch).mapInArrow(run, schema)
