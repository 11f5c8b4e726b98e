"""Substring dedup by seed and extend: every repeated run of words goes, but for its first occurrence.

Seeds are winnowed anchors (the least hash of a short word run in every window of the threshold length).
Each window has exactly one anchor, set by its content alone, so equal windows have equal anchors. Anchors that
occur once can belong to no repeat and drop out, by a bitmap of those that recur which every task holds, so no text is shuffled. Around each of the others the text is extended both ways over all windows
that the anchor stands for: the seed's block. A block with an equal one before it is repeated as a whole; the first of its kind and
blocks that differ at an edge are compared window by window (an earliest window always stands in such a block).
Repeated windows that overlap join into maximal repeats. Everything is a grouped minimum or an equi-join on hashes, so
no group of copies is paired up: documents are not joined pair by pair, as seed-and-extend would. Blocks and windows are
equal if 128 bits of two independent hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, gram_hashes, key_filter, left_join_few, mix, passes, schema_with, signed, text_chunks, with_rest

MIN_WORDS = 20
#: Words in an anchor; shorter ones recur by chance, longer ones leave more anchors.
ANCHOR_WORDS = 6


def window_anchors(hashes: np.ndarray, min_words: int, anchor_words: int) -> np.ndarray:
    """For each window of ``min_words`` words, where its anchor starts: the least hash, leftmost of equals."""
    grams = gram_hashes(hashes, anchor_words)
    span = min_words - anchor_words + 1
    n = len(grams) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    value, where, width = grams, np.arange(len(grams)), 1

    def merge(step: int) -> None:
        nonlocal value, where, width
        right = value[step:] < value[:-step]
        where = np.where(right, where[step:], where[:-step])
        value = np.minimum(value[step:], value[:-step])
        width += step

    while 2 * width <= span:
        merge(width)
    if width < span:
        merge(span - width)
    return where


#: Hashes of anchors that a task holds to count equal ones before it passes them on.
COUNTED_ANCHORS = 1 << 20
#: Slots of the bitmaps of shared anchors and windows: 2 ** FILTER_BITS at most, 32 for each of them at least as long as that suffices.
FILTER_BITS = 28


def _anchored(words: Words, min_words: int, anchor_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one text with one anchor: first window, end, hash of the anchor, and the text's number."""
    anchor = window_anchors(words.hashes, min_words, anchor_words)
    owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    # Texts are handled together; windows over the end of one are left out.
    at = np.flatnonzero(owner[: len(anchor)] == owner[min_words - 1 : min_words - 1 + len(anchor)])
    if not len(at):
        return at, at, np.empty(0, np.uint64), at
    anchor = anchor[at]
    edges = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True])))
    first = at[edges[:-1]]
    return first, first + np.diff(edges), gram_hashes(words.hashes, anchor_words)[anchor[edges[:-1]]], owner[first]


def _anchor_rows(docs: DataFrame, min_words: int, anchor_words: int) -> DataFrame:
    """(h, n): hash of an anchor, and whether a task met it once (1) or more often (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            found, many = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(np.minimum(many, 2).astype(np.int32))], ["h", "n"])

        for _, texts in text_chunks(batches):
            held.append(_anchored(Words(texts), min_words, anchor_words)[2])
            if sum(map(len, held)) >= COUNTED_ANCHORS:
                yield out()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "h long, n int")


def _filter(keys: DataFrame):
    return key_filter(keys, min(FILTER_BITS, max(16, (32 * keys.count()).bit_length())))


_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run of words ``[start, end)``, of any lengths."""
    powers, inverse = (np.full(len(hashes) + 1, base, np.uint64) for base in (_BASE, _INVERSE))
    powers[0] = inverse[0] = 1
    powers, inverse = np.multiply.accumulate(powers), np.multiply.accumulate(inverse)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers[:-1], dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * inverse[starts] ^ (ends - starts).astype(np.uint64))


def _block_rows(docs: DataFrame, shared, min_words: int, anchor_words: int) -> DataFrame:
    """Blocks around anchors that the filter ``shared`` lets pass: (b, b2, doc, at, many, ws), hashes and place of a block, its windows and their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch, texts in text_chunks(batches):
            words = Words(texts)
            first, end, key, owner = _anchored(words, min_words, anchor_words)
            use = passes(bitmap, key)
            if not use.any():
                continue
            first, end, owner = first[use], end[use], owner[use]
            many, both = end - first, (words.hashes, words.second())
            at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            windows = np.stack([gram_hashes(x, min_words)[at] for x in both], axis=1)
            edges = np.concatenate(([0], 16 * np.cumsum(many))).astype(np.int32)
            docs_ = batch.column(0).to_numpy(zero_copy_only=False)[owner]
            arrays = [pa.array(signed(span_hashes(x, first, end - 1 + min_words))) for x in both]
            arrays += [pa.array(docs_, pa.int64()), pa.array((first - words.first[owner]).astype(np.int32)), pa.array(many.astype(np.int32))]
            arrays.append(pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(edges), pa.py_buffer(windows.tobytes())]))
            yield pa.RecordBatch.from_arrays(arrays, ["b", "b2", "doc", "at", "many", "ws"])

    return docs.mapInArrow(run, "b long, b2 long, doc long, at int, many int, ws binary")


def _windows(blocks: DataFrame, wanted=None) -> DataFrame:
    """(w, w2, doc, at) of the windows of ``blocks``; only those that the filter ``wanted`` lets pass, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, at, many = (batch.column(i).to_numpy() for i in range(3))
            hashes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64).reshape(-1, 2)
            inside = np.arange(len(hashes)) - np.repeat(np.cumsum(many) - many, many)
            doc, at = np.repeat(doc, many), (np.repeat(at, many) + inside).astype(np.int32)
            if wanted is not None:
                some = passes(wanted.value, hashes[:, 0].astype(np.uint64))
                hashes, doc, at = hashes[some], doc[some], at[some]
            arrays = [*(pa.array(np.ascontiguousarray(hashes[:, k])) for k in (0, 1)), pa.array(doc), pa.array(at)]
            yield pa.RecordBatch.from_arrays(arrays, ["w", "w2", "doc", "at"])

    return blocks.select("doc", "at", "many", "ws").mapInArrow(run, "w long, w2 long, doc long, at int")


def _firsts(rows: DataFrame, *key: str) -> DataFrame:
    """(key..., d0, a0): first place of each key that occurs twice or more."""
    first = rows.groupBy(*key).agg(F.min(F.struct("doc", "at")).alias("p"), F.count("*").alias("n")).where("n > 1")
    return first.select(*key, F.col("p.doc").alias("d0"), F.col("p.at").alias("a0"))


LATER = "doc > d0 or (doc = d0 and at > a0)"


def repeated_windows(spark: SparkSession, docs: DataFrame, scratch: Scratch, min_words: int, anchor_words: int) -> DataFrame:
    """(doc, runs): runs (start, many) of the windows of ``docs(doc_id, text)`` whose words also start earlier."""
    shared = scratch.write(_anchor_rows(docs, min_words, anchor_words).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "shared")
    scratch.release()
    # The filter may let other anchors pass: their blocks are the only ones of their kind.
    blocks = scratch.write(_block_rows(docs, _filter(shared), min_words, anchor_words), "blocks")
    scratch.drop(shared)
    del shared
    scratch.release()
    firsts = scratch.write(_firsts(blocks.select("b", "b2", "doc", "at"), "b", "b2"), "firsts")
    scratch.release()
    marked = blocks.join(firsts, ["b", "b2"], "left").withColumn("again", F.coalesce(F.expr(LATER), F.lit(False)))
    marked = scratch.write(marked.select("doc", "at", "many", "again", F.when(~F.col("again"), F.col("ws")).alias("ws")), "marked")
    scratch.drop(blocks, firsts)
    del blocks, firsts
    scratch.release()
    new = marked.where("not again")
    firsts = scratch.write(_firsts(_windows(new), "w", "w2"), "firsts")
    scratch.release()
    single = _windows(new, _filter(firsts.select("w"))).join(firsts, ["w", "w2"]).where(LATER).select("doc", "at", F.lit(1).alias("many"))
    runs = marked.where("again").select("doc", "at", "many").unionByName(single)
    out = scratch.write(runs.groupBy("doc").agg(F.collect_list(F.struct("at", "many")).alias("runs")), "repeats")
    scratch.drop(marked, firsts)
    del marked, new, single, runs, firsts
    scratch.release()
    return out


def dedup_substrings(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS, layout: bool = True, carry: bool = False,
) -> DataFrame:
    """Cut from each text the words of every run of ``min_words`` that starts earlier elsewhere.

    Earlier: in a document of smaller id, or before in the same one. Returns doc_id, n_words, n_removed and
    ``text``: with ``layout`` the text without the removed words and the white space after them, else the kept
    words joined by one space; ``kept_sha256`` is over the latter form. Null texts have no words. Rows without
    an id are returned whole and take no part; rows of one id count as one document, so a repeated row loses
    nothing to its double. Empty tables give empty results. With ``carry`` a last column ``rest`` is a struct of all
    other input columns.
    """
    docs = with_rest(docs, id_col, text_col, carry)
    scratch = Scratch(spark, "substrings")
    named = docs.where("doc_id is not null").select("doc_id", "text")
    repeats = repeated_windows(spark, named, scratch, min_words, anchor_words).withColumnRenamed("doc", "doc_id")
    both = left_join_few(docs, repeats).select("doc_id", "text", "runs", *docs.columns[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            words, runs = Words(texts), batch.column(2)
            totals, gone, sums, out = [], [], [], []
            for i, text in enumerate(texts):
                a, b = words.first[i], words.first[i + 1]
                starts, ends = words.starts[a:b] - words.at[i], words.ends[a:b] - words.at[i]
                drop = np.zeros(b - a, bool)
                if runs[i].is_valid:
                    steps = np.zeros(b - a + 1, np.int32)
                    at, many = (runs[i].values.field(k).to_numpy() for k in (0, 1))
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + many - 1 + min_words, -1)
                    drop = np.cumsum(steps[:-1]) > 0
                removed = int(drop.sum())
                kept = b" ".join([text[s:e] for s, e, d in zip(starts.tolist(), ends.tolist(), drop.tolist(), strict=True) if not d])
                totals.append(int(b - a))
                gone.append(removed)
                sums.append(hashlib.sha256(kept).hexdigest())
                if not removed:
                    kept = text if layout else kept
                elif layout:
                    kept = _cut(text, starts, drop)
                out.append(kept)
            arrays = [batch.column(0), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[3:]], ["doc_id", "n_words", "n_removed", "kept_sha256", "text", *batch.schema.names[3:]])

    return both.mapInArrow(run, schema_with(both, 3, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"))


def _cut(text: bytes, starts: np.ndarray, drop: np.ndarray) -> bytes:
    """The text without dropped words, each with the white space up to the next word."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], drop, [False])).astype(np.int8)))
    parts, last = [], 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        parts.append(text[last : int(starts[a])])
        last = int(starts[b]) if b < len(starts) else len(text)
    return b"".join([*parts, text[last:]])
