"""Best-fit packing of tokenised documents: large items in pairs, small ones in the tightest gap.

Only the *number of pieces of each length* reaches the driver: one integer for each length up to the
capacity. The plan is made over these counts, then every piece gets its rank among pieces of its
length (by per-bucket counts, never by one task) and looks its place up in the plan.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, pick, split_words, text_chunks

CAPACITY = 2048
END_ID = 0
#: Words whose ids a worker remembers, about; others are encoded each time they occur.
ID_CACHE = 300_000
#: Parts of words (runs of letters or marks) whose ids a worker remembers beside.
STEM_CACHE = 600_000

#: Bytes of text encoded together, about.
SLICE_BYTES = 1 << 21

_PART = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
#: Rows of one bucket of the ranking step, about.
BUCKET_ROWS = 20_000


#: How a tokenizer must normalise and split for its ids to be those of words one by one.
WORDWISE_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORDWISE_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
MARKS = (b",", b".", b";", b":", b"!", b"?")


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def is_wordwise(path: str) -> bool:
    """Does the tokenizer drop white space and case, split as WORDWISE_SPLIT does, and end each part with a token that says so."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    norm, pre, model = made.get("normalizer") or {}, made.get("pre_tokenizer") or {}, made["model"]
    if norm.get("type") != "Sequence" or norm["normalizers"] != WORDWISE_NORMALIZERS or pre.get("type") != "Sequence" or len(pre["pretokenizers"]) != 2:
        return False
    split, level = pre["pretokenizers"]
    return (
        split.get("type") == "Split" and split["pattern"] == {"Regex": WORDWISE_SPLIT} and split["behavior"] == "Removed" and split["invert"]
        and level.get("type") == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"]
        and model.get("type") == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["dropout"] and not model.get("ignore_merges")
        and not made.get("truncation") and all("<" in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in made["added_tokens"])
    )


class TextIds:
    """Ids of texts by any tokenizer, each text as a whole."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)

    def of(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        for text in texts:
            ids = self.tokenizer.encode_batch_fast([(text or b"").decode("utf-8", "replace")], add_special_tokens=False)[0].ids
            yield np.array([*ids, END_ID], "<u4")


class WordIds:
    """Ids of texts by way of their white-space-delimited words, for tokenizers that are :func:`is_wordwise`.

    Such a tokenizer normalises white space and case away before it splits, its split pattern never spans white space,
    and a letter and a mark after it are always parts of their own; so the ids of a text are those of its words in
    order, and those of ``word,`` are those of ``word`` and of the comma. Parts that are not remembered are
    encoded together, once for each slice of texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = _tokenizer(path)
        # The same model for words of lower-case letters, which need no pattern to be split.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks = {m: self._encode([m])[0] for m in MARKS}

    def _encode(self, words: list[bytes]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in encoded]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """Words of letters only: each is one part, so it ends where a token that ends words does."""
        ids = np.array(self.letters.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):  # a letter that is normalised to more than letters
            return self._encode([w.encode() for w in words])
        data, edges = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def _parts(self, word: bytes) -> list[bytes]:
        """Parts of a word that the tokenizer splits anyway, lower-case; what is not plain stays in one."""
        if b"<" in word:  # may hold a special token, whose case counts
            return [word]
        low = word.lower()
        if low.isascii():
            return [low] if b"'" in low else _PART.findall(low)
        if low[-1:] in self.marks and 97 <= low[-2] <= 122:
            return [low[:-1], low[-1:]]
        return [low]

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not known; remembered while there is room."""
        stems, marks = self.stems, self.marks
        whole: list[tuple[bytes, bytes, bytes]] = []  # word, its letters, ids of the mark after them
        split: list[tuple[bytes, list[bytes]]] = []
        for word in new:
            if word.isalpha():
                whole.append((word, word.lower(), b""))
            elif word[:-1].isalpha() and (mark := marks.get(word[-1:])):
                whole.append((word, word[:-1].lower(), mark))
            else:
                split.append((word, self._parts(word)))
        have = {stem: stems.get(stem) for _, stem, _ in whole}
        letters, others = [stem.decode() for stem, ids in have.items() if ids is None], []
        for part in set(itertools.chain.from_iterable(parts for _, parts in split)).difference(have):
            if (ids := stems.get(part)) is not None:
                have[part] = ids
                continue
            text = part.decode("utf-8", "replace")
            letters.append(text) if text.isalpha() and text.lower().isalpha() else others.append(part)
        fresh = dict(zip(others, self._encode(others), strict=True))
        for start in range(0, len(letters), 512):
            some = letters[start : start + 512]
            fresh.update(zip((w.encode() for w in some), self._encode_letters(some), strict=True))
        have.update(fresh)
        if len(stems) < STEM_CACHE:
            stems.update(fresh)
        out = {word: have[stem] + mark for word, stem, mark in whole}
        for word, parts in split:
            out[word] = have[parts[0]] if len(parts) == 1 else b"".join(map(have.__getitem__, parts))
        if len(self.known) < ID_CACHE:
            self.known.update(out)
        return out

    def of(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        end = array("I", [END_ID]).tobytes()
        split = [split_words(text) for text in texts]
        words = list(itertools.chain.from_iterable(split))
        found = list(map(self.known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            learnt = self._learn(list({words[i]: None for i in missing}))
            for i in missing:
                found[i] = learnt[words[i]]
        at = 0
        for part in split:
            yield np.frombuffer(b"".join(found[at : at + len(part)]) + end, "<u4")
            at += len(part)


@functools.lru_cache(maxsize=1)
def text_ids(path: str) -> WordIds | TextIds:
    """One for each worker process, which Spark uses for many tasks."""
    return WordIds(path) if is_wordwise(path) else TextIds(path)


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document: whole if it fits, else cut each ``capacity`` ids.

    Null and empty texts give one piece holding only the end id. ``with_ids`` adds the ids themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = text_ids(tokenizer_path)
        for batch, texts in text_chunks(batches, limit=SLICE_BYTES):
            rows: list[list] = [[], [], [], [], []]
            kept = []
            for doc, ids in zip(batch.column(0).to_pylist(), words.of(texts), strict=True):
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for column, value in zip(rows, (doc, piece, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
                    if with_ids:
                        kept.append(part.astype(np.int32))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            arrays = [pa.array(v, t) for v, t in zip(rows, types, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Place ``counts[length]`` pieces of every length; rows (length, first rank, how many, first sequence, offset).

    1. Lengths above ``capacity / 3`` are large. From the longest down, each takes the longest large
       partner that still fits; a bin holds at most two large pieces.
    2. The other pieces, from the longest down, go to the open bin with the least sufficient gap.

    Bins of the same gap are handled together as a run, so the work depends on the number of distinct
    lengths and gaps, never on the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    next_bin = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, how many)

    def place(length: int, many: int, first: int, offset: int) -> None:
        out.append((length, used[length], many, first, offset))
        used[length] += many
        left[length] -= many

    def open_gap(gap: int, first: int, many: int) -> None:
        if gap:
            gaps.setdefault(gap, []).append((first, many))

    large = sorted(n for n in left if 3 * n > capacity)
    alive = list(large)
    for length in reversed(large):
        while left[length]:
            partner = None
            k = bisect.bisect_right(alive, min(length, capacity - length)) - 1
            while k >= 0 and not left[alive[k]]:
                alive.pop(k)
                k -= 1
            if k >= 0 and (alive[k] != length or left[length] > 1):
                partner = alive[k]
            elif k > 0 and alive[k] == length:  # only this piece itself is left of its length
                j = k - 1
                while j >= 0 and not left[alive[j]]:
                    j -= 1
                partner = alive[j] if j >= 0 else None
            if partner is None:
                many = left[length] if k < 0 else 1
                place(length, many, next_bin, 0)
                open_gap(capacity - length, next_bin, many)
            elif partner == length:
                many = left[length] // 2
                place(length, many, next_bin, 0)
                place(length, many, next_bin, length)
                open_gap(capacity - 2 * length, next_bin, many)
            else:
                many = min(left[length], left[partner])
                place(length, many, next_bin, 0)
                place(partner, many, next_bin, length)
                open_gap(capacity - length - partner, next_bin, many)
            next_bin += many
    order = sorted(gaps)
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            k = bisect.bisect_left(order, length)
            if k == len(order):
                per = capacity // length
                many, rest = divmod(left[length], per)
                if many:
                    for j in range(per):
                        place(length, many, next_bin, j * length)
                    gap, bins = capacity - per * length, many
                else:
                    for j in range(rest):
                        place(length, 1, next_bin, j * length)
                    gap, bins = capacity - rest * length, 1
                if gap:
                    if gap not in gaps:
                        bisect.insort(order, gap)
                    open_gap(gap, next_bin, bins)
                next_bin += bins
                continue
            gap = order[k]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(k)
            # What is left of a bin is the tightest gap again, so one bin is filled after the other.
            each = gap // length
            take = min(many, left[length] // each)
            if not take:
                each, take = left[length], 1
            for j in range(each):
                place(length, take, first, capacity - gap + j * length)
            for gap_now, at, bins in ((gap - each * length, first, take), (gap, first + take, many - take)):
                if gap_now and bins:
                    if gap_now not in gaps:
                        bisect.insort(order, gap_now)
                    open_gap(gap_now, at, bins)
    return out


def pack(spark: SparkSession, pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces ``(doc_id, piece, length, ...)``.

    Bins are gapless from offset 0. Repeated rows are packed as often as they occur; an empty table
    gives an empty one. The plan has a few rows per distinct length, at most ``capacity`` of them.
    """
    pieces = scratch.write(pieces, "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    total = sum(counts.values())
    by_length: dict[int, list] = {}
    for length, *rest in plan(counts, capacity):
        by_length.setdefault(length, []).append(rest)
    table = {n: tuple(np.array(sorted(v), np.int64).T) for n, v in by_length.items()}
    places_b = spark.sparkContext.broadcast(table)

    buckets = max(1, total // BUCKET_ROWS)
    keyed = pieces.withColumn("__b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__b", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        keyed.withColumn("__r", F.row_number().over(within) - 1)
        .join(sizes, ["length", "__b"])
        .withColumn("__rank", F.col("__r") + F.col("__before"))
    )

    @F.pandas_udf("sequence_id long, offset long")
    def locate(length, rank):
        import pandas as pd

        length, rank = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            first, _, start, offset = places_b.value[int(n)]
            k = np.searchsorted(first, rank[rows], "right") - 1
            seq[rows] = start[k] + rank[rows] - first[k]
            off[rows] = offset[k]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    out = ranked.withColumn("__at", locate("length", "__rank"))
    keep = [F.col(c).cast("long").alias(c) if c == "length" else F.col(c) for c in pieces.columns]
    return out.select(*keep, "__at.sequence_id", "__at.offset")


def pack_documents(
    spark: SparkSession, docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, with_ids: bool = False,
) -> DataFrame:
    """Tokenise and pack: doc_id, piece, start, length, ids_crc32, [ids], sequence_id, offset."""
    scratch = Scratch(spark, "pack")
    return pack(spark, tokenised_pieces(pick(docs, doc_id=id_col, text=text_col), tokenizer_path, capacity, with_ids), scratch, capacity)
