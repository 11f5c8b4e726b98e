"""Fuzzy line dedup: of each group of nearly equal lines in the corpus, one occurrence stays.

Lines are normalised (case, digits, marks and white space), equal normal forms are one node. Nodes are linked
where the edit similarity of the normal forms is at least SIMILARITY; of each connected group the first
line (least document id, then line number) is kept.

Candidates meet in two kinds of keys:

* blocks of the 64-bit SimHash over pairs of neighbouring words. Those within MAX_BITS bits meet for sure, by the pigeonhole principle: with MAX_BITS errors
  over m blocks some m - MAX_BITS blocks are clean, so rows meet on each choice of that many blocks.
* bands. An edit similarity of SIMILARITY moves far more bits than clean blocks can pay for, so lines also meet where
  BAND_MINIMA least hashes of these pairs agree in one of BANDS bands. There they are candidates if their SimHashes are
  within EDIT_BITS bits. This is not exact: edits in most words of a line are missed.

Only a line's nearest partner of each key is tried at first. Then the lines of a key that are not in one
component yet are brought together with their texts, and all candidates of different components are tried there: links come
out, never all pairs. A key of more than NODE_LIMIT lines is a star around one line at first; what does not hang on
it is then compared with all, in blocks.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, components, key_filter, left_join_few, mix, passes, power_tables, schema_with, signed, slices, text_chunks, with_rest

MAX_BITS = 3
SIMILARITY = 0.8
#: Lines of one key that a task compares at once.
NODE_LIMIT = 512
#: Bits that SimHashes of lines that meet in a band may differ in; those of unlike lines differ in 32 or so.
EDIT_BITS = 20
BANDS = 10
BAND_MINIMA = 2
#: Lines whose keys a task looks through for those that are frequent there.
KEY_ROWS = 1 << 16
#: Distinct lines a task remembers, so that it does not repeat their rows.
SEEN_LINES = 1_000_000
#: Distinct lines up to which keys of one clean block are selective enough, then of two, and so on.
CLEAN_BLOCKS = ((64_000_000, 1), (2_000_000_000, 2), (200_000_000_000, 3))
#: Counters of pairs of neighbouring characters, which rule out most lines that are not alike, many at a time.
PAIR_BINS = 256
#: Lines that links are sought among at once, in units of a key's limit; larger keys go in blocks of as many. Each line goes once to every block, so
#: large ones move fewer rows.
BLOCK_LIMITS = 8

#: Marks and digits beyond ASCII, which the tables below do not know.
_FOREIGN_MARKS = re.compile(r"[^\w\x00-\x7f]+")
_FOREIGN_DIGIT = re.compile(r"[^\D\x00-\x7f]")
_ASCII = bytes(10 if b == 10 else 48 if 48 <= b < 58 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_ASCII_LOWER = bytes(ord(chr(b).lower()) if b < 128 else b for b in _ASCII)


def normal_text(text: bytes | None) -> bytes:
    """Lower case, digits as 0, marks as spaces; line feeds stay."""
    text = text or b""
    if text.isascii():
        return text.translate(_ASCII_LOWER)
    low = _FOREIGN_MARKS.sub(" ", text.decode("utf-8", "replace").lower())
    if _FOREIGN_DIGIT.search(low):
        low = _FOREIGN_DIGIT.sub("0", low)
    return low.encode("utf-8", "replace").translate(_ASCII)


def normal_form(line: str) -> bytes:
    """The words of a line's normal text, joined by one space; a line of marks only stays as it is. UTF-8."""
    raw = line.encode("utf-8", "replace")
    return b" ".join(normal_text(raw).split()) or line.strip().encode("utf-8", "replace")


def _lanes() -> np.ndarray:
    """byte -> its bits, most significant first, each in a byte of a 64-bit word."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


_LANES = _lanes()


def word_pairs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs of neighbouring words, both ends included, of each run of ``hashes`` from ``first`` on; and where each run starts then."""
    if not len(first):
        return np.empty(0, np.uint64), first
    left = np.insert(hashes, first, np.uint64(0))
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + np.append(left[1:], np.uint64(0))), first + np.arange(len(first))


def simhash(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each run of ``hashes`` that starts at ``first`` (none is empty)."""
    if not len(first):
        return np.empty(0, np.uint64)
    lengths = np.diff(np.append(first, len(hashes)))
    columns = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    # Eight counters of one byte in a word count up to 255; longer forms are counted bit by bit.
    sums = np.concatenate([np.add.reduceat(_LANES[columns[:, j]], first).view(np.uint8).reshape(-1, 8) for j in range(8)], axis=1).astype(np.int64)
    for i in np.flatnonzero(lengths > 255):
        sums[i] = np.unpackbits(columns[first[i] : first[i] + lengths[i]], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * sums > lengths[:, None], axis=1).view(np.uint64).ravel()


_SALTS = (mix(np.arange(1, BANDS * BAND_MINIMA + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def bands(pairs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BANDS keys of each run that starts at ``first``: its least hashes."""
    keys = np.empty((len(first), BANDS), np.uint64)
    if not len(first):
        return keys
    low = (pairs >> np.uint64(32)).astype(np.uint32)
    for band in range(BANDS):
        key = np.full(len(first), band + 1, np.uint64)
        for salt in _SALTS[band * BAND_MINIMA : (band + 1) * BAND_MINIMA]:
            key = mix(key ^ np.minimum.reduceat((low ^ salt) * np.uint32(0x2C1B3C6D), first).astype(np.uint64))
        keys[:, band] = key
    return keys


def lines_of(text: bytes | None) -> list[str]:
    return (text or b"").decode("utf-8", "replace").split("\n")


class Lines:
    """The lines of some texts that are not blank: text and number of each, ``keys`` (hash of the normal form), ``size`` in characters."""

    def __init__(self, texts: list[bytes | None]):
        self.words = words = Words([normal_text(t) for t in texts])
        feeds = np.flatnonzero(words.buffer == 10)
        begins = np.concatenate(([0], feeds + 1))
        first = np.searchsorted(words.starts, begins)
        counts = np.diff(np.append(first, len(words.starts)))
        owner = np.searchsorted(words.at, begins, "right") - 1
        inside = owner < len(texts)
        begins, first, counts, owner = begins[inside], first[inside], counts[inside], owner[inside]
        number = np.arange(len(begins)) - np.searchsorted(begins, words.at[owner])
        up, down = power_tables(len(words.hashes) + 1)
        sums = np.zeros(len(words.hashes) + 1, np.uint64)
        np.cumsum(words.hashes * up[: len(words.hashes)], out=sums[1:])
        points = np.concatenate(([0], np.cumsum(words.code_points())))
        # Lines of marks only have no words here: each is one word of its own.
        bare = np.flatnonzero((counts == 0) & (np.diff(np.append(begins, len(words.buffer) + 1)) > 1))
        marks: list[tuple[int, bytes]] = []
        split: tuple[int, list[str]] = (-1, [])
        for i in bare.tolist():
            if split[0] != owner[i]:
                split = (int(owner[i]), lines_of(texts[owner[i]]))
            if form := split[1][number[i]].strip():
                marks.append((i, form.encode("utf-8", "replace")))
        full = np.flatnonzero(counts > 0)
        a, b = first[full], first[full] + counts[full]
        keys = mix((sums[b] - sums[a]) * down[a] ^ counts[full].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        size = points[b] - points[a] + counts[full] - 1
        lone = np.fromiter((xxhash.xxh3_64_intdigest(f) for _, f in marks), np.uint64, len(marks))
        self.first, self.counts = np.append(a, np.zeros(len(marks), a.dtype)), np.append(counts[full], np.zeros(len(marks), counts.dtype))
        at = np.append(full, np.fromiter((i for i, _ in marks), np.int64, len(marks))).astype(np.int64)
        self.owner, self.number = owner[at], number[at]
        self.keys = np.append(keys, lone)
        self.size = np.append(size, np.fromiter((len(f.decode()) for _, f in marks), np.int64, len(marks))).astype(np.int64)

    def hashes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of the lines ``rows`` one after the other, and where each starts."""
        many = np.maximum(self.counts[rows], 1)
        starts = np.concatenate(([0], np.cumsum(many)[:-1])).astype(np.int64)
        at = np.repeat(self.first[rows] - starts, many) + np.arange(int(many.sum()))
        empty = self.counts[rows] == 0
        out = self.words.hashes[np.minimum(at, max(0, len(self.words.hashes) - 1))] if len(self.words.hashes) else np.zeros(len(at), np.uint64)
        out[starts[empty]] = self.keys[rows[empty]]
        return out, starts


def _line_rows(docs: DataFrame) -> DataFrame:
    """doc, line, k (hash of the normal form) of every line that is not blank; of a task's first line of each k also sim, size and its bands' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, texts in text_chunks(batches):
            lines = Lines(texts)
            if not len(lines.keys):
                continue
            _, where = np.unique(lines.keys, return_index=True)
            new = np.array([i for i, key in zip(where.tolist(), lines.keys[where].tolist(), strict=True) if key not in seen], np.int64)
            seen.update(lines.keys[new].tolist())
            if len(seen) > SEEN_LINES:
                seen.clear()
            new.sort()
            pairs, first = word_pairs(*lines.hashes(new))
            sims = np.zeros(len(lines.keys), np.uint64)
            sims[new] = simhash(pairs, first)
            data = bands(pairs, first)
            width = np.zeros(len(lines.keys) + 1, np.int32)
            width[new + 1] = 8 * BANDS
            keys = pa.Array.from_buffers(pa.binary(), len(lines.keys), [None, pa.py_buffer(np.cumsum(width, dtype=np.int32)), pa.py_buffer(data.tobytes())])
            docs_ = batch.column(0).to_numpy(zero_copy_only=False)[lines.owner]
            arrays = [pa.array(docs_, pa.int64()), pa.array(lines.number, pa.int32()), pa.array(signed(lines.keys)), pa.array(signed(sims)), pa.array(lines.size, pa.int64()), keys]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "line", "k", "sim", "size", "bands"])

    return docs.mapInArrow(run, "doc long, line int, k long, sim long, size long, bands binary")


# --- keys and what meets in them ---------------------------------------------------------------------------------


def _cuts(width: int, blocks: int) -> list[tuple[int, int]]:
    edges = [round(i * width / blocks) for i in range(blocks + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def block_keys(sims: np.ndarray, clean: int) -> Iterator[np.ndarray]:
    """A key for each choice of ``clean`` out of MAX_BITS + clean blocks."""
    cuts = _cuts(64, MAX_BITS + clean)
    for n, choice in enumerate(itertools.combinations(cuts, clean)):
        mask = sum(((1 << (b - a)) - 1) << a for a, b in choice)
        yield mix(mix(sims & np.uint64(mask)) ^ np.uint64(n + 1))


#: Kinds of rows of a key: an ordinary one, one of a key that is frequent in its task (dealt by line), and the word that there are such.
PLAIN, DEALT, WORD = 0, 1, 2


def _key_rows(forms: DataFrame, clean: int, shared=None) -> DataFrame:
    """Rows (node, k, sim, tag) of ``forms(k, sim, size, bands)``; keys of bands are odd, those of blocks even; a tag is 4 * size + kind.

    Only those of keys that the filter ``shared`` lets pass; without one, (node, n): the keys, and how many lines of a run of the task have them.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("node", "k", "sim", "tag")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> Iterator[pa.Table]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= KEY_ROWS:
                    yield pa.Table.from_batches(held)
                    held = []
            if held:
                yield pa.Table.from_batches(held)

        for rows in whole():
            if not rows.num_rows:
                continue
            k, at = np.unique(rows.column("k").to_numpy(), return_index=True)
            sim, size = (rows.column(c).to_numpy()[at] for c in ("sim", "size"))
            data = np.frombuffer(b"".join(rows.column("bands").to_pylist()), np.uint64).reshape(-1, BANDS)[at]
            columns = [key & ~np.uint64(1) for key in block_keys(sim.view(np.uint64), clean)] + [data[:, band] | np.uint64(1) for band in range(BANDS)]
            for node in columns:
                if shared is None:
                    found, many = np.unique(node, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(many.astype(np.int32))], ["node", "n"])
                    continue
                least = max(64, len(k) // 128)
                use = passes(shared.value, node >> np.uint64(1))
                found, which, many = np.unique(node[use], return_inverse=True, return_counts=True)
                often = many[which] > least
                arrays = [signed(node[use]), k[use], sim[use], 4 * size[use] + np.where(often, DEALT, PLAIN)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], schema=schema)
                if len(words := found[many > least]):
                    none = np.zeros(len(words), np.int64)
                    arrays = [signed(words), none, none, none + WORD]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], schema=schema)

    return forms.mapInArrow(run, "node long, n int" if shared is None else "node long, k long, sim long, tag long")


def _most_bits(node: np.ndarray) -> np.ndarray:
    return np.where(node & 1 == 1, EDIT_BITS, MAX_BITS).astype(np.uint8)


def _bits(sim_a, sim_b) -> np.ndarray:
    return np.bitwise_count((sim_a ^ sim_b).view(np.uint64))


def _sizes_fit(a, b) -> np.ndarray:
    """May the similarity be reached, by the number of characters."""
    return np.minimum(a, b) >= SIMILARITY * np.maximum(a, b) - 1e-9


def _nearest(node: np.ndarray, k: np.ndarray, sim: np.ndarray, size: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the row of its nearest partner in its run (-1: none), and the bits between them."""
    best, least, most = np.full(len(node), -1, np.int64), np.full(len(node), 255, np.uint8), _most_bits(node)

    def offer(x: np.ndarray, y: np.ndarray, bits: np.ndarray) -> None:
        ok = _sizes_fit(size[x], size[y])
        for a, b in ((x[ok], y[ok]), (y[ok], x[ok])):
            better = bits[ok] < least[a]
            best[a[better]], least[a[better]] = b[better], bits[ok][better]

    end = np.repeat(first + many, many)
    x = np.flatnonzero(np.repeat(many <= 64, many) & (np.arange(len(node)) + 1 < end))
    for lag in range(1, 64):
        x = x[x + lag < end[x]]
        if not len(x):
            break
        bits = _bits(sim[x], sim[x + lag])
        some = bits <= most[x]
        if some.any():
            offer(x[some], x[some] + lag, bits[some])
    for at, n in zip(first[many > 64].tolist(), many[many > 64].tolist(), strict=True):
        here, limit = sim[at : at + n], most[at]
        for lag in range(1, n):
            bits = _bits(here[: n - lag], here[lag:])
            some = np.flatnonzero(bits <= limit)
            if len(some):
                offer(some + at, some + at + lag, bits[some])
    return best, least


MET = "node long, k long, sim long, size long, best long, bits int"


def _meet(rows: DataFrame, node_limit: int) -> DataFrame:
    """Rows (node, k, sim, size, best, bits) that have a partner; without ``best`` those of keys of over ``node_limit`` lines."""
    names = ["node", "k", "sim", "size", "best", "bits"]

    def out(node, k, sim, size, best, bits) -> pa.RecordBatch:
        arrays = [pa.array(x) for x in (node, k, sim, size)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(best, pa.int64()), pa.array(bits, pa.int32())], names)

    def unmatched(node, k, sim, size) -> pa.RecordBatch:
        return out(node, k, sim, size, [None] * len(node), [None] * len(node))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4
        large = None  # a key known to be large whose rows go on

        def handle(cols: list[np.ndarray], ended: bool) -> Iterator[pa.RecordBatch]:
            """Rows up to the last run, which is handled if it has ``ended``."""
            nonlocal held, large
            node, k = cols[0], cols[1]
            fresh = np.concatenate(([True], (node[1:] != node[:-1]) | (k[1:] != k[:-1]))) if len(node) else np.empty(0, bool)
            cols = [c[fresh] for c in cols]
            node, k, sim, size = cols
            if not len(node):
                held = cols
                return
            first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            many = np.diff(np.append(first, len(node)))
            # The word that there are frequent rows elsewhere has size 0.
            word = np.add.reduceat((size == 0).astype(np.int64), first) > 0
            big = (many > np.where(node[first] & 1 == 1, node_limit, 16 * node_limit)) | word | (node[first] == large if large is not None else False)
            last = len(first) - (0 if ended or big[-1] else 1)
            large = int(node[-1]) if big[-1] else None
            passed = np.repeat(big, many) & (size > 0)
            if passed.any():
                yield unmatched(*(c[passed] for c in cols))
            stop = first[last] if last < len(first) else len(node)
            held = [c[stop:] for c in cols]
            some = np.repeat(~big & (many > 1), many)
            some[stop:] = False
            if some.any():
                node, k, sim, size = (c[some] for c in cols)
                first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
                best, bits = _nearest(node, k, sim, size, first, np.diff(np.append(first, len(node))))
                met = best >= 0
                if met.any():
                    yield out(node[met], k[met], sim[met], size[met], k[best[met]], bits[met].astype(np.int32))

        for batch in batches:
            node, k, sim, tag = (batch.column(i).to_numpy() for i in range(4))
            size, dealt = tag >> 2, tag & 3 == DEALT
            if dealt.any():
                yield unmatched(*(c[dealt] for c in (node, k, sim, size)))
            cols = [c[~dealt] for c in (node, k, sim, size)]
            yield from handle([np.concatenate(pair) for pair in zip(held, cols, strict=True)], False)
        yield from handle(held, True)

    # Within a key the word of frequent rows is first: its size is 0. Rows of one line have one tag.
    return rows.repartition(F.expr(f"if(tag & 3 = {DEALT}, k, node)")).sortWithinPartitions("node", "tag", "k").mapInArrow(run, MET)


# --- edit similarity ---------------------------------------------------------------------------------------------


def _equal_head(x: str, y: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(x), len(y))
    if x[:high] == y[:high]:
        return high
    while low < high - 1:
        middle = (low + high) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _trimmed(x: str, y: str) -> tuple[str, str]:
    """Both without their common prefix and suffix."""
    head = _equal_head(x, y)
    x, y = x[head:], y[head:]
    tail = _equal_head(x[::-1], y[::-1])
    return x[: len(x) - tail], y[: len(y) - tail]


def edit_distance(x: str, y: str, limit: int | None = None) -> int:
    """Levenshtein distance, bit-parallel over Python integers; above ``limit`` any number that is."""
    x, y = _trimmed(x, y)
    if not x or not y:
        return len(x) + len(y)
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    rows, cols = len(x), len(y)
    full, top, score = (1 << rows) - 1, 1 << (rows - 1), rows
    plus, minus = full, 0
    for j, c in enumerate(y, 1):
        eq = where.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1 | 1) & full
        down = down << 1 & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        if limit is not None and not j & 63 and _hopeless(plus, minus, j, rows, cols, limit):
            return limit + 1
    return score


def _hopeless(plus: int, minus: int, j: int, rows: int, cols: int, limit: int) -> bool:
    """No way through column ``j`` ends within ``limit``: every 32nd value is looked at, others differ by 16 at most."""
    for i in range(max(0, j - limit - 16), min(rows, j + limit + 16) + 32, 32):
        i = min(i, rows)
        mask = (1 << i) - 1
        value = j + (plus & mask).bit_count() - (minus & mask).bit_count()
        if value - 16 + max(0, abs((rows - i) - (cols - j)) - 16) <= limit:
            return False
    return True


def _edits_at_most(x: str, y: str) -> int:
    """An upper bound of the distance: words that both have once, in the same order, stay; what is between is replaced."""
    a, b = x.split(" "), y.split(" ")
    there: dict[str, int] = {}
    for j, w in enumerate(b):
        there[w] = -1 if w in there else j
    here = Counter(a)
    pairs = [(i, there[w]) for i, w in enumerate(a) if here[w] == 1 and there.get(w, -1) >= 0]
    # Longest increasing run of the second numbers.
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        if k == len(tails):
            tails.append(j)
            at.append(n)
        else:
            tails[k], at[k] = j, n
        back[n] = at[k - 1] if k else -1
    chain = []
    n = at[-1] if at else -1
    while n >= 0:
        chain.append(pairs[n])
        n = back[n]
    ends_a, ends_b = ([0, *itertools.accumulate(len(w) + 1 for w in side)] for side in (a, b))
    cost, before = 0, (0, 0)
    for i, j in [*reversed(chain), (len(a), len(b))]:
        cost += max(ends_a[i] - ends_a[before[0]], ends_b[j] - ends_b[before[1]])
        before = (i + 1, j + 1)
    return cost


def alike(x: str, y: str) -> bool:
    """Edit similarity of at least SIMILARITY; bounds decide first, the distance only where they do not."""
    limit = int((1 - SIMILARITY) * max(len(x), len(y)) + 1e-9)
    if abs(len(x) - len(y)) > limit:
        return False
    a, b = _trimmed(x, y)
    if max(len(a), len(b)) <= limit or min(len(a), len(b)) == 0:
        return max(len(a), len(b)) <= limit
    if len(x) > 100:
        # One space more at most at an end than the words of the middles have.
        if _edits_at_most(a, b) <= limit:
            return True
        # An edit changes two pairs of neighbouring characters.
        if sum((Counter(zip(a, a[1:])) & Counter(zip(b, b[1:]))).values()) < max(len(a), len(b)) - 1 - 2 * limit:  # noqa: B905
            return False
    return edit_distance(a, b, limit) <= limit


def _pair_counts(forms: list[str]) -> np.ndarray:
    """How often each of PAIR_BINS hashes of neighbouring characters is in each form."""
    out = np.zeros((len(forms), PAIR_BINS), np.uint16)
    for n, form in enumerate(forms):
        codes = np.frombuffer(form.encode("utf-32-le", "surrogatepass"), "<u4")
        out[n] = np.minimum(np.bincount((codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)) >> np.uint32(24), minlength=PAIR_BINS), 0xFFFF) if len(codes) > 1 else 0
    return out


def _may_be_alike(counts: np.ndarray, size: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
    """False where ``alike`` is: an edit changes two pairs of neighbouring characters, and equal hashes only hide differences."""
    longest = np.maximum(size[j], size[i])
    shared = np.minimum(counts[j], counts[i]).sum(axis=1, dtype=np.int64)
    # Counters do not go beyond 16 bits: such lines are left to ``alike``.
    return (shared >= longest - 1 - 2 * ((1 - SIMILARITY) * longest + 1e-9).astype(np.int64)) | (longest >= 0xFFFF)


#: Characters of a block of ``_far_apart``, bits of one word; codes of characters there; and characters of lines that it looks at.
BLOCK, CODES, FAR_CHARS = 64, 128, 4096
#: Blocks that are compared at once.
FAR_LANES = 4096


def _far_apart(forms: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """True only where ``alike`` is false, for many pairs of ``forms`` at once.

    The first form is cut into blocks. Each edit of a pair that is alike falls into one of them, and each block is turned into some
    part of the other form that is shifted by what the limit allows; so the least distances of the blocks to any such part do not
    add up to more than the limit. They are found bit-parallel, all blocks side by side. Characters of one code only hide differences.
    """
    size = np.array([len(f) for f in forms], np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    codes = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) % CODES
    longest = np.maximum(size[a], size[b])
    limit = ((1 - SIMILARITY) * longest + 1e-9).astype(np.int64)
    # Pairs of like sizes side by side, as their blocks take the same steps.
    order = np.argsort(longest, kind="stable")
    order = order[(longest[order] <= FAR_CHARS) & (np.minimum(size[a], size[b])[order] > 0)]
    many = -(-size[a[order]] // BLOCK)
    ends = np.cumsum(many)
    out = np.zeros(len(a), bool)
    start = 0
    while start < len(order):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - many[start] + FAR_LANES, "right")))
        part, blocks = order[start:stop], many[start:stop]
        first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
        lane = np.repeat(part, blocks)
        s = (np.arange(len(lane)) - np.repeat(first, blocks)) * BLOCK
        m = np.minimum(BLOCK, size[a[lane]] - s)
        base = np.arange(len(lane)) * (CODES + 1)
        masks = np.zeros(len(lane) * (CODES + 1), np.uint64)
        for p in range(int(m.max())):
            has = np.flatnonzero(m > p)
            masks[base[has] + codes[at[a[lane[has]]] + s[has] + p]] |= np.uint64(1 << p)
        # A shift of d takes |d| edits before the block and |d - (difference of sizes)| after it.
        room, more = limit[lane], size[b[lane]] - size[a[lane]]
        low, high = -((room - more) // 2), (room + more) // 2
        begin, stop_at = np.maximum(s + low, 0), np.minimum(s + m + high, size[b[lane]])
        top = (m - 1).astype(np.uint64)
        plus, minus, score = np.full(len(lane), ~np.uint64(0)), np.zeros(len(lane), np.uint64), m.copy()
        best, one, last = m.copy(), np.uint64(1), len(codes) - 1
        for c in range(int((stop_at - begin).max(initial=0))):
            y = begin + c
            code = np.where(y < stop_at, codes[np.minimum(at[b[lane]] + y, last)], CODES)
            eq = masks[base + code]
            diagonal = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | ~(diagonal | plus), plus & diagonal
            score += ((up >> top & one).astype(np.int64) - (down >> top & one).astype(np.int64))
            up, down = up << one, down << one
            vertical = eq | minus
            plus, minus = down | ~(vertical | up), up & vertical
            np.minimum(best, score, out=best)
        out[part] = np.add.reduceat(best, first) > limit[part]
        start = stop
    return out


def _alike_pairs(forms: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``alike`` of pairs of ``forms``."""
    out = ~_far_apart(forms, a, b)
    for n in np.flatnonzero(out).tolist():
        out[n] = alike(forms[a[n]], forms[b[n]])
    return out


def confirm(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """The pairs whose normal forms are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            forms, rows = batch.column(2).to_pylist() + batch.column(3).to_pylist(), np.arange(batch.num_rows)
            keep = _alike_pairs(forms, rows, rows + len(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (forms.select(F.col("k").alias(c), F.col("form").alias(f"f{c}")) for c in "ab")
    # Few bytes are much work here: dealt out to a number of tasks that is not lowered.
    pairs = pairs.select("a", "b").repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "fa", "fb").mapInArrow(run, "a long, b long")


#: Slots of the filters of wanted lines and of shared keys, 2 ** FILTER_BITS and 2 ** KEY_FILTER_BITS bits.
FILTER_BITS = 26
KEY_FILTER_BITS = 28


def _forms(docs: DataFrame, bitmap) -> DataFrame:
    """(k, form, bands) of the lines that the filter lets pass, some of them more than once; no text is shuffled for those it holds back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in text_chunks(batches):
            lines = Lines(texts)
            wanted = np.flatnonzero(passes(bitmap.value, lines.keys))
            keys, forms, rows, split = [], [], [], (-1, [])
            for i, key in zip(wanted.tolist(), signed(lines.keys[wanted]).tolist(), strict=True):
                if key not in seen:
                    seen.add(key)
                    if split[0] != lines.owner[i]:
                        split = (int(lines.owner[i]), lines_of(texts[lines.owner[i]]))
                    keys.append(key)
                    rows.append(i)
                    forms.append(normal_form(split[1][lines.number[i]]).decode("utf-8", "replace"))
            if len(seen) > SEEN_LINES:
                seen.clear()
            if keys:
                data = bands(*word_pairs(*lines.hashes(np.array(rows)))).tobytes()
                arrays = [pa.array(keys, pa.int64()), pa.array(forms, pa.string()), pa.array([data[a : a + 8 * BANDS] for a in range(0, len(data), 8 * BANDS)], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["k", "form", "bands"])

    return docs.select("text").mapInArrow(run, "k long, form string, bands binary")


# --- links across components -------------------------------------------------------------------------------------


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the component of ``k`` as ``label``; a line without links is its own."""
    named = labels.select(F.col("id").alias("k"), F.col("component").alias("__c"))
    return rows.join(named, "k", "left").withColumn("label", F.coalesce("__c", "k")).drop("__c")


def _links(run: pa.Table) -> Iterator[tuple[int, int]]:
    """Links between lines ``x`` and ``y`` of one key that are in different components."""
    node, k, sim, size, label = (run.column(c).to_numpy() for c in ("own", "k", "sim", "size", "label"))
    is_x, is_y = (run.column(c).to_numpy() for c in "xy")
    keys = np.frombuffer(b"".join(run.column("bands").to_pylist()), np.uint64).reshape(-1, BANDS)
    forms, home, most = run.column("form").to_pylist(), {}, int(_most_bits(node[:1])[0])
    counts = chars = None

    def root(x: int) -> int:
        while (y := home.get(x, x)) != x:
            home[x] = home.get(y, y)
            x = y
        return x

    found = []
    # By size: those that fit a line stand together.
    ys = np.flatnonzero(is_y)
    ys = ys[np.argsort(size[ys], kind="stable")]
    label_y, k_y, sim_y, size_y, x_y = label[ys], k[ys], sim[ys], size[ys], is_x[ys]
    for i in np.flatnonzero(is_x).tolist():
        low, high = np.searchsorted(size_y, [SIMILARITY * size[i] - 1e-6, size[i] / SIMILARITY + 1e-6])
        bits = _bits(sim_y[low:high], sim[i])
        at = np.flatnonzero(bits <= most)
        bits, at = bits[at], at + low
        # Such pairs come twice where both are on both sides.
        ok = (label_y[at] != label[i]) & _sizes_fit(size_y[at], size[i]) & (~(x_y[at] & is_y[i]) | (k_y[at] > k[i]))
        j, bits = ys[at[ok]], bits[ok]
        if len(j) and node[i] & 1:
            # Lines that meet in several bands are tried in the first of them.
            here = int(((keys[i] | np.uint64(1)).view(np.int64) == node[i]).argmax())
            ok = (keys[j] == keys[i]).argmax(axis=1) == here
            j, bits = j[ok], bits[ok]
        if len(j):
            if counts is None:
                counts, chars = _pair_counts(forms), np.array([len(f) for f in forms])
            ok = _may_be_alike(counts, chars, i, j)
            j, bits = j[ok], bits[ok]
        found += zip(bits.tolist(), itertools.repeat(i), j.tolist())  # noqa: B905
    found.sort()
    for start in range(0, len(found), 4096):
        part = [p for p in found[start : start + 4096] if root(int(label[p[1]])) != root(int(label[p[2]]))]
        far = _far_apart(forms, *np.array([p[1:] for p in part], np.int64).reshape(-1, 2).T)
        for (_, i, j), no in zip(part, far.tolist(), strict=True):
            x, y = root(int(label[i])), root(int(label[j]))
            if x != y and not no and alike(forms[i], forms[j]):
                home[max(x, y)] = min(x, y)
                yield int(k[i]), int(k[j])


def _cross_links(met: DataFrame, labels: DataFrame, forms: DataFrame, scratch: Scratch, node_limit: int) -> DataFrame:
    """Links (a, b) between lines of one key that are in different components."""
    rows = scratch.write(_labelled(met.select("node", "k", "sim", "size"), labels).distinct(), "labelled")
    seen = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1")
    seen = scratch.write(seen.select("node", "n"), "divided")
    rows = rows.join(seen, "node")
    few = rows.where(f"n <= {BLOCK_LIMITS * node_limit}").select("node", F.col("node").alias("own"), "k", "sim", "size", "label", F.lit(True).alias("x"), F.lit(True).alias("y"))
    many = rows.where(f"n > {BLOCK_LIMITS * node_limit}")
    if not seen.where(f"n > {BLOCK_LIMITS * node_limit}").isEmpty():
        # Lines outside a key's main component (x), in blocks, against blocks of all its lines (y).
        main = many.groupBy("node", "label").agg(F.count("*").alias("c")).groupBy("node").agg(F.max(F.struct("c", "label")).alias("m"))
        many = many.join(main.select("node", F.col("m.label").alias("home")), "node")
        odd = many.where("label <> home").groupBy("node").agg(F.ceil(F.count("*") / (BLOCK_LIMITS * node_limit)).alias("nx"))
        many = scratch.write(many.join(odd, "node").withColumn("ny", F.ceil(F.col("n") / (BLOCK_LIMITS * node_limit))), "dealt")
        deal = "pmod(xxhash64(k), {})"
        xs = many.where("label <> home").withColumn("i", F.expr(deal.format("nx"))).withColumn("j", F.explode(F.expr("sequence(0L, ny - 1)")))
        ys = many.withColumn("j", F.expr(deal.format("ny"))).withColumn("i", F.explode(F.expr("sequence(0L, nx - 1)")))
        # The last bit of a key says what kind it is.
        node = F.expr("shiftleft(xxhash64(node, i, j), 1) | (node & 1)")
        dealt = [side.select(node.alias("node"), F.col("node").alias("own"), "k", "sim", "size", "label", F.lit(x).alias("x"), F.lit(not x).alias("y")) for side, x in ((xs, True), (ys, False))]
        few = few.unionByName(dealt[0]).unionByName(dealt[1])
    whole = few.join(forms, "k").select("node", "own", "k", "sim", "size", "label", "x", "y", "form", "bands")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def handle(rows: pa.Table) -> pa.RecordBatch:
            node = rows.column("node").to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]))
            pairs = [p for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) for p in _links(rows.slice(a, b - a))]
            return pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held and held[-1].column(0)[-1] != batch.column(0)[0]:
                yield handle(pa.Table.from_batches(held))
                held = []
            node = batch.column(0).to_numpy()
            cut = int(np.searchsorted(node != node[-1], False)) if node[0] == node[-1] else int(np.flatnonzero(node != node[-1])[-1]) + 1
            if cut:
                yield handle(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield handle(pa.Table.from_batches(held))

    return whole.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long").distinct()


def line_groups(docs: DataFrame, lines: DataFrame, scratch: Scratch, node_limit: int = NODE_LIMIT) -> DataFrame:
    """(k, g) of every normal form that is joined with another; ``lines`` as made by ``_line_rows``."""
    # Tasks make the keys of a line once each, so equal ones are taken out before they are many rows.
    forms = scratch.write(lines.where("length(bands) > 0").select("k", "sim", "size", "bands").dropDuplicates(["k"]), "forms")
    scratch.release()
    count = forms.count()
    clean = next((c for most, c in CLEAN_BLOCKS if count <= most), 4)
    # Most keys are of one line only: hashes of keys are counted first, and the rows of those that recur are dealt out.
    shared = scratch.write(_key_rows(forms, clean).groupBy("node").agg(F.sum("n").alias("n")).where("n > 1").select(F.shiftrightunsigned("node", 1).alias("node")), "shared")
    scratch.release()
    met = scratch.write(_meet(_key_rows(forms, clean, key_filter(shared, KEY_FILTER_BITS)), node_limit), "met")
    scratch.drop(forms, shared)
    del shared
    scratch.release()
    texts = scratch.write(_forms(docs, key_filter(met.select("k"), FILTER_BITS)), "passing")
    wanted = met.select("k").distinct()
    texts, passing = scratch.write(texts.join(wanted, "k", "left_semi").dropDuplicates(["k"]), "texts"), texts
    scratch.drop(passing)
    scratch.release()
    near = met.where("best is not null").select(F.least("k", "best").alias("a"), F.greatest("k", "best").alias("b"))
    large = met.where("best is null")
    pivots = large.groupBy("node").agg(F.min(F.struct("k", "sim", "size")).alias("p"))
    star = large.join(pivots, "node").where(f"k <> p.k and bit_count(sim ^ p.sim) <= if(node & 1 = 1, {EDIT_BITS}, {MAX_BITS})")
    star = star.where(f"least(size, p.size) >= {SIMILARITY} * greatest(size, p.size) - 1e-9").select(F.col("p.k").alias("a"), F.col("k").alias("b"))
    links = scratch.write(confirm(near.unionByName(star).distinct(), texts), "links")
    scratch.release()
    labels = components(scratch, links)
    more = scratch.write(_cross_links(met, labels, texts, scratch, node_limit), "links")
    scratch.drop(met, texts)
    if not more.isEmpty():
        labels = components(scratch, links.unionByName(more))
    return labels.select(F.col("id").alias("k"), F.col("component").alias("g"))


def dedup_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, node_limit: int = NODE_LIMIT) -> DataFrame:
    """doc_id, n_lines (not blank), n_removed, kept_sha256 and ``text`` without the removed lines.

    With ``carry`` a last column ``rest`` is a struct of all other input columns. ``node_limit``: lines of one key that a task
    compares at once; the result does not depend on it.

    Blank lines are no occurrences and stay. Null texts have no lines and stay null. Rows without an id take no part and stay
    whole; rows of one id are one document, so a repeated row loses nothing to its double. Empty tables give empty results.
    """
    scratch = Scratch(spark, "lines")
    docs = with_rest(docs, id_col, text_col, carry)
    named = docs.where("doc_id is not null")
    lines = scratch.write(_line_rows(named.select("doc_id", "text")), "lines")
    groups = scratch.write(line_groups(named, lines, scratch, node_limit), "groups")
    grouped = scratch.write(lines.select("doc", "line", "k").join(groups, "k", "left").select("doc", "line", F.coalesce("g", "k").alias("g")), "grouped")
    scratch.only(grouped)
    # Written, so that the lines of a frequent group can be split over tasks by adaptive execution.
    first = scratch.write(grouped.groupBy("g").agg(F.min(F.struct("doc", "line")).alias("p"), F.count("*").alias("n")).where("n > 1").select("g", "p"), "firsts")
    gone = grouped.join(first, "g").where("struct(doc, line) > p").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set("line").alias("gone"))
    gone = scratch.write(gone, "gone")
    scratch.only(gone)
    both = left_join_few(docs, gone).select("doc_id", "text", "gone", *docs.columns[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            counts, removed, sums, out = [], [], [], []
            for drop, text in zip(batch.column(2).to_pylist(), texts, strict=True):
                lines = lines_of(text)
                counts.append(sum(1 for line in lines if line.strip()))
                removed.append(len(drop or ()))
                if drop:
                    drop = set(drop)
                    text = "\n".join(line for i, line in enumerate(lines) if i not in drop).encode("utf-8", "replace")
                sums.append(hashlib.sha256(text or b"").hexdigest())
                out.append(text)
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[3:]], ["doc_id", "n_lines", "n_removed", "kept_sha256", "text", *batch.schema.names[3:]])

    return both.mapInArrow(run, schema_with(both, 3, "doc_id long, n_lines long, n_removed long, kept_sha256 string, text string"))
