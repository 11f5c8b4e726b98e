"""Repetition coverage: how many characters of a text stand in n-grams or lines that occur before.

Per text, rolling hashes of word runs of several lengths are taken in numpy; a run found twice or more
marks its later copies, and the share of characters in marked words is held against a limit for each
length. All rules see the whole text; nothing is shuffled. Texts of fewer than SHARE_MIN_WORDS words are judged by the base rule,
lines and symbols only: there one repeated phrase of a few words is over any share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words, gram_hashes, pick, text_chunks

MIN_WORDS = 10
REPEAT_WINDOW = 5
#: Of all words, in per cent, that may stand in repeated 5-word windows.
MAX_REPEAT_PERCENT = 20
#: Limits on the share of characters, after published repetition rules for web text.
TOP_GRAM_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
DUPLICATE_GRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
DUPLICATE_LINE_LIMIT = 0.30
DUPLICATE_LINE_CHAR_LIMIT = 0.20
#: Texts under so many words have too few n-grams for a share of them to mean anything.
SHARE_MIN_WORDS = 30
MAX_SYMBOL_SHARE = 0.10
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def most_copies(hashes: np.ndarray) -> tuple[int, np.uint64]:
    """Copies of the most frequent hash, and that hash (the smallest of equals)."""
    if len(hashes) < 2:
        return len(hashes), np.uint64(0)
    ranked = np.sort(hashes)
    cuts = np.flatnonzero(ranked[1:] != ranked[:-1]) + 1
    if len(cuts) == len(ranked) - 1:
        return 1, ranked[0]
    edges = np.concatenate(([0], cuts, [len(ranked)]))
    runs = np.diff(edges)
    best = int(np.argmax(runs))
    return int(runs[best]), ranked[edges[best]]


def covered(hashes: np.ndarray, size: int, words: int, first_too: bool) -> np.ndarray:
    """Mask of words inside n-grams whose hash occurs twice or more (``first_too``) or occurred before."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    hit = np.zeros(len(hashes), bool)
    hit[order[1:][same]] = True
    if first_too:
        hit[order[:-1][same]] = True
    steps = np.zeros(words + 1, np.int32)
    starts = np.flatnonzero(hit)
    steps[starts] += 1
    steps[starts + size] -= 1
    return np.cumsum(steps[:-1]) > 0


def top_gram_chars(hashes: np.ndarray, size: int, best: np.uint64, sizes: np.ndarray) -> int:
    """Characters in the non-overlapping copies of the n-gram with hash ``best``."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    taken, last = 0, -size
    for s in np.flatnonzero(hashes == best).tolist():
        if s >= last + size:
            taken += int(ends[s + size] - ends[s])
            last = s
    return taken


FIELDS = (
    ("n_words", pa.int64(), "long"), ("word_chars", pa.int64(), "long"), ("n_symbols", pa.int64(), "long"),
    ("n_dup_lines", pa.int64(), "long"), ("n_repeat_words", pa.int64(), "long"), ("base_failed", pa.bool_(), "boolean"),
    ("kept", pa.bool_(), "boolean"), ("reason", pa.string(), "string"), ("max_dup_gram_share", pa.float64(), "double"),
    ("dup_line_share", pa.float64(), "double"), ("dup_line_char_share", pa.float64(), "double"),
)


def measure(text: bytes, hashes: np.ndarray, sizes: np.ndarray, symbols: int) -> tuple:
    """One row of FIELDS for a text, given its words' hashes and code points."""
    n, chars = len(hashes), int(sizes.sum())
    seen: set[bytes] = set()
    lines = dup_lines = dup_chars = line_chars = 0
    for line in text.split(b"\n"):
        if not line.split(None, 1):
            continue
        lines += 1
        points = len(line) if line.isascii() else len(line.decode("utf-8", "replace"))
        line_chars += points
        if line in seen:
            dup_lines += 1
            dup_chars += points
        else:
            seen.add(line)
    line_share = dup_lines / lines if lines else 0.0
    line_char_share = dup_chars / line_chars if line_chars else 0.0

    # A run of n words that repeats holds repeats of n-1 words: once a length has none, longer ones have none.
    repeat, share, reasons = 0, 0.0, []
    longest = int(sizes.max()) if n else 0
    for size in range(min(TOP_GRAM_LIMITS), max(DUPLICATE_GRAM_LIMITS) + 1):
        grams = gram_hashes(hashes, size)
        copies, best = most_copies(grams)
        if copies < 2:
            break
        if size == REPEAT_WINDOW:
            repeat = int(covered(grams, size, n, True).sum())
        if n < SHARE_MIN_WORDS:
            continue
        if size in TOP_GRAM_LIMITS and copies * size * longest > TOP_GRAM_LIMITS[size] * chars:
            if top_gram_chars(grams, size, best, sizes) > TOP_GRAM_LIMITS[size] * chars:
                reasons.append(f"top_{size}gram")
        if size in DUPLICATE_GRAM_LIMITS:
            now = float(sizes[covered(grams, size, n, False)].sum()) / chars
            share = max(share, now)
            if now > DUPLICATE_GRAM_LIMITS[size]:
                reasons.append(f"dup_{size}gram")
    base_failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    if base_failed:
        reasons.insert(0, "base")
    if line_share > DUPLICATE_LINE_LIMIT:
        reasons.append("dup_lines")
    if line_char_share > DUPLICATE_LINE_CHAR_LIMIT:
        reasons.append("dup_line_chars")
    if symbols > MAX_SYMBOL_SHARE * max(chars, 1):
        reasons.append("symbols")
    return n, chars, symbols, dup_lines, repeat, base_failed, not reasons, ",".join(reasons) or None, share, line_share, line_char_share


KEPT = [f[0] for f in FIELDS].index("kept")


def _rows(texts: list[bytes | None]) -> list[tuple]:
    words = Words(texts)
    sizes = words.code_points()
    marks = np.concatenate(([0], np.cumsum(_IS_SYMBOL[words.buffer])))
    rows = []
    for i, text in enumerate(texts):
        a, b = words.first[i], words.first[i + 1]
        symbols = int(marks[words.at[i + 1] - 1] - marks[words.at[i]])
        rows.append(measure(text or b"", words.hashes[a:b], sizes[a:b], symbols))
    return rows


def score_repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, shares and verdict of every document.

    Null, empty and wordless texts have no words and fail the base rule. Repeated rows give repeated
    results, a null id is carried through, an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            arrays = [pa.array(c, t) for c, (_, t, _) in zip(zip(*_rows(texts), strict=True), FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *(f[0] for f in FIELDS)])

    source = pick(docs, doc_id=id_col, text=text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{n} {t}" for n, _, t in FIELDS))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text passes all rules, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, text_col):
            yield batch.filter(pa.array([row[KEPT] for row in _rows(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
