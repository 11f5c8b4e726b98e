"""MinHash near-dedup: a chosen-path set similarity join.

Documents are sets of word shingles; equal sets are one node of the graph from the start. In each of several
independent trees every set walks down from the root: a node selects one or two of the ``POSITIONS`` minhash
positions (by its own hash, the same for all its sets), and a set goes to the child named by its minwise token
there. Two sets of similarity s stay together down a path as in a branching process of mean s / THRESHOLD, so
each tree finds a pair at the threshold with a chance of about 0.6 at depth 3; TREES repeats them to miss about one such pair in a million.

* Nodes of at most NODE_LIMIT sets are compared exhaustively by 128-bit sketches.
* Larger ones branch two levels deeper, all of them, whatever their number.
* What is still large is a family of near copies: its sets are tried against the most typical one (a star), and after
  the exact check only sets outside the family's main component are counted against all sets there,
  in blocks, of which only links come out.

Candidates are confirmed on the full sets: first the best one of each set, twice, then every candidate
that would still join two components. So the exact work follows the number of sets, and no link between
components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, components, gram_hashes, mix, rows_by_key, signed, text_chunks

SHINGLE_WORDS = 5
#: Similarity in per cent: linked if 100 * intersection >= THRESHOLD * union.
THRESHOLD = 80
POSITIONS = 128
TREES = 14
DEPTH, DEEPER = 3, 5
NODE_LIMIT = 16
#: Of 128 sketch bits a pair at the threshold agrees in 115 on average, with a deviation of 3.4.
SKETCH_AGREE = 97


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, an empty one none."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(hashes, min(size, len(hashes))))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * POSITIONS + 1, dtype=np.uint64))
    return (seeds[:POSITIONS] >> np.uint64(32)).astype(np.uint32)[:, None], ((seeds[POSITIONS:] >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)[:, None]


def minhashes(items: np.ndarray) -> np.ndarray:
    """POSITIONS minwise values (uint32) of a set."""
    flip, factor = _permutations()
    low = (items ^ (items >> np.uint64(32))).astype(np.uint32)
    out = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 2048):
        part = (low[start : start + 2048] ^ flip) * factor
        part ^= part >> np.uint32(15)
        np.minimum(out, (part * np.uint32(0x2C1B3C6D)).min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc, n (set size), k1 and k2 (hash of the set), s1 and s2 (sketch), sig (one byte a position)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            words = Words(texts, fold_case=True)
            n, keys, sketches, sigs = [], [], [], []
            for i in range(len(texts)):
                items = shingle_set(words.of(i), size)
                n.append(len(items))
                keys.append(xxhash.xxh3_128_digest(items.tobytes()))
                if len(items):
                    low = minhashes(items)
                    sigs.append((low & 0xFF).astype(np.uint8).tobytes())
                    sketches.append(np.packbits((low >> np.uint32(8) & np.uint32(1)).astype(np.uint8)).tobytes())
                else:
                    sigs.append(b"")
                    sketches.append(bytes(16))
            key, sketch = (np.frombuffer(b"".join(x), np.int64).reshape(-1, 2) for x in (keys, sketches))
            arrays = [batch.column(0), pa.array(n, pa.int64()), *(pa.array(np.ascontiguousarray(x[:, j])) for x in (key, sketch) for j in (0, 1)), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "n", "k1", "k2", "s1", "s2", "sig"])

    return docs.mapInArrow(run, "doc long, n long, k1 long, k2 long, s1 long, s2 long, sig binary")


def _walk(nodes: np.ndarray, rows: np.ndarray, sigs: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Branch ``levels`` times: (node, row of ``sigs``) of the children reached.

    A node selects its first position always and its second with the chance that makes 100 / THRESHOLD of
    them on average.
    """
    for _ in range(levels):
        pick1 = mix(nodes ^ np.uint64(0xA0761D6478BD642F))
        pick2 = mix(pick1)
        coin = (mix(pick2) >> np.uint64(11)).astype(np.float64) / 2.0**53
        two = np.flatnonzero(coin < 100 / THRESHOLD - 1)
        parents = np.concatenate((nodes, nodes[two]))
        at = np.concatenate((pick1, pick2[two])) % np.uint64(POSITIONS)
        rows = np.concatenate((rows, rows[two]))
        token = sigs[rows, at.astype(np.int64)].astype(np.uint64)
        nodes = mix(mix(parents + np.uint64(1)) ^ (at << np.uint64(8) | token) * np.uint64(0xE7037ED1A0B428DB))
    return nodes, rows


def _grow(rows: DataFrame, levels: int) -> DataFrame:
    """Children of sets ``(node, doc, s1, s2, sig)``; without ``node``, of the roots of all trees."""
    rooted = "node" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                sigs = np.frombuffer(b"".join(col["sig"].to_pylist()), np.uint8).reshape(-1, POSITIONS)
                n = len(sigs)
                if rooted:
                    nodes, at = col["node"].to_numpy().view(np.uint64), np.arange(n)
                else:
                    nodes = np.repeat(mix(np.arange(1, TREES + 1, dtype=np.uint64)), n)
                    at = np.tile(np.arange(n), TREES)
                nodes, at = _walk(nodes, at, sigs, levels)
                arrays = [pa.array(signed(nodes)), *(pa.array(col[c].to_numpy()[at]) for c in ("doc", "s1", "s2"))]
                yield pa.RecordBatch.from_arrays(arrays, ["node", "doc", "s1", "s2"])

    return rows.mapInArrow(run, "node long, doc long, s1 long, s2 long")


def _small_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of one node whose sketches agree; no node has over NODE_LIMIT rows."""

    def handle(part: pa.Table) -> pa.RecordBatch | None:
        node, doc, s1, s2 = (part.column(c).to_numpy() for c in ("node", "doc", "s1", "s2"))
        found = []
        for lag in range(1, NODE_LIMIT):
            i = np.flatnonzero(node[lag:] == node[:-lag]) if len(node) > lag else ()
            if not len(i):
                break
            differ = np.bitwise_count((s1[i] ^ s1[i + lag]).view(np.uint64)).astype(np.int64) + np.bitwise_count((s2[i] ^ s2[i + lag]).view(np.uint64))
            near = (128 - differ >= SKETCH_AGREE) & (doc[i] != doc[i + lag])
            i, differ = i[near], differ[near]
            found.append(np.stack((np.minimum(doc[i], doc[i + lag]), np.maximum(doc[i], doc[i + lag]), 128 - differ)))
        if not found:
            return None
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(pairs[2].astype(np.int32))], ["a", "b", "agree"])

    return rows.repartition("node").sortWithinPartitions("node", "doc").mapInArrow(lambda it: rows_by_key(it, "node", handle), "a long, b long, agree int")


def _typical(rows: DataFrame) -> DataFrame:
    """(node, pivot, p1, p2): of each node's sets the one whose sketch is nearest to the majority of bits."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nodes, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
                sketch = np.stack((batch.column(1).to_numpy(), batch.column(2).to_numpy()), axis=1)
                bits = np.unpackbits(np.ascontiguousarray(sketch).view(np.uint8), axis=1)
                sums = np.zeros((len(nodes), 128), np.int64)
                np.add.at(sums, at, bits)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.bincount(at)), pa.array([s.tobytes() for s in sums], pa.binary())], ["node", "n", "sums"])

    def whole(group: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x, np.int64) for x in group.column("sums").to_pylist())
        most = np.packbits(2 * sums > sum(group.column("n").to_pylist())).view(np.int64)
        return pa.table({"node": group.column("node").slice(0, 1), "m1": most[:1], "m2": most[1:]})

    majority = rows.select("node", "s1", "s2").mapInArrow(partial, "node long, n long, sums binary").groupBy("node").applyInArrow(whole, "node long, m1 long, m2 long")
    away = F.expr("bit_count(s1 ^ m1) + bit_count(s2 ^ m2)")
    best = rows.join(majority, "node").groupBy("node").agg(F.min(F.struct(away.alias("away"), "doc", "s1", "s2")).alias("p"))
    return best.select("node", F.col("p.doc").alias("pivot"), F.col("p.s1").alias("p1"), F.col("p.s2").alias("p2"))


def candidates(spark: SparkSession, reps: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a < b, agree), and the members (node, doc, pivot) of families left large."""
    pairs, left = [], None
    source, levels = reps.select("doc", "s1", "s2", "sig"), DEPTH
    for depth in (DEPTH, DEEPER):
        rows = scratch.write(_grow(source, levels), "nodes")
        large = scratch.write(rows.groupBy("node").agg(F.count("*").alias("n")).where(f"n > {NODE_LIMIT}").select("node"), "large")
        pairs.append(scratch.write(_small_pairs(rows.join(large, "node", "left_anti")), "pairs"))
        left = scratch.write(rows.join(large, "node"), "left")
        scratch.drop(rows)
        levels = DEEPER - DEPTH
        if depth == DEEPER or large.isEmpty():
            break
        source = left.join(reps.select("doc", "sig"), "doc")
    families = scratch.write(left.join(_typical(left), "node"), "families")
    star = families.withColumn("agree", F.expr("128 - bit_count(s1 ^ p1) - bit_count(s2 ^ p2)")).where(f"doc <> pivot and agree >= {SKETCH_AGREE}")
    pairs.append(star.select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b"), F.col("agree").cast("int").alias("agree")))
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionByName(more)
    return scratch.write(out.distinct(), "candidates"), families.select("node", "doc", "pivot")


#: Slots of the filter of wanted documents, 2 ** FILTER_BITS bits at most: other documents' sets are not kept.
FILTER_BITS = 24


def _wanted_filter(spark: SparkSession, ids: DataFrame):
    """A bitmap of hashed ids, of bounded size: it may let others pass, never leaves a wanted one out."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    words = ids.select(F.shiftright(slot, 6).alias("w"), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()  # at most 2 ** (FILTER_BITS - 6) rows
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bitmap[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    return spark.sparkContext.broadcast(bitmap)


def _sets(docs: DataFrame, size: int, bitmap) -> DataFrame:
    """(doc, n, items) of the documents that the filter lets pass."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    docs = docs.select("doc_id", "text", slot.alias("slot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passing() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slots = batch.column(2).to_numpy()
                yield batch.filter(pa.array(bitmap.value[slots >> 6] >> (slots & 63) & 1 == 1))

        for batch, texts in text_chunks(passing()):
            words = Words(texts, fold_case=True)
            sets = [shingle_set(words.of(i), size) for i in range(len(texts))]
            arrays = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "n", "items"])

    return docs.mapInArrow(run, "doc long, n long, items binary")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, counted on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= THRESHOLD * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("doc").alias(k), F.col("n").alias(f"n{k}"), F.col("items").alias(f"i{k}")) for k in "ab")
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    joined = joined.where(f"100 * least(na, nb) >= {THRESHOLD} * greatest(na, nb)").select("a", "b", "ia", "ib")
    return joined.mapInArrow(run, "a long, b long")


#: Sets of one block of a family, about.
BLOCK_SETS = 256
#: Distinct shingles compared at a time in a pair of blocks.
BLOCK_SHINGLES = 1 << 16


def block_links(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Mask of linked pairs of two lists of sets, by exact intersection sizes."""
    universe = np.unique(np.concatenate(left)) if left else np.empty(0, np.uint64)
    both = np.zeros((len(left), len(right)), np.float64)
    for start in range(0, len(universe), BLOCK_SHINGLES):
        part = universe[start : start + BLOCK_SHINGLES]
        sides = []
        for sets in (left, right):
            dense = np.zeros((len(sets), len(part)), np.float32)
            for i, items in enumerate(sets):
                at = np.searchsorted(part, items)
                at = at[(at < len(part)) & (part[np.minimum(at, len(part) - 1)] == items)]
                dense[i, at] = 1
            sides.append(dense)
        both += sides[0] @ sides[1].T
    sizes = [np.array([len(s) for s in sets], np.float64) for sets in (left, right)]
    return 100 * both >= THRESHOLD * (sizes[0][:, None] + sizes[1][None, :] - both)


def _family_links(families: DataFrame, labels: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Links (a, b) of sets that are in a family but not in its main component, to anything in the family.

    One link of a set to each component is enough. None if there are no such sets. Families of one main component are taken together.
    """
    rows = scratch.write(_labelled(families.select("node", "doc").distinct(), labels, "doc", "label"), "family-labels")
    main = rows.groupBy("node", "label").agg(F.count("*").alias("n")).groupBy("node").agg(F.max(F.struct("n", "label")).alias("m")).select("node", F.col("m.label").alias("home"))
    members = scratch.write(rows.join(main, "node").select("home", "doc", "label").distinct(), "members")
    odd = members.where("label <> home")
    if odd.isEmpty():
        return None

    def packed(rows: DataFrame, part: str) -> tuple[DataFrame, DataFrame]:
        many = rows.groupBy("home").agg(F.ceil(F.count("*") / BLOCK_SETS).alias(f"n_{part}"))
        dealt = rows.join(many, "home").withColumn(part, F.expr(f"pmod(xxhash64(doc), n_{part})"))

        def pack(group: pa.Table) -> pa.Table:
            one = lambda c: pa.array([group.column(c)[0].as_py()], pa.int64())
            sizes = np.array(group.column("n").to_pylist(), np.int64).tobytes()
            docs, marks = (group.column(c).to_numpy().astype(np.int64).tobytes() for c in ("doc", "label"))
            values = (pa.array([v], pa.binary()) for v in (docs, marks, sizes, b"".join(group.column("items").to_pylist())))
            return pa.table([one("home"), one(part), *values], ["home", part, f"d_{part}", f"l_{part}", f"s_{part}", f"i_{part}"])

        schema = f"home long, {part} long, d_{part} binary, l_{part} binary, s_{part} binary, i_{part} binary"
        whole = dealt.join(sets, "doc").select("home", part, "doc", "label", "n", "items")
        return scratch.write(whole.groupBy("home", part).applyInArrow(pack, schema), f"blocks-{part}"), many

    left, many = packed(odd, "x")
    right, _ = packed(members.join(odd.select("home").distinct(), "home", "left_semi"), "y")
    spread = right.join(many, "home").withColumn("x", F.explode(F.expr("sequence(0L, n_x - 1)")))
    met = left.join(spread, ["home", "x"]).select("d_x", "l_x", "s_x", "i_x", "d_y", "l_y", "s_y", "i_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                side = []
                for at in (0, 4):
                    docs, marks, sizes = (np.frombuffer(batch.column(at + k)[row].as_py(), np.int64) for k in range(3))
                    items = np.frombuffer(batch.column(at + 3)[row].as_py(), np.uint64)
                    side.append((docs, marks, np.split(items, np.cumsum(sizes)[:-1])))
                (dx, lx, sx), (dy, ly, sy) = side
                i, j = np.nonzero(block_links(sx, sy) & (lx[:, None] != ly[None, :]))
                _, first = np.unique(np.stack((dx[i], ly[j])), axis=1, return_index=True)
                i, j = i[first], j[first]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(dx[i], dy[j])), pa.array(np.maximum(dx[i], dy[j]))], ["a", "b"])

    return met.mapInArrow(run, "a long, b long").distinct()


def _labelled(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    named = labels.select(F.col("id").alias(column), F.col("component").alias("__c"))
    return rows.join(named, column, "left").withColumn(name, F.coalesce("__c", column)).drop("__c")


def _best(pairs: DataFrame) -> DataFrame:
    """Of the pairs of each set the one that agrees most."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "agree").unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"), "agree"))
    best = both.groupBy("u").agg(F.max(F.struct("agree", F.col("v"))).alias("m")).select("u", F.col("m.v").alias("v"))
    return best.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def link_components(spark: SparkSession, docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """One row per input row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(spark, "chosen-path")
    named_docs = docs.where("doc_id is not null").select("doc_id", "text")
    signed_docs = scratch.write(signatures(named_docs, size), "signatures")
    filled = signed_docs.where("n > 0")
    classes = scratch.write(filled.groupBy("k1", "k2").agg(F.min("doc").alias("rep")), "classes")
    reps = filled.join(classes.select("k1", "k2", F.col("rep").alias("doc")), ["k1", "k2", "doc"], "left_semi")
    reps = scratch.write(reps.select("doc", "s1", "s2", "sig"), "reps")
    pairs, families = candidates(spark, reps, scratch)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(families.select(F.col("doc").alias("doc_id")))
    bitmap = _wanted_filter(spark, needed)
    sets = scratch.write(_sets(named_docs, size, bitmap), "sets")
    scratch.only(signed_docs, classes, pairs, families, sets)

    links, labels, rest = None, None, pairs
    for rounds in (1, 2, 3):
        now = scratch.write(_best(rest), "tried") if rounds < 3 else rest.select("a", "b")
        found = scratch.write(confirm(now, sets), "links")
        links = found if links is None else links.unionByName(found)
        if rounds < 3 or not found.isEmpty():
            labels = components(scratch, links)
        if rounds < 3:
            rest = rest.join(now, ["a", "b"], "left_anti")
            rest = scratch.write(_labelled(_labelled(rest, labels, "a", "la"), labels, "b", "lb").where("la <> lb").select("a", "b", "agree"), "rest")
            scratch.release()
    across = _family_links(families, labels, sets, scratch)
    if across is not None:
        across = scratch.write(across, "links")
        if not across.isEmpty():
            labels = components(scratch, links.unionByName(across))
    scratch.release()

    named = _labelled(classes, labels, "rep", "component_id").select("k1", "k2", "component_id")
    out = signed_docs.join(named, ["k1", "k2"], "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))
    scratch.only(out)
    # Rows of one id are one node: all of them carry its smallest component.
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def near_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Near-duplicate groups of whole texts: doc_id, n_shingles, component_id, kept, one row per input row.

    A-Z are lower-cased; the set of a text is its distinct shingles, or its whole sequence of words if that is
    shorter; texts without words (and nulls) are linked with nothing. Rows without an id are returned
    with a null component, ``kept`` true. Repeated rows are copies of each other under one id and all kept.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = link_components(spark, docs, shingle_words)
    nameless = signatures(docs.where("doc_id is null"), shingle_words)
    nameless = nameless.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(nameless)
