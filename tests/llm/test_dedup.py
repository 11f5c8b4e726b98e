"""Near dedup, line dedup and substring dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("lakequill.llm")
from lakequill.llm import chosen_path_join, common, fuzzy_lines, substring_dedup  # noqa: E402
from lakequill.llm.common import Scratch  # noqa: E402

from .fixtures import corpus, edited, frame, prose, words  # noqa: E402


def smallest_reachable(sets, linked):
    """id -> smallest id reachable, over rows of (id, set)."""
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if linked(a, b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def shingles(text, size):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + min(size, len(w))]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup_equals_all_pairs(spark, size):
    rows = [(i, shingles(t, size)) for i, t in corpus() if i is not None]
    want = smallest_reachable(rows, lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b))
    got = chosen_path_join.near_dedup(spark, frame(spark), shingle_words=size).collect()
    assert len(got) == len(corpus())
    named = [r for r in got if r["doc_id"] is not None]
    assert {r["doc_id"]: r["component_id"] for r in named} == want
    assert {r["doc_id"]: r["n_shingles"] for r in named} == {i: len(s) for i, s in rows}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in named)
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)


def test_near_dedup_of_a_whole_table(spark):
    """All pairs of sf0.01/documents by an inverted index: the same components and sizes."""
    from collections import defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r["doc_id"]: shingles(r["text"], 2) for r in docs.collect()}
    where, common = defaultdict(list), Counter()
    for i in sorted(sets):
        for item in sets[i]:
            where[item].append(i)
    for ids in where.values():
        for n, i in enumerate(ids):
            common.update((i, j) for j in ids[n + 1 :])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, j), both in common.items():
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in chosen_path_join.near_dedup(spark, docs, shingle_words=2).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert sum(i != find(i) for i in sets) > 50


def test_near_dedup_of_a_large_family(spark):
    """More near copies than a node holds: the star, and the blocks for those outside its component."""
    base = prose(3, 150)
    rows = [(i, edited(base, i, random.Random(i).choice((0.01, 0.04, 0.07)))) for i in range(150)]
    sets = [(i, shingles(t, 2)) for i, t in rows]
    want = smallest_reachable(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    got = chosen_path_join.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_block_links_counts_exactly():
    r = np.random.default_rng(1)
    left, right = ([np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(20)] for _ in range(2))
    left[3] = right[5]
    got = chosen_path_join.block_links(left, right)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            both = len(np.intersect1d(a, b))
            assert got[i, j] == (100 * both >= 80 * (len(a) + len(b) - both))
    assert got[3, 5]


@pytest.mark.parametrize("size", [20, 50])
def test_substring_dedup_equals_brute_force(spark, size):
    got = substring_dedup.dedup_substrings(spark, frame(spark), min_words=size, layout=False).collect()
    assert len(got) == len(corpus())
    texts = {i: t for i, t in corpus() if i is not None}
    seen, want = set(), {}
    for i in sorted(texts):
        w = words(texts[i])
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            window = tuple(w[k : k + size])
            if window in seen:
                gone[k : k + size] = [True] * size
            seen.add(window)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert sum(w[1] for w in want.values()) > 500
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["n_removed"] == 0 for r in got if r["doc_id"] is None)


def test_substring_dedup_shuffles_no_text_of_whole_documents(spark, monkeypatch):
    """Blocks are made where the texts are, and documents without repeats are not dealt out; bitmaps that let nearly all pass change nothing."""
    want = {r["doc_id"]: r["kept_sha256"] for r in substring_dedup.dedup_substrings(spark, frame(spark), layout=False).collect() if r["doc_id"] is not None}
    plans = {}
    write = Scratch.write

    def noted(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "write", noted)
    monkeypatch.setattr(substring_dedup, "FILTER_BITS", 6)
    monkeypatch.setattr(common, "ID_BITS", 7)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = substring_dedup.dedup_substrings(spark, frame(spark), layout=False)
        got = {r["doc_id"]: r["kept_sha256"] for r in out.collect() if r["doc_id"] is not None}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == want
    assert "Exchange" not in plans["blocks"]


def test_left_join_few_is_a_left_join(spark):
    """Whatever ids share a slot of the bitmap; null and negative ids too."""
    bits = common.ID_BITS
    docs = spark.createDataFrame([(i, f"t{i}") for i in [None, -1, -(1 << bits) + 5, 0, 1, 5, 5, 64, (1 << bits) + 5, (1 << bits) - 1]], "doc_id long, text string")
    for ids in ([5, 64], [-1, 0], [], [(1 << bits) + 5]):
        rows = spark.createDataFrame([(i, 2 * i) for i in ids], "doc_id long, twice long")
        want = Counter((r["doc_id"], r["text"], r["twice"]) for r in docs.join(rows, "doc_id", "left").collect())
        made = common.left_join_few(docs, rows)
        assert made.columns == ["doc_id", "text", "twice"]
        assert Counter((r["doc_id"], r["text"], r["twice"]) for r in made.collect()) == want


def test_substring_layout_keeps_what_is_kept(spark):
    got = substring_dedup.dedup_substrings(spark, frame(spark), min_words=20).collect()
    plain = {r["doc_id"]: r["text"] for r in substring_dedup.dedup_substrings(spark, frame(spark), min_words=20, layout=False).collect()}
    texts = dict(corpus())
    for r in got:
        if r["doc_id"] is not None:
            assert words(r["text"]) == words(plain[r["doc_id"]])
            if not r["n_removed"]:
                assert r["text"] == texts[r["doc_id"]]


def line_corpus():
    r = random.Random(5)
    base = [prose(s, r.randrange(4, 60)) for s in range(60)]
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, "---\n---"), (None, base[0])]
    for i in range(60):
        lines = [r.choice(base) for _ in range(3)] + [edited(r.choice(base), i, 0.02), f"Copyright {1990 + i}, all rights", f"copyright {2000 + i}: ALL rights "]
        rows.append((10 + i, "\n".join(lines)))
    return [*rows, rows[8]]


def similar(a, b):
    """Edit similarity of two normal forms, nothing else."""
    long = max(len(a), len(b))
    return 5 * abs(len(a) - len(b)) <= long and 5 * fuzzy_lines.edit_distance(a, b) <= long


@pytest.mark.parametrize("node_limit", [4, fuzzy_lines.NODE_LIMIT])
def test_line_dedup_against_all_pairs(spark, node_limit):
    rows = line_corpus()
    got = fuzzy_lines.dedup_lines(spark, frame(spark, rows), node_limit=node_limit).collect()
    assert len(got) == len(rows)
    lines = sorted({(i, n, fuzzy_lines.normal_form(x).decode()) for i, t in rows if i is not None for n, x in enumerate((t or "").split("\n")) if x.strip()})
    group = smallest_reachable([(f, f) for f in sorted({f for _, _, f in lines})], similar)
    first = {}
    for i, n, f in lines:
        first.setdefault(group[f], (i, n))
    want = Counter(i for i, n, f in lines if first[group[f]] != (i, n))
    assert sum(want.values()) > 100
    removed = {r["doc_id"]: r["n_removed"] for r in got if r["doc_id"] is not None}
    assert removed.keys() == {i for i, _ in rows if i is not None}
    # Bands may miss a pair of lines; what is removed is right.
    assert all(n <= want[i] for i, n in removed.items()) and sum(removed.values()) >= 0.98 * sum(want.values())
    assert all(r["n_removed"] == 0 for r in got if r["doc_id"] is None)
    assert np.all([r["text"] is None for r in got if r["doc_id"] == 1])


def test_only_keys_of_several_lines_are_dealt_out(spark, monkeypatch):
    """Rows that are shuffled to meet are of keys that recur; a filter that lets all pass links the same."""
    rows = [(i, prose(5000 + i, 12, 10**6)) for i in range(300)] + [(1000 + i, edited(prose(1, 30), i, 0.05)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, removed = [], []
    meet = fuzzy_lines._meet
    monkeypatch.setattr(fuzzy_lines, "_meet", lambda keys, limit: dealt.append(Counter(r["node"] for r in keys.collect())) or meet(keys, limit))
    for bits in (28, 6):
        monkeypatch.setattr(fuzzy_lines, "KEY_FILTER_BITS", bits)
        removed.append({r["doc_id"]: r["n_removed"] for r in fuzzy_lines.dedup_lines(spark, df).collect()})
    few, many = dealt
    assert removed[0] == removed[1] and sum(removed[0].values()) >= 15
    assert all(n > 1 for n in few.values()) and few == Counter({k: n for k, n in many.items() if n > 1})
    assert sum(few.values()) < sum(many.values())


def test_line_recall_on_a_whole_table(spark):
    """All pairs of normal forms of sf0.001 with the similarity, by edit distance alone: nine in ten are in one group, in each class of lengths."""
    from bisect import bisect_right

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    forms = sorted({fuzzy_lines.normal_form(x).decode() for t in texts.values() for x in (t or "").split("\n") if x.strip()}, key=len)
    sizes = [len(f) for f in forms]
    bags = [Counter(zip(f, f[1:])) for f in forms]
    pairs = []
    for i, f in enumerate(forms):
        for j in range(i + 1, bisect_right(sizes, sizes[i] / 0.8 + 1e-9)):
            # Each edit changes two pairs of neighbouring characters.
            if sum((bags[i] & bags[j]).values()) >= 0.6 * sizes[j] - 1 and similar(f, forms[j]):
                pairs.append((f, forms[j]))
    scratch = Scratch(spark, "recall")
    lines = scratch.write(fuzzy_lines._line_rows(docs), "lines")
    group = {r["k"]: r["g"] for r in fuzzy_lines.line_groups(docs, lines, scratch).collect()}
    key = {f: int(fuzzy_lines.signed(fuzzy_lines.Lines([f.encode()]).keys)[0]) for pair in pairs for f in pair}
    assert len(pairs) > 30
    for low, high in ((0, 100), (100, 300), (300, 10**9)):
        some = [(a, b) for a, b in pairs if low <= len(b) < high]
        caught = sum(group.get(key[a], key[a]) == group.get(key[b], key[b]) for a, b in some)
        assert caught >= 0.9 * len(some), (low, caught, len(some))


def test_normal_forms():
    import re

    for line in ("  Hello,  WORLD 12\u00a0x ", "---", "a_b", "\u00abÉté\u00bb \u0663", "STRASSE ß", "x\u2003y", "İ!"):
        plain = re.sub(r"[\W_]+", " ", re.sub(r"\d", "0", line.lower())).strip() or line.strip()
        assert fuzzy_lines.normal_form(line).decode() == plain
    long = " ".join(f"w{i % 7}" for i in range(600)).encode()
    hashes = fuzzy_lines.Words([long]).hashes
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    assert fuzzy_lines.simhash(np.concatenate((hashes[:1], hashes)), np.array([0, 1]))[1] == np.packbits(2 * bits.sum(axis=0) > 600).view(np.uint64)[0]


def test_lines_of_a_chunk():
    texts = [b"One, two\n\n***\n one TWO 3", None, b"", "\u00c9t\u00e9 \u00ab\n\u2003\n--\n\u00e9t\u00e9".encode(), b"\n", b"one two"]
    lines = fuzzy_lines.Lines(texts)
    found = {(o, n): (k, s) for o, n, k, s in zip(lines.owner.tolist(), lines.number.tolist(), lines.keys.tolist(), lines.size.tolist(), strict=True)}
    plain = {(o, n): fuzzy_lines.normal_form(x).decode() for o, t in enumerate(texts) for n, x in enumerate((t or b"").decode().split("\n")) if x.strip()}
    assert found.keys() == plain.keys()
    assert {p: s for p, (_, s) in found.items()} == {p: len(f) for p, f in plain.items()}
    assert all((found[a][0] == found[b][0]) == (plain[a] == plain[b]) for a in plain for b in plain)


def test_line_families_and_edit_distance(spark):
    """Many variants of one long line, more than a node holds."""
    base = prose(8, 120)
    rows = [(i, edited(base, i, 0.012)) for i in range(100)]
    got = fuzzy_lines.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    forms = [(i, fuzzy_lines.normal_form(t).decode()) for i, t in rows]
    want = smallest_reachable([(i, f) for i, f in forms], similar)
    assert {r["doc_id"] for r in got.collect() if r["n_removed"] == 0} == set(want.values())

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(2)
    for _ in range(300):
        a, b = ("".join(r.choices("abc", k=r.randrange(14))) for _ in range(2))
        assert fuzzy_lines.edit_distance(a, b) == slow(a, b)
    for i in range(200):
        a = prose(i, r.randrange(3, 60))
        b = edited(a, i, r.choice((0.02, 0.1, 0.2, 0.3)))
        assert fuzzy_lines.alike(a, b) == (5 * slow(a, b) <= max(len(a), len(b)))


def test_counters_of_pairs_never_rule_out_lines_that_are_alike():
    r = random.Random(8)
    forms = []
    for _ in range(40):
        base = "".join(r.choice("ab cdé") for _ in range(r.randrange(1, 90)))
        for share in (0.0, 0.05, 0.1, 0.15, 0.25):
            forms.append("".join(c if r.random() >= share else r.choice(["", "x", c + "y"]) for c in base) or "z")
    counts, size, j = fuzzy_lines._pair_counts(forms), np.array([len(f) for f in forms]), np.arange(len(forms))
    ruled_out = right = 0
    for i in range(len(forms)):
        may = fuzzy_lines._may_be_alike(counts, size, i, j)
        right += sum(fuzzy_lines.alike(forms[i], f) for f in forms)
        ruled_out += int((~may).sum())
        assert all(ok or not fuzzy_lines.alike(forms[i], f) for ok, f in zip(may, forms, strict=True))
    assert right > len(forms) and ruled_out > 0


def test_lines_that_are_alike_are_never_called_far_apart():
    r, forms = random.Random(9), []
    for _ in range(600):
        n = r.choice([1, 9, 30, 63, 64, 65, 129, 200])
        line = [r.choice("abcde ü字") for _ in range(n)]
        other = line[:]
        for _ in range(r.randrange(int(0.3 * n) + 2)):
            at = r.randrange(len(other) + 1)
            other[at : at + r.randrange(2)] = r.choices("abcd ", k=r.randrange(2))
        if r.random() < 0.3:
            other = other[n // 8 :]
        forms += ["".join(line), "".join(other)]
    a, b = np.arange(0, len(forms), 2), np.arange(1, len(forms), 2)
    right = np.array([fuzzy_lines.alike(forms[i], forms[j]) for i, j in zip(a, b, strict=True)])
    for x, y in ((a, b), (b, a)):
        far = fuzzy_lines._far_apart(forms, x, y)
        assert not (far & right).any() and far.any()
        assert (fuzzy_lines._alike_pairs(forms, x, y) == right).all()


def test_lines_of_one_key_that_are_unlike_cost_few_edit_distances(monkeypatch):
    """Many lines of one language in one band: before, each pair with like counts of characters took an edit distance of its own."""
    r, calls = random.Random(4), []
    syllables = ["th", "en", "er", "in", "on", "re", "an", "tion", "ing", "ou", "wh", "at"]
    forms = [" ".join("".join(r.choices(syllables, k=r.randrange(1, 4))) for _ in range(40)) for _ in range(60)]
    n = len(forms)
    distance = fuzzy_lines.edit_distance
    monkeypatch.setattr(fuzzy_lines, "edit_distance", lambda *a: calls.append(a) or distance(*a))
    columns = {"own": [2] * n, "k": list(range(n)), "sim": [0] * n, "size": [len(f) for f in forms], "label": list(range(n)), "x": [True] * n, "y": [True] * n}
    rows = pa.table(columns | {"form": forms, "bands": [bytes(8 * fuzzy_lines.BANDS)] * n})
    assert list(fuzzy_lines._links(rows)) == [] and len(calls) < 60
    assert not any(fuzzy_lines.alike(a, b) for a in forms[:20] for b in forms[20:])


def test_lines_are_linked_by_edit_similarity_alone(spark):
    """What the query links is all pairs of the similarity, whatever bits of the SimHash an edit moves."""
    from lakequill.llm import queries

    rows = []
    for i in range(40):
        base = prose(1000 + i, 6 + i % 50).split()
        other = list(base)
        other[len(other) // 2] = "zz"
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(other)), (3 * i + 2, f"{' '.join(base)} end")]
    family = prose(77, 40)
    rows += [(1000 + i, edited(family, i, 0.06)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    forms = [(i, fuzzy_lines.normal_form(t).decode()) for i, t in rows]

    groups = smallest_reachable(forms, similar)
    want = {i for i, _ in rows if groups[i] == i}
    table = queries.table
    queries.table = lambda *_: df
    try:
        got = {r["doc_id"] for r in queries.op5_fuzzy_line_dedup(spark, "").collect() if r["n_removed"] == 0}
    finally:
        queries.table = table
    assert want <= got and len(got - want) <= 2


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert chosen_path_join.near_dedup(spark, empty).count() == 0
    assert substring_dedup.dedup_substrings(spark, empty).count() == 0
    assert fuzzy_lines.dedup_lines(spark, empty).count() == 0


def test_few_edges_are_folded_by_one_task(spark, monkeypatch):
    r = random.Random(6)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1200)]
    df, got = spark.createDataFrame(edges, "a long, b long"), []
    for most in (common.TASK_EDGES, 0):
        monkeypatch.setattr(common, "TASK_EDGES", most)
        got.append(sorted(map(tuple, common.components(common.Scratch(spark, "t"), df).collect())))
    assert got[0] == got[1] and (1200, 1000) in got[0]


def test_components_of_chains_and_random_graphs(spark):
    from lakequill.llm.common import components

    r = random.Random(9)
    edges = [(i, i + 1) for i in range(1000, 1040)] + [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(5, 5), (2000, 1999), (2000, 1998)]
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    pairs = {frozenset(e) for e in edges}
    want = smallest_reachable([(x, x) for x in nodes], lambda a, b: frozenset((a, b)) in pairs)
    got = components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == want and len(got) == len(want)
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0
