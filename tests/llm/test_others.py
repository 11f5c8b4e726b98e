"""Quality rules, WARC, vector search, pieces, HTML, toxicity, packing and the pipeline."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("lakequill.llm")
from lakequill.llm import best_fit_packing, piece_lattice, pu_toxicity, quality_repetition, vector_approximation, warc_derivatives, wrapper_inference  # noqa: E402
from lakequill.llm.common import Scratch  # noqa: E402
from lakequill.llm.html_tree import tokens, visible_text  # noqa: E402

from .fixtures import corpus, frame, prose, words  # noqa: E402

DATA = "/root/testdata/sf0.001"


# --- quality ---


def test_quality_counts_equal_brute_force(spark):
    rows = [*corpus(), (900, "a # b\n* é\n* é\n"), (901, "x y z v w " * 30)]
    got = quality_repetition.score_repetition(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, text in rows:
        if i is None:
            continue
        text, w = text or "", words(text)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        r = by[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert not by[901]["kept"] and not by[1]["kept"] and by[312]["kept"]
    kept = quality_repetition.keep_good(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns and kept.count() == sum(r["kept"] for r in got)
    assert quality_repetition.score_repetition(frame(spark, [])).count() == 0


def test_quality_agrees_with_labels(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    both = quality_repetition.score_repetition(docs).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").select("quality", "kept").collect()
    good, bad = ([r["kept"] for r in both if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.1


# --- WARC ---


def test_warc_round_trip_and_links(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a.example/x", "<html lang=en><title>T &amp; U</title><body><p>Hi<br>you</p><a href='/z'>link</a><script>no()</script>"), (2, None, None), (2, None, None)],
        "page_id long, url string, html string").selectExpr("*", "1 AS block", "2 AS headers")
    responses = warc_derivatives.responses_from_pages(pages)
    made = warc_derivatives.build_derivatives(responses, keep="source_id")
    rows = [r.asDict(recursive=True) for r in made.collect()]
    assert len(rows) == 6 and Counter(r["warc_type"] for r in rows) == {"metadata": 3, "conversion": 3}
    source = {r["record_id"]: r for r in responses.collect()}
    for r in rows:
        assert r["refers_to"] in source and r["target_uri"] == source[r["refers_to"]]["target_uri"]
        assert r["block_digest"] == warc_derivatives.digest(r["block"])
        names = [h["name"] for h in r["headers"]]
        assert names.count("WARC-Refers-To") == 1 and dict((h["name"], h["value"]) for h in r["headers"])["Content-Length"] == str(len(r["block"]))
    text = next(r for r in rows if r["source_id"] == "1" and r["warc_type"] == "conversion")
    meta = next(r for r in rows if r["source_id"] == "1" and r["warc_type"] == "metadata")["block"].decode()
    assert text["block"].decode() == "Hi you\nlink"
    payload = source[text["refers_to"]]["payload_digest"]
    assert f"source-WARC-Payload-Digest: {payload}" in meta and f"source-payload-digest-computed: {payload}" in meta
    assert "title: T & U" in meta and "outlink: /z" in meta and "http-Content-Type: text/html" in meta and f"conversion: {text['record_id']}" in meta
    out = f"file://{tmp_path}/out"
    warc_derivatives.write_warc(made.drop("source_id"), out)
    back = [r.asDict(recursive=True) for r in warc_derivatives.read_warc(spark, f"{out}/*.gz").collect()]
    key = lambda r: (r["record_id"], r["block"])
    assert [(key(r), r["headers"], r["refers_to"]) for r in sorted(back, key=key)] == [(key(r), r["headers"], r["refers_to"]) for r in sorted(rows, key=key)]


def test_http_codings():
    import gzip

    body = gzip.compress("<p>né</p>".encode("latin-1"))
    chunked = b"%x\r\n" % len(body) + body + b"\r\n0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\nX-Long: a\r\n b\r\n\r\n" + chunked
    metadata, conversion = warc_derivatives.derive({"record_id": "<urn:x>", "target_uri": "http://a", "warc_date": None, "headers": [], "block": block})
    assert conversion["block"].decode() == "né" and b"http-X-Long: a b" in metadata["block"]
    bare = warc_derivatives.derive({"record_id": None, "target_uri": None, "warc_date": None, "headers": None, "block": b"plain"})
    assert bare[1]["block"] == b"plain"


# --- vectors ---


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(0, 0.15, 16).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[i - 300][1]) for i in range(300, 340)]  # ties
    rows += [(400, None), (401, [None] * 16), (402, [float("nan")] * 16), (403, [float("inf")] + [0.0] * 15), (404, [0.5] * 3), (405, []), (None, [0.1] * 16), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS stripe", "2 AS dim")
    from pyspark.sql import functions as F

    got = {}
    for row in sorted(vector_approximation.top_k(spark, df, F.col("vec_id") % 20 == 0).collect(), key=lambda x: x["rank"]):
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    fine = {i: np.floor(np.array(v, np.float32).astype(float) * 64).astype(int) for i, v in rows if i is not None and i < 340}
    want = {}
    for q in fine:
        if q % 20 == 0:
            best = sorted(((-int(v @ fine[q]), i) for i, v in fine.items() if i != q))[:20]
            want[q] = [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == want
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert vector_approximation.top_k(spark, few, F.col("vec_id") % 20 == 0).count() == 2
    assert vector_approximation.top_k(spark, df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_repeats_no_rows_through_the_driver(spark, tmp_path):
    from pyspark.sql import functions as F

    r = np.random.default_rng(6)
    rows = [(n, i, 2, r.integers(-9, 9, 2).tolist(), 0) for n, i in enumerate(range(40))]
    spark.createDataFrame(rows, "n int, id long, dim int, v array<long>, block long").write.parquet(f"{tmp_path}/v")
    v = spark.read.parquet(f"{tmp_path}/v").select("id", "v", "dim", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("stripe"))
    vector_approximation._stripes(v).write.parquet(f"{tmp_path}/s")
    vector_approximation._blocks(v).write.parquet(f"{tmp_path}/b")
    stripes, blocks = (spark.read.parquet(f"{tmp_path}/{x}") for x in "sb")
    floors = v.groupBy("block", "dim").agg(F.collect_list(F.struct(F.col("id").alias("query_id"), F.lit(0.0).alias("floor"))).alias("floors"))
    for met in (vector_approximation._met(stripes, blocks, None, 3, 5000, 5000), vector_approximation._met(stripes, blocks, floors, 3, 5000, 5000)):
        assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
    assert vector_approximation._smallest(np.array([[-128, 127]])).dtype == np.int8 and vector_approximation._smallest(np.array([[0, 128]])).dtype == np.int16


def test_bounds_hold_for_large_components():
    r = np.random.default_rng(4)
    for most in (40, 2**27):
        vectors = r.integers(-most, most, (200, 8))
        lower, upper = vector_approximation.bounds(vectors[:50], *vector_approximation.cells_of(vectors))
        exact = (vectors[:50].astype(object) @ vectors.T.astype(object)).astype(float)
        assert (lower <= exact).all() and (exact <= upper).all()


def test_few_exact_vectors_are_read(spark):
    """Of the pairs of queries and vectors few reach the floor that the cells give; their exact vectors alone are read."""
    import pyarrow.parquet as pq

    rows = [v for v in pq.read_table("/root/testdata/sf0.1/embeddings.parquet").column("embedding").to_pylist() if v is not None]
    vectors = np.floor(np.array(rows, float) * 64).astype(np.int64)
    queries = vectors[::20]
    lower, upper = vector_approximation.bounds(queries, *vector_approximation.cells_of(vectors))
    floor = np.sort(lower, axis=1)[:, -21]  # the query itself is among them
    assert (upper >= floor[:, None]).mean() < 0.05


def test_charset_and_members_of_any_size():
    """A charset behind a long comment; many gzip members; an empty file."""
    page = b"<html><!--" + b"x" * 5000 + b"--><META http-equiv=a content='text/html; charset=iso-8859-1'><body>caf\xe9 <meta charset=ascii>"
    assert warc_derivatives.decode_html([], page) == (page.decode("latin-1"), "iso-8859-1")
    assert warc_derivatives.decode_html([], b"<body><meta charset=ascii>caf\xc3\xa9")[1] == "utf-8"
    record = {"headers": [{"name": "WARC-Type", "value": "resource"}, {"name": "Content-Length", "value": "200000"}], "block": bytes(range(200)) * 1000}
    data = b"".join(warc_derivatives.to_bytes(record) for _ in range(5))
    assert [r["block"] for r in warc_derivatives.parse(data)] == [record["block"]] * 5
    assert [r["block"] for r in warc_derivatives.parse(warc_derivatives.to_bytes(record, compress=False) * 2)] == [record["block"]] * 2
    assert list(warc_derivatives.parse(b"")) == []


# --- pieces ---


@pytest.fixture(scope="module")
def piece_model():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library_and_round_trip(spark, piece_model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    model = piece_lattice.load_model(piece_model)
    texts = ["Hello  world   x\n\ny\t z 日本語 🙂 é ▁a", "", None, "a" * 100 + " " + "ab" * 50, "   ", "trailing ", "internationalisation of unbelievable", prose(4, 40)]
    texts += [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(12).collect()]
    df = frame(spark, list(enumerate(texts)))
    rows = piece_lattice.encode(spark, df, model, Scratch(spark, "t"))
    got = {r["doc_id"]: r["ids"] for r in rows.collect()}
    assert got == {i: library.encode(t or "") for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in piece_lattice.decode(spark, rows, model, ["doc_id"]).collect()}
    assert back == {i: library.decode(got[i]) for i in got}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))


def test_pieces_of_odd_rows(spark, piece_model):
    """Repeated rows, null ids, an empty table, a very long text."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    model = piece_lattice.load_model(piece_model)
    rows = [(1, "some text"), (1, "some text"), (1, "another"), (None, "no id"), (None, None), (2, prose(3, 40_000))]
    got = piece_lattice.encode_and_decode(spark, frame(spark, rows), model, Scratch(spark, "t")).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, len(library.encode(t or ""))) for i, t in rows)
    assert all(r["round_trip"] for r in got)
    # The digest follows the ids and their order.
    digests = [sorted(r["ids_digest"] for r in got if r["doc_id"] == 1 and r["n_tokens"] == n) for n in (len(library.encode("some text")), len(library.encode("another")))]
    assert digests[0][0] == digests[0][1] and not set(digests[0]) & set(digests[1])
    assert piece_lattice.encode_and_decode(spark, frame(spark, []), model, Scratch(spark, "t")).count() == 0


def test_unigram_pieces_equal_the_library(spark, tmp_path):
    """A model written by hand: best sums of scores, and neighbouring unknown characters as one unknown."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    scored = {"▁": -2.1, "a": -3.3, "b": -3.7, "c": -4.3, "ab": -5.9, "bc": -6.13, "abc": -8.41, "▁a": -4.27, "▁ab": -6.71, "ca": -5.57, "aa": -6.03, "▁bca": -9.2}
    for piece, score in scored.items():
        proto.pieces.add(piece=piece, score=score, type=1)
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.remove_extra_whitespaces = False
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["abc", "abcab  bca", "zz ab zé", "", None, "aab caab bcabc", " a", "xyz", "ab" * 30]
    rows = piece_lattice.encode(spark, frame(spark, list(enumerate(texts))), piece_lattice.load_model(str(path)), Scratch(spark, "t"))
    assert {r["doc_id"]: r["ids"] for r in rows.collect()} == {i: library.encode(t or "") for i, t in enumerate(texts)}


    # The query's way gives the same whole lists, and the texts that stand for them.
    model = piece_lattice.load_model(str(path))
    got = {r["doc_id"]: r for r in piece_lattice.encode_and_decode(spark, frame(spark, list(enumerate(texts))), model, Scratch(spark, "t")).collect()}
    assert {i: (r["ids"], r["n_tokens"], r["text"]) for i, r in got.items()} == {i: (ids := library.encode(t or ""), len(ids), library.decode(ids)) for i, t in enumerate(texts)}
    assert {i for i, r in got.items() if not r["round_trip"]} == {i for i, t in enumerate(texts) if library.decode(library.encode(t or "")) != (t or "")}


def test_the_query_decodes_what_it_encoded(spark, piece_model, monkeypatch):
    import sentencepiece

    from lakequill.llm import queries

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    texts = ["Hello  world x\n\ny\t z 日本語 🙂 é ▁a", "", None, "a" * 60 + " trailing ", "   ", " lead"]
    df = frame(spark, list(enumerate(texts)))
    monkeypatch.setattr(queries, "table", lambda *_: df)
    got = {r["doc_id"]: r for r in queries.op6_sentencepiece(spark, "").collect()}
    assert len(got) == len(texts) and all(r["round_trip"] for r in got.values())
    assert [got[i]["n_tokens"] for i in range(len(texts))] == [len(library.encode(t or "")) for t in texts]


def test_whole_ids_and_texts_with_holes(spark, piece_model, monkeypatch):
    """Ids of rare chunks come by a join; lists, digests and texts are those of whole rows, of 16-bit and 32-bit ids."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    model = piece_lattice.load_model(piece_model)
    texts = ["Hello  world x\n\ny\t z 日本語 🙂 é", "", None, "a" * 70 + " trailing ", " lead", prose(8, 300), prose(9, 200)]
    monkeypatch.setattr(piece_lattice, "FREQUENT_CHUNKS", 20)
    for unused in (0, 70_000):
        model = model._replace(all_pieces=model.all_pieces + [("", 5)] * unused)
        got = {r["doc_id"]: r for r in piece_lattice.encode_and_decode(spark, frame(spark, list(enumerate(texts))), model, Scratch(spark, "t")).collect()}
        assert {i: (r["ids"], r["n_tokens"], r["text"]) for i, r in got.items()} == {i: (ids := library.encode(t or ""), len(ids), t or "") for i, t in enumerate(texts)}
        assert all(r["round_trip"] for r in got.values()) and len({r["ids_digest"] for r in got.values()}) == len(texts) - 1


def test_rows_of_a_block_share_what_is_written_of_their_rare_chunks(spark, piece_model, monkeypatch):
    """A chunk that is rare in the corpus but in many rows of a block was written and joined for each occurrence; ids are packed."""
    import sentencepiece

    monkeypatch.setattr(piece_lattice, "FREQUENT_CHUNKS", 1)
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    model = piece_lattice.load_model(piece_model)
    texts = [prose(3, 120)] * 40 + [None, ""] + [f"{prose(4, 30)} ⟐⟐ é"] * 3
    rows = piece_lattice._rows(spark, frame(spark, list(enumerate(texts))).select("doc_id", "text").coalesce(1), model, Scratch(spark, "t")).collect()
    held = [len(f) for r in rows for f in (r["fills"] or [],)]
    assert sum(held) <= len(set(piece_lattice.Cutter(model).chunks(" ".join(t or "" for t in texts).encode()))) + 5
    assert sum(len(r["ids"]) + len(r["places"]) for r in rows) < sum(len(library.encode(t or "")) for t in texts)
    got = {r["doc_id"]: r["ids"] for r in piece_lattice.encode(spark, frame(spark, list(enumerate(texts))), model, Scratch(spark, "t")).collect()}
    assert got == {i: library.encode(t or "") for i, t in enumerate(texts)}


def test_viterbi_fold_equals_plain_viterbi(spark):
    pieces = {p: (i, s) for i, (p, s) in enumerate([("a", -2.0), ("b", -2.5), ("ab", -3.0), ("abc", -3.2), ("c", -2.0), ("bc", -3.9), ("▁", -1.0), ("▁a", -2.2)])}
    model = piece_lattice.Model("unigram", pieces, [], 99, {}, True)
    chunks = ["▁abcab", "abcabc", "▁", "xax", "bcbca"]
    rows = piece_lattice.segment(spark, spark.createDataFrame([(c, 1) for c in chunks], "chunk string, n long"), model).collect()
    assert {r["chunk"]: r["ids"] for r in rows} == {c: piece_lattice.viterbi_chunk(c, model) for c in chunks}


# --- HTML ---


def test_main_text_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header>Top</header><nav><ul><li><a>Menu</a></ul></nav>
      <div class="cookie-notice">Accept</div><main><article class="post"><h1>Title &amp; more</h1><p>One <b>bold</b>  two<br>three <p>Four &#233; &lt;x&gt;
      <div class="ad">Buy</div><form><input value=x>Sign<button>Go</button></form><script>var t="</p>";</script><ul><li>item 1<li>item 2</ul>
      <aside>Related</aside><section id="comments"><p>First!</p></section></article></main><div id="sidebar">Side</div><footer>&copy;</footer>"""
    assert wrapper_inference.main_text(page) == "Title & more\nOne bold two three\nFour é <x>\nitem 1\nitem 2"
    assert wrapper_inference.main_text(None) == "" and wrapper_inference.main_text("a < b <!-- x") == "a < b"
    assert visible_text("<p>a<p>b<table><tr><td>c<td>d</table>") == "a\nb\nc\nd"


def test_wrappers_resolve_differences():
    w = None
    for n, (title, extra) in enumerate([("A", ""), ("B", "<div class=x>Sale</div>"), ("C", "")]):
        page = f"<html><body><div>Site name</div><ul>{'<li>x</li>' * (n + 2)}</ul>{extra}<h1>{title}</h1>{'<p>t</p>' * (n + 1)}<div>Imprint</div></body></html>"
        w, _ = wrapper_inference.infer(w, n, wrapper_inference.fold_repeats(wrapper_inference.stream(tokens(page))))
    kinds = [x if isinstance(x, str) else x[0] for x in w]
    assert "?" in kinds and "+" in kinds
    import xxhash

    fixed = {text for _, text in wrapper_inference.constants(w)}
    assert xxhash.xxh3_64_hexdigest("Site name") in fixed and xxhash.xxh3_64_hexdigest("Imprint") in fixed and xxhash.xxh3_64_hexdigest("A") not in fixed


def test_every_page_counts_in_a_large_wrapper():
    import random

    import xxhash

    def folded(middle):
        page = f"<html><body><div>Site name</div>{middle}<div>Imprint</div></body></html>"
        return wrapper_inference.fold_repeats(wrapper_inference.stream(tokens(page)))

    def varied(seed):
        r = random.Random(seed)
        return "".join(f"<{t}>Text {seed} {i}</{t}>" for i, t in enumerate(r.choices(("h2", "h3", "p", "pre", "div", "address"), k=300)))

    w, n = None, 0
    for seed in (1, 2, 3):
        w, n = wrapper_inference.infer(w, n, folded(varied(seed)))
    assert n == 3
    place = ("<html>", "<body>", "<div>")
    assert wrapper_inference.constants(w) == {(place, xxhash.xxh3_64_hexdigest(t)) for t in ("Site name", "Imprint")}


def extracted(spark, pages, host="h.example", partitions=None):
    df = spark.createDataFrame([(i, f"http://{host}/{i}", html) for i, html in enumerate(pages)], "page_id long, url string, html string")
    if partitions:
        df = df.repartition(partitions, "page_id")
    return [r["text"] for r in wrapper_inference.extract_main_text(spark, df).orderBy("page_id").collect()]


def test_the_wrapper_says_where_main_text_is(spark):
    """Text that varies over pages decides, not names of elements."""
    story = "<p>Story {0} begins here and goes on for a while</p><p>then it ends, {0}</p>"
    plain = f'<body><div class="site-header">Top {{0}}</div><div>{story}</div><article class="reply-1">I agree {{0}}</article><div><a>More {{0}}</a></div></body>'
    teaser = f"<body><main>{story}</main><article>Read also: {{0}}</article></body>"
    inside = f'<body><article><h1>Title {{0}}</h1><div>Pass it on</div>{story}<div class="public-notice">Notice {{0}} of the town</div><div class="social-links"><a>A {{0}}</a> <a>B {{0}}</a></div></article></body>'
    lines = "Story n{0} begins here and goes on for a while\nthen it ends, n{0}"
    for n in (1, 2, 5):
        for page in (plain, teaser):
            assert extracted(spark, [page.format(f"n{i}") for i in range(n)]) == [lines.format(i) for i in range(n)]
    # A line that stands at its place in every page is the template's, from three different pages on.
    share = ["", "Pass it on\n"]
    for n in (2, 5):
        got = extracted(spark, [inside.format(f"n{i}") for i in range(n)])
        assert got == [f"Title n{i}\n{share[n < 3]}{lines.format(i)}\nNotice n{i} of the town" for i in range(n)]


def test_long_pages_keep_their_text(spark):
    """Pages without a common template, of more items than a wrapper keeps."""
    import random

    def page(seed):
        r = random.Random(seed)
        tags = r.choices(("h2", "h3", "p", "pre", "address"), k=460)
        return "<body>" + "".join(f"<{t}>Text {seed} {i}</{t}>" for i, t in enumerate(tags)) + "</body>"

    got = extracted(spark, [page(i) for i in range(4)])
    assert [len(t.split("\n")) for t in got] == [460] * 4


def test_large_wrappers_keep_optional_groups(spark):
    """What only some pages have counts for the host's main text, and all its characters stay in the wrapper."""
    import random

    def page(seed):
        r = random.Random(seed)
        story = "".join(f"<{t}>Text {seed} {i}</{t}>" for i, t in enumerate(r.choices(("h2", "h3", "p", "pre", "address"), k=460)))
        return f"<body><div><p>Teaser {seed} {'and so on ' * 120}</p></div><section>{story}</section></body>"

    got = extracted(spark, [page(i) for i in range(10)])
    assert [(len(t.split("\n")), "Teaser" in t) for t in got] == [(460, False)] * 10
    w, chars = None, 0
    for n in range(10):
        items = wrapper_inference.fold_repeats(wrapper_inference.stream(tokens(page(n))))
        chars += sum(slot[2] for _, slot, _ in wrapper_inference._walk(items))
        w, _ = wrapper_inference.infer(w, n, items)
    assert sum(slot[2] for _, slot, _ in wrapper_inference._walk(w)) == chars


def test_alignment_is_the_longest_common_subsequence():
    """Steps against the plain table of lengths; sides of thousands take less than a table of millions."""
    import random

    r = random.Random(5)
    for case in range(300):
        a, b = ([r.randrange(1 + case % 7) for _ in range(r.randrange(30))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = aligned = 0
        for x, y in wrapper_inference._steps(a, b):
            assert not (x and y) or a[i] == b[j]
            i, j, aligned = i + x, j + y, aligned + (x and y)
        assert (i, j, aligned) == (len(a), len(b), best[0][0])


def test_wrappers_do_not_depend_on_partitions(spark):
    pages = [f"<body><div>Name</div><div>{'<p>a %d</p>' % i * (1 + i % 3)}</div>{'<h4>x</h4>' * (i % 2)}<div>End</div></body>" for i in range(40)]
    one = extracted(spark, pages, partitions=1)
    assert one == extracted(spark, pages, partitions=7) == extracted(spark, list(reversed(pages)), partitions=3)[::-1]
    assert one[4] == "a 4\na 4"


def test_pages_without_an_article_lose_template_texts(spark):
    html = "<html><body><div>Site name</div><div><p>Story {0} begins</p><p>and ends {0}</p></div><div>All rights</div></body></html>"
    rows = [(i, f"http://h.example/{i}", html.format(f"n{i}")) for i in range(4)] + [(9, None, None), (10, "http://other.example/", "<p>alone</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS wrapper", "3 AS text")
    got = {r["page_id"]: r["text"] for r in wrapper_inference.extract_main_text(spark, df).collect()}
    assert got == {**{i: f"Story n{i} begins\nand ends n{i}" for i in range(4)}, 9: "", 10: "alone"}
    assert wrapper_inference.extract_main_text(spark, df.limit(0)).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    html = "<html><body><div>Site name</div><h1>Title</h1><p>Alone</p></body></html>"
    df = spark.createDataFrame([(i, f"http://h.example/{i}", html) for i in range(5)], "page_id long, url string, html string")
    got = {r["text"] for r in wrapper_inference.extract_main_text(spark, df).collect()}
    assert got == {"Site name\nTitle\nAlone"}


def test_pages_of_the_test_data(spark):
    import html as H

    df = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in wrapper_inference.extract_main_text(spark, df).collect()}
    for r in df.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        blocks = (" ".join(H.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        text = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]] == (text, len(text))


# --- toxicity ---


def test_toxicity_on_held_out_rows(spark):
    insult = [f"vile{i}" for i in range(12)]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 9 == 0
        text = prose(i, 40) + (" " + " ".join(insult[(i // 9 + k) % 12] + ",." [k % 2] for k in range(2)) if bad else "")
        rows.append((i, text))
        if i % 2 or i % 18 == 0:
            labels.append((i, int(bad)))
    rows += [(5000, None), (5001, ""), (None, "vile1 vile2")]
    df, known = frame(spark, rows), spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in pu_toxicity.score_toxicity(spark, df, known).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    toxic = [got[i]["score"] for i in range(1500) if got[i]["held_out"] and i % 9 == 0]
    clean = [got[i]["score"] for i in range(1500) if got[i]["held_out"] and i % 9]
    assert np.mean([t > c for t in toxic for c in clean]) > 0.95
    nothing = pu_toxicity.score_toxicity(spark, df, known.limit(0)).collect()
    assert {r["score"] for r in nothing} == {0.0}
    assert pu_toxicity.score_toxicity(spark, df.limit(0), known).count() == 0


# --- packing ---


def piece_by_piece(counts, capacity):
    """Sequences of the same rule, one piece at a time: large pieces in pairs, the others into the tightest gap."""
    large = sorted((n for n, c in counts.items() for _ in range(c) if 3 * n > capacity), reverse=True)
    gaps = []
    while large:
        first = large.pop(0)
        partner = next((i for i, n in enumerate(large) if n <= capacity - first), None)
        gaps.append(capacity - first - (large.pop(partner) if partner is not None else 0))
    for n in sorted((n for n, c in counts.items() for _ in range(c) if 3 * n <= capacity), reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] -= n
    return len(gaps)


def test_plan_is_best_fit_and_gapless():
    import random

    r = random.Random(6)
    for capacity in (30, 100):
        for _ in range(20):
            counts = Counter(min(capacity, 1 + int(r.expovariate(1) * capacity / r.choice((2, 4, 9)))) for _ in range(400))
            placed: dict[int, list] = {}
            for length, first, many, sequence, offset in best_fit_packing.plan(dict(counts), capacity):
                for k in range(many):
                    placed.setdefault(sequence + k, []).append((offset, length, first + k))
            ranks = {n: sorted(k for b in placed.values() for _, m, k in b if m == n) for n in counts}
            assert all(ranks[n] == list(range(c)) for n, c in counts.items())
            for items in placed.values():
                at = 0
                for offset, length, _ in sorted(items):
                    assert offset == at
                    at += length
                assert at <= capacity
            assert len(placed) == piece_by_piece(counts, capacity)
            large = sum(c for n, c in counts.items() if 2 * n > capacity)
            assert len(placed) <= 1.1 * max(large, -(-sum(n * c for n, c in counts.items()) // capacity)) + 1


def test_other_tokenizers_encode_whole_texts(spark):
    """A tokenizer that keeps case and white space is not taken word by word."""
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    assert best_fit_packing.is_wordwise(tokenizers.path("word_bpe_49k.json"))
    path = tokenizers.path("byte_bpe_50k.json")
    assert not best_fit_packing.is_wordwise(path)
    rows = [(1, "Two  words,\n and MORE"), (2, None), (3, "")]
    got = best_fit_packing.pack_documents(spark, frame(spark, rows), path, with_ids=True).collect()
    library = Tokenizer.from_file(path)
    assert {r["doc_id"]: r["ids"] for r in got} == {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}


def test_packing_equals_the_tokenizer(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    odd = "İstanbul, <|endoftext|> x<|ENDOFTEXT|>y, it's, don't. a...b ,, é, \x1c\x85z ½, x_y, 'S 3,4. 한국어."
    rows = [*corpus(), (500, odd), (501, prose(9, 5000)), (502, "I'LL, we're. CAN'T!")]
    got = best_fit_packing.pack_documents(spark, frame(spark, rows), path, capacity=256, with_ids=True).collect()
    library = Tokenizer.from_file(path)
    want = Counter()
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 256)):
            part = ids[start : start + 256]
            want[(i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 256
    assert best_fit_packing.pack_documents(spark, frame(spark, []), path).count() == 0


# --- pipeline ---


def test_pipeline_of_an_empty_table(spark, tmp_path):
    """Every stage on no rows, written and read again; scratch tables of a stage go when the next begins."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert len({s.root for s in corpus_pipeline._scratches}) <= 1
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = frame(spark, [*corpus(), (901, "x y z v w " * 30)])
    columns = docs.columns
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    kept = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    good = {r["doc_id"] for r in quality_repetition.score_repetition(frame(spark)).where("kept").collect()}
    assert {100, 312} <= set(kept) <= good and 101 not in kept and 901 not in kept
    windows = Counter(tuple(words(t)[k : k + 50]) for t in kept.values() for k in range(len(words(t)) - 49))
    assert max(windows.values()) == 1
    lines = [line for t in kept.values() for line in t.split("\n") if line.strip()]
    assert len(lines) == len(set(lines))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} - {None} == set(kept)
