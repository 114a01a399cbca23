"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and over odd rows."""

import functools
import hashlib
import json
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import same
from pyspark.sql import functions as F

from driftline.llm import chat_format, decontaminate, html_style_tree, pu_quality, shared, simhash_anchor, sp_wfst, token_counts, token_index, topk_segments, url_filters
from driftline.llm.queries import QUERIES, SQL, tokenizer_path

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, start int, fp string, `key` int, term string, __keep int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows, clashing columns."""
    long = " ".join(f"word{i % 977} thing{i % 13}," for i in range(20_000))
    rows = [(1, "The cat sat on the mat and looked at the very old dog.", 1), (2, None, None), (3, "", 1), (4, long, 1), (5, "The cat sat on the mat and looked at the very old dog.", 1), (5, "The cat sat on the mat and looked at the very old dog.", 1), (5, "another text of the same id", 2), (None, "no id here", 1), (None, None, 1), (6, " \n\t ", 1), (7, "Été ﬁn ΣΑΣ 你好 <|endoftext|> it's a\x1cb ▁x", 1)]
    return spark.createDataFrame([(i, t, s, "x", s, "y", 0) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts(name="documents"):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, duck, name):
    same(QUERIES[name](spark, data), duck, SQL[name])


# --- token index ---


def test_perfect_hash_of_any_size():
    for n in [0, 1, 2, 3, 4, 5, 7, 11, 50, 333, 5000]:
        keys = random.Random(n).sample(range(-(10**12), 10**12), n)
        index = token_index.ShardIndex(token_index.pack_index(keys, np.arange(1, n + 1), False))
        first, run = index.find(keys)
        assert first.tolist() == list(range(n)) and (run == 1).all()
        if n > 50:
            absent = [k + 1 for k in keys if k + 1 not in set(keys)]
            assert (index.find(absent)[0] >= 0).mean() < 0.01


def test_word_encoder_equals_library():
    e = token_index.WordEncoder(Path(tokenizer_path("word_bpe_49k.json")).read_text(), limit=500)
    some = [t["text"] for t in texts()[:80]] + ["Don't we'll ΣαΣ İ a\x1cb é x² Ⅷ <|endoftext|> a|b", "", None, " ", "abc,def. X! O'Neil's.", "Ééa, é ﬁ ǅ", "_a_, b.. 12,3.4", "\xa0b c\x85d 你好,世界。"]
    ids, lens = e.encode_batch(pa.array(some))
    at = np.concatenate([[0], np.cumsum(lens)])
    for i, t in enumerate(some):
        assert ids[at[i] : at[i + 1]].tolist() == e.library.encode(t or "", add_special_tokens=False).ids


def test_token_store(spark, odd, empty):
    from tokenizers import Tokenizer

    out = shared.shared_path(spark, "t")
    shards = token_index.write_tokens(odd, out, tokenizer_path("word_bpe_49k.json"))
    got = sorted(token_index.read_tokens(spark, out, shards).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = odd.withColumn("salt", F.xxhash64("text")).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.salt, r.text or ""))
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    store = token_index.TokenStore(out)
    assert len(store.get(5)) == 3 and len(store.get(None)) == 2 and store.get(99) == []
    assert store.get(3)[0].tolist() == [1]
    # One id has most documents, which fill several shards; string ids.
    many = spark.createDataFrame([(f"k{i:03d}" if i < 40 else "hot", f"text {i} {j}") for i in range(41) for j in range(1 if i < 40 else 3000)], "doc_id string, text string")
    out = shared.shared_path(spark, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shards_of_many = token_index.write_tokens(many, out, tokenizer_path("word_bpe_49k.json"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum("hot" in (s["first_key"], s["last_key"]) for s in shards_of_many) > 1 and sum(s["n_docs"] for s in shards_of_many) == 3040
    store = token_index.TokenStore(out)
    assert len(store.get("hot")) == 3000 and len(store.get("k007")) == 1 and store.get("k0070") == [] and store.get(None) == []
    assert token_index.read_tokens(spark, out, shards_of_many, "string").agg(F.sum("n_tokens")).first()[0] == sum(s["n_ids"] for s in shards_of_many)
    shared.clear(spark)
    none = token_index.write_tokens(empty, shared.shared_path(spark, "t"), tokenizer_path("word_bpe_49k.json"))
    assert none == [] and token_index.read_tokens(spark, out, none).count() == 0


# --- html ---


def test_page_parsing():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>Menu</ul></nav><div class="ad-box">Buy</div>
    <article><h1>Head &amp; line</h1><p><b>One<br><p>two  <i>three</i><script>if(a<b)"</p>"</script> four<ul><li>x<li>y</ul><aside>side</aside><form>f<input></form>
    <div class="cookieNotice">c</div><div id="comments"><p>reader</p></div></article><p>outside</p><footer>f</footer>"""
    blocks = lambda html: html_style_tree.main_blocks(html_style_tree.parse(html))
    assert blocks(page) == ["Head & line", "One", "two three four", "x", "y"]
    assert blocks("<div class=with-sidebar><article><p>x</p></article></div>") == ["x"]
    assert blocks("") == [] and blocks("a < b <p") == ["a < b <p"]


@pytest.mark.parametrize("around", ["layout with-sidebar", "sidebar", "widget site"])
def test_names_lose_no_article(around):
    """Containers around an article, and sections and titles in one, stay whatever words their names hold."""
    got = lambda html: html_style_tree.main_blocks(html_style_tree.parse(html))
    assert got(f'<a href="#x">Skip</a><div class="{around}"><article><p>x</p></article></div><p>Copyright</p>') == ["x"]
    inner = '<div class="entry-header"><h1>Title</h1></div><p>a</p><h2 id="advertising">Advertising</h2><section id="discussion"><p>b</p></section>'
    assert got(f'<article>{inner}<div class="share-bar">Share</div></article>') == ["Title", "a", "Advertising", "b"]
    assert got('<div class="ad-box">Buy</div><div id="site-footer">f</div><div class="story">x</div>') == ["x"]


def test_style_tree_drops_what_repeats(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div class=x{i % 3}>Same promise on all pages</div><div class=story><p>Story {i} says {i * 7}</p></div></body>") for i in range(12)]
    rows += [(100, "http://one.example/", "<body><div class=x>Same promise on all pages</div></body>"), (101, None, None), (102, "http://h.example/z", "")]
    got = {r.page_id: r.text for r in html_style_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} says {i * 7}" for i in range(12))
    assert got[100] == "Same promise on all pages" and got[101] == got[102] == ""


def brute_importance(pages):
    """Composite importance and peak of every place by the recursive definition, from {host: [parsed pages]}."""
    import math

    out = {}
    for host, own in pages.items():
        once = list({"\n".join(b[1] for b in p.blocks): p for p in own}.values())
        held = {}
        for p in once:
            for path in p.looks:
                held.setdefault(path, []).append(p)
        entropy = lambda counts, m: -sum(n / m * math.log(n / m, m) for n in counts)

        @functools.cache
        def content(path):
            texts = Counter("\n".join(p.texts[path]) for p in held[path] if path in p.texts)  # noqa: B023
            m = len(held[path])  # noqa: B023
            return None if not texts else 1.0 if m == 1 else 1 - sum(math.log(n, m) for n in texts.values()) / len(texts)

        @functools.cache
        def composite(path):
            m = len(held[path])  # noqa: B023
            if m == 1:
                return 1.0
            looks = Counter("|".join(p.looks[path]) for p in held[path])  # noqa: B023
            inner = html_style_tree.GAMMA ** len(looks)
            below = 0.0
            for look, n in looks.items():
                kids = set(look.split("|")) - html_style_tree.VOID - {""}
                for k in kids:
                    below += n / m / len(kids) * ((content(path) or 0.0) if k == html_style_tree.TEXT else composite((*path, k)))
            return (1 - inner) * entropy(looks.values(), m) + inner * below  # noqa: B023

        for path in held:
            if path:
                branch = [x for x in held if x[: len(path)] == path]
                out[html_style_tree._hash(host), html_style_tree._Hashes().chain(path)[-1]] = (composite(path), max(max(composite(x), content(x) or 0.0) for x in branch))
    return out


def test_importance_equals_recursion(spark):
    rnd = random.Random(9)

    def tree(depth):
        if depth == 0 or rnd.random() < 0.2:
            return rnd.choice(["same", "menu one", f"unique {rnd.random()}", "", "<br>x"])
        return "".join(f"<{t}{c}>{tree(depth - 1)}</{t.split()[0]}>" for t, c in [(rnd.choice(["div", "ul", "section", "span"]), rnd.choice(["", " class=a", " id=b3"])) for _ in range(rnd.randint(1, 3))])

    rows = []
    for host in range(20):
        shapes = [tree(4) for _ in range(3)]
        rows += [(len(rows) + i, f"http://h{host}.example/", rnd.choice(shapes).replace("unique", f"unique {rnd.randrange(3)}")) for i in range(rnd.randint(1, 9))]
    got = {(r.site, r.path): (r.importance, r.peak) for r in html_style_tree.importance(html_style_tree.site_places(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    pages = {}
    for _, url, html in rows:
        pages.setdefault(html_style_tree.host_of(url), []).append(html_style_tree.parse(html))
    want = brute_importance(pages)
    assert got.keys() == want.keys() and len(want) > 100
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_tree_decides_without_class_names(spark, monkeypatch):
    """On a host with enough pages menus, adverts and footers go by the tree alone, also with no class name known."""
    rnd = random.Random(3)
    story = lambda: "".join(f"<p>{' '.join(rnd.choice('abcdefgh') * 3 + str(rnd.random()) for _ in range(9))}</p>" for _ in range(3))
    rows = [(i, "http://h.example/", f"<body><div class=menu>Menu {i % 3}</div><div class=ad>Buy {i % 5}</div><article><h1>T {i}</h1>{story()}<div class=box>Read our promise</div></article><div>Notice {i % 2}</div></body>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    named = {r.page_id: r for r in html_style_tree.main_text(df).collect()}
    assert all(r.n_noise == 4 and r.n_declared == 0 and r.n_blocks == 8 and r.text.startswith(f"T {i}\n") for i, r in named.items())
    monkeypatch.setattr(html_style_tree, "NO_CONTENT_WORD", set())
    assert {r.page_id: r.text for r in html_style_tree.main_text(df).collect()} == {i: r.text for i, r in named.items()}


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    rows = [(1, "http://h.example/", "<p>a</p>", 1), (1, "http://h.example/", "<p>b</p>", 2), (1, None, "<p>c</p>", 3), (1, "<p>c</p>", None, 4), (2, "http://h.example/", deep, 5), (3, "http://[", "<p>" + "word " * 400_000 + "</p>", 6), (None, "http://h.example/", "<p>d", 7), (1, "http://h.example/", "<p>a</p>", 1)]
    df = spark.createDataFrame([(*r, "z", "z", "z") for r in rows], "page_id long, url string, html string, row int, host string, blocks string, article string")
    got = sorted(((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in html_style_tree.main_text(df).collect()), key=str)
    want = [(1, "http://h.example/", "a", 1), (1, "http://h.example/", "a", 1), (1, "http://h.example/", "b", 1), (1, "", "c", 1), (1, "<p>c</p>", "", 0), (2, "http://h.example/", "core", 4), (3, "http://[", ("word " * 400_000).strip(), 1_999_999), (0, "http://h.example/", "d", 1)]
    assert got == sorted(want, key=str)


def test_copies_of_an_article_stay(spark):
    rows = [(i, "http://h.example/a", "<body><article><h1>T</h1><p>The same text.</p></article></body>") for i in range(8)]
    got = html_style_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"T\nThe same text."} and len(got) == 8
    assert html_style_tree.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_query(spark, data):
    from html import unescape

    want = {}
    for r in texts("pages"):
        a = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub("<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:p|h\d)\b[^>]*>", a)]
        want[r["page_id"]] = "\n".join(p for p in parts if p)
    got = QUERIES["op2_html_style_tree"](spark, data).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


# --- sentencepiece ---


def test_transducer_equals_library():
    import sentencepiece

    blob = Path(tokenizer_path("piece_bpe_32k.model")).read_bytes()
    machine, library = sp_wfst.Transducer(blob, chunks=300), sentencepiece.SentencePieceProcessor(model_proto=blob)
    rnd = random.Random(3)
    pieces = list(machine.ids)
    some = [t["text"] for t in texts()[:40]] + [" ▁ a", "▁", "a▁▁ b", "", " ", "  a", "a  b ", "\tx\n\ny", "é你好😀 ﬁ", "<s> a</s>", "▁x", "a\x1eb"]
    some += ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 6))).replace("▁", " ") for _ in range(1500)]
    ids, lens = machine.encode_batch(pa.array(some))
    at = np.concatenate([[0], np.cumsum(lens)])
    for i, t in enumerate(some):
        own = ids[at[i] : at[i + 1]]
        assert own.tolist() == library.encode(t) and machine.decode(own) == library.decode(own.tolist())


def _hand_made(kind, pieces, byte_fallback):
    """A model file with the given pieces and scores."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = kind, byte_fallback
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, False, True
    for name, of in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=name, score=0.0, type=of)
    for b in range(256 if byte_fallback else 0):
        m.pieces.add(piece=f"<0x{b:02X}>", score=0.0, type=6)
    for piece, score in pieces.items():
        m.pieces.add(piece=piece, score=score, type=1)
    return m.SerializeToString()


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_weights_order_paths(byte_fallback):
    """In unigram models several paths are open and the lightest is the library's segmentation."""
    import sentencepiece

    rnd = random.Random(4)
    for _ in range(6):
        pieces = {c: -rnd.uniform(3, 9) for c in "abc▁"}
        pieces |= {"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 4))): -rnd.uniform(2, 14) for _ in range(12)}
        pieces |= {"▁" + "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 3))): -rnd.uniform(2, 14) for _ in range(8)}
        blob = _hand_made(1, pieces, byte_fallback)
        machine, library = sp_wfst.Transducer(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
        same = 0
        for _ in range(200):
            text = " ".join("".join(rnd.choice("abcabcabcé") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(1, 4)))
            own, want = machine.encode(text).tolist(), library.encode(text)
            weigh = lambda ids: sum(-machine.weights[i] for i in ids)  # noqa: E731, B023
            assert own == want or (weigh(own) == pytest.approx(weigh(want), abs=1e-4) and len(own) == len(want)), "another path of the same weight at most"
            same += own == want
        assert same > 180


def test_acceptor_leaves_one_path():
    """Among all ways to cut a chunk into BPE pieces the pair acceptor lets one through, which is what merging gives."""
    machine = sp_wfst.Transducer(Path(tokenizer_path("piece_bpe_32k.model")).read_bytes())

    def paths(chunk, at=0, prev=-1):
        if at == len(chunk):
            return [[]]
        return [[i, *rest] for end in range(at + 1, len(chunk) + 1) if (i := machine.ids.get(chunk[at:end])) is not None and machine.passes(prev, i) for rest in paths(chunk, end, i)]

    rnd = random.Random(6)
    words = {w for t in texts()[:60] for w in (t["text"] or "").split() if len(w) < 12 and all(c in machine.ids for c in w)}
    for w in rnd.sample(sorted(words), 300):
        found = paths("▁" + w)
        assert found == [[machine.ids[s] for s in machine.merged(list("▁" + w))]] and machine.path(" " + w) == found[0]


def test_encode_decode_rows(spark, odd, empty):
    out = sp_wfst.encode_decode(odd, tokenizer_path("piece_bpe_32k.model"))
    rows = out.collect()
    assert len(rows) == odd.count() and set(odd.columns) < set(out.columns)
    assert all(r.sp_round_trip == ("▁" not in (r.text or "")) for r in rows)
    assert sp_wfst.digests(sp_wfst.encode_decode(empty, tokenizer_path("piece_bpe_32k.model"))).count() == 0


# --- token counts ---


def test_longest_match_equals_greedy():
    rnd = random.Random(5)
    for _ in range(30):
        bits = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(12)]
        initial, rest = set(bits[:7]), set(bits[4:])
        machine = token_counts.LongestMatch(initial, rest)
        for _ in range(200):
            word = "".join(rnd.choice("abcd"[: 3 + (rnd.random() < 0.1)]) for _ in range(rnd.randint(0, 12)))
            n, at = 0, 0
            while at < len(word):
                end = next((e for e in range(len(word), at, -1) if word[at:e] in (rest if at else initial)), None)
                if end is None:
                    n = -1
                    break
                n, at = n + 1, end
            assert machine.count(word) == n


def test_counts_equal_greedy_over_bytes(spark, odd, empty):
    path = tokenizer_path("byte_bpe_50k.json")
    initial, rest = token_counts.pieces_of_byte_bpe(Path(path).read_text())
    assert all(chr(b) in rest for b in range(256) if b != 32) and " " in initial
    longest = max(map(len, initial | rest))

    @functools.cache
    def greedy(word):
        data, at, n = " " + word.encode().decode("latin-1"), 0, 0
        while at < len(data):
            at = next(e for e in range(min(len(data), at + longest), at, -1) if data[at:e] in (rest if at else initial))
            n += 1
        return n

    for rows in (odd, spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")):
        got = token_counts.token_counts(rows, path).collect()
        want = [(r.doc_id, len(w := (r.text or "").split()), sum(map(greedy, w)), 0) for r in rows.collect()]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert token_counts.token_counts(empty, path).count() == 0


# --- quality ---


def test_quality_on_held_out(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op5_pu_quality"](spark, sf).toPandas().set_index("doc_id")
    labels = pq.read_table(f"{sf}/labels.parquet").to_pandas().set_index("doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]).all()
    both = labels.join(got, how="inner")
    held = both[both.held_out]
    assert ((held.predicted == 1) == (held.quality == 1)).mean() > 0.93
    assert (held[held.quality == 1].predicted == 1).mean() > 0.97
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    lab = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (99, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    assert pu_quality.scores(odd, lab).count() == odd.count()
    none = pu_quality.scores(odd, lab.where("false"))
    assert {r.score for r in none.collect()} == {0.5}
    assert pu_quality.scores(empty, lab).count() == 0 and pu_quality.good_rows(empty, lab).count() == 0


def test_prior_estimate():
    rnd = np.random.default_rng(0)
    p = rnd.normal(2, 1, 4000)
    u = np.concatenate([rnd.normal(2, 1, 2400), rnd.normal(-2, 1, 1600)])
    cuts = np.quantile(p, np.linspace(0, 0.99, 100))
    above = lambda s: np.array([(s >= c).mean() for c in cuts])
    assert pu_quality.prior_of(above(p), above(u), 4000, 4000) == pytest.approx(0.6, abs=0.08)


def test_risk_and_gradient_by_definition(spark):
    """Risk and gradient against direct sums and differences, also from a distributed pass; the descent ends at a minimum."""
    rnd = np.random.default_rng(1)
    x = np.abs(rnd.normal(size=(400, len(pu_quality.NAMES)))).astype(np.float32)
    x[:200, 0] += 1
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, features array<float>").repartition(7)
    edges = pu_quality.quantile_edges(table)
    for f in range(len(pu_quality.NAMES)):
        grid = ((x[:, f].view(np.uint32) >> 16) << 16).view(np.float32)
        assert np.allclose(edges[f], np.quantile(grid, np.linspace(0, 1, pu_quality.BINS + 1)[1:-1], method="inverted_cdf"))
    size = len(pu_quality.NAMES) * pu_quality.BINS + 1
    positive, rows = pu_quality.Rows.of(edges, x[:80], np.arange(1.0, 81)), pu_quality.Rows.of(edges, x, np.ones(400))
    w = rnd.normal(size=size) * 0.1

    def direct(w, prior):
        logit = lambda r: sum(w[f * pu_quality.BINS + int((edges[f] <= r[f]).sum())] for f in range(len(pu_quality.NAMES))) + w[-1]
        zp, zu = np.array([logit(r) for r in x[:80]]), np.array([logit(r) for r in x])
        share = np.arange(1, 81) / np.arange(1, 81).sum()
        negatives = np.log1p(np.exp(zu)).mean() - prior * share @ np.log1p(np.exp(zp))
        return prior * share @ np.log1p(np.exp(-zp)) + max(0, negatives), negatives

    for prior in (0.3, 0.97):
        value, negatives, grad = pu_quality.risk(w, positive, prior, rows.negative(w))
        assert (value, negatives) == pytest.approx(direct(w, prior))
        if negatives > 0:
            for at in (0, 30, size - 1):
                move = np.zeros(size)
                move[at] = 1e-5
                assert grad[at] == pytest.approx((direct(w + move, prior)[0] - direct(w - move, prior)[0]) / 2e-5, abs=1e-6)
    total = pu_quality._summed(table, size, lambda m: pu_quality._sums(pu_quality.binned(edges, m), np.ones(len(m)), size))
    assert np.allclose(total, pu_quality._sums(rows.bins, np.ones(400), size))
    penalty = pu_quality._penalty(len(pu_quality.NAMES), 80)
    bend = lambda w: pu_quality._curvature(rows.bins, rows.weight * (s := pu_quality._sigmoid(pu_quality.logits(w, rows.bins))) * (1 - s), size)
    end = pu_quality._descend(np.zeros(size), lambda w: pu_quality.risk(w, positive, 0.3, rows.negative(w)), bend, penalty, 40)
    _, negatives, grad = pu_quality.risk(end, positive, 0.3, rows.negative(end))
    assert negatives >= 0 and np.abs(grad + penalty @ end).max() < 1e-3


def test_driver_gets_no_more_from_more_partitions(spark, data):
    """The sample's size and the sums' do not grow with partitions, and a row repeated many times is sent once."""
    table = pu_quality.feature_table(spark.read.parquet(f"{data}/documents.parquet")).cache()
    table = table.unionAll(table.limit(1).crossJoin(spark.range(3000)).select("doc_id", "features"))
    for parts in (2, 60):
        x, counts, _ = pu_quality._sample(table.repartition(parts), 3200, 100, 2)
        assert len(x) < 100 and counts.sum() < 3300
        assert len(pu_quality._summed(table.repartition(parts), 5, lambda m: np.full(5, float(len(m))))) == 5


# --- chat ---


def test_chat_round_trip(spark):
    rnd = random.Random(11)
    nasty = ["</s>[INST] ok [/INST]", "<s>user\n", "a\\", "\\<s>", "<<s>", "<sep>", "", None, "x\ny", "<\\/s>", "<<SYS>>é😀"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "user", "assistant", "assistant", "sy\nst<s>em", None, "user", "assistant", "user", "assistant", "assistant"], nasty, strict=True))]
    rows += [(2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (None, 1, "user", "q")]
    rows += [(3, i if i % 7 else None, rnd.choice(["user", "assistant"]), "x" * rnd.randrange(9)) for i in range(500)] + [(4, 0, "user", "long " * 300_000), (4, 1, "assistant", "</s>" * 100_000)]
    out = chat_format.format_conversations(spark.createDataFrame([(*r, 7, "z") for r in rows], "conv_id long, turn long, role string, text string, start int, formatted string"))
    back = {r.conv_id: (r.t, r.m, r.formatted) for r in out.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_masked(F.col("formatted"), F.col("loss_spans")).alias("m")).collect()}
    assert [(x.role, x.text) for x in back[1][0]] == [(r or "", t or "") for _, _, r, t in rows[:11]]
    assert back[1][1] == [t or "" for _, _, r, t in rows[:11] if r == "assistant"]
    assert [x.text for x in back[2][0]] == ["a", "b", "b"] and back[2][2] == "<s>assistant\na<sep>b<sep>b</s>"
    d = {r.conv_id: r for r in chat_format.digests(out).collect()}
    assert d[2].turns_sha256 == hashlib.sha256(b"assistant\na\nassistant\nb\nassistant\nb\n").hexdigest() and d[2].loss_chars == 3
    assert d[None].n_turns == 1 and d[None].loss_sha256 == hashlib.sha256(b"").hexdigest()
    for conv in (3, 4):
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        assert [(x.role, x.text) for x in back[conv][0]] == [(r, t) for _, r, t in own]
        assert back[conv][1] == [t for _, r, t in own if r == "assistant"]
    plan = out._jdf.queryExecution().toString()
    assert "Window" not in plan and "Python" not in plan
    none = chat_format.digests(chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))
    assert none.count() == 0


# --- decontamination ---


def brute_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        b = words(t)
        n = min(window, len(b))
        for s in range(len(b) - n + 1 if n else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == b[s : s + n]:
                    hit |= set(range(at, at + n))
                    found.add(i)
    return len(w), len(hit), found


def brute_near(docs, items, slop=5, probe=3):
    """Items of which the rarest words stand near their places, by document."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    cf = Counter(w for _, t in docs for w in words(t))
    out = []
    for _, t in docs:
        w, n = words(t), 0
        for _, b in set(items):
            rare = sorted(((cf[x], off, x) for off, x in enumerate(words(b))))[:probe]
            if rare and rare[0][0]:
                starts = [i - rare[0][1] for i, x in enumerate(w) if x == rare[0][2]]
                n += any(all(x in w[max(0, s + off - slop) : max(0, s + off + slop + 1)] for _, off, x in rare) for s in starts)
        out.append(n)
    return out


def test_contamination_brute_force(spark, odd, empty):
    rnd = random.Random(2)
    vocab = ["a", "B", "c", "É", "é", "d9"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 14)))) for i in range(25)] + [(77, None), (78, "ZZ unknown"), (None, "c c c c c c c c c c"), (79, "a \ue000 c")]
    docs = [(i, "; ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60)))) for i in range(60)] + [(100, None), (101, items[3][1]), (101, items[5][1]), (103, "b a \ue000 c \ue000"), (104, "\ue000"), (102, " x ".join(t for _, t in items if t))]
    docs_df, items_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs_df, items_df).collect()
    want = []
    for (i, t), near in zip(docs, brute_near(docs, items), strict=True):
        n, hit, found = brute_hits(t, items)
        ids = sorted(str(x) for x in found if x is not None)
        want.append((i, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0, near))
    assert sorted(map(tuple, got)) == sorted(want)
    assert decontaminate.contamination(odd, items_df).count() == odd.count()
    assert decontaminate.contamination(empty, items_df).count() == 0
    assert decontaminate.contamination(odd, items_df.where("false")).where("contaminated").count() == 0
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs_df, items_df).collect()) == sorted(w[0] for w in want if w[0] not in {x[0] for x in want if x[5]})


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red old fox jumps"), (2, "red fox old jumps"), (3, "fox red far away old jumps"), (4, "red old")], "doc_id long, text string")
    phrase = decontaminate.item_words(spark.createDataFrame([(9, "red old fox")], "item_id long, text string"))
    index = decontaminate.build_index(docs, phrase)
    phrase = decontaminate._with_frequencies(phrase, index)
    near = lambda k: sorted({r.doc_id for r in decontaminate.proximity_matches(index, phrase, k).collect()})
    assert near(0) == [1] and near(2) == [1, 2] and near(6) == [1, 2, 3]


def test_a_phrase_repeated_in_one_document(spark):
    phrase = "the quick brown fox jumps over a very lazy dog today"
    docs = [(1, " ".join([phrase] * 10_000)), (2, phrase), (3, "quick " * 5000 + phrase[:30])] + [(4, phrase + " x " + phrase)] * 300
    items = [("a", phrase), ("b", "quick quick"), ("c", " ".join([phrase] * 3))]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()
    by = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.n_near) for r in got}
    assert len(got) == len(docs) and {i: x[:3] for i, x in by.items()} == {1: (110_000, 110_000, 2), 2: (11, 11, 2), 3: (5006, 5000, 1), 4: (23, 22, 2)}
    assert [by[i][3] for i in (1, 2, 3, 4)] == brute_near(docs, items)[:4]


# --- url filters ---


def test_intervals_and_asof(spark):
    e = [("l", "Bad.example", "add", "2024-01-10"), ("l", "bad.example", "remove", "2024-02-01"), ("l", "bad.example", "add", "2024-02-01"), ("l", "bad.example", "add", "2024-03-01"), ("m", "x.org", "add", "2024-01-01"), ("m", "x.org", "add", "2024-01-05"), (None, None, "add", "2024-01-01"), ("l", "y.org", "add", None)]
    entries = spark.createDataFrame(e, "list_name string, value string, action string, day string").withColumn("day", F.col("day").cast("date"))
    c = [(1, "http://a.bad.example/x", "2024-01-09"), (2, "http://a.bad.example/x", "2024-01-10"), (3, "http://bad.example:80", "2024-02-01"), (4, "https://u@bad.example./", "2024-03-02"), (5, "http://notbad.example", "2024-01-15"), (6, "http://X.ORG/?q=http://bad.example", "2024-05-05"), (7, None, "2024-05-05"), (8, "mailto:x", "2024-05-05"), (9, "http://x.org", None), (6, "http://X.ORG/?q=http://bad.example", "2024-05-05")]
    captures = spark.createDataFrame([(*r, "z") for r in c], "page_id int, url string, fetched string, value string").withColumn("fetched", F.col("fetched").cast("date"))
    got = sorted((r.page_id, r.lists) for r in url_filters.evaluate(captures, entries).collect())
    assert got == [(1, ""), (2, "l"), (3, ""), (4, "l"), (5, ""), (6, "m"), (6, "m"), (7, ""), (8, ""), (9, "")]
    paths = spark.createDataFrame([("p", "X.org/Ads/", "add", "2024-01-01"), ("p", "x.org/Ads", "remove", "2024-03-01"), ("q", "[::1]", "add", "2020-01-01"), ("q", "x.org/a/b", "add", "2024-02-20")], "list_name string, value string, action string, day string").withColumn("day", F.col("day").cast("date"))
    c = [(1, "http://x.org/Ads", "2024-02-29"), (2, "http://x.org/Ads/1?x", "2024-01-01"), (3, "http://x.org/Ads", "2024-03-01"), (4, "http://x.org/Adsense", "2024-02-01"), (5, "http://a.x.org/Ads", "2024-02-01"), (6, "http://[::1]:80/x", "2025-07-01"), (7, "http://x.org//a/b/c#d", "2024-03-01"), (8, "http://x.org/a", "2024-03-01"), (9, "http://x.org/" + "a/" * 50_000, "2024-03-01"), (10, "http://" + "a." * 300 + "x.org/Ads/", "2024-02-01"), (11, "http://x.org/Ads", "2023-12-31")]
    got = sorted((r.page_id, r.lists) for r in url_filters.evaluate(spark.createDataFrame(c, "page_id int, url string, fetched string").withColumn("fetched", F.col("fetched").cast("date")), paths).collect())
    assert got == [(1, "p"), (2, "p"), (3, ""), (4, ""), (5, ""), (6, "q"), (7, "q"), (8, ""), (9, ""), (10, ""), (11, "")]
    assert url_filters.evaluate(captures, entries.where("false")).where("blocked").count() == 0
    assert url_filters.evaluate(captures.where("false"), entries).count() == 0


# --- near duplicates ---


def brute_components(prints, threshold=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold and find(i) != find(j):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_fingerprint_by_definition():
    import xxhash

    for text in [t["text"] for t in texts()[:15]] + ["", None, "one", "a b c", "A b\xa0C d  e\ff", "x x x x x x x x"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash_anchor.simhash(text) == want


def test_anchors_cover():
    rnd = np.random.default_rng(1)
    for _, bits in simhash_anchor.BLOCKS:
        v = rnd.integers(0, 1 << bits, 2000).astype(np.uint32)
        home = simhash_anchor.homes(v)
        assert (np.bitwise_count(home ^ v) <= 1).all()
        near = v ^ (np.uint32(1) << rnd.integers(0, bits, 2000).astype(np.uint32))
        to = simhash_anchor.anchors(v, bits)
        assert (to == simhash_anchor.homes(near)[:, None]).any(axis=1).all()
        assert (np.bitwise_count(to ^ v[:, None]) <= 2).all()


@pytest.mark.parametrize("chunk", [8192, 16])
def test_links_equal_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash_anchor, "CHUNK", chunk)
    monkeypatch.setattr(simhash_anchor, "FEEDERS", 256 if chunk > 1000 else 4)
    rnd = random.Random(4)
    seeds = [rnd.getrandbits(64) for _ in range(60)]
    prints = {*seeds, 0, 1, (1 << 64) - 1}
    for s in seeds[:25]:
        for _ in range(8):
            x = s
            for _ in range(rnd.randint(1, 6)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
            s = rnd.choice([s, x])
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    roots = {r.node: r.root for r in simhash_anchor.components(simhash_anchor.links(spark.createDataFrame([(s,) for s in signed], "fp long"))).collect()}
    want = brute_components(prints)
    groups = {}
    for s, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_near_duplicates_rows(spark, odd, empty, data):
    got = simhash_anchor.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.fingerprint, set()).add(r.component_id)
    assert all(len(c) == 1 for c in by.values())
    assert {r.component_id for r in got if r.doc_id in (2, 3, 6)} == {2}
    kept = simhash_anchor.one_of_each(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 4}
    assert simhash_anchor.near_duplicates(empty).count() == 0 and simhash_anchor.one_of_each(empty).count() == 0
    full = QUERIES["op9_simhash_anchors"](spark, data).collect()
    want = brute_components([int(r.fingerprint, 16) for r in full])
    least = {}
    for r, w in zip(full, want, strict=True):
        least[w] = min(least.get(w, r.doc_id), r.doc_id)
    assert all(r.component_id == least[w] for r, w in zip(full, want, strict=True))


# --- top k ---


@pytest.mark.parametrize("first", [10, 50, 2048])
def test_topk_equals_brute_force(spark, first):
    rnd = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in v], 0) for i, v in enumerate(rnd.normal(0, 1, (300, 16)).astype(np.float32))]
    rows += [(400 + i, rows[7][1], 1) for i in range(30)]
    bad = [(1000, None, 0), (1020, [1.0] * 15 + [None], 0), (1040, [float("nan")] * 16, 0), (1060, [float("inf")] * 16, 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score int")
    got = topk_segments.top_k(df, query_block=7, candidate_block=50, first=first).collect()
    x = np.floor(np.array([r[1] for r in rows]).astype(np.float32).astype(float) * 64).astype(int)
    ids = np.array([r[0] for r in rows])
    want = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:20]
        want += [(int(ids[q]), k + 1, int(ids[j]), int(s[j])) for k, j in enumerate(order)]
    assert sorted(map(tuple, got)) == sorted(want)
    few = topk_segments.top_k(df.where("vec_id IN (0, 1, 2)")).collect()
    assert len(few) == 2
    assert topk_segments.top_k(df.where("false")).count() == 0
    big = spark.createDataFrame([(0, [1e8] * 4), (1, [1e8] * 4), (2, [-1e8] * 4)], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in sorted(topk_segments.top_k(big).collect(), key=lambda r: r.rank)] == [(1, 2**63 - 1), (2, -(2**63))]


def test_bounds_hold():
    rnd = np.random.default_rng(0)
    a, b = rnd.normal(0, 5, (50, 64)), rnd.normal(1, 3, (60, 64))
    for s in topk_segments.RESOLUTIONS:
        assert (topk_segments.segment_stats(a, s) @ topk_segments.segment_stats(b, s).T >= a @ b.T - 1e-9).all()


def brute_top_k(rows, k=20, every=20):
    out = []
    for n, (q, v) in enumerate(rows):
        if q % every == 0:
            scored = sorted((-sum(int(a) * int(b) for a, b in zip(np.floor(np.array(v) * 64), np.floor(np.array(x) * 64), strict=True)), i) for m, (i, x) in enumerate(rows) if m != n and len(x) == len(v))
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_of_odd_tables(spark):
    """Every row twice, ties across blocks, ids that repeat with other vectors, vectors of several lengths."""
    rnd = np.random.default_rng(8)
    twice = [(i, rnd.normal(size=8).tolist()) for i in range(60)] * 2
    ties = [(i, rnd.choice([1.0, -1.0], 3).tolist()) for i in range(200)]
    same_id = [(20, [1.0, 0.0]), (20, [2.0, 0.0]), (1, [0.5, 0.0])] + [(40, rnd.normal(size=2).tolist()) for _ in range(50)]
    lengths = [(i, rnd.normal(size=1 + i % 3).tolist()) for i in range(90)] + [(100, [3.0] * 5), (101, [])]
    for rows in (twice, ties, same_id, lengths):
        for first in (4, 2048):
            got = topk_segments.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query_block=2, candidate_block=16, first=first).collect()
            assert sorted(map(tuple, got)) == brute_top_k(rows)


def test_few_rows_come_back(spark):
    """A query gets about GROWTH * k rows from a part of the candidates, not k from every block."""
    rnd = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, rnd.normal(size=8).tolist()) for i in range(3000)], "vec_id long, embedding array<double>")
    q = topk_segments._blocks(pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([[1] * 8], type=pa.list_(pa.int64())), pa.array([5]), pa.array([9])], names=list("abcde")), True)[0]
    c = topk_segments._blocks(pa.RecordBatch.from_arrays([pa.array(range(1, 40)), pa.array(range(1, 40)), pa.array([[i % 2] + [0] * 7 for i in range(1, 40)], type=pa.list_(pa.int64()))], names=list("abc")), False)[0]
    assert len(topk_segments.search_block(q, c, 20)[0]) == 0
    assert topk_segments.top_k(rows, first=100, candidate_block=64).count() == 150 * 20


# --- pipeline ---


def test_pipeline(spark, data):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = {r["doc_id"]: r["text"] for r in texts()}
    items = [(r["item_id"], r["text"]) for r in texts("benchmark")]
    got = pipeline.run(spark, data).collect()
    assert 0 < len(got) < len(docs)
    ids = [r.doc_id for r in got]
    assert len(set(ids)) == len(ids) and all(r.text == docs[r.doc_id] and r.round_trip and len(r.ids) == r.n_tokens for r in got)
    assert not any(brute_hits(r.text, items)[1] for r in got)
    comp = brute_components([simhash_anchor.simhash(docs[i]) for i in ids])
    assert len(set(comp)) == len(ids)
    first = pipeline.STAGES[0][1](spark, spark.read.parquet(f"{data}/documents.parquet"), data)
    assert first.columns == spark.read.parquet(f"{data}/documents.parquet").columns
    json.dumps([n for n, _ in pipeline.STAGES])


def test_pipeline_of_odd_tables(spark, odd, empty, tmp_path):
    """Nulls, ties, repeated rows, clashing columns and empty tables go through all stages."""
    pipeline = pytest.importorskip("corpus_pipeline")
    more = odd.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_tokens": F.lit(3), "ids": F.lit("x"), "sp_ids": F.lit(1)})
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([("a", "thing that is in no document"), ("b", None), (None, "another text of the same id")], "item_id string, text string")
    for name, docs, lab, bench in (("odd", more, labels, items), ("none", more.where("false"), labels.where("false"), items.where("false")), ("unlabelled", more, labels.where("false"), items.where("false"))):
        for table, df in (("documents", docs), ("labels", lab), ("benchmark", bench)):
            df.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        got = pipeline.run(spark, f"file://{tmp_path}/{name}").collect()
        ids = [r.doc_id for r in got]
        assert len(ids) == len(set(ids)) and all(r.round_trip or "▁" in (r.text or "▁") or r.doc_id == 7 for r in got)
        assert (name == "none") == (not got) and (name != "odd" or 5 not in ids)
        for _, stage in pipeline.STAGES[:-1]:
            assert stage(spark, docs, f"file://{tmp_path}/{name}").columns == docs.columns


def brute_sets(all_texts):
    out = []
    for t in all_texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def test_dense_groups_keep_the_closest_links(spark):
    """Copies of one text that are near it but hardly each other: trees link each to it, with few pairs to compare."""
    from driftline.llm import near_copies as N

    rnd = random.Random(7)
    base = [f"w{rnd.randrange(5000)}" for _ in range(400)]
    rows = [base] + [[f"n{rnd.random()}" if rnd.random() < 0.022 else x for x in base] for _ in range(250)]
    sets = brute_sets([" ".join(r) for r in rows])
    alike = lambda a, b: len(a & b) / len(a | b) >= 0.8
    near = [i for i in range(1, len(sets)) if alike(sets[0], sets[i])]
    fp = np.stack([N.fingerprint(N.shingles([x.encode() for x in r])) for r in rows])
    x, y, bits = N.spanning_pairs(np.arange(len(rows)), fp)
    assert len(x) < len(rows) and all(b == np.bitwise_count(fp[i] ^ fp[j]).sum() for i, j, b in zip(x, y, bits, strict=True))
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    kept = {r.doc_id for r in N.one_of_each(docs).collect()}
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert 100 < len(near) and sum(i not in kept for i in near) >= 0.95 * len(near)
    assert {i for i in range(len(rows)) if find(i) == i} <= kept
    few = N._dealt(spark.createDataFrame([(i, [int(v) for v in f.view(np.int64)]) for i, f in enumerate(fp)], "node long, fp array<long>"))
    assert few.count() == 64 * len(rows)


def test_pipeline_links_near_copies(spark, empty, odd, monkeypatch):
    """Planted copies of Jaccard 0.8 and more in pairs and in a group that makes anchors large; nothing below is linked."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(5)
    plant = lambda w, n: [f"n{rnd.random()}" if i in n else x for i, x in enumerate(w)]
    rows = []
    for _ in range(300):
        w = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(60, 300))]
        rows += [w, plant(w, {rnd.randrange(len(w)) for _ in range(rnd.randint(1, max(1, len(w) // 30)))})]
    hot = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    rows += [plant(hot, {rnd.randrange(200)}) for _ in range(150)]
    sets = brute_sets([" ".join(r) for r in rows])
    near = [len(a & b) / len(a | b) >= 0.8 for a, b in zip(sets[:600:2], sets[1:600:2], strict=True)]
    assert 100 < sum(near) < 250
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    for chunk in (8192, 40):
        monkeypatch.setattr("driftline.llm.near_copies.CHUNK", chunk)
        kept = {r.doc_id for r in pipeline.near_duplicates(spark, docs, "").collect()}
        caught = [2 * i + 1 not in kept for i in range(300)]
        assert not any(c and not n for c, n in zip(caught, near, strict=True))
        assert sum(caught) >= 0.98 * sum(near)
        assert {i for i in kept if i >= 600} == {600}
    assert pipeline.near_duplicates(spark, empty, "").count() == 0
    ids = [r.doc_id for r in pipeline.near_duplicates(spark, odd, "").collect()]
    assert sorted(ids, key=str) == sorted([1, 2, 4, 5, 7, None], key=str)


def test_near_copies_meet_at_covering_anchors(spark):
    """A node is sent to the homes of all values within one bit of its own, so whoever differs in a bit of a block meets there."""
    from driftline.llm import near_copies as N
    from driftline.llm.simhash_anchor import homes

    value = np.arange(1 << 15, dtype=np.uint32)
    sent = N._ANCHORS[value]
    assert (sent[:, 0] == homes(value)).all() and (homes(sent.astype(np.uint32)) == sent).all() and (np.diff(np.sort(sent, axis=1)) > 0).all()
    for bit in range(15):
        assert (sent == homes(value ^ np.uint32(1 << bit))[:, None]).any(axis=1).all()
    rnd = np.random.default_rng(1)
    for more in range(N.LONGER + 1):
        bits = 15 + more
        fp = rnd.integers(0, 1 << 63, (40, N.PRINTS))
        other = rnd.integers(0, 1 << 63, (40, N.PRINTS))
        block = rnd.integers(0, N.BLOCKS[more], 40)
        at, low = block // (64 // bits), block % (64 // bits) * bits
        for i in range(40):  # equal in one block but for one bit of the code's
            mask = ((1 << bits) - 1) << int(low[i])
            v = int(other[i, at[i]]) & ~mask | int(fp[i, at[i]]) & mask ^ (1 << int(low[i] + rnd.integers(15)))
            other[i, at[i]] = v - (1 << 64) if v >> 63 else v
        rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.concatenate([fp, other]))], "node long, fp array<long>")
        dealt = N._dealt(rows, more).toPandas()
        assert len(dealt) == 80 * N.BLOCKS[more] * N.SENT
        sent = {n: set(g.key) for n, g in dealt.groupby("node")}
        home = {n: set(g.key) for n, g in dealt[dealt.home].groupby("node")}
        assert all(home[i] & sent[40 + i] and sent[i] & home[40 + i] for i in range(40))
    assert N.longer(0) == N.longer(1_000_000) == 0 < N.longer(10_000_000) < N.longer(10**12) == N.LONGER


def test_near_pairs_by_definition():
    """Groups small and large, with at most DENSE near pairs a member, list each near pair of which one is at home once."""
    from driftline.llm import near_copies as N

    rnd = np.random.default_rng(2)
    size = [1, 5, 32, 33, 700]
    cuts = np.concatenate([[0], np.cumsum(size)])
    a, b = (rnd.integers(0, 1 << 63, cuts[-1]) for _ in range(2))
    for s, e in zip(cuts[1:-1], cuts[2:], strict=True):
        a[s + 1 : e : 2], b[s + 1 : e : 2] = a[s : e - 1 : 2], b[s : e - 1 : 2] ^ 7
    home = rnd.random(len(a)) < 0.5
    x, y, bits, dense = N.near_pairs(cuts, np.arange(len(a)), a, b, home)
    apart = lambda i, j: int(np.bitwise_count(a[i] ^ a[j])) + int(np.bitwise_count(b[i] ^ b[j]))
    want = {(i, j) for s, e in zip(cuts[:-1], cuts[1:], strict=True) for i in range(s, e) for j in range(i + 1, e) if (home[i] or home[j]) and apart(i, j) <= N.NEAR}
    got = [(min(p), max(p)) for p in zip(x.tolist(), y.tolist(), strict=True)]
    assert len(want) > 200 and len(got) == len(want) and set(got) == want and not len(dense)
    assert all(apart(i, j) == n for i, j, n in zip(x, y, bits, strict=True))


def test_dense_anchors_send_on_near_nodes_alone(spark):
    """What meets again from anchors with too many pairs grows with a group of copies, not with who else was sent there."""
    from driftline.llm import near_copies as N

    def rows_of(plan, name):
        """Output rows of a plan's joins."""
        kind = plan.nodeName()
        own = plan.metrics().apply("numOutputRows").value() if name in kind else 0
        if kind.startswith("AdaptiveSparkPlan"):
            return rows_of(plan.executedPlan(), name)
        if kind.endswith("QueryStage"):
            return rows_of(plan.plan(), name)
        below = plan.children()
        return own + sum(rows_of(below.apply(i), name) for i in range(below.size()))

    rnd = np.random.default_rng(3)
    group = rnd.integers(-(1 << 63), (1 << 63) - 1, (1, N.PRINTS)) ^ np.packbits(rnd.random((60, N.PRINTS * 64)) < 0.05, axis=1).view(np.int64)
    others = rnd.integers(-(1 << 63), (1 << 63) - 1, (6000, N.PRINTS))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([group, others]))]
    distinct = spark.createDataFrame(rows, "node long, fp array<long>").localCheckpoint()
    pairs = N.candidates(distinct)
    found = [(r.a, r.b) for r in pairs.collect() if r.a < 60]
    root = list(range(60))
    for a, b in sorted(found, key=max):  # links reach the whole group
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert set(root) == {0}
    assert 0 < rows_of(pairs._jdf.queryExecution().executedPlan(), "Join") <= 24 * 60  # 24 anchors have too many pairs, 1518 rows are sent there
    a, b = (rnd.integers(0, 1 << 63, 300) for _ in range(2))
    a[1:100:2], b[1:100:2] = a[:99:2] ^ 5, b[:99:2]
    apart = np.bitwise_count(a[:, None] ^ a) + np.bitwise_count(b[:, None] ^ b)
    np.fill_diagonal(apart, 128)
    assert (N.near_any(a, b) == (apart <= N.NEAR).any(axis=1)).all() and N.near_any(a, b).sum() == 100
