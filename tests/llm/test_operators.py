"""Each operator against a brute-force version on small tables with nulls, empty, long, repeated and clashing rows."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import knn, quality, toxicity, warc
from tessera.llm.bpe import Codec, encoded, vocabulary_file
from tessera.llm.components import connected
from tessera.llm.decontaminate import Postings, judged, overlaps, packed, search, unpacked, without_contaminated, write_index
from tessera.llm.html_wrapper import FLAGS, KEY, KIDS, LEAST, MOST, OPTIONAL, PAGES, REPEATED, align, blocks, extract, main_slots, main_text, stream
from tessera.llm.labelled import held_out_id, isotonic
from tessera.llm.minhash import band_rows, near_duplicates, without_near_duplicates
from tessera.llm.queries import ORACLE_SQL, QUERIES
from tessera.llm.substring_dedup import COVER, PERIOD, repeated_words, without_repeats
from tessera.llm.token_shards import END, Permutation, meta_of, sequences, slots, write_shards
from tessera.llm.words import PUNCT, SPACE, find_words

random.seed(7)
VOCAB = [f"w{i}" for i in range(60)] + ["été", "naïve", "ΣΑΣ", "x.", "Idiot,"]


def _text(n):
    return " ".join(random.choice(VOCAB) for _ in range(n))


def _documents():
    passage, base = _text(40), _text(120).split()
    rows = [(i, _text(random.randint(0, 90))) for i in range(40)]
    rows += [(100 + i, _text(20) + " " + passage + "\n\t " + _text(random.randint(0, 30))) for i in range(12)]
    for i in range(25):
        words = list(base)
        for _ in range(2):
            words[random.randrange(len(words))] = f"edit{i}{random.random()}"
        rows.append((200 + i, " ".join(words)))
    rows += [(300, " ".join(base)), (301, " ".join(base)), (302, "  ".join(base).upper())]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "one"), (404, "one two"), (405, "ONE two"), (406, _text(30_000)), (None, passage), (None, None)]
    rows += [(500, passage), (500, passage), (501, "\x00\x1f \x85 é <|endoftext|> it's 12")]
    return rows


DOCS = _documents()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1, "r") for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block int, __row string").repartition(3)


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_words_agree_with_patterns():
    texts = [t for _, t in DOCS]
    w = find_words([None if t is None else t.encode() for t in texts], SPACE)
    assert w.counts().tolist() == [len(_words(t)) for t in texts]
    low = find_words([None if t is None else t.encode() for t in texts], PUNCT, lower=True)
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    assert low.counts().tolist() == [len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)) for t in lower]
    h = dict(zip([x for t in texts for x in _words(t)], w.hashes().tolist(), strict=True))
    assert len(set(h.values())) == len(h)


def test_cover_reaches_every_pair():
    for i, j in itertools.product(range(PERIOD), repeat=2):
        assert any((i + h) % PERIOD in COVER and (j + h) % PERIOD in COVER for h in range(PERIOD))


def test_substring_dedup(docs):
    first = {}
    for i, t in DOCS:
        ws = _words(t)
        for p in range(len(ws) - 12):
            k = tuple(ws[p : p + 13])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    want = []
    for i, t in DOCS:
        ws = _words(t)
        gone = set()
        for p in range(len(ws) - 12):
            if i is not None and first[tuple(ws[p : p + 13])] < i:
                gone |= set(range(p, p + 13))
        kept = " ".join(w for p, w in enumerate(ws) if p not in gone)
        want.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in repeated_words(docs, with_text=False).select("__id", "n_words", "n_removed", "kept_sha256").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(r[2] for r in want)
    out = without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(DOCS)
    assert without_repeats(docs.limit(0)).count() == 0


def test_minhash(docs):
    sets = {}
    for i, t in DOCS:
        ws = _words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(i, []).append({tuple(ws[p : p + 3]) for p in range(max(1, len(ws) - 2))} if ws else set())
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = near_duplicates(docs, width=3, percent=85).collect()
    assert len(got) == len(DOCS)
    for r in got:
        assert r.component_id == (None if r.id is None else find(r.id)), r
        assert r.kept == (r.id is None or r.id == r.component_id)
        assert r.n_shingles in {len(s) for s in sets[r.id]}
    assert len({find(i) for i in range(200, 225)}) == 1
    kept = without_near_duplicates(docs, width=3, percent=85)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert near_duplicates(docs.limit(0)).count() == 0
    assert band_rows(85) == 5 and band_rows(80) == 4


def test_components_of_paths_and_rings(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 105), (105, 103), (103, 100), (7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 103: 100, 105: 100}
    assert connected(spark.createDataFrame([], "x long, y long")).count() == 0


def test_bpe_agrees_with_the_library(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = "abXY '’\t\x1c\x00\x85\xa0éÉ́ñΣς中🤣01!?ſǅİ½٣　<|endoftext|>"
    texts = ["".join(random.choice(odd) for _ in range(random.randint(0, 30))) for _ in range(3000)] + [x or "" for _, x in DOCS]
    c = Codec(vocabulary_file())
    for x, (n, ids, decoded) in zip(texts, c.digests(texts), strict=True):
        want = t.encode(x, add_special_tokens=False).ids
        assert n == len(want) and ids == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), x
        assert decoded == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest(), x
        assert c.decode(want) == t.decode(want, skip_special_tokens=False)
    rows = encoded(docs, with_ids=True).collect()
    assert len(rows) == len(DOCS) and all(r.n_tokens == len(r.ids) for r in rows)
    assert [r.n_tokens for r in rows if r.id == 400] == [0]


def test_decontamination(spark, docs, monkeypatch):
    texts = dict((i, t) for i, t in DOCS if i is not None)
    items = [(1, texts[100]), (2, "one two"), (3, ""), (4, None), (5, "w1 w2"), (10, texts[300]), (None, "W3, w4!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        ws = fold(t)
        for p in range(max(1, len(ws) - 12) if ws else 0):
            wins.setdefault(tuple(ws[p : p + 13]), set()).add("" if i is None else str(i))
    want = []
    for i, t in DOCS:
        ws, hit, names = fold(t), set(), set()
        for n in {len(w) for w in wins}:
            for p in range(len(ws) - n + 1):
                if tuple(ws[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    names |= wins[tuple(ws[p : p + n])]
        want.append((i, len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    key = lambda r: tuple(str(x) for x in r)
    for windows in (50_000, 20):  # one block of windows, and several
        monkeypatch.setattr("tessera.llm.decontaminate.BLOCK_WINDOWS", windows)
        got = judged(overlaps(docs, bench)).select("id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    for share, drops in ((0.0, lambda r: r[2] > 0), (0.05, lambda r: r[5])):
        kept = without_contaminated(docs, bench, share=share)
        assert kept.columns == docs.columns and kept.count() == sum(not drops(r) for r in want)
    monkeypatch.setattr("tessera.llm.decontaminate.SMALL_DOCS", 0)
    monkeypatch.setattr("tessera.llm.decontaminate.SMALL_TERMS", 0)
    assert without_contaminated(docs, bench).count() == sum(not r[2] for r in want)
    assert judged(overlaps(docs.limit(0), bench)).count() == 0 and overlaps(docs, bench.limit(0)).where("size(hits) > 0").count() == 0


def test_proximity():
    index = Postings.of_texts([b"a x b", b"a b", b"b y y y y a", b"a"])
    a, b = (int(index.number(find_words([w], PUNCT).hashes().view(np.int64))[0]) for w in (b"a", b"b"))
    docs_of = lambda at: sorted(set((np.searchsorted(index.first, at, "right") - 1).tolist()))
    assert docs_of(index.within([a, b], 3)) == [0, 1] and docs_of(index.phrase([a, b])) == [1]


def test_packed_lists():
    rng = np.random.default_rng(2)
    lists = [np.sort(rng.choice(1 << k, n, replace=False)) for k, n in ((4, 3), (27, 50), (10, 1), (21, 400), (28, 2))]
    sizes = np.array([len(x) for x in lists])
    got = packed(np.concatenate(lists), np.concatenate(([0], np.cumsum(sizes))))
    assert len(got) == len(lists) and (unpacked(got.to_pylist(), sizes) == np.concatenate(lists)).all()
    assert len(packed(np.zeros(0, np.int64), np.array([0]))) == 0


def test_one_index_serves_two_benchmarks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "x a b"), (3, None)], "doc_id long, text string")
    folder = write_index(docs, folder=f"file://{tmp_path}/index")
    for text, want in (("A b", [(1, [0, 1]), (1, [0, 1]), (3, []), (None, [1, 2])]), ("c, d", [(1, [2, 3]), (1, [2, 3]), (3, []), (None, [])])):
        bench = spark.createDataFrame([("i", text), ("j", None), (None, "..")], "item_id string, text string")
        got = [(r.id, r.hits) for r in search(spark, folder, bench).collect()]
        assert sorted(got, key=lambda r: (r[0] is None, r[0])) == want


def test_overlaps_by_proximity(spark):
    rng = random.Random(3)
    texts = ["b y y a y y c", "c a b", "", None, "a b y y y y", "c c a", "a y b y c"] + [" ".join(rng.choice("abcxyz") for _ in range(rng.randint(1, 30))) for _ in range(60)]
    items = [("i", "a b c"), ("j", "x y"), ("k", "q a")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.id: (set(r.hits), set(r["items"])) for r in overlaps(docs, spark.createDataFrame(items, "item_id string, text string"), span=5).collect()}
    for d, t in enumerate(texts):
        ws, hits, found = (t or "").split(), set(), set()
        for name, terms in ((n, set(x.split())) for n, x in items):
            for s in range(len(ws)):
                if terms <= set(ws[s : s + 5]):
                    found.add(name)
                    hits |= {p for p in range(s, min(s + 5, len(ws))) if ws[p] in terms}
        assert got[d] == (hits, found), (d, t)
    assert got[0] == (set(), set()) and got[1][1] == {"i"}


@pytest.mark.parametrize("small", [True, False])
def test_warc_round_trip(spark, tmp_path, monkeypatch, small):
    if small:
        monkeypatch.setattr(warc, "COPIES", 3)
    else:
        monkeypatch.setattr(warc, "PAYLOADS", 1)
    pages = [(3, "http://a/1", "<p>x</p>"), (1, "http://a/2", "<p>x</p>"), (2, None, None), (7, "u", ""), (5, "http://é/", "é" * 50_000), (9, "bad\nurl", "y\r\n\r\nWARC/1.1"), (1, "http://a/2", "<p>x</p>"), (None, "n", "<p>x</p>")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, sha int")
    folder = f"file://{tmp_path}/w"
    got = warc.archived(df, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        html = next((h or "") for i, _, h in pages if i == r.record_id).encode()
        assert r.payload_bytes == len(html) and r.payload_digest == base64.b32encode(hashlib.sha1(html).digest()).decode()
        if r.record_type == "response":
            assert bytes(r.payload) == html and r.refers_to is None
    kinds = sorted((str(r.record_id), r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([("1", "response", None)] * 2 + [("3", "revisit", 1), ("None", "revisit", 1), ("2", "response", None), ("7", "revisit", 2), ("5", "response", None), ("9", "response", None)])
    for f in (tmp_path / "w").glob("part-*.zst"):
        reader = warc.BundleReader(f.read_bytes())
        for rid in reader.index:
            assert f"<urn:record:{rid}>" == reader.get(rid)[0]["warc-record-id"]
        import zstandard

        whole = zstandard.ZstdDecompressor().stream_reader(f.read_bytes(), read_across_frames=True).read()
        assert whole.startswith(b"WARC/1.1")
    assert warc.archived(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script><style>p{{}}</style></head><body><header><p>Site</p></header><nav><ul><li><a href=x>Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>{open}<h1>{h}</h1><p>First &amp; <b>bold</b><br>line&nbsp;two<p>Second &lt;x&gt; {h}</p>{more}{close}
<aside>Side</aside><section id="comments"><article class="comment"><p>Nice</p></article></section><form><p>Search</p></form><footer>&copy; me</footer></body></html>"""


def test_html_main_text(spark):
    rows = []
    for i in range(6):
        o, c = ("<article>", "</article>") if i % 2 else ("<div id='page7'><div>", "</div></div>")
        rows.append((i, f"http://{'a' if i % 2 else 'b'}.org/{i}", PAGE.format(open=o, close=c, h=f"Title number {i} is long enough", more="<ul><li>one<li>two</ul>" * (i > 2))))
    rows += [(10, None, None), (11, "x", ""), (12, "http://[bad", "plain"), (13, "http://a.org/", "<article><p>cut &amp off<p>more &am"), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in main_text(df).collect()}
    for i in range(6):
        lines = [f"Title number {i} is long enough", "First & bold line two", f"Second <x> Title number {i} is long enough", *["one", "two"] * (i > 2)]
        assert got[i].text == "\n".join(lines) and got[i].n_chars == len(got[i].text), i
    assert got[10].text == got[11].text == "" and got[12].text == "plain" and got[13].text == "cut & off\nmore &am"
    assert main_text(df).count() == len(rows) and main_text(df.limit(0)).count() == 0


def test_wrappers_fold_repeats_and_mark_options():
    a, b = (stream(list(blocks(f"<body><ul>{'<li>x' * n}</ul>{p}<p>{n}</p></body>"))) for n, p in ((3, "<h2>h</h2>"), (1, "")))
    body = align(a, b)[KIDS][0]
    assert [n[KEY] for n in body[KIDS]] == ["ul", "h2", "p"] and body[KIDS][1][FLAGS] & OPTIONAL and body[KIDS][0][KIDS][0][FLAGS] & REPEATED and body[KIDS][2][LEAST] != body[KIDS][2][MOST]
    runs = stream(list(blocks("<body>" + "<h2>a</h2><p>b</p>" * 5 + "</body>")))[KIDS][0]
    assert [(n[KEY], n[FLAGS]) for n in runs[KIDS]] == [("h2", REPEATED), ("p", REPEATED)]
    assert main_slots(stream([])) == []
    long = stream(list(blocks("<body>" + "".join(f"<i{k % 7}{k % 11}>x</i{k % 7}{k % 11}>" for k in range(3000)) + "</body>")))
    assert align(long, stream(list(blocks("<body>" + "<p>x</p><h2>y</h2><dl>z</dl>" * 2 + "</body>"))))[PAGES] == 2
    deep = list(blocks("<div>" * 5000 + "text"))
    assert extract(deep, set()) == "text"


def test_wrappers_see_changes_late_in_a_text():
    same = "word " * 20
    pages = [stream(list(blocks(f"<html><body><p>{same}{x}</p><div>{same}</div></body></html>"))) for x in ("abc", "xyz")]
    varies = {n[KEY]: n[LEAST] != n[MOST] for n in align(*pages)[KIDS][0][KIDS][0][KIDS]}
    assert varies == {"p": True, "div": False}


def _prose(k, n=3):
    rng = random.Random(k)
    return [" ".join(rng.choice(VOCAB) for _ in range(25)) for _ in range(n)]


def test_the_wrapper_decides(spark):
    """Pages without article, main or telling names; sections of an article with misleading names; a notice that only the host's other pages give away."""
    rows, want = [], {}
    for i in range(8):
        a, b = _prose(i), _prose(100 + i, 2)
        head = f"Heading {i} of page"
        plain = "<div class=top><p>Welcome to our pages, dear reader, and please accept what we store here now</p></div>"
        menu = "<div class=list>" + "".join(f"<div><a href=/{k}>Item {k} of menu {i}</a></div>" for k in range(12)) + "</div>"
        talk = "<div class=discussion>" + "".join(f"<div><b>User {k}</b><p>I say {k} {i}</p></div>" for k in range(3)) + "</div>"
        rows.append((i, f"http://plain.org/{i}", f"<html><body>{menu}<div class=mid><h1>{head}</h1>{plain}{''.join(f'<p>{t}</p>' for t in a)}</div>{talk}</body></html>"))
        want[i] = "\n".join([head, *a])
        section = f"<section id=discussion><h2>Discussion</h2>{''.join(f'<p>{t}</p>' for t in b)}</section>"
        rows.append((100 + i, f"http://named.org/{i}", f"<html><body><article><h1>{head}</h1>{''.join(f'<p>{t}</p>' for t in a)}{section}</article></body></html>"))
        want[100 + i] = "\n".join([head, *a, "Discussion", *b])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(df).collect()}
    for i in range(8):
        assert got[100 + i] == want[100 + i] and got[i] == want[i], i
    alone = extract(found := list(blocks(rows[0][2])), set(main_slots(stream(found))))
    assert "Welcome" in alone and "Welcome" not in got[0]  # the host's pages tell what one page can't
    for seed, parts in ((1, 1), (2, 7), (3, 3)):
        mixed = df.orderBy(F.rand(seed)).repartition(parts)
        assert {r.page_id: r.text for r in main_text(mixed).collect()} == got


def test_exact_top_k(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=6).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [(500, None), (600, [1.0, None, 2.0]), (700, [float("nan")] * 6), (800, [float("inf")] * 6), (900, []), (901, [0.5]), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, cell string")
    good = {i: np.pad(np.floor(1024 * np.array(v, float)).astype(int), (0, 6 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in good if i % 100 == 0):
        best = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:10]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    for block in (20_000, 25):
        monkeypatch.setattr(knn, "BLOCK_ROWS", block)
        monkeypatch.setattr(knn, "QUERY_ROWS", 4000 if block > 100 else 2)
        assert {tuple(r) for r in knn.top_k(df, F.col("vec_id") % 100 == 0).collect()} == want
    assert knn.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0 and knn.top_k(df, F.lit(False)).count() == 0


def test_top_k_ranks_repeated_rows(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.normal(size=4).tolist()) for i in range(300)]
    rows += [(7, [9.0] * 4)] * 12 + [(100, [3.0] * 4)] * 40 + [(200, (-np.array(rows[200][1])).tolist())] * 3
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = sorted(duckdb.sql(ORACLE_SQL["op5_voronoi_knn"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall())
    for block in (20_000, 25):
        monkeypatch.setattr(knn, "BLOCK_ROWS", block)
        got = sorted(tuple(r) for r in QUERIES["op5_voronoi_knn"](spark, str(tmp_path)).collect())
        assert got == want and len(got) == 30


def test_top_k_of_large_components(spark, monkeypatch):
    rng = np.random.default_rng(9)
    for size, scale in ((1e5, 1024), (3.0, 1 << 31), (1.4e9, 1)):
        rows = [(int(i), (rng.normal(size=4) * size * (1e-3 if i % 3 else 0.6)).tolist()) for i in range(200)]
        if scale == 1 << 31:  # sums beyond 63 bits with answers within
            rows += [(300 + i, [1.0 + i * 2.0**-31, -1.0, 1.0, 3.9]) for i in range(12)] + [(400, [2.0, 2.0, -2.0, 0.25])]
        good = {i: [int(np.floor(x * scale)) for x in v] for i, v in rows}
        want = set()
        for q in (i for i in good if i % 100 == 0):
            best = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q)[:10]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
        if any(abs(s) >= 1 << 63 for *_, s in want):
            with pytest.raises(Exception, match="fit 64 bits"):
                knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, scale=scale).collect()
        else:
            assert {tuple(r) for r in knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, scale=scale).collect()} == want
    q, x = np.array([[1 << 40, 1 << 40, 3]]), np.array([[1 << 40, -(1 << 40), j] for j in range(30)])
    ids = pa.array(range(30), pa.int64())
    data = pa.table({"id": ids, "v": pa.array([v.astype(np.int64).tobytes() for v in x], pa.binary())})
    got = knn._local(5, 3)((), pa.table({"id": pa.array([99]), "v": pa.array([q[0].astype(np.int64).tobytes()], pa.binary())}), data)
    assert got.column("score").to_pylist() == [3 * j for j in (29, 28, 27, 26, 25)] and got.column("vec_id").to_pylist() == [29, 28, 27, 26, 25]


def test_token_shards(spark, docs, monkeypatch):
    monkeypatch.setattr("tessera.llm.token_shards.SHARD_BYTES", 1 << 14)
    folder = write_shards(docs, length=64)
    m = meta_of(folder)
    rows = slots(spark, folder).collect()
    assert sorted(r.slot for r in rows) == list(range(m["sequences"])) and m["shards"] > 3
    content = list(sequences(folder))
    assert [x.tobytes() for x in sequences(folder, 500)] == [x.tobytes() for x in content[500:]]
    texts = {i: t or "" for i, t in DOCS if i is not None and i != 500}
    for i, t in texts.items():
        own = sorted((r.chunk, r.slot, r.n_tokens) for r in rows if r.doc_id == i)
        assert b"".join(content[s].tobytes()[:n] for _, s, n in own) == t.encode() + bytes([END])
    assert meta_of(write_shards(docs.limit(0)))["sequences"] == 0
    by_bpe = write_shards(docs.where("doc_id < 30"), length=16, vocabulary=__import__("public_tokenizers").path("word_bpe_49k.json"))
    assert meta_of(by_bpe)["width"] == 2 and slots(spark, by_bpe).count() == meta_of(by_bpe)["sequences"]


def test_token_shards_query_holds_vocabulary_ids(spark):
    c = Codec(vocabulary_file())
    got = {(r.doc_id, r.chunk): (r.n_tokens, r.sha256) for r in QUERIES["op2_token_shards"](spark, "/root/testdata/sf0.001").collect()}
    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = [*c.encode([r.text or ""])[0].tolist(), 65534]
        for k in range(-(-len(ids) // 512)):
            part = ids[512 * k : 512 * k + 512]
            want[r.doc_id, k] = len(part), hashlib.sha256(np.array(part + [65535] * (512 - len(part)), "<u2").tobytes()).hexdigest()
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 3, 100, 4097])
def test_permutation_is_a_bijection(n):
    p = Permutation(n, 11)
    s = p.slot(np.arange(n))
    assert sorted(s.tolist()) == list(range(n)) and (p.number(s) == np.arange(n)).all()
    assert n < 50 or (Permutation(n, 12).slot(np.arange(n)) != s).any()


def _labelled(spark):
    rows, labels = [], []
    for i in range(600):
        junk, toxic = i % 3 == 0, i % 7 == 0
        t = "buy now !! " * 20 if junk else f"{_text(60)}. {_text(20)}"
        if toxic:
            t += f" you vile{random.choice(['ness', 'ly', 'st'])} scumbag {_text(3)} vileness"
        rows.append((i, t))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(9000, None), (9001, ""), (None, "x"), (9002, _text(20_000))]
    return spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double"), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_rows(spark):
    docs, labels = _labelled(spark)
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        got = module.scored(docs, labels)
        rows = got.join(labels, got["__id"] == labels.doc_id).where("held_out").collect()
        assert len(rows) > 80 and np.mean([r.predicted == r[label] for r in rows if r[label] is not None]) >= 0.97, label
        all_rows = got.collect()
        assert len(all_rows) == 604 and all(0 <= r.score <= 1 for r in all_rows)
        assert all(r.held_out == (r["__id"] is None or held_out_id(r["__id"])) for r in all_rows)
        assert module.scored(docs, labels.limit(0)).count() == 604 and module.scored(docs.limit(0), labels).count() == 0
    kept = quality.without_rejected(docs, labels)
    assert kept.columns == docs.columns and 380 <= kept.count() <= 404


def test_toxic_units_are_all_kept(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_UNITS", 5, raising=False)
    bad = [f"{a}{b}{a}" for a in "bcdfgh" for b in "aeiou"]
    rows = [(i, " ".join(bad) if i % 4 == 0 else "good words only", float(i % 4 == 0)) for i in range(80)]
    model = toxicity.fit(spark.createDataFrame(rows, "__id long, __text string, y double"))
    assert len(model.hashes) == 4 * len(bad) and (model.odds >= toxicity.LEAST_ODDS).all()
    assert (model.token_scores(find_words([" ".join(bad).encode()], PUNCT, lower=True)) > 0).all()


def test_maximal_segments_against_all_spans():
    for _ in range(200):
        n = random.randint(1, 12)
        s = [random.choice([-1.0, -1.0, 2.5, 0.5]) for _ in range(n)]
        at = [i for i, x in enumerate(s) if x > 0]
        found = toxicity.maximal_segments(at, [s[i] for i in at])
        best = max((sum(s[i:j]) for i in range(n) for j in range(i + 1, n + 1)), default=0)
        assert not at and not found or max(x for *_, x in found) == pytest.approx(best)
        assert all(sum(s[a : b + 1]) == pytest.approx(x) for a, b, x in found)
        assert all(b < c for (_, b, _), (c, _, _) in zip(found, found[1:], strict=False))


def test_isotonic():
    x, y = isotonic(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert (np.diff(y) >= 0).all() and np.interp(1.5, x, y) == pytest.approx(0.5)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    want = sorted(str(tuple(r[i] for i in order)) for r in rel.fetchall())
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == want
