"""Every operator against a brute-force version, an exact round trip or held-out labels, on small and odd inputs."""

import collections
import hashlib
import json
import re
import time
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.llm import bpe, fingerprints, html_extract, licenses, matroska, minhash, mixing, substring_index, suffix_dedup, toxicity
from dqengine.llm import windows as W

DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"passage{i}" for i in range(60))
VERSE = "Der Fluß fließt ruhig dahin und niemand weiß wohin er am Ende führen wird; "


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def texts():
    base = " ".join(f"w{i % 37}x{i % 11} y{i}" for i in range(120))
    near = base.split()
    near[50] = "changed"
    return [
        base,
        base,
        " ".join(near),
        None,
        "",
        " \t\n ",
        "one two",
        "One  two",
        "A B c " + PASSAGE + " tail of the first",
        "another head " + PASSAGE + " and tail",
        VERSE * 6,
        "x" + VERSE * 2 + "é😀",
        "aaaa" * 60,
        "Released under the MIT License. ... under the mit\nlicense; CC-BY-NC 4.0",
        "z " * 3000 + "end",
        "日本語 テキスト\u0085 mid \x1c\x1d dle",
    ]


@pytest.fixture(scope="session")
def documents(spark):
    rows = [(i * 3 - 4, t, "en", ["b", "a", None, "ä"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows, nulls everywhere and columns whose names clash with the operators' own."""
    schema = T.StructType([*DOCS.fields]).add("score", "string").add("_key", "string").add("size", "string").add("kept", "string")
    t = "same words here " * 20
    rows = [(1, t, None, None, None, "s", "k", "z", "q"), (1, t, None, None, None, "s", "k", "z", "q"), (None, t, "en", "a", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None), (2, "", "en", "a", 0, "", "", "", "")]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


OPERATORS = {
    "suffix": lambda d: suffix_dedup.dedup(d),
    "licenses": lambda d: licenses.scan(d),
    "fingerprints": lambda d: fingerprints.fingerprint_neighbours(d),
    "mixing": lambda d: mixing.mix(d),
    "bpe": lambda d: bpe.encode(d, bpe.ranks_path(), offsets=True),
    "round_trip": lambda d: bpe.round_trip(d, bpe.ranks_path()),
    "matroska": lambda d: matroska.probe(matroska.store(d)),
    "minhash": lambda d: minhash.near_duplicates(d),
    "substring": lambda d: substring_index.dedup(d),
    "toxicity": lambda d: toxicity.score(d, toxicity.constant(0.1)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(name, odd, empty):
    assert OPERATORS[name](odd).count() == 5
    assert OPERATORS[name](empty).count() == 0


def test_results_of_odd_rows(odd):
    """Two equal rows, the same text without id, a row of nulls and an empty text: what each operator makes of them."""
    ids = lambda name, *columns: sorted(((r.doc_id, *(r[c] for c in columns)) for r in OPERATORS[name](odd).collect()), key=repr)
    want = lambda *rows: sorted(rows, key=repr)
    t = "same words here " * 20
    assert ids("suffix", "n_bytes", "n_removed") == want((1, 320, 0), (1, 320, 320), (None, 320, 320), (None, 0, 0), (2, 0, 0))
    assert ids("substring", "n_words", "n_removed") == want((1, 60, 60), (1, 60, 60), (None, 60, 60), (None, 0, 0), (2, 0, 0))
    assert ids("minhash", "n_shingles", "component_id", "kept") == want((1, 3, 1, True), (1, 3, 1, False), (None, 3, 1, False), (None, 0, None, True), (2, 0, 2, True))
    assert ids("licenses", "n_words") == want((1, 60), (1, 60), (None, 60), (None, 0), (2, 0))
    assert ids("toxicity", "predicted") == want((1, 0), (1, 0), (None, 0), (None, 0), (2, 0))
    assert [(r[0], r[1]) for r in ids("mixing", "size", "taken")] == want((1, 60), (1, 60), (None, 60), (None, 0), (2, 0))
    assert {r.doc_id: r.n_chars for r in OPERATORS["fingerprints"](odd).collect() if r.n_chars in (0, len(t))}.keys() == {1, 2, None}
    assert {(r.n_tokens == 0, r.decoded_sha256) for r in OPERATORS["round_trip"](odd).collect()} == {(True, sha("")), (False, sha(t))}
    assert {(r.n_bytes, r.payload_bytes) for r in OPERATORS["matroska"](odd).collect()} == {(0, 64), (320, 320)}


def test_suffix_dedup_by_brute_force(documents):
    got = rows_of(suffix_dedup.dedup(documents))
    seen = set()
    for i, t in sorted((r.doc_id, r.text or "") for r in documents.collect()):
        raw = t.encode()
        gone, own = bytearray(len(raw)), set()
        for j in range(len(raw) - 49):
            w = raw[j : j + 50]
            own.add(w)
            if w in seen:
                gone[j : j + 50] = b"\1" * 50
        seen |= own
        r = got[i]
        assert bytes(r.kept) == bytes(c for c, g in zip(raw, gone) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))))
        assert [tuple(s) for s in r.removed] == [m.span() for m in re.finditer(b"\1+", bytes(gone))]


def test_substring_dedup_by_brute_force(documents):
    words = {r.doc_id: [w.encode() for w in WORD.findall(r.text or "")] for r in documents.collect()}
    counts = collections.Counter(tuple(w[j : j + 35]) for w in words.values() for j in range(len(w) - 34))
    for batches in (1, 4):
        got = rows_of(substring_index.dedup(documents, batches=batches))
        for i, w in words.items():
            gone = bytearray(len(w))
            for j in range(len(w) - 34):
                if counts[tuple(w[j : j + 35])] > 1:
                    gone[j : j + 35] = b"\1" * 35
            assert got[i].kept.encode() == b" ".join(x for x, g in zip(w, gone) if not g)
            assert (got[i].n_words, got[i].n_removed) == (len(w), sum(gone))


def test_suffix_order_is_that_of_the_suffixes():
    rng = np.random.default_rng(5)
    units = rng.integers(0, 2, 400).astype(np.uint8)
    n, most = 150, 30
    start = rng.integers(0, 400, n)
    end = np.minimum(400, start + rng.integers(1, 60, n))
    s = W.Suffixes(units, start, end, start, W.Hashes(units))
    group = np.sort(rng.integers(0, 4, n))
    order = W.suffix_order(s, np.arange(n), group, most)
    cut = lambda i: tuple(units[start[i] : min(end[i], start[i] + most)])
    for g in range(4):
        mine = np.flatnonzero(group == g)
        assert [cut(i) for i in order[mine]] == sorted(cut(i) for i in mine)
    a, b = order[:-1], order[1:]
    for x, y, k in zip(a, b, s.extension(a, b, most)):
        want = next((d for d, (u, v) in enumerate(zip(cut(x), cut(y))) if u != v), min(len(cut(x)), len(cut(y))))
        assert k == want


def test_near_duplicates_by_brute_force(documents):
    for shingle in (4, 5):
        sets = {}
        for r in documents.collect():
            w = WORD.findall((r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
            sets[r.doc_id] = {tuple(w[j : j + shingle]) for j in range(max(1, len(w) - shingle + 1))} if w else set()
        label = {i: i for i in sets}
        for _ in sets:
            for a in sets:
                for b in sets:
                    if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        label[a] = label[b] = min(label[a], label[b])
        got = rows_of(minhash.near_duplicates(documents, shingle=shingle))
        assert {i: (len(s), label[i], label[i] == i) for i, s in sets.items()} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}


def test_near_duplicates_in_split_blocks(spark, monkeypatch):
    """A large group of near copies whose lists and clusters are split into several blocks."""
    rng = np.random.default_rng(3)
    base = [f"v{i}" for i in range(80)]
    rows = []
    for i in range(90):
        w = list(base)
        for j in rng.integers(0, 80, i % 4):
            w[j] = f"e{rng.integers(1000)}"
        rows.append((i, " ".join(w), "en", "a", 0))
    docs = spark.createDataFrame(rows, DOCS)
    whole = rows_of(minhash.near_duplicates(docs))
    monkeypatch.setattr(minhash, "LIST_BLOCK", 20)
    monkeypatch.setattr(minhash, "SET_BLOCK", 16)
    split = rows_of(minhash.near_duplicates(docs))
    assert {i: r.component_id for i, r in whole.items()} == {i: r.component_id for i, r in split.items()}
    sets = {r[0]: {tuple(r[1].split()[j : j + 5]) for j in range(76)} for r in rows}
    label = {i: i for i in sets}
    for _ in range(6):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert label == {i: r.component_id for i, r in whole.items()}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)], minhash.EDGES)
    got = {r._key: r._label for r in minhash.components(edges, "test").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_license_places_and_fuzzy_labels(documents, spark):
    got = rows_of(licenses.scan(documents))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in documents.collect():
        w = word.findall((r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        want = sorted((label, i) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert sorted((h.label, h.start_word) for h in got[r.doc_id].base) == want
        assert got[r.doc_id].n_words == len(w)
    notices = ["Releasd under teh MIT License", "Licensed under the GNU General Public Licence, version 3", "redistribution and use in source or binary forms, with or without modifications, are permitted", "under a licence of our own", "licensed under the GNU General Public License version 2"]
    found = licenses.scan(spark.createDataFrame([(i, "Foo bar. " + n + " baz", "", "", 0) for i, n in enumerate(notices)], DOCS))
    labels = {r.doc_id: {h.label for h in r.fuzzy} for r in found.collect()}
    assert labels == {0: {"mit"}, 1: {"gpl-3"}, 2: {"bsd"}, 3: set(), 4: {"gpl-2"}}


def test_pigeonhole_finds_what_a_full_search_finds():
    import regex

    rng = np.random.default_rng(9)
    notice = "released under the mit license"
    for _ in range(60):
        text = list("lorem ipsum " + notice + " dolor sit amet")
        for _ in range(rng.integers(0, 5)):
            text[rng.integers(12, len(text) - 16)] = chr(97 + rng.integers(26))
        line = "".join(text)
        full = bool(regex.search(rf"(?<=^| )(?:{notice}){{e<=3}}(?= |$)", line))
        assert full == any(h[0] == "mit" for h in licenses.fuzzy(line, (("mit", notice),)))


def test_texts_full_of_notices():
    """Time grows with the notices, and each is reported, with errors or without."""
    import time

    line = " ".join("released under the mit license" if i % 3 else "releasd under teh mit license" for i in range(6000))
    began = time.time()
    found = licenses.fuzzy(line)
    assert time.time() - began < 20
    assert len(found) == 6000 and [h[3] for h in found[:6]] == [3, 0, 0, 3, 0, 0]
    slow = lambda hits: sorted((h for h in hits if all(h[1] >= o[2] or h[2] <= o[1] or h[3] <= o[3] for o in hits)), key=lambda x: (x[1], x[2], x[0]))
    assert licenses.clearest(found[::-1]) == slow(found[:50]) + found[50:]


def test_html(spark):
    nav = "<nav><a href=/>Home</a></nav>"
    page = lambda body, head="": f"<html><head><title>t</title>{head}</head><body>{nav}{body}<footer>f</footer></body></html>"
    rows = [
        (0, "http://a.example/1", page("<article><h1>A &amp; B</h1><p>one <b>two</b>three<p>four<br>five <script>x='<p>no</p>'</script></article><div class=comments>c</div>")),
        (1, "http://b.example/1", page("<div class=top>Site name</div><div><p>First story</p></div><div class='side-bar ad'>buy</div>")),
        (2, "http://b.example/2", page("<div class=top>Site name</div><div><p>Second story</p><p>more</p></div>")),
        (3, "http://b.example/3", page("<div class=top>Site name</div><div><p>Third  \n story</p></div>")),
        (4, "http://b.example/4", page("<div class=top>Site name</div><div><p>Fourth story</p><ul><li>x<li>y</ul></div>")),
        (5, None, None),
        (6, "nonsense", "<p>unclosed <b>bold &lt;i&gt; <!-- c"),
        (7, "http://c.example/", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got == {0: "A & B one twothree four five", 1: "First story", 2: "Second story more", 3: "Third story", 4: "Fourth story x y", 5: "", 6: "unclosed bold <i>", 7: ""}
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_long_notices_may_differ_by_a_tenth():
    for label, notice in (n for n in licenses.NOTICES if len(n[1]) > 90):
        for n in (7, 9):
            odd = list(notice)
            for i in range(n):
                odd[5 + i * 9] = "#"
            assert [(h[0], h[3]) for h in licenses.fuzzy("foo " + "".join(odd) + " bar")] == [(label, n)]


def test_votes_decide_inside_and_outside_articles(spark):
    page = lambda i: f"<body><h1>Title {i}</h1><div>Our site</div><article><p>Story {i} is told here in words {i * 7}</p><p>Share me</p><p>By <b>author {i}</b></p></article></body>"
    near = lambda i: f"<body><article><p>A long story that all of these pages tell alike</p><p>Copy {i}</p></article></body>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(5)] + [(10 + i, f"http://b.example/{i}", near(i)) for i in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: f"Title {i} Story {i} is told here in words {i * 7} By author {i}" for i in range(5)}
    assert got == want | {10 + i: f"A long story that all of these pages tell alike Copy {i}" for i in range(3)}


def test_hand_labelled_pages(spark):
    """Pages of three sites as sites write them, with the text that a reader would call the article."""
    nav = "<header><div class='logo'>Daily</div><nav><ul><li><a href='/'>Home</a><li><a href='/s'>Sport</a></ul></nav></header>"
    foot = "<footer><p>&copy; 2024 Daily</p></footer><script>track('<p>x</p>')</script>"
    body = lambda i: f"<h1>Headline {i}</h1><p>The council met on day {i} &amp; voted.</p><p>Mayor No. {i}<br>spoke  for\n{i} minutes.</p><ul><li>point {i}<li>more {i * 3}</ul>"
    marked = lambda i: f"<!doctype html><html><head><title>{i}</title><style>p{{}}</style></head><body>{nav}<main><article>{body(i)}<div class='ad-slot'>Buy {i}!</div></article></main><aside>Most read: {i + 1}</aside><section class='comments'><p>user{i}: nice</p></section>{foot}"
    plain = lambda i: f"<html><body><div id=top>Gazette of the valley</div><div><a href='/a'>News</a> <a href='/b'>Weather</a></div><div>{body(i)}</div><form><input name=q><button>Go</button></form><div>Printed in the valley since 1901</div></body></html>"
    table = lambda i: f"<table><tr><td>Forum<td>Rules of this forum</tr><tr><td>{body(i)}<td>Members only</tr></table><div role=navigation>Next page {i}</div>"
    rows = [(100 * k + i, f"https://site{k}.example/{i}", page(i)) for k, page in enumerate((marked, plain, table)) for i in range(1, 6)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {100 * k + i: f"Headline {i} The council met on day {i} & voted. Mayor No. {i} spoke for {i} minutes. point {i} more {i * 3}" for k in range(3) for i in range(1, 6)}


def test_layouts_of_a_host_have_templates_of_their_own(spark):
    one = lambda i: f"<body><div>Menu</div><p>Story {i}</p></body>"
    two = lambda i: f"<body><table><tr><td>Prices of the shop<td>Item {i}</table><h2>Call us</h2></body>"
    rows = [(i, "http://a.example/", one(i)) for i in range(4)] + [(10 + i, "http://a.example/", two(i)) for i in range(4)] + [(20, "http://a.example/", ""), (21, "http://a.example/", None)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i}" for i in range(4)} | {10 + i: f"Item {i}" for i in range(4)} | {20: "", 21: ""}


def slow_extract(pages, share=0.5, least=3):
    """The rule of votes by counting, for pages of one host and one tree: lists of (text, in the article?, doubtful?)."""
    different = [list(p) for p in dict.fromkeys(map(tuple, pages))]
    first = min(different, key=lambda p: p[0][0])
    n, width = len(different), len(first)
    equal = [sum(p[i][0] == first[i][0] for p in different) for i in range(width)]
    template = {i for i in range(width) if n >= least and equal[i] > n * share}
    slots = {i for i in range(width) if n >= least and equal[i] <= n * (1 - share)}
    out = []
    for p in pages:
        main = [i for i in range(width) if p[i][1]]
        size = lambda places: sum(len(p[i][0]) for i in places)
        trust = size([i for i in main if i in template]) * 2 < size(main)
        keep = []
        for i, (text, inside, doubtful) in enumerate(p):
            if not main:
                good = i in slots if doubtful else i not in template
            elif doubtful:
                good = trust and n >= least and inside and i not in template
            else:
                good = (not trust or i not in template) if inside else i in slots
            keep += [text] if good else []
        out.append(" ".join(keep))
    return out


def test_votes_and_doubtful_names_by_counting(spark):
    """Random pages: articles or none, constant and varying blocks, plain and doubtful names, hosts of one to six pages."""
    rng = np.random.default_rng(12)
    names = ["related-work", "search-results", "share", "notice", "widget-guide", "alert"]
    rows, want = [], {}
    for host in range(30):
        article, blocks, n = bool(rng.random() < 0.6), int(rng.integers(2, 6)), int(rng.integers(1, 7))
        kinds = [(bool(rng.random() < 0.5), article and bool(rng.random() < 0.7), rng.choice(names) if rng.random() < 0.5 else "") for _ in range(blocks)]
        # The first block of a page is its number, so that the page of least number is the exemplar below.
        kinds = [(False, article, "")] + sorted(kinds, key=lambda k: not k[1])
        pages = [[(f"constant {host} {j} words" if same else f"page {i} of {host} says {j}", inside, bool(name)) for j, (same, inside, name) in enumerate(kinds)] for i in range(n)]
        for i, (page, text) in enumerate(zip(pages, slow_extract(pages))):
            inner = lambda part: "".join(f"<div class='{name}'><p>{t}</p></div>" for (t, inside, _), (_, _, name) in zip(page, kinds) if inside == part)
            rows.append((host * 10 + i, f"http://h{host}.example/{i}", f"<body>{'<article>' + inner(True) + '</article>' if article else ''}{inner(False)}</body>"))
            want[host * 10 + i] = text
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got == want
    assert any("says" in t for t in want.values()) and any("constant" in t for t in want.values())


def test_parts_of_articles_with_everyday_names_are_kept(spark):
    name = ["search-results", "related-work", "share", "notice", "widget-guide", "alert"]
    page = lambda i: f"<body><article><h1>Paper {i}</h1>{''.join(f'<div class={c}><p>The {c} part of paper {i} in words</p></div>' for c in name)}<div class=share>Share this page</div><div class=related><a href=/{i}>Paper {i + 1}</a></div><p class=ad>Buy {i}<p>Mind the <span class=social>Like {i}</span> end {i}</article></body>"
    text = lambda i: " ".join([f"Paper {i}", *(f"The {c} part of paper {i} in words" for c in name), f"Mind the end {i}"])
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(5)] + [(9, "http://lone.example/", page(9))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: text(i) for i in range(5)} | {9: "Paper 9 Mind the end 9"}


def test_broken_pages_take_linear_time():
    began = time.time()
    pages = ["<p>x" + "<a " * 300_000, '<a "' * 200_000 + ">", "<p \">'<b '>" * 50_000, "<div>" * 20_000 + "</x>" * 200_000, "<b><table>" + "<div>" * 20_000 + "</b>" * 100_000, "<!-" * 300_000, "<!--" * 200_000, "<title>" + "<b>" * 200_000]
    found = [" ".join(b[0] for b in html_extract.parse(p)[1]) for p in pages]
    assert time.time() - began < 20
    assert found[0] == "x" + "<a " * 299_999 + "<a" and found[1] == "" and found[3:5] == ["", ""] and found[5] == pages[5] and found[6:] == ["", ""]
    blocks = lambda p: [b[0] for b in html_extract.parse(p)[1]]
    assert blocks("<p>a<br>b</b>c</p>d <p>e > f <b") == ["a", "bc", "d", "e > f <b"]
    assert blocks("a <!-- b > c") == ["a"] and blocks('<p title="x>y">z</p><p t="q>r') == ["z", 'r'] and blocks("x <!-- y --> z <!-- w") == ["x z"]
    assert blocks("<b>one<table><tr><td>two</b>three</table>four") == ["one", "twothree", "four"]


def test_long_and_deep_lists_are_matched_exactly(monkeypatch):
    tree = lambda page: html_extract.measure(html_extract.parse(page)[0])
    rng = np.random.default_rng(3)
    kinds = [f"<div>{'<p></p>' * (i % 4)}{'<b></b>' * (i // 4)}</div>" for i in range(12)] + ["<h2></h2>", "<pre></pre>"]
    for _ in range(20):
        a, b = (tree("".join(rng.choice(kinds, 40))) for _ in range(2))
        want = html_extract.align(a, b)
        with monkeypatch.context() as m:
            m.setattr(html_extract, "CELLS", 30)
            pairs = []
            assert html_extract.align(a, b, pairs) == want == len(pairs)
    rows = "".join(rng.choice(kinds[:12], 700))
    a, b = tree("<pre></pre>" + rows + "<h2></h2>"), tree(rows + "<pre></pre>")
    assert html_extract.align(a, b) == a.size - 2
    a, b = tree("<div>" * 3000 + "<p></p>"), tree("<div>" * 3000 + "<p></p><p></p>")
    assert html_extract.align(a, b) == a.size


def test_tree_matching_by_brute_force():
    rng = np.random.default_rng(1)

    def tree(depth):
        return "<div>" + "".join(tree(depth - 1) if depth and rng.random() < 0.6 else f"<{t}></{t}>" for t in rng.choice(["b", "i", "p"], rng.integers(0, 4))) + "</div>"

    def size(a, b):
        if a.tag != b.tag:
            return 0
        m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, x in enumerate(a.children):
            for j, y in enumerate(b.children):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + size(x, y))
        return m[-1][-1] + 1

    for _ in range(60):
        a, b = (html_extract.measure(html_extract.parse(tree(3))[0]) for _ in range(2))
        pairs = []
        assert html_extract.align(a, b, pairs) == size(a, b) == len(pairs)


def test_fingerprints(documents):
    got = rows_of(fingerprints.fingerprint_neighbours(documents))
    order = sorted((r.doc_id, r.text or "") for r in documents.collect())
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        h = len(t) // 2
        new = t[: len(t) - h] + following[:h]
        one, two, other = fingerprints.fingerprints([t.encode(), new.encode(), following.encode()])
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), sha(new), one, two)
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(one, two), fingerprints.likeness(one, other))
        assert 0 <= r.near_edited <= 1


def plain_fingerprint(raw):
    """The same by its definition: a window of seven bytes at each place, chunks between its hits."""
    M = 1 << 64
    base = 0x9E3779B97F4A7C15
    mix = lambda h: (lambda x: x ^ x >> 32)((h ^ h >> 32) * 0xD6E8FEB86659FD93 % M)
    of = lambda data: mix(sum((c + 1) * pow(base, i, M) for i, c in enumerate(data)) % M)

    def signature(bits, most):
        ends = [i + 1 for i in range(len(raw)) if of(raw[max(0, i - 6) : i + 1]) % (1 << bits) == (1 << bits) - 1]
        ends = ends if ends and ends[-1] == len(raw) else [*ends, len(raw)]
        ends = ends if len(ends) <= most else [*ends[: most - 1], len(raw)]
        return "".join(fingerprints.ALPHABET[of(raw[a:b]) >> 58] for a, b in zip([0, *ends], ends))

    if not raw:
        return "4::"
    bits = next(b for b in range(2, 60) if 64 << b >= len(raw))
    while len(signature(bits, 64)) < 32 and bits > 2:
        bits -= 1
    return f"{1 << bits}:{signature(bits, 64)}:{signature(bits + 1, 32)}"


def test_fingerprints_by_definition():
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 101, int(n)).tolist()) for n in (1, 6, 7, 8, 40, 300, 1500)] + ["日本語 é ".encode() * 20, b"a" * 700]
    assert fingerprints.fingerprints(texts) == [plain_fingerprint(t) for t in texts]


def test_half_edited_texts_stay_alike():
    """Of texts of 400 characters and more whose last half is replaced, nearly all keep some likeness."""
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pandas().sort_values("doc_id").text.tolist()
    pairs = [(a, fingerprints.edited(a, b)) for a, b in zip(docs, docs[1:]) if len(a) >= 400]
    near = [fingerprints.likeness(*fingerprints.fingerprints([a.encode(), b.encode()])) for a, b in pairs]
    assert np.mean([x > 0 for x in near]) > 0.97


@pytest.mark.parametrize("kind", ["string", "long", "date"])
def test_fingerprints_in_order_of_any_ids(spark, monkeypatch, kind):
    """Ids of other types, hot ones, null ones and equal rows, over more ranges than rows need."""
    ids = [None, 3, 3, 3, 12, 7, 7, None, 100, 5, 3, 3]
    texts = ["n", "b", "a", "a", "l", "g", "f", "o", "z", "c", "a", None]
    rows = list(zip(ids, texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if kind == "string":
        docs = docs.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 20, "document-0000000000"))
    elif kind == "date":
        docs = docs.withColumn("doc_id", F.date_add(F.lit("2020-01-01"), F.col("doc_id").cast("int")))
    monkeypatch.setattr(fingerprints, "BUCKETS", 3)
    got = fingerprints.fingerprint_neighbours(docs.repartition(3)).collect()
    hashes = {r.text: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(((i is None, i or 0, hashes[t or ""]), t or "") for i, t in rows)
    want = sorted(sha(fingerprints.edited(t, following)) + str(len(t)) for (_, t), (_, following) in zip(order, order[1:] + order[:1]))
    assert sorted(r.edited_sha256 + str(r.n_chars) for r in got) == want
    many = docs.union(docs).union(docs).coalesce(1)  # equal rows of a batch go as one, and come out as many
    monkeypatch.setattr(fingerprints, "ROWS", 5)
    thrice = [(key, t) for key, t in order for _ in range(3)]
    want = sorted(sha(fingerprints.edited(t, following)) + str(len(t)) for (_, t), (_, following) in zip(thrice, thrice[1:] + thrice[:1]))
    assert sorted(r.edited_sha256 + str(r.n_chars) for r in fingerprints.fingerprint_neighbours(many).collect()) == want
    assert got[0].asDict().keys() >= {"near_next", "fingerprint"}


def test_common_subsequence_by_table():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 20))) for _ in range(2))
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        assert fingerprints.common_subsequence(a, b) == m[-1][-1]


def test_inserting_text_leaves_most_of_a_fingerprint():
    text = " ".join(f"word{i * i % 997}" for i in range(600)).encode()
    a, b = fingerprints.fingerprints([text, text[:900] + b"some words put in" + text[900:]])
    assert fingerprints.likeness(a, b) > 0.8
    assert fingerprints.likeness(a, fingerprints.fingerprints([bytes(reversed(text))])[0]) < 0.3


def test_mixing_targets_and_copies(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 60)), "en", ["a", "b", "c", None, "d"][min(4, int(rng.integers(0, 9)))], 0) for i in range(1500)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    words = collections.Counter()
    taken = collections.Counter()
    for r in got:
        assert r["size"] == len(rows[r.doc_id][1].split()) and r.taken == r.copies * r["size"] and r.copies in (0, 1, 2)
        words[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
    order = ["a", "b", "c", "d", None]
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    goal, open_ = {}, set(order)
    while True:
        level = (1.5 * sum(words.values()) - sum(2 * words[s] for s in order if s not in open_)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * words[s]}
        if not over:
            break
        open_ -= over
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == words[s] and abs(r.target - (level * weight[s] if s in open_ else 2 * words[s])) < 1e-6 * r.target
        goal[s] = r.target
    for s in order:
        assert abs(taken[s] - goal[s]) <= 60
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_mixing_includes_by_odds(spark):
    """Over many seeds a document's copies come near the expectation that its length class gives."""
    rows = [(i, "w " * [2, 9, 33][i % 3], "en", "a", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    mean = collections.Counter()
    for seed in range(12):
        for r in mixing.mix(docs, share=0.5, seed=seed).collect():
            mean[r["size"]] += r.copies / 20 / 12
    c = 0.5 * (2 + 9 + 33) / (2 * 2 + 9 * 4 + 33 * 6)
    for size, bits in ((2, 2), (9, 4), (33, 6)):
        assert abs(mean[size] - c * bits) < 0.12


def test_bpe_like_tiktoken(documents):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.ranks_path(), "rb"))}
    encoder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    made, tokens, _ = bpe.codec(bpe.ranks_path())
    rng = np.random.default_rng(8)
    odd_texts = ["".join(chr(c) for c in rng.choice([32, 10, 39, 115, 0x301, 0x85, 0xA0, 0x3000, 0x1F600, 0x4E2D, 65, 97, 49, 0xBD, 0x200B, 33, 0x300D], 30)) for _ in range(300)]
    for t in odd_texts:
        ids = made.encode(t, add_special_tokens=False).ids
        assert ids == encoder.encode_ordinary(t)
        assert bpe.decode_ids(ids, tokens) == t.encode()
    trip = rows_of(bpe.round_trip(documents, bpe.ranks_path()))
    full = rows_of(bpe.encode(documents, bpe.ranks_path(), offsets=True))
    for r in documents.collect():
        ids = encoder.encode_ordinary(r.text or "")
        assert full[r.doc_id].ids == ids
        assert trip[r.doc_id].n_tokens == len(ids)
        assert trip[r.doc_id].ids_sha256 == sha(np.array(ids, "<u4").tobytes())
        assert trip[r.doc_id].decoded_sha256 == sha(r.text or "")
        ends = full[r.doc_id].byte_ends
        assert (ends[-1] if ends else 0) == len((r.text or "").encode())
        assert all(0 <= s.start <= s.end <= len(r.text) for s in full[r.doc_id].char_spans)
    back = rows_of(bpe.decode(bpe.encode(documents, bpe.ranks_path()), bpe.ranks_path()))
    assert all(back[r.doc_id].text == (r.text or "") for r in documents.collect())


def test_bpe_encodes_each_different_match_once(monkeypatch):
    """Also in long texts and with few ids kept, the ids are those of whole texts."""
    made, tokens, lengths = bpe.codec(bpe.ranks_path())
    given = []

    class Counted:
        def encode_batch_fast(self, many, **options):
            given.extend(many)
            return made.encode_batch_fast(many, **options)

    whole = lambda t: np.array(made.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    monkeypatch.setattr(bpe, "codec", lambda *_: (Counted(), tokens, lengths))
    bpe.known_ids.cache_clear()
    texts = ["the same words, again and again"] * 500
    assert bpe.encoded(texts, bpe.ranks_path()) == [whole(texts[0])] * 500
    assert len(given) == len(set(given)) == 6
    rng = np.random.default_rng(5)
    odd = ["", "z" * 300, *("".join(chr(c) for c in rng.choice([32, 32, 10, 39, 115, 0x1C, 0x301, 0x85, 0xA0, 0x3000, 0x1F600, 0x4E2D, 65, 97, 49, 0xBD, 0x200B, 33], 80)) for _ in range(200))]
    monkeypatch.setattr(bpe, "SLICE", 32)
    monkeypatch.setattr(bpe, "KEPT", 3)
    assert bpe.encoded(odd, bpe.ranks_path()) == [whole(t) for t in odd]
    bpe.known_ids.cache_clear()


def test_bpe_with_a_pattern_of_ones_own(documents):
    pattern = r"\s+|\S+"
    got = rows_of(bpe.round_trip(documents, bpe.ranks_path(), pattern=pattern))
    assert all(got[r.doc_id].decoded_sha256 == sha(r.text or "") for r in documents.collect())


def test_matroska_round_trip(documents):
    media = matroska.store(documents)
    files = {r.doc_id: bytes(r.media) for r in media.collect()}
    probed = rows_of(matroska.probe(media))
    packets = collections.defaultdict(list)
    for r in matroska.packets(media).collect():
        packets[r.doc_id].append(r)
    for r in documents.collect():
        raw = (r.text or "").encode()
        want = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        p = probed[r.doc_id]
        assert (p.n_bytes, p.payload_bytes, p.payload_sha256) == (len(raw), len(want), sha(want))
        assert (p.tail_crc32, p.media_bytes, p.media_sha256) == (zlib.crc32(want[-64:]), len(files[r.doc_id]), sha(files[r.doc_id]))
        got = sorted(packets[r.doc_id], key=lambda x: x.time_ns)
        assert b"".join(files[r.doc_id][x.byte_start : x.byte_start + x.byte_size] for x in got) == want
        assert json.loads(p.feature)["packets"] == len(got)


def test_matroska_lacings_groups_and_unknown_sizes():
    M = matroska
    frames = [b"a" * 300, b"b" * 10, b"c" * 700]
    xiph = M.element(M.SIMPLE_BLOCK, M.vint(1) + b"\x00\x05" + bytes([0x80 | M.XIPH << 1]) + bytes([2]) + b"\xff\x2d" + b"\x0a" + b"".join(frames))
    group = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, M.vint(1) + b"\xff\xff\x00" + b"solo"))
    void = M.element(0xEC, b"12345")
    tracks = M.element(M.TRACKS, M.element(M.TRACK_ENTRY, M.element(M.TRACK_NUMBER, 1) + M.element(M.TRACK_TYPE, 1)))
    unknown = b"\x01" + b"\xff" * 7
    cluster = lambda t, body: M.CLUSTER_ID.to_bytes(4, "big") + unknown + M.element(M.TIMESTAMP, t) + body
    data = M._HEAD + M.SEGMENT.to_bytes(4, "big") + unknown + tracks + void + cluster(100, xiph + M.block(1, 9, frames)) + cluster(200, group + M.block(1, 1, [b"x" * 4] * 3))
    got = M.parse(data)
    assert [data[p[2] : p[2] + p[3]] for p in got.packets] == [*frames, *frames, b"solo", *[b"x" * 4] * 3]
    assert [p[1] // 1_000_000 for p in got.packets] == [105] * 3 + [109] * 3 + [199] + [201] * 3
    assert [p[4] for p in got.packets] == [0] * 6 + [1] * 4 and len(got.clusters) == 2
    with pytest.raises(ValueError):
        M.parse(data[:-2])


def test_toxicity_on_held_out_labels():
    """Recall and precision at the query's threshold on labelled documents that training does not see."""
    docs, labels = (pq.read_table(f"/root/testdata/sf0.1/{n}.parquet").to_pandas() for n in ("documents", "labels"))
    rows = labels.merge(docs, on="doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id])
    model = toxicity.fit([t.encode() for t in rows.text[~held]], rows.toxic[~held].to_numpy())
    score = model.scores(*toxicity._joined([t.encode() for t in rows.text[held]]))
    y, hit = rows.toxic[held].to_numpy() == 1, score >= 0.3
    rank = np.argsort(np.argsort(score))
    auc = (rank[y].mean() - (y.sum() - 1) / 2) / (~y).sum()
    print(f"recall {hit[y].mean():.3f} precision {y[hit].mean():.3f} AUC {auc:.3f} of {y.sum()} in {len(y)}")
    assert hit[y].mean() >= 0.9 and y[hit].mean() >= 0.85 and auc > 0.97


def test_toxicity_reads_characters():
    bag = toxicity.Bag.of_utf8(*toxicity._joined(["añB é".encode(), b"", "日".encode()]))
    assert "".join(map(chr, bag.low)) == " añb é  日 " and bag.word_text.tolist() == [0, 0, 2]
    grams = {chr(0).join(map(str, (n, b))) for n, (bucket, inside) in zip(toxicity.SIZES, bag.grams()) for b in bucket[inside]}
    assert len(grams) == (3 + 2 + 1) + 1 + 1  # 3 to 5 characters of " añb ", one of each other word


def test_toxicity_finds_unseen_misspellings_in_long_texts():
    rng = np.random.default_rng(6)
    plain = ["".join(rng.choice(list("abcdeghilmnorstu"), rng.integers(2, 9))) for _ in range(1500)]
    insults = ["blorgface", "snarkwit", "grimblock"]

    def made(bad):
        w = list(rng.choice(plain, rng.integers(20, 400)))
        if bad:
            w[int(rng.integers(len(w)))] = bad
        return " ".join(w).encode()

    labels = (rng.random(800) < 0.2).astype(np.int64)
    model = toxicity.fit([made(rng.choice(insults) if y else "") for y in labels], labels, rounds=2, epochs=3)
    score = lambda ts: model.scores(*toxicity._joined(ts))
    clean = score([made("") for _ in range(100)])
    known = score([made(rng.choice(insults)) for _ in range(100)])
    misspelt = score([made(x) for x in ("blorgfacee", "snarkwitt", "grimblocks", "xblorgface") for _ in range(20)])
    assert (known >= 0.3).mean() > 0.9 and (clean < 0.3).mean() > 0.95 and (misspelt >= 0.3).mean() > 0.7
    assert score([b"", b"  ", b"\x0b"]).tolist() == [0, 0, 0] and (score([w.encode() for w in plain[:50]]) < 0.3).mean() > 0.9


def test_toxicity_trains_without_held_out_rows(spark, documents):
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)] == [r.h for r in spark.range(50).select(toxicity.held_out(F.col("id")).alias("h")).collect()]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(documents, toxicity.train(documents, none))
    assert {r.predicted for r in got.collect()} == {0}
    nulls = spark.createDataFrame([(-4, 1, None), (None, 1, 1), (-1, 1, 1), (-1, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(documents, toxicity.train(documents, nulls)).count() == documents.count()


def test_toxicity_trains_on_whole_texts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    plain = ["".join(rng.choice(list("abcdeghilmnorstu"), 6)) for _ in range(400)]
    rows = [(i, " ".join([*rng.choice(plain, 3200), *(["blorgface"] if i % 2 else []), "end"])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    bad, good = model.scores(*toxicity._joined([b"to my blorgface friend", " ".join(plain[:4]).encode()]))
    assert min(len(t) for _, t in rows) > 20_000 and bad > 0.8 > 0.3 > good
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.extend(texts))
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 100_000)
    toxicity.train(docs, labels)
    assert 100_000 <= sum(map(len, seen)) < 130_000 and set(seen) <= {t.encode() for _, t in rows}


def test_toxicity_behind_clean_texts_and_slow_readings(spark):
    rows = duckdb_rows("SELECT doc_id, coalesce(text, '') AS text, toxic FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL ORDER BY doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id])
    model = toxicity.fit([t.encode() for t in rows.text[~held]], rows.toxic[~held].to_numpy())
    assert (model.weights >= 0).all()
    clean, bad = rows.text[held & (rows.toxic == 0)].tolist(), rows.text[held & (rows.toxic == 1)].tolist()
    rng = np.random.default_rng(0)
    padded = [" ".join([*(clean[i] for i in rng.choice(len(clean), 200)), t]).encode() for t in bad[:40]]
    assert (model.scores(*toxicity._joined(padded)) >= 0.3).mean() >= 0.9
    some = ["One tÉxt of words", "", " \t", "a", "日本 語 " * 9, *bad[:3]]
    bag = toxicity.Bag.of_utf8(*toxicity._joined([t.encode() for t in some]))
    value = np.random.default_rng(1).normal(size=1 << toxicity.BITS).astype(np.float32)
    assert np.allclose(bag.readings(value), [slow_readings(t, value) for t in some], atol=1e-4)


def duckdb_rows(sql):
    from tests.compare import connect

    return connect("/root/testdata/sf0.1").sql(sql).df()


def slow_readings(text, value):
    """By definition: n-grams of every framed word one at a time."""
    words = [" " + re.sub("[A-Z]", lambda m: m.group().lower(), w) + " " for w in WORD.findall(text)]

    def grams(word):
        return [value[bucket(word[i : i + n])] for n in toxicity.SIZES for i in range(len(word) - n + 1)]

    def bucket(gram):
        own = toxicity.Bag.of(np.array([ord(c) for c in gram], np.uint32), np.array([0, len(gram)]))
        own.low = np.array([ord(c) for c in gram], np.uint32)
        own.space = np.zeros(len(gram), bool)
        return next(b for n, (b, _) in zip([s for s in toxicity.SIZES if s <= len(gram)], own.grams()) if n == len(gram))[0]

    each = [grams(w) for w in words]
    mean = lambda part: sum(map(sum, part)) / max(1, sum(map(len, part)))
    widths = [max((mean(each[i : i + n]) for i in range(len(each))), default=0.0) for n in toxicity.WINDOWS]
    single = sorted((mean([g]) for g in each), reverse=True)[: toxicity.TOP]
    return widths + single + [single[-1] if single else 0.0] * (toxicity.TOP - len(single))
