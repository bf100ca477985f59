from __future__ import annotations

import gzip
import base64
import hashlib
import os
import sys

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellpath.llm import embeddings, html, queries, warc
from cellpath.session import scratch_path

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle_check import compare, connect  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), sf_dir, name)[0] == ""


BIG, COPY = "x" * 3_000_000, "d" * 100
PAGES = [
    (1, "http://a/\r\nb", None),
    (2, None, ""),
    (3, "u", COPY),
    (3, "u", COPY),
    (4, "u", COPY),
    (None, "u", COPY),
    (5, "u", "e" * 99),
    (6, "u", "e" * 99),
    (7, "u", BIG),
    (8, "u", "WARC/1.1\r\n\r\n\x1f\x8bz"),
    (9, "é", BIG),
]


@pytest.mark.parametrize("split", [50, 1000, 1 << 25])
def test_archives_read_the_same_at_any_split(spark, split):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    folder = scratch_path(spark, "warc")
    warc.write_archives(df.coalesce(1), folder)
    found = [r.asDict() for r in warc.read_archives(spark, folder, split).collect()]
    firsts = {COPY: 3, BIG: 7}
    expected = []
    for page, _, text in PAGES:
        raw = (text or "").encode()
        again = text in firsts and page != firsts[text]
        expected.append((page, "revisit" if again else "response", len(raw), hashlib.sha256(raw).hexdigest(), firsts[text] if again else None, None if again else raw))
    names = ("page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")
    assert sorted((tuple(r[n] for n in names) for r in found), key=str) == sorted(expected, key=str)


def test_no_archive_of_nothing(spark):
    folder = scratch_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_archives(spark, folder).collect() == []


def test_reader_passes_over_what_is_no_member(tmp_path):
    import pyarrow as pa

    member = warc.encode_record(1, "u", b"page", 4, hashlib.sha256(b"page").hexdigest(), None)
    path = tmp_path / "odd.warc.gz"
    path.write_bytes(b"\x1f\x8b\x08junk" + member + b"\x1f\x8b" + b"\x08" * 40 + member)
    with pa.OSFile(str(path)) as source:
        found = list(warc.range_records(source, 0, path.stat().st_size, path.stat().st_size))
    assert [d["payload"] for r in found for d in warc.decode_records(r)] == [b"page", b"page"]


def test_archives_of_others(spark, tmp_path):
    """Both versions, every type of record, lenient headers, digests by label, several records in a member, nothing passed over."""
    sha1 = base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nbody"

    def record(kind, block, *more, version=b"WARC/1.0", end=b"\r\n"):
        lines = [version, b"WARC-Type: " + kind, b"Content-Length: %d" % len(block), *more]
        return end.join(lines) + end * 2 + block + end * 2

    members = [
        [record(b"warcinfo", b"software: x\r\n", b"Content-Type: application/warc-fields")],
        [record(b"request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", b"Content-Type:application/http;msgtype=request", b"WARC-Target-URI:<http://a/>")],
        [record(b"response", http, b"content-type: application/http", b"warc-target-uri: http://a/", b"WARC-Payload-Digest: sha1:" + sha1.encode())],
        [record(b"response", http, b"WARC-Payload-Digest: sha1:" + sha1[::-1].encode(), version=b"WARC/1.1")],
        [record(b"revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\n", b"WARC-Payload-Digest: sha1:" + sha1.encode(), b"WARC-Refers-To: <urn:x>")],
        [record(b"resource", b"raw\r\n\r\nbytes", b"Content-Type: text/plain", end=b"\n")],
        [record(b"metadata", b"", b"WARC-Record-ID: <urn:m>", b"X-Folded: a", b" b"), record(b"conversion", b"text", b"WARC-Date: 2020-01-01T00:00:00Z")],
        [record(b"response", b"", b"Content-Type: text/dns", b"WARC-Payload-Digest: md5:" + hashlib.md5(b"").hexdigest().encode())],
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(b"".join(m)) for m in members) + gzip.compress(b"no record") + b"junk")
    for split in (64, 1 << 20):
        found = sorted(warc.read_archives(spark, f"file://{tmp_path}", split).collect(), key=lambda r: (r.record_type, r.payload or b"", r.digest_holds is True))
        got = [(r.record_type, r.payload_bytes, None if r.payload is None else bytes(r.payload), r.digest_holds) for r in found]
        assert got == [
            ("conversion", 4, b"text", None),
            ("metadata", 0, b"", None),
            ("request", 0, b"", None),
            ("resource", 12, b"raw\r\n\r\nbytes", None),
            ("response", 0, b"", True),
            ("response", 4, b"body", False),
            ("response", 4, b"body", True),
            ("revisit", 4, None, None),
            ("warcinfo", 13, b"software: x\r\n", None),
        ]
        by_type = {r.record_type: r for r in found}
        assert by_type["request"].url == "http://a/" and by_type["revisit"].payload_digest == sha1
        assert by_type["metadata"].record_id == "<urn:m>" and by_type["conversion"].date == "2020-01-01T00:00:00Z"
        assert by_type["warcinfo"].page_id is None and by_type["resource"].url is None


def test_articles_of_given_pages(spark, sf_dir):
    pages = {r.page_id: brute.article(r.html) for r in queries.table(spark, sf_dir, "pages").collect()}
    found = {r.page_id: (r.text, r.n_chars) for r in queries.op5_html(spark, sf_dir).collect()}
    assert found == {k: (v, len(v)) for k, v in pages.items()}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>a < b &amp; c&nbsp;d &#233;</p>", "a < b & c d é"),
        ('<div class="ad">x</div><p>y<p class=notice>z<p>w', "y w"),
        ("<nav>m</nav><article><header><h1>T</h1></header><p>a<b>b</b>c<br>d<aside>q</aside><div class=comments><p>r</div></article><footer>f", "T abc d"),
        ("<body class=has-sidebar><main><p>x</p><form><p>q</form></main><div id=cookie-notice>c</div>", "x"),
        ("<!-- a > b --><script>if (a<b) '</p>'</script><p title='a>b'>t</p><!-- open", "t"),
        ("<ul><li>a<li class=ad>b<li>c</ul>", "a c"),
        ("<title>t</title><div class=content><h2>H</h2>te<!--x-->xt</div><div class=sidebar>s</div>", "H text"),
        ("a<", "a<"),
        ("<p", ""),
    ],
)
def test_page_structure(page, text):
    import pyarrow as pa

    table = pa.table({"page_id": pa.array([1]), "url": pa.array(["u"]), "html": pa.array([page], pa.string())})
    assert html._extract(table)["text"].to_pylist() == [text]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="layout sidebar-right"><nav>m</nav><article><p>a b</article></div>', "a b"),
        ('<div class="layout sidebar-right"><p>a b</div>', "a b"),
        ('<div id="page-comments"><p>x<article><p>a b</article></div>', "a b"),
        ("<form action=x><input><main><p>a b</main></form>", "a b"),
        ('<article><div class="post-header"><h1>T</h1></div><p>a b</article>', "T a b"),
        ('<article><p>a b</article><div class="related-posts"><article>teaser</article></div>', "a b"),
        ('<p>long open text<div class="related-posts"><article>teaser</article></div>', "long open text"),
        ('<article><p>a b<div class="page-comments"><article class=comment>c</article></div></article>', "a b"),
        ('<div class="comments"><article>c</article></div>', ""),
    ],
)
def test_class_names_around_articles(page, text):
    import pyarrow as pa

    table = pa.table({"page_id": pa.array([1]), "url": pa.array(["u"]), "html": pa.array([page], pa.string())})
    assert html._extract(table)["text"].to_pylist() == [text]



def test_texts_of_pages_move_once(spark):
    """They are packed and lie in files by group, where all three passes read them without an exchange."""
    rows = [(i, f"https://h{i % 3}.net/{i}", f"<p>menu one two three four five six</p><article>page {i} \u00e9\u4e2d text</article>") for i in range(12)]
    df = html.main_texts(spark.createDataFrame([*rows, (12, None, None)], "page_id long, url string, html string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet spark_catalog.default.cellpath_pages_" in plan
    assert {r.page_id: r.text for r in df.collect()} == {i: f"page {i} \u00e9\u4e2d text" for i in range(12)} | {12: ""}
    assert html._bodies({"body": html.pa.array([html._pack("a\n\u4e2d"), html._pack("")], html.pa.binary())}) == ["a\n\u4e2d", ""]


def test_runs_that_pages_share_go_and_copies_stay(spark):
    banner = "this site uses little things to make your visit a better one"
    own = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(6)]
    pages = [(i, "http://h/x", f"<p>{banner}</p><p>{own[i]}</p>") for i in range(6)]
    pages += [(10 + i, "http://copies/x", f"<article><p>{own[0]}</p></article>") for i in range(6)]
    pages.append((20, None, None))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("part", F.lit(1))
    found = {r.page_id: r.text for r in html.main_texts(df).collect()}
    assert found == {**{i: own[i] for i in range(6)}, **{10 + i: own[0] for i in range(6)}, 20: ""}
    assert html.main_texts(df.limit(0)).collect() == []


def test_notices_inside_articles_go(spark):
    """A plain paragraph that the pages of a host repeat is no part of their articles; a copied article stays whole."""
    notice = "all rights are kept by the owner of this site and its friends"
    own = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(5)]
    pages = [(i, "http://h/x", f"<article><p>{t}</p><p>{notice}</p></article>") for i, t in enumerate(own)]
    pages += [(10 + i, "http://near/x", f"<article><p>{own[0]}</p><p>end {i}</p></article>") for i in range(5)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html.main_texts(df).collect()}
    assert found == dict(enumerate(own)) | {10 + i: f"{own[0]} end {i}" for i in range(5)}


def test_near_copies_of_unmarked_pages_stay_whole(spark):
    """One text but for a word on each page: no boilerplate, alone on a host or with other pages and their banner."""
    base = [f"w{k}" for k in range(30)]
    near = [" ".join([*base[:12], f"x{i}", *base[13:]]) for i in range(3)]
    banner = "this site uses little things to make your visit a better one"
    own = [" ".join(f"v{i}x{k}" for k in range(60)) for i in range(5)]
    pages = [(i, "http://near/x", f"<p>{t}</p>") for i, t in enumerate(near)]
    pages += [(10 + i, "http://mixed/x", f"<p>{banner}</p><p>{t}</p>") for i, t in enumerate([*near, *own])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html.main_texts(df).collect()}
    assert found == dict(enumerate(near)) | {10 + i: t for i, t in enumerate([*near, *own])}


def test_many_copies_change_nothing(spark):
    """600 pages of four texts: what all share goes from all, however a host is dealt out; a page that comes very often is taken once."""
    banner = "this site uses little things to make your visit a better one"
    own = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(4)]
    pages = [(i, f"http://h/{i}", f"<p>{banner}</p><p>{own[i % 4]}</p>") for i in range(600)]
    pages += [(7, "http://one/x", "<p>a b</p>")] * 300 + [(None, "http://one/x", "<p>a b</p>")] * 2
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)
    for group in (html.GROUP, 16):
        found = html.main_texts(df, group=group).collect()
        assert len(found) == 902
        assert sorted((r.page_id, r.text) for r in found if r.url != "http://one/x") == [(i, own[i % 4]) for i in range(600)]
        assert {r.text for r in found if r.url == "http://one/x"} == {"a b"}
        assert sum(r.page_id is None for r in found) == 2


def test_size_of_groups_decides_nothing(spark):
    """Runs and near copies of a host are counted over all its pages, however many groups they are dealt to."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    notes = [" ".join(f"n{j}x{k}" for k in range(12)) for j in range(3)]
    pages = []
    for i in range(90):
        own = [f"w{i % 75}x{k}" for k in range(40)]
        own[20] = f"y{i}"
        # shares of pages near the bound of 30 %: 28, 31 and 34 %
        extra = "".join(f"<p>{n}</p>" for n, share in zip(notes, (0.28, 0.31, 0.34)) if rng.random() < share)
        page = f"<div>{extra}<p>{' '.join(own)}</p></div>"
        pages.append((i, "http://open/x", page))
        pages.append((100 + i, "http://marked/x", f"<article>{page}</article>"))
    pages.append((300, "http://marked/x", None))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    expected = {}
    for host in ("open", "marked"):
        some = [p for p in pages if host in p[1]]
        table = pa.table({"page_id": [p[0] for p in some], "url": [p[1] for p in some], "html": pa.array([p[2] for p in some], pa.string())})
        expected |= dict(zip(table["page_id"].to_pylist(), html._extract(table)["text"].to_pylist()))
    for group in (16, html.GROUP):
        assert {r.page_id: r.text for r in html.main_texts(df, group=group).collect()} == expected


def test_near_copies_by_hand():
    def labels(*texts):
        words = [t.split() for t in texts]
        ids = {}
        tokens = np.array([ids.setdefault(w, len(ids)) for t in words for w in t], np.int64)
        return html.near_copies(tokens, np.repeat(np.arange(len(words)), [len(t) for t in words]), np.arange(len(words))).tolist()

    a = [f"a{k}" for k in range(40)]
    b = [*a[:20], "b", *a[21:]]
    c = [*b[:5], "c", *b[6:]]
    d = [*a[:12], *(f"d{k}" for k in range(28))]
    join = " ".join
    assert labels(join(a), join(b), join(c), join(d)) == [0, 0, 0, 1]
    assert labels("x y", "x y z", "") == [0, 1, 2] and labels("", "") == [0, 1]
    assert labels() == []


def test_shared_runs_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        tokens, pages = rng.integers(0, 3, 120), np.sort(rng.integers(0, 5, 120))
        texts = np.array([0, 1, 2, 3, 3])
        found = html.repeated(tokens, pages, texts, 4, 3)
        runs = {}
        spans = [i for i in range(117) if pages[i] == pages[i + 3]]
        for i in spans:
            runs.setdefault(tuple(tokens[i : i + 4]), set()).add(texts[pages[i]])
        expected = np.zeros(120, bool)
        for i in spans:
            expected[i : i + 4] |= len(runs[tuple(tokens[i : i + 4])]) >= 3
        assert (found == expected).all()


def test_near_vectors(spark, sf_dir, rows):
    given = [(r.vec_id, r.embedding) for r in queries.table(spark, sf_dir, "embeddings").collect()]
    assert rows(queries.op8_int8_tiles(spark, sf_dir)) == brute.near_vectors(given)
    odd = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [2.0, 0.0]), (5, [2.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]),
        (8, [float("inf"), 1.0]), (9, [1e200, 1e199]), (10, [1.0, 0.0, 0.0]), (11, [1.0, 0.3]),
    ]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<double>").withColumn("node", F.lit(1)).withColumn("tile", F.lit(1))
    assert rows(embeddings.near_vectors(df, tile=2)) == brute.near_vectors(odd)
    assert rows(embeddings.near_vectors(df.limit(0))) == []


def test_links_across_tiles(spark, rows):
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(20, 16)), 15, 0) + rng.normal(size=(300, 16)) * 0.2
    given = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    assert rows(embeddings.near_vectors(df, tile=32)) == brute.near_vectors(given)


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(0)
    unit = embeddings._unit(rng.normal(size=(200, 64)) ** 3)
    q = embeddings.Quantised.of(unit)
    every = slice(0, 200)
    assert (np.abs(unit @ unit.T - q.approx(every, q)) <= q.bound(every, q)).all()
