import base64
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from strophe.llm import htmltext as H
from strophe.llm import warc as W


def test_warc_round_trip_of_odd_pages(spark):
    rows = [(1, "http://a/1", "<p>x</p>", "s"), (2, "http://a/2\r\nWARC-Type: no", "<p>x</p>", "s"), (3, None, "é\r\n\r\nWARC/1.1\r\n", "s"), (4, "u", None, "s"), (5, "u", "", "s"), (None, "u", "only", "s"), (7, "u", "<p>x</p>", "s"), (8, "u", "y" * 3_000_000, "s")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string")
    table = W.round_trip(df)
    big = [(r.chunk_no, len(r.data), r.bytes_so_far, r.last) for r in table.where("page_id = 8").orderBy("chunk_no").collect()]
    assert big == [(0, 1 << 20, 1 << 20, False), (1, 1 << 20, 2 << 20, False), (2, 3_000_000 - (2 << 20), 3_000_000, True)]
    got = {r.page_id: r for r in W.records(table).collect()}
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    for page, _, html, _ in rows:
        r = got[page]
        assert (r.payload_bytes, r.payload_digest, r.verified) == (len((html or "").encode()), digest(html or ""), True)
    assert {p: (r.record_type, r.refers_to) for p, r in got.items()} == {1: ("revisit", 7), 2: ("revisit", 7), 7: ("response", None), 3: ("response", None), 4: ("revisit", 5), 5: ("response", None), None: ("response", None), 8: ("response", None)}
    assert W.round_trip(df.limit(0)).collect() == []


def test_a_revisit_that_tells_otherwise_is_not_verified(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, "u", "other")]
    table = W.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.verified for r in W.records(table).collect()} == {1: True, 2: True, 3: True}
    from pyspark.sql import functions as F

    wrong = table.withColumn("declared_bytes", F.when(F.col("record_type") == "revisit", 5).otherwise(F.col("declared_bytes")).cast("long"))
    assert {r.page_id: r.verified for r in W.records(wrong).collect()} == {1: False, 2: True, 3: True}
    lost = table.where("page_id != 2")
    assert {r.page_id: r.verified for r in W.records(lost).collect()} == {1: False, 3: True}


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in W.records(W.round_trip(df, min_bytes=5)).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_bytes_of_every_page_come_back(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    back = {}
    for r in W.round_trip(pages).orderBy("page_id", "chunk_no").collect():
        back[r.page_id] = back.get(r.page_id, b"") + bytes(r.data)
    for r in pages.collect():
        assert back[r.page_id] == r.html.encode()


def test_an_archive_that_ends_early_is_an_error():
    record = b"".join(W._record(1, "u", memoryview(b"hello"), hashlib.sha1(b"hello").hexdigest(), None))
    assert [r[7] for r in W.chunks(io.BufferedReader(io.BytesIO(record)))] == [b"hello"]
    assert [r[7] for r in W.chunks(io.BufferedReader(io.BytesIO(record)), 2)] == [b"he", b"ll", b"o"]
    with pytest.raises(ValueError):
        list(W.chunks(io.BufferedReader(io.BytesIO(record[:-6]))))


def text(source):
    return H.main_text(source, set(), None)


@pytest.mark.parametrize(
    "source,want",
    [
        ("", ""),
        ("just text", "just text"),
        ("<nav>n</nav><article><h1>T</h1><p>a<p>b</article><footer>f</footer>", "T a b"),
        ("<article>one <b>two</b>three<br>four &amp; five&nbsp;six &lt;x&gt; &#233;</article>", "one twothree four five six <x> é".replace("four", "four &")),
        ("<article><p>x<script>if (a<b) document.write('<p>no</p>')</script>y</p><style>p{}</style></article>", "x y"),
        ("<article><aside>no</aside><div class='comment-list'>no</div><form>no</form><p>yes</p></article>", "yes"),
        ("<body class='has-sidebar'><main><p>yes</p></main><div id='sidebar'>no</div></body>", "yes"),
        ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
        ("<article><!-- <p>no</p> --><p title='a > b'>yes</p>", "yes"),
        ("<div role=banner>no</div><p>yes</p><div hidden>no</div><div style='display: none'>no</div>", "yes"),
        ("<article><p>open<b>bold<p>next", "openbold next"),
        ("<script>never closed <p>no", ""),
        ("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>", "deep"),
        ("<article><span class=ad>no</span>yes</article>", "yes"),
    ],
)
def test_main_text(source, want):
    assert text(source) == want


def test_templates_of_a_host_without_articles(spark):
    rows = [(i, f"http://H.example:80/{i}", f"<body><div class=top>Site name</div><div id=c><h2>T{i}</h2><p>Story number {i} has words.</p><p>More {i * 7}</p></div><div>All rights and so on</div>", 1) for i in range(6)]
    df = spark.createDataFrame([*rows, (None, None, None, 2), (7, "x", "<p>lonely", 3), (7, "x", "<p>lonely", 3)], "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in H.extract(df).collect()), key=str)
    want = [(i, f"T{i} Story number {i} has words. More {i * 7}", len(f"T{i} Story number {i} has words. More {i * 7}")) for i in range(6)]
    assert got == sorted([*want, (None, "", 0), (7, "lonely", 6), (7, "lonely", 6)], key=str)
    assert H.extract(df.limit(0)).collect() == []


def test_articles_of_copies_are_no_template(spark):
    df = spark.createDataFrame([(i, "http://h/x", "<nav>a</nav><article><p>same words</p></article>") for i in range(5)], "page_id long, url string, html string")
    assert {r.text for r in H.extract(df).collect()} == {"same words"}


def test_what_a_host_repeats_inside_its_articles_goes(spark):
    body = "<html><body><article><h1>Title {0}</h1><p>Story number {0} has words.</p><div class=zz>Read this again tomorrow, and tell all of your friends about it.</div></article></body></html>"
    copy = "<html><body><article><h1>Seen {0} times</h1><p>One story that all pages have.</p><p>And what followed.</p></article></body></html>"
    rows = [(i, "http://repeats/x", body.format(i)) for i in range(6)] + [(10 + i, "http://copies/x", copy.format(i)) for i in range(6)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i} Story number {i} has words." for i in range(6)} | {10 + i: f"Seen {i} times One story that all pages have. And what followed." for i in range(6)}


def test_repeated_rows_and_copies_keep_their_text(spark):
    body = "<html><body><div id=c><h2>Title</h2><p>The whole article stands here, and it has words.</p></div></body></html>"
    rows = [(1, "http://one/x", body)] * 3 + [(k, "http://four/x", body) for k in range(4)]
    assert {r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"Title The whole article stands here, and it has words."}


def test_slogans_inside_articles_go(spark):
    rows = [(k, "http://h/x", f"<html><body><article><p>Site slogan for all</p><h1>Title {k}</h1><p>Story {k} of its own, with words.</p>{'<p>Shared line.</p>' if k < 4 else ''}<p>Read our terms and all</p></article></body></html>") for k in range(6)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # a line that some articles share has an occurrence vector of its own and stays; what stands on every page belongs to the class of the skeleton
    assert got == {k: f"Title {k} Story {k} of its own, with words.{' Shared line.' if k < 4 else ''}" for k in range(6)}


def test_classes_are_the_groups_of_equal_occurrence_vectors(spark):
    """Against vectors written out in full."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    extra = [(1000 + k, "http://extra.example/x", f"<html><body><div class=a><p>Same</p></div><p>{k % 2}</p>{'<i>x</i><p>Twice</p><p>Twice</p>' if k % 3 else ''}</body></html>") for k in range(7)]
    pages = pages.select("page_id", "url", "html").unionByName(spark.createDataFrame(extra * 2, "page_id long, url string, html string"))
    by_host = {}
    for r in pages.withColumn("host", H.host(pages.url)).collect():
        by_host.setdefault(r.host, {})[r.html] = H.page_tokens(H.Page(r.html or ""))
    want = set()
    for host, found in by_host.items():
        vectors = {}
        for token in {t for page in found.values() for t in page if t[0] < 2}:
            vector = tuple(page.get(token, (0,))[0] for page in found.values())
            if sum(map(bool, vector)) >= H.SUPPORT * len(found):
                vectors.setdefault(vector, []).append(token)
        want |= {(host, sum(map(bool, v)), len(found), tuple(sorted(ts))) for v, ts in vectors.items()}
    got = {(r.host, r.n_pages, r.pages, tuple(sorted((t.kind, t.token) for t in r.tokens))) for r in H.classes(pages).where("n_pages is not null").collect()}
    assert got == want and len(got) > 20


def test_pages_without_main_elements_have_the_same_text(spark):
    """The template alone finds what the main elements mark, on hosts with several pages."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("host", H.host(F.col("url")))
    pages = pages.join(pages.groupBy("host").count().where("count >= 3"), "host")
    plain = pages.withColumn("html", F.regexp_replace("html", "<(/?)article", "<$1section"))
    want = {r.page_id: r.text for r in H.extract(pages).collect()}
    got = {r.page_id: r.text for r in H.extract(plain).collect()}
    assert sum(got[k] == want[k] for k in want) >= 0.97 * len(want)


def test_nested_classes():
    assert H.nested([["/html", "/html/body"], ["/html/body/p"], ["/x/y", "/x/y/z"]]) == {"/html", "/html/body", "/html/body/p"}


def test_articles_of_the_pages_are_the_documents(spark):
    """Of the pages, all articles less their heading are documents, word for word."""
    docs = {" ".join((r.text or "").split()) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    hit = 0
    for r in H.extract(pages).collect():
        head = text("<article>" + source[r.page_id].split("<h1>")[1].split("</h1>")[0] + "</article>")
        hit += r.text.removeprefix(head).strip() in docs
    assert hit == len(source)


def test_templates_are_sent_or_met_with_the_same_rows(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("host", F.lit("x")).withColumn("content", F.lit(1)).withColumn("_host", F.lit(2))
    odd = spark.createDataFrame([(900, None, "<article>a</article>"), (901, "http://a.b/c", None), (None, None, None)], "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("content", F.lit(1)).withColumn("_host", F.lit(2))
    both = pages.select(odd.columns).unionByName(odd)
    sent = sorted(map(str, H.extract(both).collect()))
    monkeypatch.setattr(H, "SENT", -1)
    assert sorted(map(str, H.extract(both).collect())) == sent and len(sent) == both.count()
