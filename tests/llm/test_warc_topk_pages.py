import base64
import hashlib
import io
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quizloom.llm import common, pages, registry, topk, warc

SMALL = "/root/testdata/sf0.001"


def test_archives_round_trip(spark):
    rows = [(i, f"http://h/{i}", f"<p>{'x' * (i % 5)}é{'lorem ipsum ' * 300}</p>", i) for i in range(200)]
    rows += [(500, None, None, 0), (None, "u\r\nv", "", 0), (3, "http://h/3", rows[3][2], 3), (900, "http://h", "a\r\n\r\nWARC/1.1" * 20_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to long").repartition(3)
    manifest = warc.write_archives(df, common.shared_dir(spark))
    got = warc.read_archives(manifest).collect()
    assert manifest.groupBy().sum("n_records").first()[0] == len(rows) == len(got)
    first = {}
    for k, _, h, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", k)
    want = []
    for k, _, h, _ in rows:
        data, to = (h or "").encode(), first[h or ""]
        again = to != k
        want.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", to if again else None, None if again else data))
    assert sorted(map(str, want)) == sorted(str((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))) for r in got)
    assert warc.archive_pages(df.limit(0)).isEmpty()


def test_smaller_payloads_are_written_again(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(df, common.shared_dir(spark), min_revisit=5))
    assert sorted((r.key, r.record_type) for r in got.collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_dictionary_frame_leads_each_archive():
    data = warc.dictionary_frame(b"") + b""
    assert list(warc.read_archive(io.BytesIO(data))) == [] and data[:4] == (0x184D2A5D).to_bytes(4, "little")
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(b"\0" * 16)))


def leading_dictionaries(manifest):
    out = []
    for r in manifest.collect():
        with open(r.path.removeprefix("file://"), "rb") as f:
            magic, n = struct.unpack("<II", f.read(8))
            assert magic == 0x184D2A5D
            out.append(f.read(n))
    return out


PAGE_TABLES = {
    "one page": [(1, "u", "x")],
    "one large page": [(1, "u", "".join(f"<p>{i * i}</p>" for i in range(60_000)))],
    "equal pages": [(i, "u", "<p>the same page</p>" * 40) for i in range(300)],
    "empty pages": [(i, None, None) for i in range(20)],
    "null keys": [(None, "u", f"<p>{i}</p>" * 20) for i in range(3000)],
    "different pages": [(i, f"http://h/{i}", f"<html><body><h1>{i}</h1>" + f"<p>words {i % 7}</p>" * 50) for i in range(600)],
}


@pytest.mark.parametrize("name", PAGE_TABLES)
def test_every_archive_has_a_dictionary(spark, name):
    rows = PAGE_TABLES[name]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), common.shared_dir(spark))
    dictionaries = leading_dictionaries(manifest)
    assert dictionaries and all(0 < len(d) <= warc.DICT_BYTES for d in dictionaries)
    back = warc.read_archives(manifest).collect()
    assert len(back) == len(rows)
    assert {r.payload.decode() for r in back if r.record_type == "response"} == {h or "" for _, _, h in rows}
    if name == "different pages":
        assert dictionaries[0].startswith(b"\x37\xa4\x30\xec")  # trained
        press = lambda d: sum(len(zstandard.ZstdCompressor(dict_data=d).compress(warc.record(k, u, h.encode(), False, None))) for k, u, h in rows)
        assert press(zstandard.ZstdCompressionDict(dictionaries[0])) < 0.7 * press(None)


def brute_top(rows, k):
    ok = {i: np.floor(1024.0 * np.array(v, "f8")).astype("i8") for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in ok if i % 100 == 0):
        best = sorted((-int(ok[q] @ ok[c]), c) for c in ok if c != q and len(ok[c]) == len(ok[q]))[:k]
        out += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    return out


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype("f4")]) for i in range(0, 3000, 7)]
    rows += [(10_000 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(1, None), (200, [1.0, None] * 4), (300, [float("nan")] * 8), (400, [float("inf")] * 8), (None, [1.0] * 8), (20_000, [0.5, 2.0]), (20_100, [1.0, 1.0]), (30_000, []), (30_001, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(map(tuple, topk.embedding_neighbours(df).collect()))
    assert got == sorted(brute_top(rows, 10))
    assert topk.embedding_neighbours(df.limit(0)).isEmpty()


def test_top_k_in_a_grid_with_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_ROWS", 200)
    monkeypatch.setattr(topk, "TILE", 64)
    monkeypatch.setattr(topk, "BLOCK", 4)
    rng = np.random.default_rng(2)
    rows = [(i * 10, [float(x) for x in rng.normal(size=4).astype("f4")], "x", i, 1) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, grp string, rank int, score int").repartition(3)
    got = sorted(map(tuple, topk.embedding_neighbours(df).collect()))
    assert got == sorted(brute_top([r[:2] for r in rows], 10))
    assert topk.grid(10**9, 10**7)[1] > 1 and topk.grid(1500, 150) == (7, 1) and topk.grid(1500, 1500)[1] > 1


def test_tile_with_scores_beyond_double_precision():
    q, c = np.array([[1 << 29, 3]], "i8"), np.array([[1 << 29, 1], [1 << 29, 2], [1 << 29, 2]], "i8")
    ids, best, scores = topk.tile_best(np.array([0]), q, np.array([5, 6, 7]), c, 2)
    assert best.tolist() == [6, 7] and scores.tolist() == [(1 << 58) + 6] * 2
    with pytest.raises(OverflowError):
        topk.tile_best(np.array([0]), q << 4, np.array([5, 6, 7]), c, 2)


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>{open}<h1>Title &amp; more</h1><p>First <b>bold</b>&nbsp; text<p>Second&#33;<br>line</p>
<form><p>Subscribe</p></form><div class="comments"><p>Nice!</p></div><blockquote>a &lt; b</blockquote>{close}<aside>Side</aside><section id="comments"><p>Me too</p></section><footer>&copy; x</footer></body></html>"""
WANT = "Title & more\nFirst bold text\nSecond! line\na < b"


@pytest.mark.parametrize("tag", ["article", "main", 'div class="content"'])
def test_main_text(spark, tag):
    name = tag.split()[0]
    html = PAGE.format(open=f"<{tag}>", close=f"</{name}>")
    rows = [(i, f"http://host/{i}", html.replace("First", f"First {i} " + "word " * i).replace(f"First {i} " + "word " * i, "First" if i == 0 else f"First {i}")) for i in range(5)]
    rows += [(10, "http://alone/x", html), (11, None, html), (12, "http://host/9", None), (13, "http://host/10", ""), (14, "nonsense", "plain &amp; simple\n text"), (15, "http://host/2", "<article><p>cut <b>off")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.extract(df).collect()}
    assert got[0].text == got[10].text == got[11].text == WANT and got[0].n_chars == len(WANT)
    assert got[3].text == WANT.replace("First", "First 3")
    assert [got[i].text for i in (12, 13, 14, 15)] == ["", "", "plain & simple text", "cut off"]
    assert pages.extract(df.limit(0)).isEmpty()


def test_pages_query_against_a_direct_reading(spark):
    import html as entities
    import re

    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r.page_id: r.text for r in registry.op7_pages(spark, SMALL).collect()}
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", body))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_furniture_is_told_by_element_not_by_path():
    words = "the article's own words " * 20
    for mark in ('<div id="header">', '<div role="navigation">'):
        page = pages.Page(f'<body><div id="intro">before {words}</div>{mark}<div>links</div></div><div id="content"><p>{words}</p></div></body>')
        text = page.text_of(None)
        assert text.count("article's") == 40 and "links" not in text


def test_a_name_alone_discards_no_main_slot():
    words = "the article's own words " * 20
    for name in ("content with-sidebar", "post has-sidebar", "layout no-sidebar", "site-content has-header"):
        for tag in ("article", "div"):
            page = pages.Page(f'<body><div class="sidebar">links</div><div class="{name}"><{tag} class="{name}"><p>{words}</p><div class="share">post this</div></{tag}></div></body>')
            assert page.text_of(pages.main_slot(page.chars())) == words.strip()


def test_only_valid_classes_are_gathered(spark):
    rows = [(i, "http://h/x", f'<body class="postid-{i}"><div><p>own {i}</p></div></body>') for i in range(8)]
    rows += [(i, "http://h/x", f"<html><body><div><p>other {i}</p></div></body></html>") for i in range(8, 20)]
    found = pages.templates(spark.createDataFrame(rows, "page_id long, url string, html string"), "url", "html")
    assert [(r.host, [t.path for t in r.template]) for r in found.collect()] == [("h", ["html", "html/body", "html/body/div", "html/body/div/p"])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1 and "Filter" in plan.split("collect_list")[1]


def plain_site(n):
    """Pages of div elements alone: a fixed menu, a varying offer, the article, a fixed notice in it, a fixed imprint."""
    rows, want = [], {}
    for i in range(n):
        article = [f"title {i}", *(f"paragraph {i} {j} " + "text " * (1 + (i * j) % 30) for j in range(1 + i % 4))]
        offer = f"offer {i} " + "buy " * (60 if i % 5 == 0 else 3)
        blocks = "".join(f"<p>{x}</p>" for x in article)
        html = f"<html><body><div><p>Start</p><p>News</p></div><div>{offer}</div><div><p>All rights of this text are reserved</p>{blocks}</div><div>Imprint and contact</div></body></html>"
        rows.append((i, "http://plain.example/" + str(i), html, "x", "y"))
        want[i] = "\n".join(" ".join(x.split()) for x in article)
    return rows, want


def test_a_template_finds_the_article_without_names(spark):
    rows, want = plain_site(40)
    df = spark.createDataFrame([*rows, rows[7]], "page_id long, url string, html string, text string, slot string").repartition(4)
    got = pages.extract(df).collect()
    assert len(got) == 41 and {r.page_id: r.text for r in got} == want
    alone = pages.extract(df.withColumn("url", F.concat(F.lit("http://h"), "page_id", F.lit(".example/"))).where("page_id <> 7"))
    assert sum(r.text != want[r.page_id] for r in alone.collect()) > 30  # each page on a host of its own: no template


def test_deduction_against_occurrence_vectors(spark):
    """Classes by whole vectors and a slot by walking from the root, over parsed trees."""
    from collections import Counter, defaultdict

    rows, _ = plain_site(30)
    rows = [(k, u, h.replace("<p>News</p>", "") if k % 9 == 0 else h) for k, u, h, _, _ in rows]
    times, chars = defaultdict(Counter), Counter()
    for k, _, h in rows:
        for path, token, n, size in pages.Page(h).tokens():
            times[path, token][k] += n
            chars[path, token] += size
    classes = defaultdict(list)
    for token, on in times.items():
        if len(on) >= pages.MIN_PAGES:
            classes[tuple(sorted(on.items()))].append(token)
    valid = {t for on, tokens in classes.items() if len(tokens) >= pages.MIN_TOKENS and 2 * len(on) >= len(rows) for t in tokens}
    found = pages.templates(spark.createDataFrame(rows, "page_id long, url string, html string"), "url", "html").first()
    assert {(t.path, None) for t in found.template} | {(t.path, t.token) for t in found.fixed} == valid
    assert {(t.path, t.chars) for t in found.template} == {(p, chars[p, t]) for p, t in valid if t is None}
    assert any(t is not None for _, t in valid) and not any("News" in str(t) for t in found.template)


def test_copies_for_pages_and_a_very_long_page(spark):
    rows, want = plain_site(8)
    same = [(i, "http://copies.example/", rows[1][2].replace("<div><p>All", "<article><p>All").replace("</div><div>Imprint", "</article><div>Imprint")) for i in range(20)]
    long = "<article>" + "<p>a very long page</p>" * 60_000 + "</article>"
    df = spark.createDataFrame([*same, (100, "http://long.example/", long), (None, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert all(got[i] == "All rights of this text are reserved\n" + want[1] for i in range(20))
    assert got[100] == "\n".join(["a very long page"] * 60_000) and got[None] == ""


def article_page(i, frame, tag):
    """Article i in a frame: its name, a menu, a notice in the slot, an offer and an imprint, some of which change."""
    body = "".join(f"<p>{f'article {i} says in its paragraph {j} ' * 6}</p>" for j in range(5))
    want = "\n".join(" ".join((f"article {i} says in its paragraph {j} " * 6).split()) for j in range(5))
    notice = "<p>Please read this with care</p>"
    html = f"<html><body><div><p>Start</p><p>News</p></div><div><p>offer {frame} {'buy ' * (frame % 4)}</p></div><{tag}>{notice}{body}</{tag}><div>Imprint and contact</div></body></html>"
    return html, want


@pytest.mark.parametrize("tag", ["div", "article"])
@pytest.mark.parametrize("frames", ["one", "differing"])
@pytest.mark.parametrize("copies", [2, 5, 6, 8, 10])
def test_hosts_that_are_partly_copies_lose_no_article(spark, copies, frames, tag):
    rows, want = [], {}
    for host in range(2):
        for k in range(10):
            i = 0 if k < copies else k
            html, text = article_page(i, k if frames == "differing" else 0, tag)
            rows.append((100 * host + k, f"http://h{host}.example/{k}", html))
            want[100 * host + k] = text
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, text in want.items():
        own = got[k].removeprefix("Please read this with care\n")
        assert own == text, (k, got[k][:80])


@pytest.mark.parametrize("tag", ["div", "article"])
def test_two_articles_shared_half_and_half(spark, tag):
    rows = [(k, f"http://h.example/{k}", article_page(k % 2, k, tag)[0]) for k in range(12)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].endswith(article_page(k % 2, k, tag)[1]) for k in got)


def test_versions_of_one_article_keep_their_common_text(spark):
    """Pages that differ in one line of the slot: what they share outweighs it, so it stays."""
    rows, want = [], {}
    for k in range(10):
        html, text = article_page(0 if k < 6 else k, 1, "article")
        rows.append((k, f"http://h.example/{k}", html.replace("</article>", f"<p>version {k}</p></article>")))
        want[k] = f"{text}\nversion {k}"
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: t.removeprefix("Please read this with care\n") for k, t in got.items()} == want


def test_a_host_s_notice_goes_from_articles_that_differ(spark):
    rows = [(k, f"http://h.example/{k}", article_page(0 if k < 3 else k, k, "div")[0]) for k in range(20)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: article_page(0 if k < 3 else k, k, "div")[1] for k in range(20)}


def test_furniture_inside_the_deduced_slot(spark):
    rows = [
        (i, "http://inner.example/", f'<body><div>menu</div><div><h1>title {i}</h1><p>{f"words of page {i} " * 9}</p><form>ask {i}</form><div class="comments"><p>reader {i} says</p></div><aside>aside {i}</aside></div></body>')
        for i in range(12)
    ]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"title {i}\n" + f"words of page {i} " * 8 + f"words of page {i}" for i in range(12)}
