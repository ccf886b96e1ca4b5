"""Page text: planted pages, character references, broken markup, and templates deduced from a host."""

import random

from inkprint.llm import templates


def test_parts_outside_the_article_go():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
    <header class="masthead">Site</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">Cookies</div>
    <div class="ad">Buy</div><main><article><h1>Head &amp; line</h1><p>First &lt;b&gt;
      &eacute;t&#233;&nbsp;x <b>bold</b>.<br>next<p>Second &hearts; &unknown; & more<form>Mail <input name="a>b"></form>
    <aside>Side</aside><noscript>No</noscript><p></p></article><section id="comments"><p>Reader</p></section></main>
    <footer>&copy; Foot</footer><!-- <p>gone</p> --></body></html>"""
    assert templates.extract(page) == "Head & line\nFirst <b> été x bold. next\nSecond ♥ &unknown; & more"


def test_broken_and_empty_pages():
    assert templates.extract(None) == templates.extract("") == templates.extract("<html></html>") == ""
    assert templates.extract("plain  words\n here") == "plain words here"
    assert templates.extract("<article><p>cut <b>off") == "cut off"
    assert templates.extract("<article><p>a</p></article><footer>f") == "a"
    assert templates.extract("<article><p>a<!-- open") == "a"
    assert templates.extract("<article><p title=\"x>y>'\" class='z'>a < b</article><script>never ends <p>x") == "a < b"
    assert templates.extract("<div><p>one</p><p>two</p></div>") == "one\ntwo"
    assert templates.extract("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"
    assert len(templates.extract("<article><p>" + "word " * 200_000)) == 999_999


def host_pages(n, seed=1):
    rng = random.Random(seed)
    pages, texts = [], []
    for i in range(n):
        blocks = [" ".join("w%d" % rng.randrange(900) for _ in range(rng.randint(5, 30))) for _ in range(rng.randint(1, 4))]
        if i % 3 == 0:
            blocks.append("a passage that many pages of this host share")
        texts.append("\n".join(blocks))
        body = "".join(f"<p>{b}</p>" for b in blocks)
        pages.append(f"<html><body><div><p>Call us now today</p></div><div>{body}</div><div><p>All rights reserved here</p></div></body></html>")
    return pages, texts


def test_text_of_the_template_belongs_to_no_slot(spark):
    pages, texts = host_pages(40)
    rows = [(i, "https://Host.example/%d" % i, p) for i, p in enumerate(pages)]
    rows += [(100, "https://other.example/", pages[0]), (101, None, None), (102, "no url", ""), (0, rows[0][1], pages[0])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, text string, host int").repartition(4)
    found = {}
    for r in templates.extract_pages(frame).collect():
        found.setdefault(r["page_id"], []).append(r)
        assert r["n_chars"] == len(r["text"])
    assert len(found[0]) == 2
    for i, text in enumerate(texts):
        assert found[i][0]["text"] == text
    assert found[100][0]["text"] == "Call us now today\n" + texts[0] + "\nAll rights reserved here"
    assert found[101][0]["text"] == found[102][0]["text"] == "" and found[101][0]["url"] is None
    assert templates.extract_pages(frame.where("false")).count() == 0


def test_signatures_tell_vectors_apart(spark):
    pages = spark.createDataFrame([(i, "h", f"<p>same</p><i>same</i><i>same</i>{'<u>x</u>' * (1 + i % 2)}") for i in range(8)], "page_id bigint, host string, html string")
    classes = templates.deduce_templates(pages).collect()[0]["classes"]
    together = [set(c) for c in classes]
    once, twice, mixed = templates.token_hash("/p", "same"), templates.token_hash("/i", "same"), templates.token_hash("/u", "x")
    assert len(together) == 3 and not any({once, twice} <= c or {once, mixed} <= c or {twice, mixed} <= c for c in together)


def test_given_pages_have_articles_only(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = templates.extract_pages(pages).collect()
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    assert len(found) == len(html)
    for r in found:
        inside = html[r["page_id"]].split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        import html as references
        import re
        words = references.unescape(re.sub(r"<[a-z/][^>]*>", " ", inside)).split()
        assert r["text"].split() == words


def test_copies_of_an_article_are_no_template(spark):
    pages, texts = host_pages(12, seed=2)
    whole = "Call us now today\n%s\nAll rights reserved here"
    rows = [(i, "https://copies.example/%d" % i, pages[0]) for i in range(20)]
    rows += [(20, "https://copies.example/20", pages[1]), (3, rows[3][1], pages[0])]
    rows += [(100 + i, None, pages[2]) for i in range(8)]
    rows += [(200 + i, "https://mixed.example/%d" % i, pages[min(i, 11)]) for i in range(300)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    found = {r["page_id"]: r["text"] for r in templates.extract_pages(frame).collect()}
    for i in range(20):
        assert found[i] == whole % texts[0]
    assert found[20] == whole % texts[1]
    for i in range(8):
        assert found[100 + i] == whole % texts[2]
    for i in range(300):
        assert found[200 + i] == texts[min(i, 11)]


def test_words_in_names_do_not_drop_an_article():
    body = "<p>The text of the page.</p>"
    for page in (
        f'<body class="home has-sidebar"><div>{body}</div></body>', f'<html class="js no-cookies"><body>{body}</body></html>',
        f'<article class="post comments-open">{body}</article>', f'<div class="menu-history">{body}</div>',
        f'<main class="page-with-sidebar">{body}</main>', f'<div class="widget"><main>{body}</main></div>', f'<p class="notice">{body[3:]}',
    ):
        assert templates.extract(page) == "The text of the page.", page
    assert templates.extract('<h2 id="market-share">Shares</h2><p id="ad-hoc-networks">Nets</p>') == "Shares\nNets"
    for name in ("comments", "site-footer", "cookie-notice", "adBanner", "left sidebar", "newsletter-box"):
        assert templates.extract(f'<div>{body}</div><div class="{name}"><p>Away</p></div>') == "The text of the page.", name


def test_a_teaser_article_is_not_the_text():
    long = "<p>" + " ".join("w%d" % i for i in range(60)) + "</p>"
    found = templates.extract(f"<body><div>{long}{long}</div><article class=teaser><p>Read this too</p></article></body>")
    assert found.startswith("w0 w1") and found.count("w59") == 2


def test_broken_markup_takes_linear_time():
    import time

    for page in (
        '<a b="' * 170_000, "<a '" * 250_000, "<a>" * 8000 + "</b>" * 8000 + "x" * 500_000, "<" * 1_000_000, "<a " * 330_000, "<!--" * 250_000,
        "<title>" + "</title " * 120_000, "<a \">\" <a " * 80_000 + "'", "<p>" + "<div><b>" * 5000 + "<li>x" * 20_000, "<p><div>" + "<b>" * 8000 + "<li>" * 60_000,
        "<script>" * 100_000, "<ul>" + "<li><ul>" * 4000 + "</ul>" * 30_000, "<a b='\"' " * 100_000 + ">", 'x <a b=">' * 100_000,
    ):
        started = time.process_time()
        templates.extract(page)
        assert time.process_time() - started < 4, page[:40]


def test_scanner_ends_tags_as_before():
    assert templates.extract("<p title='a>b\"'>one</p><p title=\"never closed>two</p><p>three 'quoted' \"text\"</p>") == "one\ntwo\nthree 'quoted' \"text\""
    assert templates.extract("<p>a < b and c > d, <3 </p><!-- <p>no</p> --><p>e</p") == "a < b and c > d, <3\ne</p"
    assert templates.extract("<table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e<dt>f</dl>") == "a\nb\nc\nd\ne\nf"


def gathered_classes(pages):
    """The classes from occurrence vectors that are gathered whole."""
    vectors = {}
    for i, page in enumerate(pages):
        for token, n in templates.page_tokens(page)[0].items():
            vectors.setdefault(token, [0] * len(pages))[i] = n
    classes = {}
    for token, vector in vectors.items():
        if sum(n > 0 for n in vector) >= templates.SUPPORT * len(pages):
            classes.setdefault(tuple(vector), set()).add(token)
    return sorted(sorted(c) for c in classes.values() if len(c) >= templates.CLASS_TOKENS)


def test_classes_equal_those_of_gathered_vectors(spark):
    pages = host_pages(30, seed=5)[0]
    pages = [p.replace("</body>", "<ul>" + "<li><i>n</i><b>m</b></li>" * (i % 4 + 1) + "</ul></body>") for i, p in enumerate(pages)]
    frame = spark.createDataFrame([(i, "h", p) for i, p in enumerate(pages)], "page_id bigint, host string, html string").repartition(5)
    row = templates.deduce_templates(frame).collect()[0]
    assert sorted(sorted(c) for c in row["classes"]) == gathered_classes(pages)
    assert 0 < row["once"] < len(row["classes"])


def shop_pages(n, seed):
    """Pages without article or main: a heading and text between a link list and short teasers, all of which vary."""
    rng = random.Random(seed)

    def words(k):
        return " ".join("w%d" % rng.randrange(5000) for _ in range(k))

    pages, texts = [], []
    for i in range(n):
        title, blocks = words(6), [words(rng.randint(20, 60)) for _ in range(rng.randint(2, 5))]
        links = "".join(f'<li><a href="/{i}">{words(3)}</a></li>' for _ in range(6))
        teasers = "".join(f"<div><p>{words(4)}</p></div>" for _ in range(rng.randint(3, 6)))
        pages.append(
            f'<html><body><div class="top"><b>Shop</b><i>since 1900</i></div><div class="leftcol"><ul>{links}</ul></div><div class="text"><h1>{title}</h1>'
            f'{"".join(f"<p>{b}</p>" for b in blocks)}</div><div class="rightcol">{teasers}</div><div class="end"><b>Bye</b><i>for now</i></div></body></html>'
        )
        texts.append("\n".join([title, *blocks]))
    return pages, texts


def test_the_article_s_slot_is_chosen_for_the_host(spark):
    """Of 60 pages without an article element: with the host's template their own slot, without it the teasers and links as well."""
    pages, texts = shop_pages(60, 7)
    rows = [(i, "http://shop.example/%d" % i, p) for i, p in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    found = {r["page_id"]: r["text"] for r in templates.extract_pages(frame).collect()}
    assert all(found[i] == text for i, text in enumerate(texts))
    assert not any(templates.extract(p) == t for p, t in zip(pages, texts))
