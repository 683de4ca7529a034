import html
import re

from matrixloom.llm import html_extract as H

SF = "/root/testdata/sf0.01"


def expected(page):
    """The text as the given pages are built: paragraphs of one article."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    inner = re.sub(r"</?b>", "", inner.replace("<br>", " "))
    blocks = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = H.op9_html_extract(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == expected(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def text(page, winner=None):
    return H.text_of(H.blocks_of(page), winner)


def test_dropped_parts():
    page = """<!doctype html><html><head><title>T</title><style>x{}</style></head><body class="page">
    <header><h1>Site</h1></header><nav>Home</nav><div id="cookie-notice">We use cookies</div>
    <div class="wrap"><div class="content-12"><h2>Title &amp; more</h2><p>First <b>bold
      text</b>,&nbsp;<a href="#">link</a>.<br>next<p>Second &lt;b&gt; &#233;<ul><li>one<li>two</ul><script>var a = "</p>";</script>
    <div class="adBox">advert</div><form><p>Sign up</p></form><blockquote>Quoted</blockquote></div>
    <aside>Side</aside><div id="comments"><p>Reader says a lot of things here, more than anyone else on the page, on and on and on.</p></div></div>
    <footer>(c)</footer></body></html>"""
    assert text(page) == "Title & more\n\nFirst bold text, link. next\n\nSecond <b> é\n\none\n\ntwo\n\nQuoted"


def test_odd_markup():
    assert text(None) == "" and text("") == "" and text(" <p> ") == ""
    assert text("plain & simple") == "plain & simple"
    assert text("<p>a<p>b</div>c") == "a\n\nbc"  # an end without a start is no boundary
    assert text("<article><p>x < y and a<b</p>") .startswith("x < y and a")
    assert text("<article>a<!-- b --><!-- unclosed <p>c") == "a"
    assert text("<article><p>" + "<b>" * 3000 + "deep" + "</b>" * 3000 + "</p></article>") == "deep"
    assert text("<div>" * 5000 + "deep") == "deep"
    assert text("<article><p>one<script>never closed <p>two") == "one"
    assert text("<article><header><h1>Head</h1><p>by me</p></header><p>Body</p></article>") == "Head\n\nBody"


def test_offsets_and_comments():
    assert text("<article><p>" + "İ" * 9 + " one</p><SCRIPT>var a = '<p>';</Script ><p>two</p></article>") == "İ" * 9 + " one\n\ntwo"
    assert text("<article><p>one</p><!--><p>two</p><!---><p>three</p><!-- > --><p>four</p></article>") == "one\n\ntwo\n\nthree\n\nfour"
    assert text("<article><p>a</p><script>x</scripty></script><p>b</p></article>") == "a\n\nb"


def test_names_that_only_hint():
    body = "<p>" + "text " * 90 + "end</p>"
    want = " ".join(["text"] * 90 + ["end"])
    inner = "<div class='social-science notice-period'><p>Of notice periods</p></div>"
    assert text(f"<body><article>{body}{inner}</article></body>") == want + "\n\nOf notice periods"
    for names in ("site-nav", "nav_main", "comment-list-2", "ad-slot-x7", "share", "newsletter-signup", "cookieBanner", "user-comments-thread"):
        assert text(f"<body><article>{body}<div class='{names}'><p>part</p></div></article></body>") == want, names


def test_host_decides_on_hints(spark):
    """Same texts or links under a hinted path go on all pages of the host; different prose stays."""
    def page(i):
        inner = f"<div class='notice-period'><p>Period number {i} of {i * 7} days</p></div><div class='cookie-hint-xy'><p>We use cookies</p></div><div class='related-reading'><a href='#'>Read {i} next</a></div>"
        return f"<body><article><p>{'word ' * 60}{i}</p>{inner}</article></body>"

    rows = [(i, f"http://h.example.com/{i}", page(i)) for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (H.BROADCAST_PATHS, 0):
        for r in H.extract(pages, broadcast_paths=limit).collect():
            assert r.text.split("\n\n")[1:] == [f"Period number {r.page_id} of {r.page_id * 7} days"]


def test_containers_far_outside_a_block_are_scored():
    sections = "".join(f"<section class='s{'abcdefghij'[i]}'><h2>Head {i}</h2><div><div><div><p>{'text ' * 100}{i}</p></div></div></div></section>" for i in range(10))
    got = text(f"<body><article>{sections}</article></body>").split("\n\n")
    assert len(got) == 20 and got[0] == "Head 0" and got[-1].endswith("9")


def test_blocks_deep_below_the_winner_are_kept():
    page = "<article>" + "<p>shallow words here</p>" * 50 + "<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000 + "</article>"
    assert text(page).endswith("here\n\ndeep")
    assert text(page, H.best_path(H.blocks_of(page))[0]).endswith("here\n\ndeep")


def test_words_do_not_drop_the_article():
    body = "<p>" + "text " * 60 + "end</p>"
    want = " ".join(["text"] * 60 + ["end"])
    for names in ("class='content with-sidebar'", "class='no-sidebar'", "class='post has-comments'", "id='search-results-article'", "class='entry share-enabled'"):
        side = "<div class='sidebar'><p>" + "side " * 100 + "</p></div>"
        assert text(f"<body><p>Other words</p><div {names}><article>{body}</article>{side}</div><footer>f</footer></body>") == want
        assert text(f"<body><div {names}><div>{body}</div></div><p>Other</p></body>") == want
    assert text("<body><div class='widget'><p>only text</p></div></body>") == "only text"
    assert text("<body><p><span class='share'>only text</span></p></body>") == "only text"
    cards = "<section class='related'>" + "<article><p>card</p></article>" * 5 + "</section><div id='comments'><article class='comment-body'><p>" + "reply " * 90 + "</p></article></div>"
    assert text(f"<body><main class='c'><article>{body}</article>{cards}</main></body>") == want
    assert text("<body>" + "<div class='widget'>" * 3000 + "deep") == "deep"


def test_host_vote_overrules_a_page(spark):
    """A page whose widest container is another one is read again by its host's path."""
    normal = "<body><div class='story-{i}'><p>" + "word " * 80 + "{i}</p></div><div class='extra'><p>short</p></div></body>"
    odd = "<body><div class='story-9'><p>brief</p></div><div class='extra'><p>" + "noise " * 200 + "</p></div></body>"
    rows = [(i, f"http://h.example.com:80/{i}", normal.format(i=i), "x") for i in range(5)] + [(9, "http://H.example.com/9", odd, "x")]
    rows += [(10, "http://other.example.com/", odd, "x"), (11, None, None, "x"), (12, "http://[bad", "<p>z</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    for limit in (H.BROADCAST_PATHS, 0):
        got = {r.page_id: r.text for r in H.extract(pages, broadcast_paths=limit).collect()}
        assert got[9] == "brief" and got[10].startswith("noise") and got[11] == "" and got[12] == "z" and got[1].endswith("1")
    assert H.extract(pages.limit(0)).count() == 0
