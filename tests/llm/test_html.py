from html.parser import HTMLParser

import pytest

from taxolink.llm.html_text import extract_pages, extract_text

LONG = "This is a sentence of the article, with commas, and enough words to be scored as prose by the extractor."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


CUT = [
    '<nav><ul><li><a href="/a">Home</a></li></ul></nav>', "<header><h1>Site name</h1><p>Slogan, with commas, here.</p></header>",
    f"<footer><p>{LONG.replace('article', 'footer')}</p></footer>", f'<aside class="x"><p>{LONG} aside</p></aside>',
    f'<div class="sidebar"><p>{LONG} side</p></div>', f'<div id="cookie-notice">{LONG} cookies</div>',
    f'<div class="ad">{LONG} buy</div>', f'<form action="/s"><p>{LONG} form</p><input name=q></form>',
    "<script>var t='</p><p>not text, really, not</p>';</script>", "<style>p{margin:0}</style>", "<!-- a comment, with, commas -->",
    f'<div class="comments"><div class="comment"><p>{LONG} I disagree</p></div></div>',
    f'<section id="comments"><p>{LONG} reader</p></section>', f'<div role="navigation"><p>{LONG} nav</p></div>',
    f'<div class="newsletter-signup"><p>{LONG} mail</p></div>', "<noscript>enable scripts, please</noscript>",
    f'<p class="notice">{LONG} maintenance tonight.</p>', f'<div class="siteFooter"><p>{LONG} imprint</p></div>',
    f'<div id="header"><p>{LONG} site</p></div>', f'<div style="display: none"><p>{LONG} hidden</p></div>',
    f'<div class="article-comments"><p>{LONG} me too</p></div>', f'<div class="related-articles"><p>{LONG} next</p></div>',
    '<ul class="menu"><li>One, two, three, four, five, six, seven, eight</li></ul>',
]


@pytest.mark.parametrize("cut", CUT)
@pytest.mark.parametrize("box", ["<article>{}</article>", '<div class="content">{}</div>', "<div>{}</div>", "<main>{}</main>"])
def test_boilerplate_around_the_article_goes(cut, box):
    html = page(cut + box.format(f"<h1>Title here</h1><p>{LONG}</p><p>Short &amp; last.</p>") + cut)
    assert extract_text(html) == f"Title here\n{LONG}\nShort & last."


@pytest.mark.parametrize("cut", CUT[8:16])
def test_boilerplate_inside_the_article_goes(cut):
    html = page(f"<article><p>{LONG}</p>{cut}<p>{LONG} two</p></article>")
    assert extract_text(html) == f"{LONG}\n{LONG} two"


def test_blocks_space_references_and_unclosed_tags():
    html = page(f"<article><h1>A&nbsp;&lt;b&gt; &#8364;</h1><p><b>{LONG}\n  more<br>text<br><p>  Next &copy; one \t two"
                "<ul><li>first<li>second <i>third</i></ul><blockquote>said</blockquote>tail text</article>")
    assert extract_text(html).split("\n") == [
        "A <b> €", f"{LONG} more text", "Next © one two", "first", "second third", "said", "tail text"]


@pytest.mark.parametrize("names", ["content with-sidebar", "post comments-open", "no-ads story", "loaded shared header-image"])
def test_names_that_only_sound_unwanted_stay(names):
    assert extract_text(page(f'<div class="{names}"><p>{LONG}</p></div><p>Bye</p>')) == LONG


def test_text_beside_a_marked_article_goes():
    html = page(f"<p>Follow us everywhere, please do.</p><article><p>{LONG}</p></article><p>{LONG} elsewhere</p>")
    assert extract_text(html) == LONG


def test_siblings_of_the_best_container_are_kept():
    html = page(f"<div class=wrap><div class=story><p>{LONG}</p><p>{LONG} b</p></div><p>{LONG} sibling</p>"
                f"<div class=links><p><a href=x>{LONG} link</a></p></div></div>")
    text = extract_text(html)
    assert f"{LONG} sibling" in text and "link" not in text


@pytest.mark.parametrize("left_out", [
    ["</head>"], ["</head>", "<body>"], ["</body>", "</html>"], ["</head>", "</body>", "</html>"],
    ["</head>", "<body>", "</body>", "</html>"], ["<html>", "<head>", "</head>", "<body>", "</body>", "</html>"]])
@pytest.mark.parametrize("body", [f"<article><h1>Title</h1><p>{LONG}</p></article>", f"<p>{LONG}</p>", LONG])
def test_end_tags_of_head_body_and_html_left_out(left_out, body):
    html = page(body, '<meta name=x><link rel=y><style>p{}</style><noscript><style>q{}</style></noscript>')
    expected = extract_text(html)
    for tag in left_out:
        html = html.replace(tag, "")
    assert extract_text(html) == expected and LONG in expected


@pytest.mark.parametrize("tag", ["nav", "aside", "footer", "form", "dialog", "menu", "button", "object", "noscript"])
@pytest.mark.parametrize("inside", ["<p>Menu", "<li>Menu", "<div>Menu", "<ul><li>Menu", "<p>Menu <input><div><p>more"])
def test_unclosed_blocks_inside_unwanted_sections(tag, inside):
    cut = f"<{tag}>{inside}</{tag}>"
    assert extract_text(page(f"{cut}<article><p>{LONG}</p></article>")) == LONG
    assert extract_text(page(f"<article><p>{LONG}</p>{cut}<p>{LONG} two</p></article>")) == f"{LONG}\n{LONG} two"
    listed = f"<ul><li>{LONG}{cut}<li>{LONG} two</ul>"
    assert extract_text(page(f"<article>{listed}</article>")) == f"{LONG}\n{LONG} two"


@pytest.mark.parametrize("tag", ["nav", "aside", "footer", "dialog", "menu"])
def test_unwanted_section_ends_an_open_paragraph(tag):
    html = page(f"<article><p>{LONG}<{tag}><p>Menu</{tag}>tail text<p>{LONG} two</article>")
    assert extract_text(html) == f"{LONG}\ntail text\n{LONG} two"


ARTICLE = f"<h1>Title here</h1><p>{LONG}</p><p>{LONG} two</p>"
TEXT = f"Title here\n{LONG}\n{LONG} two"


@pytest.mark.parametrize("box", [
    '<form id="aspnetForm"><input type=hidden>{}<select><option>x</select></form>',
    '<form><div class="search-box">Search <input></div><article>{}</article></form>',
    '<article class="post category-announcements">{}</article>', '<article class="tag-social-media">{}</article>',
    '<div id="search-page">{}</div>', '<div id="search-page"><div class="subscribe-wrap"><article>{}</article></div></div>',
    '<div class="social-page"><p>By the staff of the search page, today.</p>{}</div><p>Some imprint of the company here</p>',
    '<main class="page-widget">{}</main>'])
def test_unwanted_names_and_forms_around_the_article_stay(box):
    cut = f'<nav><p>Menu</nav><div class="sidebar"><p>{LONG} side</p></div>'
    assert TEXT in extract_text(page(cut + box.format(ARTICLE)))
    assert f"{LONG} side" not in extract_text(page(cut + box.format(ARTICLE)))


def test_inline_elements_and_topics_stay():
    html = page(f'<article><p>{LONG} One <span class="search-hit">word</span> more, a <a class="related" href=x>link</a>.</p>'
                f'<section id="related-work"><h2>Related work</h2><p>{LONG} others</p></section></article>')
    assert extract_text(html) == f"{LONG} One word more, a link.\nRelated work\n{LONG} others"


def test_page_is_read_without_name_cuts_when_little_is_left():
    prose = [f"{LONG} {LONG} {LONG} {LONG} {LONG} {i}" for i in range(4)]
    halves = "".join(f'<div class="social-{side}"><p>{a}</p><p>{b}</p><form>Login</form></div>'
                     for side, a, b in (("left", *prose[:2]), ("right", *prose[2:])))
    assert extract_text(page(f"<div>{halves}<p>Bye</p></div>")) == "\n".join(prose)


@pytest.mark.parametrize("box", ["<article>{}</article>", '<div class="content">{}</div>', "<div>{}</div>"])
@pytest.mark.parametrize("thread", ['<div class="comments">{}</div>', '<section id="respond"><div class="replies">{}</div></section>'])
def test_a_thread_longer_than_its_article_goes(box, thread):
    long_thread = thread.format("".join(f'<div class="comment"><p>{LONG} reader {i}</p></div>' for i in range(20)))
    assert extract_text(page(box.format(ARTICLE) + long_thread)) == TEXT
    assert extract_text(page(box.format(ARTICLE + long_thread))) == TEXT


def test_a_comment_marked_as_article_inside_the_article_goes():
    assert extract_text(page(f'<article>{ARTICLE}<article class="comment"><p>{LONG} reader</p></article></article>')) == TEXT


def test_parts_of_a_marked_article_with_ids_of_their_own_are_kept():
    html = page(f'<div><article id="p1" class="part x"><p>{LONG}</p></article><article class="x part" id=p2><p>{LONG} two</p>'
                f'</article><article class="teaser"><p>{LONG} next</p></article></div>')
    assert extract_text(html) == f"{LONG}\n{LONG} two"


@pytest.mark.parametrize("short,text", [
    ("<ul><li>one<li>two</ul>", "one\ntwo"), ("<blockquote>A quote</blockquote>", "A quote"), ("<pre>x = 1</pre>", "x = 1"),
    ("<table><tr><td>1<td>2</table>", "1\n2"), ("<section><p>Short</p></section>", "Short"), ("<p>Short</p>", "Short")])
def test_short_blocks_among_the_kept_siblings_stay(short, text):
    part = "<div class=part>" + f"<p>{LONG} {LONG} {LONG} {LONG}</p>" * 3 + "</div>"
    links = "<ul><li><a href=x>elsewhere</a></ul>"
    prose = "\n".join([" ".join([LONG] * 4)] * 3)
    html = page(f"<div>{short}{part}{links}{short}{part}{short}</div>")
    assert extract_text(html) == f"{prose}\n{text}\n{prose}"


def test_short_closing_section_like_the_others_stays():
    part = "<div class=part>" + f"<p>{LONG} {LONG} {LONG} {LONG}</p>" * 3 + "</div>"
    html = page(f"<div>{part}<div class=part><p>So it ended</p></div><div class=imprint>Imprint</div></div>")
    assert extract_text(html).endswith(f"{LONG}\nSo it ended")


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>tiny</p>", "tiny"), ("<script>x</script>", ""),
    ("<p>broken < tag &amp", "broken < tag &"), ("<div><div><div>", ""), ("</p></div>odd", "odd")])
def test_odd_pages(html, text):
    assert extract_text(html) == text


def test_very_long_and_deep_pages():
    deep = "<div>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 3000
    assert extract_text(deep) == LONG
    many = "".join(f"<p>{LONG} {i}</p>" for i in range(5000))
    assert extract_text(page(f"<article>{many}</article>")).count("\n") == 4999


def test_pages_table(spark):
    rows = [(1, "u", page(f"<article><p>{LONG}</p></article>"), "x", 5), (None, None, None, None, None), (1, "u", "", "x", 2 ** 60 + 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, big long")
    out = extract_pages(df)
    assert out.columns == ["page_id", "url", "big", "text", "n_chars"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, "u", 5, LONG, len(LONG)), (None, None, None, "", 0), (1, "u", 2 ** 60 + 1, "", 0)], key=str)
    assert extract_pages(df.limit(0)).count() == 0


UNWANTED_NAMES = ["ad", "advert", "cookie-consent", "comments", "newsletter-signup", "sidebar", "related-articles", "promo"]


@pytest.mark.parametrize("name", UNWANTED_NAMES)
@pytest.mark.parametrize("box", ["article", "main"])
@pytest.mark.parametrize("body", ["<h1>Reorea. Nd.</h1><p>Short.", "<p>One, two.</p><p>Three.</p>", "Bare text"])
def test_a_short_article_beside_a_long_unwanted_element(name, box, body):
    cut = f'<div class="{name}"><p>{LONG}</p><p>{LONG} again, and again, and again</p></div>'
    want = extract_text(page(f"<{box}>{body}</{box}>"))
    assert want.split("\n")[0] in ("Reorea. Nd.", "One, two.", "Bare text")
    for html in (cut + f"<{box}>{body}</{box}>", f"<{box}>{body}</{box}>" + cut, cut + f"<{box}>{body}</{box}>" + cut):
        assert extract_text(page(html)) == want


def test_paragraphs_in_wrappers_of_their_own():
    para = "Words follow words in this paragraph without many marks between them and it goes on for a while " * 2
    paras = [f"{para}{n}" for n in ("one", "two", "three", "four")]
    for wrap in ("<div><p>{}</p></div>", "<div>{}</div>", "<div><div><p>{}</p></div></div>", "<section><p>{}</p></section>",
                 '<div class="row"><div class="col"><p>{}</p></div></div>'):
        for box in ("{}", "<div>{}</div>", '<div class="content">{}</div>'):
            html = page("<nav><a href=x>Home</a></nav>" + box.format("".join(wrap.format(p) for p in paras))
                        + "<footer>imprint</footer>")
            assert extract_text(html).split("\n") == paras, (wrap, box)


def test_a_headline_beside_the_container():
    box = f"<div class=text><p>{LONG}</p><p>{LONG} b</p></div>"
    for html in (f"<h1>Title</h1>{box}", f"<h1>Title</h1><img src=x>{box}", f"<h1>Title</h1><div><div>{box}</div></div>"):
        assert extract_text(page("<nav><a href=x>Home</a></nav>" + html)) == f"Title\n{LONG}\n{LONG} b"
    assert extract_text(page(f"<h1>Site</h1><p><a href=x>{LONG}</a></p>{box}")) == f"{LONG}\n{LONG} b"


class Article(HTMLParser):
    """Plain text of the article element of the supplied pages: blocks, line breaks and references only."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in ("b", "i", "a", "em", "strong", "span"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        if tag not in ("b", "i", "a", "em", "strong", "span"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


@pytest.mark.parametrize("size", ["0.001", "0.01", "0.1"])
def test_every_supplied_page_gives_its_article(size):
    import duckdb
    pages = duckdb.sql(f"SELECT page_id, html FROM '/root/testdata/sf{size}/pages.parquet'").fetchall()
    assert pages
    for page_id, html in pages:
        plain = Article()
        plain.feed(html)
        plain.close()
        blocks = [" ".join(b.split()) for b in plain.blocks]
        assert extract_text(html) == "\n".join(b for b in blocks if b), page_id
