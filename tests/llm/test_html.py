import pytest

from corpusmill.llm import html

BODY = "<p>The first paragraph is long enough, with commas, to count as text of an article.</p><p>Second &amp; last   one,\n with <b>bold</b> and <a href='#'>a link</a> inside it, fine.</p>"
TEXT = "The first paragraph is long enough, with commas, to count as text of an article. Second & last one, with bold and a link inside it, fine."
NOISE = {
    "nav": "<nav><ul><li><a href='/'>Home</a></li></ul></nav>", "menu": "<div class='top-menu'><a href='/'>Home</a> <a>News</a></div>", "header": "<header><h2>Site name, the best site</h2></header>",
    "footer": "<footer>Copyright, all rights reserved, by someone</footer>", "sidebar": "<aside><p>Related, read more, of this kind of thing, and that.</p></aside>", "side": "<div id='sidebar'><p>Popular, and more, of long text that could be an article, really.</p></div>",
    "cookie": "<div class='cookie-notice'>We use cookies, as everyone does, to make things better.</div>", "ad": "<div class='ad'>Buy now, cheap, good, and long text for an advert, isn't it.</div>",
    "form": "<form><p>Subscribe, please, to our long and good newsletter, today.</p><input></form>", "script": "<script>var p='<p>not text, at all, no, really not</p>';</script>", "style": "<style>p{a:b}</style>",
    "comments": "<section id='comments'><p>First, I say, and a reader says more, a lot more, really.</p></section>", "comment": "<!-- <p>hidden, in a comment, of some length, to be sure</p> -->", "role": "<div role='navigation'><p>A, b, c, d and some more links, as text.</p></div>",
    "hidden": "<div style='display: none'><p>Unseen, for all, at any time, whatever happens to it.</p></div>", "iframe": "<iframe src='x'><p>frame, text</p></iframe>",
}


@pytest.mark.parametrize("where", ["before", "after", "inside"])
@pytest.mark.parametrize("box", ["article", "main", "div class='content'", "div"])
@pytest.mark.parametrize("kind", sorted(NOISE))
def test_noise_goes(kind, box, where):
    tag = box.split()[0]
    inner = BODY.replace("</p><p>", f"</p>{NOISE[kind]}<p>", 1) if where == "inside" else BODY
    if kind == "header" and where == "inside" and tag in ("article", "main"):
        pytest.skip("an article's own header is its text")
    page = f"<html><head><title>T, t</title></head><body>{NOISE[kind] if where == 'before' else ''}<{box}>{inner}</{tag}>{NOISE[kind] if where == 'after' else ''}</body></html>"
    assert html.main_text(page) == TEXT


@pytest.mark.parametrize("name", ["leftSidebar", "site-header", "cookieBanner", "page_footer", "adsbygoogle", "userComments", "top-nav", "relatedPosts"])
def test_names_of_noise(name):
    noise = f"<div class='{name}'><p>Some more, or less, of text that is long enough, and has commas, to count.</p></div>"
    assert html.main_text(f"<body>{noise}<div class='content'>{BODY}</div>{noise}</body>") == TEXT


@pytest.mark.parametrize("name", ["has-sidebar", "post comments-open", "layout no-ads", "entry-header", "commentary", "shadow", "notice-period", "social-history", "share-price", "cookie-recipe"])
def test_names_that_are_none(name):
    assert html.main_text(f"<body><nav><a>x</a></nav><div class='{name}'>{BODY}</div></body>") == TEXT


def test_article_is_whole():
    page = f"<body><nav><a>x</a></nav><article><header><h1>Title</h1></header>{BODY}<ul><li>one</li><li>two</li></ul><table><tr><td>cell<td>next</table><p>Ok.</p><pre>a  b</pre><blockquote>Quote</blockquote></article></body>"
    assert html.main_text(page) == f"Title {TEXT} one two cell next Ok. a b Quote"


def test_defined_cases():
    assert html.main_text(None) == html.main_text("") == html.main_text("<html></html>") == html.main_text("<script>x</script>") == ""
    assert html.main_text("just text &lt;b&gt; &#233;") == "just text <b> é"
    assert html.main_text("<p>one<p>two<div>three</p>four") == "one two three four"
    assert html.main_text("<b>a<i>b</b>c</i>") == "abc"
    assert html.main_text("<p>2 < 3 and 4 > 1</p>").startswith("2 < 3 and 4 > 1")
    assert html.main_text("<div>" * 20000 + "deep" + "</div>" * 20000) == "deep"
    long = "<article>" + "<p>word, and more of it.</p>" * 50000 + "</article>"
    assert html.main_text(long).count("word") == 50000
    assert html.main_text("<article><p>unclosed, <b>bold <a href=\"x\">link") == "unclosed, bold link"
    assert html.main_text("<p title='a > b'>quoted</p>") == "quoted"


def test_report(spark):
    schema = "page_id long, url string, html string, text string"
    df = spark.createDataFrame([(1, "u", f"<article>{BODY}</article>", "clash"), (2, None, None, None), (None, "v", "", "x"), (1, "u", f"<article>{BODY}</article>", "clash")], schema)
    got = sorted((tuple(r) for r in html.report(df).collect()), key=str)
    assert got == sorted([(1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (2, None, "", 0), (None, "v", "", 0)], key=str)
    assert html.report(df.limit(0)).collect() == []
    assert html.with_main_text(df).columns == [*df.columns, "main_text"]


@pytest.mark.parametrize("tag", ["script", "STYLE", "svg"])
def test_raw_element_after_letters_that_grow_in_lower_case(tag):
    dotted = "<p>İİİİİİİİİİİİ İstanbul is, as all know, a large city, on two continents, of many people.</p>"
    page = lambda raw: f"<html><body><article>{dotted}{raw}{BODY}</article></body></html>"
    assert html.main_text(page(f"<{tag}>var a = 1</{tag.swapcase()}>")) == html.main_text(page(""))
    assert TEXT.split(".")[0] in html.main_text(page(f"<{tag}>var a = 1</{tag}>"))


@pytest.mark.parametrize("raw", ["<script>if(a<b){x()} // don't</script>", '<script><!-- var x=1; </script>', "<script>'</scripty>'</script >", "<style>a:after{content:'<'}</style>", "<!-- <p>it's --><!-->"])
def test_raw_elements_end(raw):
    page = lambda x: f"<html><head>{x}</head><body>{x}<article><p>It's one, it's two, it's long enough, really.</p>{x}{BODY}</article></body></html>"
    assert html.main_text(page(raw)) == html.main_text(page("")) == f"It's one, it's two, it's long enough, really. {TEXT}"


def test_text_is_not_lost():
    inline = "<p>Let <math><mi>x</mi></math> be, press <button>Save</button> or <label>this</label>, and go on, as long as you like.</p>"
    assert html.main_text(f"<article>{inline}</article>") == "Let x be, press Save or this, and go on, as long as you like."
    assert html.main_text(f"<article>{BODY}<ul><li><a href='1'>One link</a></li><li><a href='2'>Two</a></li></ul></article>") == f"{TEXT} One link Two"
    assert html.main_text(f"<body>Bare text before <b>it</b>, <div class='content'>{BODY}</div> and after.</body>") == f"Bare text before it, {TEXT} and after."
    assert html.main_text(f"<body><form action='x'><h1>Title</h1><article>{BODY}</article></form></body>") == TEXT or html.main_text(f"<body><form action='x'><h1>Title</h1><article>{BODY}</article></form></body>") == f"Title {TEXT}"
    assert html.main_text("<p title=it's>one</p><p>it's two") == "one it's two"
    assert html.main_text("<div><button>Share</button></div><p>Some words, in a line, and on.</p>") == "Some words, in a line, and on."


@pytest.mark.parametrize("unit", ["</i>", "<b>", "<b></i>", "<a x=\">\"", "<a ", "<p><i></b>", "<table></i>", "<!--", "<!", "&", "<li>", "<a x='"])
def test_time_is_linear(unit):
    import time

    def took(n):
        began = time.process_time()
        html.main_text("<b>" * (n // 50) + "<i>" + unit * (n // len(unit)) + "end")
        return time.process_time() - began

    assert took(400_000) < 8 * took(100_000) + 0.5
