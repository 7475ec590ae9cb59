import html
import re

from nightjar.llm.html import extract, main_text, path_scores, text_nodes

SENTENCE = "This is the first sentence of a longer story, told at some length. It goes on, and on; who knows why? "


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var a="</p>";</script></head><body>
    <header><a href="/">Home</a> Site name</header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav><div class="cookie-notice">We use cookies, many of them, all the time.</div>
    <div class="ad">Buy now!</div><article><h1>A &amp; B&nbsp;title</h1><p><b>Bold</b>ly{SENTENCE}<br>after<p>Second&#8217;s
    text<script>x()</script>.</p><div class="share">Share this</div><aside>By the way</aside><form><input value="x">Mail: <button>Go</button></form><table><tr><td>cell<td>cell2</table>
    <section class="comments"><p>{SENTENCE * 9}</p></section></article><aside class="sidebar"><p>{SENTENCE * 3}</p></aside><footer>&copy; me</footer></body></html>"""
    want = f"A & B title Boldly{SENTENCE.strip()} after Second’s text. cell cell2"
    assert main_text(page) == want


def test_page_without_article_element():
    body = "".join(f"<p>{SENTENCE}{i}</p>" for i in range(4))
    page = f"<body><div id=top><a>Home</a><a>About</a></div><div class=story><h2>Head</h2>{body}<p>End.</p></div><div id=links><ul><li><a>x</a></li><li><a>y</a></li></ul></div></body>"
    assert main_text(page) == " ".join(["Head", *[f"{SENTENCE}{i}" for i in range(4)], "End."])


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<script>x</script>") == main_text("<nav>menu</nav>") == ""
    assert main_text("just text &lt;b&gt; here") == "just text <b> here"
    assert main_text("<article><p>cut off in the mid") == "cut off in the mid"
    assert main_text("<article>" + "<p>word</p>" * 50_000 + "</article>") == " ".join(["word"] * 50_000)
    assert main_text("<article><p>a</article><article><p>" + SENTENCE + "</article>") == SENTENCE.strip()
    assert main_text("<p>" * 3000 + "deep") == "deep"


def test_ratios_prefer_long_punctuated_paths():
    nodes = text_nodes(f"<div><a>menu</a><a>item</a><a>x</a><a>y</a><a>z</a></div><div><p>{SENTENCE}</p><p>{SENTENCE}</p><p>{SENTENCE}</p></div>")
    scores = path_scores(nodes)
    assert scores[("div", "p")] > 4 * scores[("div", "a")]


def test_given_pages_keep_the_whole_article(spark, sf):
    def article(page):
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:h1|p|br)>", " ", body))).split())

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {x.page_id: (x.text, x.n_chars) for x in extract(pages).collect()}
    want = {x.page_id: article(x.html) for x in pages.collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>a b</p>", "x"), (1, "u", "<p>a b</p>", "x"), (None, None, None, "x")], "page_id bigint, url string, html string, text string")
    assert sorted((x.page_id or 0, x.url, x.text, x.n_chars) for x in extract(df).collect()) == [(0, None, "", 0), (1, "u", "a b", 3), (1, "u", "a b", 3)]
    assert extract(df.where("page_id = 9")).collect() == []


def test_links_inside_paragraphs_stay_without_article_element():
    body = "".join(f"<p>{SENTENCE}See <a href=x>the report {i}</a> today.</p>" for i in range(4))
    menu = "<ul><li><a>One</a> | <a>Two</a></li><li><a>Three</a></li></ul>"
    want = " ".join(f"{SENTENCE}See the report {i} today." for i in range(4))
    assert main_text(f"<body><div class=story>{body}{menu}</div></body>") == want
    assert main_text(f"<body>{menu}{body}</body>") == want


def test_names_on_what_holds_the_article_make_no_side_area():
    story = f"<h1>Head</h1><p>{SENTENCE}</p><p>{SENTENCE}</p>"
    want = f"Head {SENTENCE}{SENTENCE}".strip()
    side = "<nav><a>Home</a></nav><div class=sidebar>Also read this.</div><footer>me</footer>"
    for page in (f"<body class=no-sidebar><article>{story}</article>{side}</body>", f"<html class=search><body class='has-comments search-results'><main>{story}</main>{side}",
                 f"<body><article class='post promoted'>{story}</article>{side}", f"<div id=main-with-sidebar><article>{story}</article>{side}</div>",
                 f"<body><form id=f><div class=widget><div>{story}</div></div>{side}</form>", f"<form>{side}<main class=share><article class=promoted>{story}</article></main></form>"):
        assert main_text(page) == want, page
    assert main_text(f"<article>{story}<section class=comments><article class=comment><p>{SENTENCE}</p></article></section></article>") == want
    assert main_text(f"<nav class=x>{SENTENCE}</nav><div hidden>{SENTENCE}</div>") == ""
