import html
import re

from foldwise.llm import html_extract, html_page
from foldwise.llm.registry import QUERIES
from tests.llm.conftest import prose


def page(body, head="", chrome=True):
    top = "<header><a href='/'>Home</a></header><nav><ul><li><a href=/a>Menu one</a></li></ul></nav>" if chrome else ""
    end = "<div class='sidebar-2'>Side notes and more</div><section id=comments><p>I liked it very much indeed, said a reader at length.</p></section><footer>&copy; us</footer>" if chrome else ""
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{top}{body}{end}</body></html>"


def rows(n):
    out = []
    for k in range(n):
        paragraphs = [prose(100 + 10 * k + j, 20 + 7 * j) for j in range(3 + k % 3)]
        inner = "".join(f"<p>{p}</p>" if j % 2 else f"<p>{p}" for j, p in enumerate(paragraphs))
        body = f"<div class='wrap x{k}'><div class='post-body'>{inner}</div><div class='ad-slot'>Buy this now</div></div>"
        out.append((k, f"https://example.org/{k}", page(body), "\n\n".join(paragraphs)))
    return out


def test_consensus(spark):
    data = rows(12)
    # Most text of this page stands in a box of another kind; its host's path still finds the article.
    data.append((50, "https://example.org/odd", page("<div class='wrap x1'><div class='post-body'><p>" + prose(900, 40) + "</p></div><div class='box'><p>" + prose(901, 60) + "</p></div></div>"), prose(900, 40)))
    # Another template on the same host keeps its own container.
    data.append((51, "https://example.org/list", page(f"<main><h2>Title &amp; more</h2><p>{prose(902, 50)}<br>{prose(903, 5)}</p></main>"), f"Title & more\n\n{prose(902, 50)} {prose(903, 5)}"))
    df = spark.createDataFrame([d[:3] for d in data], "page_id long, url string, html string")
    got = {r.row.page_id: r.text for r in html_extract.extracted(df).collect()}
    assert got == {d[0]: d[3] for d in data}
    paths = html_extract.host_paths(df).collect()
    assert [(r.host, r.path.endswith(">div.wrap.x#>div.post-body"), r.votes) for r in paths] == [("example.org", True, 12)]


def test_odd_pages(spark):
    data = [
        (0, None, None, 1), (1, "", "", 2), (2, "not a url", "<p>only text", 3), (3, "http://u:p@Host.example:80/x", "<html><body><form>a</form></body></html>", 4), (None, "ftp://h/", "<div>un<b>closed <i>x &lt;y&gt;</div", 5),
        (4, "http://h.example", "<!-- <p>no</p> --><script>var a='<p>no</p>'</script><p>yes</p><style>p{}</style><noscript>no</noscript>" , 6),
        (5, "http://h.example", "<p>" + "long &amp; " * 50_000 + "</p>", 7), (5, "http://h.example", "<p>" + "long &amp; " * 50_000 + "</p>", 7)]
    df = spark.createDataFrame(data, "page_id long, url string, html string, row int")
    got = sorted(((r.row.page_id, r.text) for r in html_extract.extracted(df).collect()), key=repr)
    long = ("long & " * 50_000).strip()
    assert got == sorted([(0, ""), (1, ""), (2, "only text"), (3, ""), (None, "unclosed x <y>"), (4, "yes"), (5, long), (5, long)], key=repr)
    assert html_extract.extracted(df.where("false")).count() == 0


def test_parts_that_are_not_the_article():
    for part in ("<aside>x</aside>", "<div role=navigation>x</div>", "<div class=cookie-notice>x</div>", "<div id='newsletterSignup'>x</div>", "<div hidden>x</div>", "<ul><li><a>x</a></li><li><a>y</a></li></ul>", "<div class='related-posts'>x</div>"):
        found = html_page.blocks(page(f"<article><h1>Head</h1><p>{prose(1, 30)}</p>{part}<p>{prose(2, 30)}</p></article>"))
        assert html_page.text_below(found, html_page.best_path(found)) == ["Head", prose(1, 30), prose(2, 30)], part
    found = html_page.blocks(page(f"<div class='content with-sidebar'><p>{prose(1, 30)}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></div>"))
    kept = html_page.text_below(found, ">html>body>div.content.with-sidebar")
    assert kept == [prose(1, 30), "one", "two", "a b"]


def test_query(spark, sf_dir):
    """The small pages have their text in one article element."""
    got = {r.page_id: r for r in QUERIES["op3_html_extraction"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", r.html or "", re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", body)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_whole_article():
    """Heading, lead and sections outside the best container belong to the article; marked parts beside it do not."""
    lead, parts = prose(1, 12), [prose(k, 40) for k in (2, 3, 4)]
    body = "".join(f"<p>{p}</p>" for p in parts)
    for source in (f"<article><h1>Head</h1><p class=lead>{lead}</p><div class=body>{body}</div></article>", f"<div><h1>Head</h1><p>{lead}</p><div class=body>{body}</div></div>"):
        found = html_page.blocks(page(source))
        assert html_page.text_below(found, html_page.best_path(found)) == ["Head", lead, *parts]
    split = [prose(5, 20), prose(6, 60), prose(7, 20)]
    found = html_page.blocks(page("<div class=text>" + "".join(f"<section class={c}><p>{p}</p></section>" for c, p in zip(("intro", "results", "end"), split, strict=True)) + "</div>"))
    assert html_page.text_below(found, html_page.best_path(found)) == split


def test_templates_of_a_host(spark):
    """Pages of a minority template keep all of their article where the host's path holds a part of it."""
    data = rows(12)
    for k in range(3):
        mine, teaser = prose(950 + k, 60), prose(960 + k, 45)
        data.append((60 + k, f"https://example.org/r{k}", page(f"<div class='wrap x1'><div class='post-body'><p>{teaser}</p></div><div class='report'><p>{mine}</p></div></div>"), f"{teaser}\n\n{mine}"))
    df = spark.createDataFrame([d[:3] for d in data], "page_id long, url string, html string")
    assert {r.row.page_id: r.text for r in html_extract.extracted(df).collect()} == {d[0]: d[3] for d in data}


def test_articles_with_the_names_of_asides():
    """Class names of topics and a form around the page do not hide the article; parts beside it stay out."""
    a, b = prose(1, 40), prose(2, 40)
    inner = f"<h1>Head</h1><p>{a}</p><div class='share-bar'>Share this</div><nav>x</nav><div class=comment><p>{prose(3, 20)}</p></div><p>{b}</p>"
    for source in (
        f"<article class='post category-legal tag-social'>{inner}</article>", f"<main class='discussion'>{inner}</main>", f"<div id='search-form'>{inner}</div>",
        f"<form action='/x.aspx'><div class=alert><div>{inner}</div></div></form>", f"<form><input type=hidden>Go {inner}</form>"):
        for whole in (page(source), page(source).replace("<body>", "<body class='sidebar-right' style='visibility: hidden'>")):
            found = html_page.blocks(whole)
            kept = html_page.text_below(found, html_page.best_path(found))
            assert [x for x in kept if x != "Go"] == ["Head", a, b], source
    found = html_page.blocks(page(f"<article><p>{a}</p></article><form class=search><p>{prose(4, 30)}</p></form><div class=related><p>{b}</p></div>"))
    assert html_page.text_below(found, html_page.best_path(found)) == [a]


def main_text(source):
    found = html_page.blocks(source)
    path = html_page.best_path(found)
    return [] if path is None else html_page.text_below(found, path)


def test_long_and_deep_pages():
    """Malformed, deep and huge pages take linear time and memory, and no markup becomes text."""
    import time
    import tracemalloc

    article = f"<article><h1>Head</h1><p>{prose(1, 40)}</p></article>"
    want = ["Head", prose(1, 40)]
    tails = {
        "open tags": "<a " * 350_000, "open tags and an end": "<a " * 350_000 + ">", "quotes": "<a \"" * 250_001, "both quotes": "<a \"'" * 150_001 + ">",
        "deep": "<div>" * 50_000 + "x", "deep classes": "<div class='one two three'>" * 30_000, "deep and closed": "<b2>" * 30_000 + "</b2>" * 30_000,
        "ends": "<section>" * 20_000 + "</em2>" * 50_000, "scripts": "<script>" * 100_000, "comments": "<!--" * 200_000, "paragraphs": "<center><p>" * 20_000, "declarations": "<!x " * 200_000}
    for name, tail in tails.items():
        started = time.time()
        text = main_text(article + tail)
        assert time.time() - started < 5, name
        assert text == want, (name, [t[:60] for t in text])
    tracemalloc.start()
    html_page.blocks("<div class='some long name of a class'>" * 10_000 + "x")
    assert tracemalloc.get_traced_memory()[1] < 30 << 20
    tracemalloc.stop()


def test_brackets_in_attributes():
    """A quoted value may hold brackets; a quote that is never closed does not swallow the page."""
    for tag in ("<a title='a > b' href=\"x<y>z\">", "<img alt=\"1 < 2 > 0\">", "<i data-x='<b>'>"):
        assert main_text(f"<article><p>one {tag}two</p></article>") == ["one two"], tag
    assert main_text("<article><p>one <a href=\"x>two</a> three</p></article>") == ["one two three"]
    assert main_text("<article><p>one</p><p>two <a hre") == ["one", "two"]
    assert main_text("<p>1 < 2 and a<b") == ["1 < 2 and a"]


def test_an_article_ends_where_it_ends():
    """Title and lead in an article's header belong to it; readers' answers and other text outside an article do not."""
    a, b = prose(1, 40), prose(2, 30)
    inner = f"<header class='entry-header'><h1>Head</h1><p>{b}</p></header><p>{a}</p>"
    for answers in (f"<section id=responses><p>{prose(3, 30)}</p></section>", f"<div class=more><p>{prose(4, 20)}</p><p>{prose(5, 20)}</p></div>"):
        assert main_text(page(f"<article>{inner}</article>{answers}")) == ["Head", b, a]
        assert main_text(page(f"<main>{inner}</main>{answers}")) == ["Head", b, a]
    assert main_text(page(f"<div><header><p>{b}</p></header><p>{a}</p></div>")) == [a]  # no article: the page's header
