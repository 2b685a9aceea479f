import random

import pytest

from docfathom.llm import html


def text(page):
    return html.extract(page)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-banner">We use cookies</div>
<main><article class="post"><header><h2>The &amp; title</h2><p>by me</p></header><p>One  <b>two</b>
three&nbsp;four<p>Next<br>line &lt;x&gt; &#233;</p><!-- <p>no</p> --><ul><li>a<li>b</ul><div class="share-buttons">Share</div><form>Name <input></form>
<table><tr><td>c<td>d</table><pre>x
  y</pre><section class="comments"><p>First!</p></section><aside>More</aside></article></main>
<div id="sidebar"><p>side</p></div><section id="comments"><article class="comment"><p>a long comment, a long comment, a long comment</p></article></section><footer>&copy; all</footer></body></html>"""


def test_article():
    assert text(PAGE) == "\n\n".join(["The & title", "One two three four", "Next line <x> é", "a", "b", "c", "d", "x y"])


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<body><p>a<p>b</body>", "a\n\nb"),
        ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
        ("<article><p>open <b>bold <p>next</article>", "open bold\n\nnext"),
        ("<article><p>x</p><script>if (a<b) '</p>'", "x"),
        ("<div><div class=ad>buy</div><p>Some words here.</p></div>", "Some words here."),
        ("<article><p title='a > b'>q</p></article", "q"),
        ("<nav>only menu</nav>", ""),
        ("<article><div hidden>h</div><p>&#x41;&bogus;&copy</p></article>", "A&bogus;©"),
    ],
)
def test_odd_pages(page, want):
    assert text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><p>Intro.</p><section id="discussion"><h2 id="related-work">Related</h2><p>Said.</p></section></article>', "Intro.\n\nRelated\n\nSaid."),
        ('<body><div class="layout with-sidebar"><article><p>The text.</p></article><div class=sidebar>Side</div></div></body>', "The text."),
        ('<body><div class="page has-sidebar"><h1>Title</h1><p>A long enough text.</p><div class=sidebar>Side</div></div><p>Low</p></body>', "Title\n\nA long enough text."),
        ('<body><form action=x><h1>Title</h1><p>A long enough text.</p><select><option>one</select></form></body>', "Title\n\nA long enough text."),
        ('<article><p>See <a title="a hidden gem" href=x>this</a> one.</p><div data-id="comment-4"><p>Kept.</p></div></article>', "See this one.\n\nKept."),
        ('<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>', "So x=2 holds."),
        ('<article><p>Here is the text itself.</p><div id="comments"><p>First!</p></div><p hidden>no</p></article>', "Here is the text itself."),
        ('<article><p>Here.</p><p data-x=1 class=ad id=q>Buy</p><p class = "share" >Share</p></article>', "Here."),
    ],
)
def test_article_parts_stay(page, want):
    assert text(page) == want


def wrapper(*pages):
    return html.merge([html.fold(html.parse(p)) for p in pages])


def shown(part):
    return [(k.key, k.optional, k.repeated) for k in part.kids]


def test_folding_and_alignment():
    div = wrapper("<div><h1>A</h1><p>1</p></div>", "<div><h1>B</h1><h2>new</h2><p>4</p></div>").kids[0]
    assert shown(div) == [("h1", False, False), ("h2", True, False), ("p", False, False)]
    assert div.kids[0].text is None and div.n == 2 and div.kids[1].text
    more = wrapper("<div><h1>A</h1><p>1</p><b>x</b></div>", "<div><h1>A</h1><p>1</p><p>2</p><p>3</p><b>x</b></div>").kids[0]
    assert shown(more) == [("h1", False, False), ("p", False, True), ("b", False, False)] and more.kids[0].text
    pairs = wrapper("<dl><dt>a<dd>b</dl>", "<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>").kids[0]
    assert shown(pairs) == [("dt", False, True), ("dd", False, True)]
    before = wrapper("<ul><p>1</p><i>0</i></ul>", "<ul><b>q</b><p>1</p><i>0</i></ul>", "<ul><i>0</i></ul>").kids[0]
    assert shown(before) == [("b", True, False), ("p", True, False), ("i", False, False)]
    assert [k.n for k in before.kids] == [1, 2, 3]


@pytest.mark.parametrize("seed", range(40))
def test_matches_are_a_longest_common_subsequence(seed, monkeypatch):
    rng = random.Random(seed)
    x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
    for bits in (1 << 28, 0):
        monkeypatch.setattr(html, "TABLE_BITS", bits)
        got = html.matches(x, y)
        assert all(x[i] == y[j] for i, j in got) and all(a < c and b < d for (a, b), (c, d) in zip(got[:-1], got[1:], strict=True))
        assert len(got) == best[-1][-1]


@pytest.mark.parametrize("seed", range(40))
def test_every_page_fits_its_wrapper(seed):
    """Brute force: each page's elements, in order, are a word of the wrapper read as a regular expression."""
    import re

    rng = random.Random(seed)
    pages = ["".join(rng.choice("abiqs") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 6))]
    top = html.merge([html.fold(html.parse("".join(f"<{c}>{i}</{c}>" for c in p))) for i, p in enumerate(pages)])
    regex, run = "", ""
    for k in top.kids:  # neighbours that repeat are one group
        if k.repeated:
            run += f"{k.key}|"
        else:
            regex, run = regex + (f"(?:{run[:-1]})*" if run else "") + k.key + "?" * k.optional, ""
    regex += f"(?:{run[:-1]})*" if run else ""
    for p in pages:
        assert re.fullmatch(regex, p), (regex, p)


def test_many_varied_siblings_are_fast():
    import time

    rng = random.Random(5)
    pages = ["<div>" + "".join(f"<{t}>x</{t}>" for t in (rng.choice(["p", "h2", "ul", "pre", "table", "i", "b"]) for _ in range(4000))) + "</div>" for _ in range(3)]
    begin = time.perf_counter()
    parts = [html.fold(html.parse(p)) for p in pages]
    html.merge(parts)
    assert time.perf_counter() - begin < 5


@pytest.mark.parametrize("page", ["<div>" * 5000 + "deep &amp; down", "<p>a" + "<b>" * 5000 + "deep", "<ul><li>" * 5000 + "x", "<article>" + "<section><p>t" * 3000])
def test_deep_pages(page):
    got = text(page)
    assert got.split()[-1] in ("down", "deep", "adeep", "x", "t")
    top = wrapper(page, page.replace("x", "y"))
    known = html.told(top)
    assert html.extract(page, html.load(known) if known else None) == got
    assert html.dump(html.load(html.dump(top))[0]) == html.dump(top)


def told(pages):
    return html.load(html.told(wrapper(*pages)))


def test_the_wrapper_decides():
    """Long texts that all pages share are the wrapper's; the article is where pages differ. A page alone cannot tell."""
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice("river stone green old walk sing".split()) for _ in range(n))
    legal = words(300)
    bodies = [words(40 + i) for i in range(6)]
    pages = [f"<body><div><a href=/>Home</a></div><div><p>{b}</p></div><div><p>{legal}</p></div></body>" for b in bodies]
    known = told(pages)
    for b, p in zip(bodies, pages, strict=True):
        assert html.extract(p, known) == b and html.extract(p) != b


def test_headings_that_pages_share_stay():
    pages = [f"<article><h1>T{i}</h1><h2>Summary</h2><p>Text {i} of it.</p><h2>Sources</h2></article>" for i in range(8)]
    for i, p in enumerate(pages):
        assert html.extract(p, told(pages)) == f"T{i}\n\nSummary\n\nText {i} of it.\n\nSources"
    lead = [f"<article><p><b>LONDON</b> news {i}</p><p>Same in all.</p><p>And {i}</p></article>" for i in range(8)]
    for i, p in enumerate(lead):
        assert html.extract(p, told(lead)) == f"LONDON news {i}\n\nSame in all.\n\nAnd {i}"


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 40])
def test_texts_that_pages_share_stay(n):
    pages = [f"<nav>Menu</nav><article><p>Opening words.</p><h1>T{i}</h1><p>Shared.</p><p>Text {i}.</p><div>All rights reserved</div></article><div class='notice'>Notice</div>" for i in range(n)]
    for i, p in enumerate(pages):
        assert html.extract(p, told(pages)) == f"Opening words.\n\nT{i}\n\nShared.\n\nText {i}.\n\nAll rights reserved"


def test_long_classes_are_whole_keys():
    same = "c" * 70
    one, two = (html.fold(html.parse(f"<div class='{same}{x}'>t</div>")).kids[0].key for x in "ab")
    assert one != two and one == html.fold(html.parse(f"<div class='{same}a'>u</div>")).kids[0].key
    assert html.fold(html.parse("<div class='post-12'>t</div>")).kids[0].key == html.fold(html.parse("<div class='post-345'>t</div>")).kids[0].key


@pytest.mark.parametrize("size", [1, 2, 5, 9])
def test_records_of_any_length_are_a_repeated_group(size):
    record = lambda k: "".join(f"<div class='f{'abcdefghi'[j]}'>{k} {j}</div>" for j in range(size))
    pages = [f"<ul>{''.join(record(r) for r in range(n))}</ul>" for n in (2, 3, 5, 4)]
    for order in (pages, pages[::-1], pages[2:] + pages[:2]):
        parts = html.merge([html.fold(html.parse(p)) for p in order]).kids[0].kids
        keys = [p.key for p in parts]
        assert keys[-size:] == [f"div.f{'abcdefghi'[j]}" for j in range(size)]
        assert all(p.repeated and not p.optional for p in parts[-size:]) or all(p.repeated for p in parts[:size])


def test_long_lists_are_aligned_exactly():
    rng = random.Random(4)
    x, y = (["k" + rng.choice("abcdefgh") for _ in range(20_000)] for _ in range(2))
    got = html.matches(x, y)
    assert len(got) == int(html._lengths(x, y)[-1])
    assert all(x[i] == y[j] for i, j in got) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:], strict=False))


BOX = ["<nav><a href='/'>Home</a><a href='/a'>About us</a></nav>", "<aside class='sidebar'><p>Other things to read</p></aside>", "<footer><p>Imprint</p></footer>", "<div class='ad'>Buy now</div>", "<form><input><button>Send</button></form>", "<script>var x = '<p>no</p>';</script>", "<div class='comments'><p>I agree</p></div>"]


def written(rng, kind, words):
    """An article as markup, and the blocks that a reader sees: written side by side, so that one does not come from the other."""
    mark, text = [], []

    def say(tag, inner, plain, attributes=""):
        mark.append(f"<{tag}{attributes}>{inner}</{tag}>")
        text.append(plain)

    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(3, 14))).capitalize() + "."
    say("h1", title := sentence(), title)
    for _ in range(rng.randrange(1, 9)):
        a, b = sentence(), sentence()
        how = rng.randrange(6)
        if how == 0:
            say("p", f"{a} <b>{b}</b>", f"{a} {b}", rng.choice(["", " class='lead'", " id='p1'"]))
        elif how == 1:
            say("h2", b, b, " id='related'")
        elif how == 2:
            mark.append("<ul>")
            say("li", a, a)
            say("li", f"<a href='#'>{b}</a>", b)
            mark.append("</ul>")
        elif how == 3:
            say("blockquote", f"{a} &amp; {b}", f"{a} & {b}")
        elif how == 4:
            say("p", f"{a}\n   {b}<br>x", f"{a} {b} x")
        else:
            mark.append(rng.choice(BOX[3:6]))
            say("p", "The same words on every page.", "The same words on every page.")
    return {"article": "<article>{}</article>", "main": "<main><div>{}</div></main>", "div": "<div class='entry-content'>{}</div>"}[kind].format("".join(mark)), "\n\n".join(text)


@pytest.mark.parametrize("seed", range(12))
def test_generated_hosts_give_back_what_was_written(seed):
    """Whole texts: every block of every article, and nothing of the boxes around it, however many pages the host has."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdeilmnorst") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
    kind, around = rng.choice(["article", "main", "div"]), [rng.choice(BOX) for _ in range(4)]
    made = [written(rng, kind, words) for _ in range(rng.choice([1, 2, 3, 6, 30]))]
    pages = [f"<html><head><title>t</title></head><body>{around[0]}{around[1]}<div class='wrap'>{m}{around[2]}</div>{around[3]}</body></html>" for m, _ in made]
    wrapper = told(pages)
    assert [html.extract(p, wrapper) for p in pages] == [t for _, t in made]


def test_a_page_of_another_kind_is_its_own_wrapper():
    known = told([f"<main><p>Text {i} of some length.</p></main>" for i in range(6)])
    assert html.extract("<body><div class=post><p>Other words.</p></div></body>", known) == "Other words."


def test_layout_of_the_input_plays_no_part(spark, monkeypatch):
    rng = random.Random(8)
    part = lambda: rng.choice(["<p>{0}</p>", "<ul><li>{0}</ul>", "<h2>{0}</h2>", "<div class=x>{0}</div>"]).format(rng.randint(0, 3))
    rows = [(i, f"http://{'ab'[i % 7 == 0]}.example/{i}", "<div>" + "".join(part() for _ in range(rng.randint(1, 6))) + "</div>") for i in range(120)]
    monkeypatch.setattr(html, "PAGES_AT_ONCE", 4)
    monkeypatch.setattr(html, "WRAPPERS_AT_ONCE", 3)
    got = []
    for n in (1, 5):
        rng.shuffle(rows)
        pages = spark.createDataFrame(rows, "page_id long, host string, html string").repartition(n).withColumn("host", html.F.substring("host", 8, 9))
        got.append(sorted((r.host, r.pages, r.wrapper) for r in html.infer(pages.select("host", "html")).collect()))
    assert got[0] == got[1] and sum(r[1] for r in got[0]) == 120


def test_wrapper_of_a_host(spark):
    """Without article elements, the host's wrapper tells the article's place; a line in it that all pages share is the article's."""
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(40):
        body = [" ".join(rng.choice("river stone green old walk sing".split()) for _ in range(30)) for _ in range(rng.randint(2, 5))]
        rows.append((i, f"http://h.example/{i}", f"<html><body><div class=top><a href=/>Home</a> Welcome</div><div class=c{i}><div class=inner><span>Read our best</span><h1>T {i}</h1>{''.join(f'<p>{b}</p>' for b in body)}</div></div><div class=low>About us</div></body></html>", 1))
        want[i] = "\n\n".join(["Read our best", f"T {i}", *body])
    rows += [(100, None, None, 1), (None, "x", "<article><p>q</p></article>", 1), (102, "http://h.example/z", "", 1), (103, "http://other/", "<article>" + "<p>word</p>" * 5000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper int").repartition(3)
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    assert len(got) == len(rows)
    for i in range(40):
        assert got[i] == want[i]
    assert got[100] == got[102] == "" and got[None] == "q" and got[103] == "\n\n".join(["word"] * 5000)
    assert html.main_text(pages.limit(0)).count() == 0


def test_pages_of_the_tables(spark):
    import html as entities
    import re

    from docfathom.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    for r in QUERIES["op10_html_extraction"](spark, d).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = re.sub(r"<(?!/?(?:p|h1)>)[^>]*>", " ", inner.replace("<b>", "").replace("</b>", ""))
        want = [" ".join(entities.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", parts)]
        assert r.text == "\n\n".join(x for x in want if x) and r.n_chars == len(r.text)
