"""Main text by wrappers: known sites, broken markup, hosts of any size."""

import html
import random
import re

import pytest

from docketflow.llm import wrappers
from docketflow.llm.html_tokens import events
from docketflow.llm.wrappers import Wrapper, by_name, main_text

SF = "/root/testdata/sf0.001"
RNG = random.Random(5)


def words(n):
    return " ".join("".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 8))) for _ in range(n))


def paragraphs(ps):
    return "".join(f"<p>{p}</p>" for p in ps)


SITES = {
    "semantic": lambda i, t, ps: (
        f"<html><body><header><a href=/>Site</a></header><nav><ul><li><a>x</a><li><a>y</a></ul></nav><main><article><h1>{t}</h1>{paragraphs(ps)}<aside>{words(20)}</aside>"
        f"<form><input><p>Sign up</p></form></article><section class=comments><h2>Comments</h2><div class=comment><p>{words(50)}</p></div><div class=comment><p>{words(90)}</p></div></section></main><footer>f</footer></body></html>"
    ),
    "names": lambda i, t, ps: (
        f"<body><div id=header><h1>My Site</h1></div><div class='menu'><a href=a>one</a> <a href=b>two</a></div><div class=wrap><div class='post' id='post-{i}99'><h2>{t}</h2>{paragraphs(ps)}<div class='ad-slot ads'>Buy {words(5)}</div></div>"
        f"<div class=sidebar><h3>Popular</h3><p>{words(40)}</p></div></div><div class='cookie-notice'>We use cookies</div><div id=comments><p>{words(100)}</p></div></body>"
    ),
    "made-up names": lambda i, t, ps: (
        f"<body><div class=a1><ul><li><a>one</a></li><li><a>two</a></li><li><a>three {i}</a></li></ul></div><div class=a2><div class=b1><h1>{t}</h1>{paragraphs(ps)}</div>"
        f"<div class=b2><p>Subscribe to our letter today and never miss a thing again</p></div></div><div class=a3>All rights reserved</div></body>"
    ),
    "no names": lambda i, t, ps: f"<div><ul><li><a>one</a></li><li><a>two</a></li><li><a>three</a></li></ul></div><div><h1>{t}</h1>{paragraphs(ps)}</div><div>Copyright site</div>",
    "title apart": lambda i, t, ps: f"<body><header><img><h1>Daily</h1></header><div class=top><h1>{t}</h1></div><div class=body>{paragraphs(ps)}</div><footer><p>{'x ' * 50}</p></footer></body>",
    "table": lambda i, t, ps: f"<table><tr><td><a>home</a><br><a>news</a></td><td><h1>{t}</h1>{paragraphs(ps)}</td><td>Ad: buy now</td></tr></table>",
    "own header": lambda i, t, ps: f"<body><article><header><h1>{t}</h1></header><div class=entry-content>{paragraphs(ps)}</div><footer>Posted in x</footer></article><div class='related-posts'><ul><li><a>{words(4)}</a></li></ul></div></body>",
    "sections": lambda i, t, ps: f"<body><main><h1>{t}</h1>" + "".join(f"<section>{paragraphs([p])}</section>" for p in ps) + "</main></body>",
    "crossed": lambda i, t, ps: f"<BODY><DIV CLASS=nav><A>a</A></DIV><DIV id=content><H1>{t}</H1>" + "".join(f"<P><b>{p}<BR>" for p in ps) + "<div class=share>Share this</div></DIV></DIV>",
}


def site(make, n=8):
    for i in range(n):
        title, ps = words(6), [words(RNG.randint(5, 60)) for _ in range(RNG.randint(1, 6))]
        yield make(i, title, ps), "\n".join([title, *ps])


@pytest.mark.parametrize("name", sorted(SITES))
def test_sites(name):
    whole, parts, pages = Wrapper(), [Wrapper(), Wrapper()], [(events(h, by_name), t) for h, t in site(SITES[name])]
    for i, (stream, _) in enumerate(pages):
        whole.read(stream)
        parts[i % 2].read(stream)
    parts[0].add(Wrapper.unpacked(parts[1].packed()))
    for w in (whole, parts[0]):
        rules = Wrapper.unpacked(w.packed()).rules()
        assert [main_text(stream, rules) for stream, _ in pages] == [t for _, t in pages]
    assert [main_text(stream, None) for stream, _ in pages] == [t for _, t in pages]


def test_unvarying_text_is_template():
    """A notice without a name inside the article: pages of a host tell it from the text, a page alone cannot."""
    pages = [(f"<article><h1>{words(4)}</h1><div class=x><p>{words(20)}</p><p>{words(9)}</p></div><div class=y>Read our terms first</div></article>") for _ in range(6)]
    w = Wrapper()
    for p in pages:
        w.read(events(p, by_name))
    assert "Read our terms" not in main_text(events(pages[0], by_name), w.rules())
    assert "Read our terms" in main_text(events(pages[0], by_name), None)
    copies = Wrapper()
    for _ in range(6):
        copies.read(events(pages[0], by_name))
    assert "Read our terms" in main_text(events(pages[0], by_name), copies.rules())


def test_expression():
    w = Wrapper()
    for p in ("<body><h1>a</h1><p>x</p></body>", "<body><h1>b</h1><p>y</p><p>z</p><ul><li>1</li></ul></body>"):
        w.read(events(p, by_name))
    assert w.root.expression() == "<body><h1>#</h1>(<p>#</p>)+(<ul><li>#text</li></ul>)?</body>"
    for p in ("<body><p>x</p><h1>b</h1></body>",):
        w.read(events(p, by_name))
    assert w.root.expression() == "<body>((<h1>#</h1>)?(<p>#</p>)?)+(<ul><li>#text</li></ul>)?</body>"


def test_markup():
    def text(page):
        return main_text(events(page, by_name), None)

    assert text("<p>a &amp;&lt;b&gt; &eacute;&#233;&nbsp; c<br>d<b>e</b>f") == "a &<b> éé c def"
    assert text('<script>var t="</p><p>no</p>";</script><style>p{}</style><p>yes</p><!-- <p>no</p> --><textarea><p>no</textarea>') == "yes"
    assert text("<p>1 < 2 and <3</p><p title='a > b'>x</p><p title=\"open>y") == "1 < 2 and <3\nx\ny"
    assert text("<p>a<span class=ad>no <span>no</span> no</span>b</p><div style='display:none'>no</div><p hidden>no</p>") == "ab"
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "a\nb\nc\nd"
    assert text("no markup at   all\n here") == "no markup at all here"
    assert text("") == "" and text("<div></div>") == "" and text("<!-- open") == "" and text("<script>open") == ""
    assert text("<p>" * 3000 + "deep") == "deep" and text("<div>" * 200 + "deep" + "</div>" * 300) == "deep"


@pytest.mark.parametrize("broadcast", [True, False])
def test_whole_table(spark, monkeypatch, broadcast):
    """A host of most pages in many groups, nulls, odd urls, repeated rows and clashing columns; wrappers broadcast or merged."""
    monkeypatch.setattr(wrappers, "FAN", 2)
    monkeypatch.setattr(wrappers, "MOST_BYTES", wrappers.MOST_BYTES if broadcast else 0)
    rows, want = [], {}
    for k, name in enumerate(sorted(SITES)):
        for i, (page, text) in enumerate(site(SITES[name], 30 if k == 0 else 6)):
            rows.append((1000 * k + i, f"HTTPS://u:p@H{k}.example.org:80/a?b#{i}", page, "x", 1))
            want[1000 * k + i] = text
    odd = [(-1, None, "<p>a</p>"), (-2, "no url", None), (-3, "http://h1.example.org", ""), (-4, "http://", "<p>b"), (None, None, None)]
    rows += [(*r, "x", 1) for r in odd] + [rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper string, n long").repartition(7)
    got = wrappers.extracted(pages).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert {k: texts[k] for k in want} == want
    assert [texts[k] for k in (-1, -2, -3, -4, None)] == ["a", "", "", "b", ""]
    found = wrappers.wrappers(pages)
    assert {r.host: r.n for r in found.collect()}["h0.example.org"] == 31
    assert wrappers.expressions(found).where("host = 'h0.example.org'").first().expression.startswith("<")
    assert wrappers.extracted(pages.limit(0)).count() == 0


def test_given_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}

    def article(page):
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        return "\n".join(b for b in blocks if b)

    got = wrappers.op12_wrappers(spark, SF).collect()
    assert {r.page_id: r.text for r in got} == {k: article(v) for k, v in pages.items()}
    assert all(r.n_chars == len(r.text) for r in got)


def test_too_many_elements(monkeypatch):
    """Elements of the fewest pages leave a wrapper; pages that have them lose no text."""
    monkeypatch.setattr(wrappers, "MOST_ELEMENTS", 30)
    w, pages = Wrapper(), [f"<article><h1>t{i}</h1><p>{words(9)}</p><div class=own{'x' * i}><p>own {i}</p></div></article>" for i in range(40)]
    for p in pages:
        w.read(events(p, by_name))
    rules = Wrapper.unpacked(w.shrunk().packed()).rules()
    assert wrappers._elements(w.root) <= 30
    assert all(f"own {i}" in main_text(events(p, by_name), rules) for i, p in enumerate(pages))


@pytest.mark.parametrize("forms", [False, True])
def test_wide_wrappers(spark, monkeypatch, forms):
    """Hosts of more elements than a wrapper may have in one piece get the texts that the whole wrapper gives."""
    rows, want = [], {}
    for k, name in enumerate(sorted(SITES)):
        whole, mine = Wrapper(), []
        for i, (page, _) in enumerate(site(SITES[name], 12)):
            # What only the wrapper tells: lists of links in elements of one page, a notice of all, a header out of the article.
            name_of = "".join(RNG.choice("qwxyz") for _ in range(12))
            links = f"<div class={name_of}>" + "".join(f"<ul><li><a>{words(3)}</a></li></ul>" for _ in range(3)) + "</div>"
            page = page.replace("<p>", f"{links}<p>", 1) + "<div class=yy>Read our terms first</div>"
            if forms:
                page = f"<form class=f{k}><header>{words(3)}</header>{page}</form>"
            rows.append((100 * k + i, f"http://w{k}.org/{i}", page))
            mine.append((100 * k + i, events(page, by_name)))
            whole.read(mine[-1][1])
        rules = whole.rules()
        want.update({key: main_text(stream, rules) for key, stream in mine})
    rows += [(-1, "http://w1.org/x", None), (-2, None, "<p>a</p>"), rows[0]]
    monkeypatch.setattr(wrappers, "MOST_ELEMENTS", 8 if forms else 20)
    monkeypatch.setattr(wrappers, "FAN", 2)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = wrappers.extracted(pages).collect()
    found = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and {k: found[k] for k in want} == want and (found[-1], found[-2]) == ("", "a")
    counts = {r.host: (r.n, r.wrapper) for r in wrappers.wrappers(pages).collect()}
    assert [counts[f"w{k}.org"][0] for k in range(3)] == [13, 13, 12] and any(w is None for _, w in counts.values())
