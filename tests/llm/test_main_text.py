"""Wrappers decide, nothing of an article is lost, deep pages end, all layouts take part."""

import random

import pytest
from broodline.llm import html_extract as hx
from conftest import rows


def wrapped(pages):
    return hx.infer_wrapper(pages)


def plain_page(k, menu="Home News Contact", ad=""):
    """A page without an article or main element and without telling names."""
    words = random.Random(k)
    text = "".join(f"<div>{' '.join(words.choices(['sea', 'ship', 'storm', 'port'], k=30))} {k}.{n}</div>" for n in range(2 + k % 3))
    links = "".join(f"<div><a href=/{w}>{w}</a></div>" for w in menu.split())
    return (
        f"<html><body><div>{links}</div>{ad}<div><div><b>Title {k}</b></div>{text}</div>"
        f"<div>Imprint and terms of this house, which are long enough to be read as text by a careless reader. "
        f"{'They go on for several lines on each page and never change, as such things do. ' * 9}</div></body></html>"
    )


def plain_text(k):
    words = random.Random(k)
    lines = [f"{' '.join(words.choices(['sea', 'ship', 'storm', 'port'], k=30))} {k}.{n}" for n in range(2 + k % 3)]
    return "\n".join([f"Title {k}", *lines])


def test_the_wrapper_alone_finds_the_article(spark):
    pages = [plain_page(k) for k in range(12)]
    wrapper = wrapped(pages)
    assert [hx.main_text(p, wrapper) for p in pages] == [plain_text(k) for k in range(12)]
    assert all(hx.main_text(p) != plain_text(k) for k, p in enumerate(pages))  # not without it
    assert hx.main_text(plain_page(99), wrapper) == plain_text(99)  # also on a page that took no part


def test_the_wrapper_overrules_article_elements():
    """Teasers in article elements around a text that is in none."""
    def page(k):
        teasers = "".join(f"<article><h3>Teaser {t}</h3></article>" for t in range(3))
        return f"<body><div>{teasers}</div><div><h1>Head {k}</h1><p>{f'long text {k} ' * 30}</p></div></body>"

    pages = [page(k) for k in range(5)]
    assert hx.main_text(pages[2], wrapped(pages)) == "Head 2\n" + "long text 2 " * 29 + "long text 2"


def test_groups_of_several_elements_fold():
    def page(k):
        return "<body><dl>" + "".join(f"<dt>t{k}{n}</dt><dd>d{k}{n}</dd>" for n in range(k + 2)) + "</dl></body>"

    assert hx.expression(wrapped([page(k) for k in range(3)])) == "<#root><body><dl>(<dt>#TEXT</><dd>#TEXT</>)+</></></>"
    pages = ["<body>" + "".join(f"<h2>h{k}{n}</h2><p>p{k}{n}</p><p>q</p><hr>" for n in range(3)) + "</body>" for k in range(3)]
    assert hx.expression(wrapped(pages)) == "<#root><body>(<h2>#TEXT</>(<p>#TEXT</>)+<hr></>)+</></>"
    assert hx.main_text(pages[1], wrapped(pages)).split("\n")[:3] == ["h10", "p10", "q"]


def test_optional_parts_align_by_likeness():
    pages = [plain_page(k, ad=f"<div><i>offer {k}</i></div>" if k % 2 else "") for k in range(6)]
    wrapper = wrapped(pages)
    assert [hx.main_text(p, wrapper) for p in pages] == [plain_text(k) for k in range(6)]


@pytest.mark.parametrize("tag", ["div", "b", "ul", "span", "article"])
@pytest.mark.parametrize("closed", [False, True])
def test_deep_pages_end(tag, closed):
    deep = [f"<{tag}>" * 1500 + f"inside {k}" + f"</{tag}>" * 1500 * closed + "<p>behind" for k in range(4)]
    wrapper = wrapped(deep)
    assert hx.decoded(hx.encoded(wrapper)) == hx.without_nodes(wrapper)
    for tried in (None, wrapper):
        assert "inside 2" in hx.main_text(deep[2], tried)
    assert hx.expression(wrapper)


def test_deep_page_does_not_end_the_job(spark):
    data = [(1, "https://a.example/", "<div>" * 3000 + "x"), (2, "https://a.example/", "<article><p>fine</article>")]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in hx.extract_main_text(df).collect()} == {1: "x", 2: "fine"}


def test_nothing_of_an_article_is_lost():
    def text(inner):
        return hx.main_text(f"<body><nav>menu</nav><article>{inner}</article></body>")

    assert text('<p>one</p><svg class="i"/><p>two</p><p>three</p>') == "one\ntwo\nthree"
    assert text('<p>one</p><svg class="i"><text>icon</text></svg><p>two</p>') == "one\ntwo"
    assert text("<header><h1><span>Title</span></h1><p>standfirst</p></header><p>body</p>") == "Title\nstandfirst\nbody"
    assert text("<ul><li><a href='#a'>Part A</a></li><li><a href='#b'>Part B</a></li></ul><p>body</p>") == "Part A\nPart B\nbody"
    assert text("<p>body</p><ul><li><a href='/x'>Other page</a></li><li><a href='/y'>More</a></li></ul>") == "body"


def test_names_count_as_a_whole():
    def text(inner):
        return hx.main_text(f"<body><div>{inner}</div></body>")

    body = "<p>" + "long text " * 20 + "</p>"
    for kept in ("<p class='search-intro'>kept</p>", "<div class='form-of-life'>kept</div>", "<p class='ad-hoc'>kept</p>"):
        assert "kept" in text(body + kept)
    for name in ("site-footer", "navBar", "cookie_banner", "ad", "ad-slot", "main-menu", "sidebar right", "top-nav"):
        assert "gone" not in text(body + f"<div class='{name}'>gone</div>")


def test_every_layout_takes_part(spark):
    """A rare layout of a host with very many pages of another one, over several partitions."""
    many = [(k, "https://a.example/", plain_page(k)) for k in range(120)]
    rare = [
        (1000 + k, "https://a.example/", f"<body><table><tr><td>Fixed words in a cell</td><td><div><p>{plain_text(k)}</p></div></td></tr></table></body>")
        for k in range(4)
    ]
    single = [(2000, "https://a.example/", "<body><center><p>only one</p></center></body>")] * 5
    odd = [(None, None, None), (3000, "not a url", "<p>loose</p>"), (3001, "", "")]
    df = spark.createDataFrame(many + rare + single + odd, "page_id long, url string, html string").repartition(7)
    found = hx.extract_main_text(df)
    got = sorted(rows(found.select("page_id", "text")), key=repr)
    wanted = [(k, plain_text(k)) for k in range(120)] + [(1000 + k, plain_text(k).replace("\n", " ")) for k in range(4)]
    wanted += [(2000, "only one")] * 5 + [(None, ""), (3000, "loose"), (3001, "")]
    assert got == sorted(wanted, key=repr)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    hx_limit, hx.BROADCAST_BYTES = hx.BROADCAST_BYTES, 0  # the way of many wrappers
    try:
        assert sorted(rows(hx.extract_main_text(df).select("page_id", "text")), key=repr) == got
    finally:
        hx.BROADCAST_BYTES = hx_limit
