import random

import pytest
from helpers import prose
from orderflow.llm import htmltext


def page(i, article, host="a.example"):
    """A page whose furniture varies as much as its article."""
    return f"""<!DOCTYPE html><html><head><title>{prose(i, 4)}</title><style>p > b {{x: "</p>"}}</style>
<script>var t = "<article>no</article>"; if (1 < 2) go();</script></head><body>
<header class="site"><a href="/">{prose(i + 1, 2)}</a></header>
<nav><ul>{"".join(f"<li><a href='/{k}'>{prose(i + k, 1)}</a>" for k in range(2 + i % 4))}</ul></nav>
<div class="cookie-notice">{prose(i + 2, 12)}</div><!-- <p>hidden</p> -->
<div class="ad banner">{prose(i + 3, 9)}</div>
{article}
<aside id=sidebar><p>{prose(i + 4, 20)}</p></aside>
<section class="comments"><p>{prose(i + 5, 25)}</p></section>
<form action="/q"><label>{prose(i + 6, 3)}</label><textarea>{prose(i + 7, 5)}</textarea></form>
<footer>&copy; {host} &middot; {prose(i + 8, 6)}</footer></body></html>"""


def body(i, tag="article"):
    text = [prose(100 * i + k, 12) for k in range(4)]
    html = f"<{tag}><h1>{text[0]}</h1><p><b>{text[1]}<br>x&amp;y&nbsp;&eacute; &#x41;<p>{text[2]}\n\n <i>in</i>line</p><ul><li>{text[3]}</ul></{tag}>"
    return html, f"{text[0]} {text[1]} x&y é A {text[2]} inline {text[3]}"


def test_furniture_goes_and_the_article_stays_whole():
    made = [body(i) for i in range(12)]
    assert htmltext.extract([page(i, html) for i, (html, _) in enumerate(made)]) == [t for _, t in made]


def test_without_an_article_element_the_rich_slots_are_taken():
    made = [body(i, "div") for i in range(12)]
    assert htmltext.extract([page(i, html) for i, (html, _) in enumerate(made)]) == [t for _, t in made]


@pytest.mark.parametrize("n", [1, 2])
def test_few_pages_go_by_elements(n):
    made = [body(i) for i in range(n)]
    assert htmltext.extract([page(i, html) for i, (html, _) in enumerate(made)]) == [t for _, t in made]


def test_comments_and_adverts_inside_the_article_go():
    inner = "<article><p>one</p><div class='ad'>buy</div><p>two</p><div class='comments'><p>meh</p></div></article>"
    assert htmltext.extract([inner]) == ["one two"]


def test_malformed_pages():
    assert htmltext.extract(["<article><p>a<p>b < c <b>d", "", "plain", "</p></div><article>x", "<script>never ends <p>y"]) == [
        "a b < c d", "", "plain", "x", "",
    ]


def test_template_of_classes_in_order_and_nested():
    pages = [htmltext.parse(f"<ul>{'<li>w' + str(i) + '</li>' * 1}{'<li>v</li>' * i}</ul><p>by {prose(i, 2)} end</p>") for i in range(1, 6)]
    found = htmltext.template(pages)
    once = [n for n, depth in found.items() if depth == 1]
    assert once == [(">ul", "<"), (">ul", "</"), (">p", "<"), (">p", "by"), (">p", "end"), (">p", "</")]
    assert {n for n, depth in found.items() if depth > 1} == {(">ul>li", "<"), (">ul>li", "</")}


def test_tokens_out_of_order_leave_the_class():
    words = ["<p>a b c d</p>", "<p>a c b d</p>", "<p>a b c d</p>"]
    kept = [w for _, w in htmltext.template([htmltext.parse(w) for w in words])]
    assert kept[0] == "<" and kept[-1] == "</" and {"a", "d"} < set(kept) and len({"b", "c"} & set(kept)) == 1


def test_a_class_that_crosses_a_slot_on_a_late_page_is_not_nested():
    """c and d stand between a and b on the first pages, and on both sides of b from the eleventh on."""
    inside, across = "<p>a c d b</p>", "<p>a c b d</p>"
    # c and d are not on the last page, so they are a class apart from a and b.
    pages = [htmltext.parse(t) for t in [inside] * 10 + [across] * 4 + ["<p>a b</p>"]]
    found = htmltext.template(pages)
    assert {(">p", "a"), (">p", "b")} <= set(found) and not {(">p", "c"), (">p", "d")} & set(found)


NOTICE = "Readers may <b>write</b> to the editors about anything that is printed here and shall be answered soon"


@pytest.mark.parametrize("tag", ["article", "div"])
@pytest.mark.parametrize("n", [4, 12])
def test_what_stands_on_all_pages_is_dropped_without_a_label(tag, n):
    """A notice, a byline and a share line inside the article, and a box of many words beside it."""
    made = [body(i, tag) for i in range(n)]
    inside = [
        html.replace("<p><b>", f"<p>By the same hand</p><p>{NOTICE}</p><p><b>", 1).replace(f"</{tag}>", f"<p>Pass it on</p></{tag}>")
        for html, _ in made
    ]
    pages = [page(i, f"<div class=x1>{f'<p>{NOTICE}</p>' * 9}</div>{html}") for i, html in enumerate(inside)]
    assert htmltext.extract(pages) == [t for _, t in made]


def test_an_article_that_only_repeats_stays():
    pages = [page(i, "<article><p>one text</p><p>on all pages</p></article>") for i in range(6)]
    assert htmltext.extract(pages) == ["one text on all pages"] * 6


def run(spark, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in htmltext.main_text(pages, **options).collect()}


def test_hosts_of_all_sizes_nulls_and_copies(spark):
    rng, rows, wanted = random.Random(1), [], {}
    for i in range(150):
        html, text = body(i % 140)
        host = "big.example" if i % 3 else f"h{rng.randrange(20)}.example"
        rows.append((i, f"https://{host}/{i}", page(i % 140, html, host)))
        wanted[i] = text
    rows += [(1000, None, None), (1001, "no url at all", ""), (1002, None, "<p>x</p>")]
    wanted |= {1000: "", 1001: "", 1002: "x"}
    assert run(spark, rows, per_group=16) == wanted
    assert run(spark, []) == {}


def test_clashing_and_extra_columns(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>", "old", 5)], "page_id int, url string, html string, Text string, _n int")
    rows = htmltext.main_text(pages).collect()
    assert [r.asDict() for r in rows] == [{"page_id": 1, "url": "http://a/", "_n": 5, "text": "x"}]


@pytest.mark.parametrize(
    "label", ["page has-sidebar", "sidebar-left blog", "nav-open", "search results", "social", "cookie", "site-header menu-open"]
)
def test_labels_of_the_whole_page_say_nothing(label):
    made = [body(i) for i in range(8)]
    pages = [page(i, html).replace("<body>", f'<body id="{label}" class="{label} n{i}">') for i, (html, _) in enumerate(made)]
    assert htmltext.extract(pages) == [t for _, t in made]
    wrapped = [page(i, f'<div class="has-sidebar nav-open">{html}</div>') for i, (html, _) in enumerate(made)]
    assert htmltext.extract(wrapped) == [t for _, t in made]


@pytest.mark.parametrize("label", ["entry share", "related-work", "story social", "post-comments-open"])
def test_labels_of_the_article_itself_do_not_remove_it(label):
    made = [body(i) for i in range(8)]
    pages = [page(i, html.replace("<article>", f'<article class="{label}">')) for i, (html, _) in enumerate(made)]
    assert htmltext.extract(pages) == [t for _, t in made]


@pytest.mark.parametrize("comment", ['<div class="comments"><article><p>so</p></article></div>', '<article class="comment"><p>so</p></article>'])
def test_readers_comments_go_though_they_are_articles(comment):
    made = [body(i) for i in range(5)]
    assert htmltext.extract([page(i, html + comment) for i, (html, _) in enumerate(made)]) == [t for _, t in made]


@pytest.mark.parametrize("tag", ["article", "div"])
@pytest.mark.parametrize("n", [4, 8, 30])
def test_a_shared_heading_and_a_repeated_line_between_varying_blocks_stay(tag, n):
    articles = [
        (f"<{tag}><h1>{a}</h1><p>{b}</p><h2>In short</h2><p>{c}</p><p>said by all</p><p>{d}</p></{tag}>", f"{a} {b} In short {c} said by all {d}")
        for a, b, c, d in ([prose(100 * i + k, 15) for k in range(4)] for i in range(n))
    ]
    assert htmltext.extract([page(i, html) for i, (html, _) in enumerate(articles)]) == [t for _, t in articles]


def test_a_heading_shared_by_two_pages_stays():
    articles = [f"<article><h2>In short</h2><p>{prose(i)}</p></article>" for i in range(2)]
    assert htmltext.extract([page(i, a) for i, a in enumerate(articles)]) == [f"In short {prose(i)}" for i in range(2)]


def test_a_box_within_the_article_that_never_varies_goes_wherever_it_stands():
    made = [body(i) for i in range(6)]
    box = "<div class=x2><p>Letters may be sent in at any time</p></div>"
    assert htmltext.extract([page(i, html.replace("<ul>", box + "<ul>", 2)) for i, (html, _) in enumerate(made)]) == [t for _, t in made]


def test_a_last_line_that_all_pages_begin_alike_goes():
    made = [body(i) for i in range(8)]
    pages = [page(i, html.replace("</article>", f"<p>Read next: {prose(i + 70, 4)}</p></article>")) for i, (html, _) in enumerate(made)]
    assert htmltext.extract(pages) == [t for _, t in made]


def test_the_template_decides_where_no_label_does(monkeypatch):
    """Boxes of many words that all pages have alike, without labels, before and after the article."""
    made = [body(i, "div") for i in range(10)]
    pages = [f"<body><div class=q><p>{NOTICE}</p><p>{NOTICE}</p></div>{html}<div class=r><p>{NOTICE}</p></div>" for html, _ in made]
    assert htmltext.extract(pages) == [t for _, t in made]
    monkeypatch.setattr(htmltext, "template", lambda pages: {})
    monkeypatch.setattr(htmltext, "_standing", lambda pages: frozenset())
    assert all(NOTICE.split()[0] in text for text in htmltext.extract(pages))


def test_a_very_long_page_is_read_whole():
    text = " ".join(["word"] * 200_000)
    assert htmltext.extract([f"<article><p>{text}</p></article>"]) == [text]


def test_internal_names_repeated_rows_and_other_types(spark):
    names = ["_host", "_groups", "_group", "n", "size", "host"]
    pages = spark.createDataFrame([(7, "http://a/", "<p>x</p>")] * 3, "page_id int, url string, html string")
    pages = pages.selectExpr("*", *(f"{i} AS {n}" for i, n in enumerate(names)), "map('k', 1) AS m")
    rows = [r.asDict() for r in htmltext.main_text(pages, per_group=1).collect()]
    assert len(rows) == 3 and all(r["text"] == "x" and [r[n] for n in names] == list(range(6)) and r["m"] == {"k": 1} for r in rows)
