"""Main-text extraction against pages whose article is known by construction, and its worst cases."""

import random
import time

import pytest

from cellweave.llm.extract import main_text


def prose(rng, words):
    return " ".join(rng.choice(["the", "house", "of", "river,", "stones.", "light", "Carried", "over", "a", "quiet", "field;"]) for _ in range(words)) + "."


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def links(rng, n):
    return "<ul>" + "".join(f"<li><a href='/{k}'>{rng.choice(['Home', 'About us', 'News', 'Contact'])}</a></li>" for k in range(n)) + "</ul>"


LAYOUTS = {
    "labelled": "<nav>{menu}</nav><div class=ad>{ad}</div><article><h1>{title}</h1>{body}</article><div id=comments>{talk}</div><footer>{foot}</footer>",
    "menu without a label": "{menu}<div><h1>{title}</h1>{body}</div><div>{foot}</div>",
    "all in body": "{menu}<h1>{title}</h1>{body}<div class='site-footer'>{foot}</div>",
    "main": "<header><a href=/>Site</a></header><main><h1>{title}</h1>{body}<aside>{ad}</aside></main><form><p>Your name</p><button>Send</button></form>",
    "two boxes": "<div><div>{menu}</div></div><div class=wrapper><div class='content no-sidebar'><h2>{title}</h2>{body}</div><div class=sidebar>{ad}</div></div>",
    "form around the page": "<form action=x><div class=top-menu>{menu}</div><div><h1>{title}</h1>{body}</div><input type=hidden></form>",
    "nested sections": "<article><section><h2>{title}</h2></section><section><div>{body}</div></section><footer>{foot}</footer></article><div class=newsletter>{ad}</div>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_article_of_every_layout(layout):
    rng = random.Random(layout)
    for _ in range(20):
        title = prose(rng, 5)
        body = [prose(rng, rng.randint(25, 120)) for _ in range(rng.randint(3, 9))]
        page = LAYOUTS[layout].format(menu=links(rng, 6), ad=prose(rng, 8), title=title, body=paragraphs(body), talk=paragraphs([prose(rng, 12)] * 3), foot="(c) 2020 Site")
        assert main_text(f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body>{page}</body></html>") == "\n".join([title, *body])


def test_ratios_alone_find_the_article():
    """Without what tags, roles, classes and ids say: menu, advert and footer go by their paths' ratios."""
    rng = random.Random(3)
    for _ in range(20):
        body = [prose(rng, rng.randint(40, 120)) for _ in range(6)]
        page = LAYOUTS["labelled"].format(menu=links(rng, 6), ad="Buy now", title="Title", body=paragraphs(body), talk="", foot="(c) Site")
        assert main_text(page, hints=False) == "\n".join(["Title", *body])


@pytest.mark.parametrize("tag", ["section", "section id=related-work", "div class=legal-history", "div class=lead"])
def test_short_sections_stay(tag):
    rng = random.Random(4)
    long, short = [prose(rng, 80) for _ in range(10)], [prose(rng, 12), "Three words only"]
    name = tag.split()[0]
    for page in ("<article><section>{a}</section><{t}>{b}</{n}></article>", "<div id=content><section>{a}</section><{t}>{b}</{n}></div>", "<main><{t}>{b}</{n}><section>{a}</section></main>"):
        got = main_text("<body><nav>x</nav>" + page.format(a=paragraphs(long), b=paragraphs(short), t=tag, n=name) + "</body>")
        assert sorted(got.split("\n")) == sorted(long + short), page


def test_inline_elements_do_not_split_and_unclosed_controls_hide_nothing():
    text = "The sum of <math><mi>x</mi><mo>+</mo><mn>1</mn></math> and <font>more</font>, press <button>OK</button>now."
    assert main_text(f"<article><p>{text}</p></article>") == "The sum of x+1 and more, press now."
    for control in ("button", "select", "object", "svg", "video", "noscript", "template", "textarea", "iframe", "title"):
        assert main_text(f"<article><p>One, two.</p><{control}><p>Three, four.</p><p>Five.</p></article>") == "One, two.\nThree, four.\nFive.", control
        assert main_text(f"<article><p>One, two.</p><{control}>no</{control}><p>Three, four.</p></article>") == "One, two.\nThree, four."
    assert main_text("<p>a < b &amp;&#65;&#x42;&#99999999999;&#" + "0" * 5000 + "67; <!-- c --> d<br>e&nbsp;f <a href='x") == "a < b &AB� C d e f".replace("� C", "�C")
    assert main_text("<article><header><h1>Title, long</h1><p>By me</p></header><p>Text, text and more text.</p></article>") == "Title, long\nText, text and more text."


WORST = {
    "open tags": "<a " * 100_000, "nested": "<div>" * 100_000 + "<p>x", "text in depth": "<div>a" * 50_000, "quotes": "<a ='" * 100_000 + ">", "comments": "<!--" * 100_000,
    "controls": "<button>" * 50_000, "images": "<svg>" * 50_000 + "</svg>" * 9, "classes": "<p class='" + "a-b " * 100_000 + "'>x", "ends": "</div>" * 100_000,
    "scopes": "<p><table>" + "<x-y>" * 30_000 + "<h1>a</h1>" * 30_000, "cdata": "<![CDATA[" * 50_000, "less": "<" * 200_000, "spaces": "<p " + "= " * 100_000 + ">x", "boxes": "<div>a</div><nav>b</nav>" * 30_000,
}


@pytest.mark.parametrize("name", WORST)
def test_time_is_linear(name):
    began = time.process_time()
    main_text(WORST[name])
    assert time.process_time() - began < 20
