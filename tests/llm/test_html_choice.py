"""Where the article is: what varies in its place stays, whatever forms and names are around; hosts with and without article elements."""

import random

import pytest

from palimpsest.llm import html_extract

SCHEMA = "page_id long, url string, html string"


def _words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def _form(rnd, tag):
    head, text = _words(rnd, 4), _words(rnd, rnd.randint(60, 120))
    page = f'<body><form id="aspnetForm"><div class="top"><a href="/a">Home page</a></div><{tag}><h1>{head}</h1><p>{text}</p></{tag.split()[0]}></form><footer>Imprint and terms</footer></body>'
    return page, f"{head} {text}"


def _share_price(rnd, tag):
    text, side = _words(rnd, 120), _words(rnd, 9)
    inner = f'<div class="share-price"><p>{text}</p></div><div class="x"><p>{side}</p></div>'
    return f"<body><nav>menu here</nav><{tag}>{inner}</{tag.split()[0]}></body>", f"{text} {side}"


def _sections(rnd, tag):
    parts = [_words(rnd, rnd.randint(12, 30)) for _ in range(3)]
    inner = f'<p>{parts[0]}</p><section id="discussion"><p>{parts[1]}</p></section><section id="related"><p>{parts[2]}</p></section>'
    return f"<body><nav>menu here</nav><{tag}><h1>Some head</h1>{inner}</{tag.split()[0]}></body>", " ".join(parts)


def _lead(rnd, tag):
    lead, text = _words(rnd, 7), _words(rnd, rnd.randint(150, 250))
    return f'<body><nav>menu here</nav><{tag}><div class="lead">{lead}</div><div class="text"><p>{text}</p></div></{tag.split()[0]}><footer>x y</footer></body>', f"{lead} {text}"


def _lead_on_page(rnd, tag):
    lead, text = _words(rnd, 7), _words(rnd, rnd.randint(150, 250))
    return f'<body><nav>menu here</nav><div class="lead">{lead}</div><div class="text"><p>{text}</p></div><footer>x y</footer></body>', f"{lead} {text}"


def _lead_under_heading(rnd, tag):
    head, lead, text = _words(rnd, 5), _words(rnd, 7), _words(rnd, rnd.randint(150, 250))
    ads = [f'<div class="k{n}">{_words(rnd, 4)}</div>' for n in (2, 3)]
    return f'<body><nav>menu here</nav>{ads[0]}<div class="h"><h1>{head}</h1></div><div class="lead">{lead}</div><div class="text"><p>{text}</p></div>{ads[1]}<footer>x y</footer></body>', f"{head} {lead} {text}"


def _comments(rnd, tag):
    head, text = _words(rnd, 4), _words(rnd, rnd.randint(30, 60))
    kind = "article" if tag == "article" else "div"
    said = "".join(f'<{kind} class="comment"><p>{_words(rnd, rnd.randint(3, 40))}</p></{kind}>' for _ in range(rnd.randint(2, 6)))
    return f"<body><nav>menu here</nav><{tag}><h1>{head}</h1><p>{text}</p><div>{said}</div></{tag.split()[0]}></body>", f"{head} {text}"


def _formula(rnd, tag):
    head, a, b, c, d = (_words(rnd, n) for n in (4, 30, 30, 3, 3))
    inner = f"<p>{a} <math><mi>x</mi><mo>=</mo><mn>{rnd.randint(1, 99)}</mn></math> {b}</p><svg><text>{c}</text></svg><object>{d}</object><noscript><p>{a}</p></noscript>"
    number = inner.split("<mn>")[1].split("<")[0]
    return f"<body><nav>menu here</nav><{tag}><h1>{head}</h1>{inner}</{tag.split()[0]}></body>", f"{head} {a} x={number} {b} {c} {d} {a}"


@pytest.mark.parametrize("tag", ["article", 'div class="k9"'])
@pytest.mark.parametrize("site", [_form, _share_price, _sections, _lead, _lead_on_page, _lead_under_heading, _comments, _formula])
def test_what_varies_in_the_article_stays(spark, site, tag):
    rnd = random.Random(5)
    made = [site(rnd, tag) for _ in range(6)]
    rows = [(k, f"https://h.example/{k}", page) for k, (page, _) in enumerate(made)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    # The sections' heading is a constant: of an article element it is kept, of a plain container it is the template's.
    constant = "Some head " if site is _sections and tag == "article" else ""
    assert got == {k: constant + text for k, (_, text) in enumerate(made)}


@pytest.mark.parametrize("site", [_form, _share_price, _lead, _comments, _formula])
def test_single_pages_decide_the_same(site):
    rnd = random.Random(6)
    page, want = site(rnd, "article")
    assert html_extract.main_text(page, None, frozenset()) == want


@pytest.mark.parametrize(("page", "want"), [
    ('<form><input></form><p>some words of the page</p><form action="/s">search for it</form>', "some words of the page"),
    ('<form><p>long text of the page that is in the form</p></form><p>a b</p>', "long text of the page that is in the form a b"),
    ('<article><p>a b c d e</p><div class="ad">buy it</div><p>f g</p></article>', "a b c d e f g"),
    ('<article><div class="ad"><p>a b c d e f g h</p></div><p>i j</p></article>', "a b c d e f g h i j"),
    ("<p>one <svg><path d='x'/></svg>two</p>", "one two"),
])
def test_forms_and_names(page, want):
    assert html_extract.main_text(page, None, frozenset()) == want
