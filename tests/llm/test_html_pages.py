"""HTML extraction: names that only look like furniture, pages of any depth, and generated pages with a known text."""

import html
import random
import resource

import pytest

from tests.llm.test_operators import PAGES, page, words
from tideline.llm import html_extract


@pytest.mark.parametrize("name", ["layout has-sidebar", "ad-free-story", "post no-comments", "share-price report", "related-work", "wrapper", "mw-navigation", "shop-banner"])
def test_a_name_empties_no_page(name):
    assert html_extract.Page(f'<body><div class="{name}"><p>The only text.</p></div></body>').main_text(None) == "The only text."


@pytest.mark.parametrize("name", ["sidebar", "site-footer", "nav-list", "cookie-notice", "comments", "ads", "ad-slot-2", "share-buttons", "newsletter_box", "main-nav", "td-footer", "related-posts"])
def test_furniture_goes(name):
    text = html_extract.Page(f'<body><article><p>{"The text. " * 9}</p></article><div class="{name}"><p>Beside it.</p></div></body>').main_text(None)
    assert text == ("The text. " * 9).strip()


def test_inline_names_part_no_block():
    assert html_extract.Page('<body><p>One <span class="share-count">5</span>two <b class="ad">buy</b>three</p></body>').main_text(None) == "One two three"


@pytest.mark.parametrize("source", ["<body>" + "<b>" * 200_000 + "text", "<body>" + "<div>x" * 50_000, "<body>" + "<b><p>x" * 20_000, "<body>" + "<i>" * 2000 + "</u>" * 200_000 + "x", "<body>" + "<div class=a>" * 100_000 + "x" + "</div>" * 100_000, "<" * 300_000])
def test_deep_and_unclosed_tags(source):
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    made = html_extract.Page(source)
    votes = made.votes()
    text = made.main_text(max(votes, key=votes.get) if votes else None)
    assert text and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # KB
    assert sum(map(len, votes)) <= 50 * len(source) + 2000 * len(votes)


def generated(r, k):
    """A page, and its main text: blocks by construction."""
    blocks = []

    def inline(n):
        out, plain = [], []
        for w in words(n, r.random()).split():
            w += r.choice(["", "", "&", "<", "é", '"'])
            plain.append(w)
            shown = html.escape(w) if r.random() < 0.7 else "".join(f"&#{ord(c)};" for c in w)
            out.append(r.choice(["{}", "{}", "<b>{}</b>", "<i>{}</i>", "<span class=x>{}</span>", "<!-- c -->{}"]).format(shown))
        return r.choice([" ", "\n  ", "<br>"]).join(out), " ".join(plain)

    def block(depth):
        kind = r.choice(["p", "p", "p", "h2", "ul", "div", "blockquote"]) if depth < 3 else "p"
        if kind == "ul":
            items = [inline(r.randint(1, 6)) for _ in range(r.randint(1, 4))]
            blocks.extend(t for _, t in items)
            close = r.choice(["</li>", ""])
            return "<ul>" + "".join(f"<li>{s}{close}" for s, _ in items) + "</ul>"
        if kind in ("div", "blockquote"):
            return f"<{kind}>" + "\n".join(block(depth + 1) for _ in range(r.randint(1, 3))) + f"</{kind}>"
        s, t = inline(r.randint(3, 25))
        blocks.append(t)
        return f"<{kind}>{s}</{kind}>"

    junk = lambda: r.choice([
        "<nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav>", "<aside><p>Side text</p></aside>", '<div class="cookie-notice"><p>We use cookies</p></div>', "<script>var a = '<p>no</p>';</script>",
        "<style>p{}</style>", '<div id="ad-slot-3"><p>Buy now</p></div>', "<form><p>Your name</p><input></form>", '<section class="comments"><p>First!</p><p>Nice one</p></section>', "<footer><p>&copy; us</p></footer>"])
    body = "\n".join(block(0) + (junk() if r.random() < 0.2 else "") for _ in range(r.randint(4, 12)))
    whole = f"<html><head><title>t</title></head><body>{junk()}{junk()}<div class='story s{k}'>{body}</div>{junk()}{junk()}</body></html>"
    return whole, "\n".join(blocks)


def test_generated_pages(spark):
    r = random.Random(5)
    made = [generated(r, k) for k in range(120)]
    rows = [(*page(s, host=f"h{k % 3}.org", i=k), 7, "x", "y") for k, (s, _) in enumerate(made)]
    got = {x.page_id: x for x in html_extract.extract(spark.createDataFrame(rows, PAGES + ", host int, winner string, text string")).collect()}
    for k, (_, text) in enumerate(made):
        assert got[k].text == text and got[k].n_chars == len(text), k


BODY = "Story text of this page. " * 14
SURE = ["banner-story", "sidebar-article", "story-widget", "main-nav-content", "social-post", "newsletter-body", "article widget"]


def text_of(source):
    page = html_extract.Page(source)
    votes = page.votes()
    return page.main_text(max(votes, key=votes.get) if votes else None)


def test_no_page_is_emptied_by_a_name_or_a_form():
    for name in SURE:
        assert text_of(f"<body><div class='{name}'><p>{BODY}</p></div></body>") == BODY.strip()
        assert text_of(f"<body><nav>Menu</nav><div class='{name}'><p>{BODY}</p></div><p>Short.</p></body>").startswith(BODY.strip())
    form = f"<body><form><input type=hidden><nav>Home</nav><div class=main><p>{BODY}</p></div><div class=footer>Foot</div><button>Go</button></form></body>"
    assert text_of(form) == BODY.strip()


def test_names_and_forms_beside_an_article_stay_out():
    article = f"<article><p>{BODY}</p></article>"
    for name in SURE:
        assert text_of(f"<body>{article}<div class='{name}'><p>Something else here.</p></div></body>") == BODY.strip()
    assert text_of(f"<body>{article}<form><div>Your name</div><div>Your mail</div></form></body>") == BODY.strip()
    for alone in ("<div class='comment-content'><p>Reader.</p></div>", "<div class='comments article'><p>Reader.</p></div>", "<nav><a href=/>Home</a></nav>", "<div class='cookie-notice'>We use cookies.</div>", "<div class='sidebar'>Side.</div>"):
        assert text_of(f"<body>{alone}</body>") == ""
