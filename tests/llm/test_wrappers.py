import pytest

from lantern.llm import html

TEXT = "The old bridge over the river was closed for a year, and the town had to find another way to the market. " * 6
MENU = '<div class="sidebar"><a href="/a">First link</a><a href="/b">Second link</a></div>'


@pytest.mark.parametrize("wrapper", ['div class="layout has-sidebar"', 'div id="page" class="with-sidebar"', 'div class="elementor-widget-container"', 'form id="aspnetForm"', 'div class="no-header"'])
@pytest.mark.parametrize("inner", ["<article><p>{}</p></article>", "<div><p>{}</p></div>"])
def test_wrappers_keep_their_article(wrapper, inner):
    page = f"<html><body><{wrapper}>{MENU}{inner.format(TEXT)}</{wrapper.split()[0]}></body></html>"
    assert html.main_text(page) == TEXT.strip()


def test_marked_nodes_still_go():
    comments = f'<div id="comments"><article class="comment-body"><p>{TEXT * 3}</p></article></div>'
    form = '<form class="newsletter"><p>Subscribe to our letter</p></form>'
    assert html.main_text(f"<body>{MENU}<div><p>{TEXT}</p></div>{form}{comments}</body>") == TEXT.strip()


ARTICLE = "A quiet street by the harbour has been opened to walkers again after two years of work on its walls. " * 4
BLOCK = "We use cookies and similar techniques to remember what you like, and to show you offers of our partners. " * 18


@pytest.mark.parametrize("block", ['div class="sidebar"', 'div class="newsletter"', 'div class="cookie-consent"', 'div class="footer"', 'div class="advert"', "form", 'section id="comments"', 'article class="comment"', 'div class="reader-responses"'])
@pytest.mark.parametrize("article", ["<div><p>{}</p></div>", "<article><p>{}</p></article>", "<main><h1>Street</h1><p>{}</p></main>", '<article><div class="body"><p>{}</p></div></article>'])
@pytest.mark.parametrize("first", [True, False])
def test_long_marked_blocks_go(block, article, first):
    noise, text = f"<{block}><p>{BLOCK}</p><p>{BLOCK}</p></{block.split()[0]}>", article.format(ARTICLE)
    page = f"<html><body><h2>Title</h2>{noise + text if first else text + noise}</body></html>"
    assert html.main_text(page).removeprefix("Street\n\n").removeprefix("Title\n\n").removeprefix("Street\n\n") == ARTICLE.strip()


def test_teasers_in_a_sidebar_go_beside_an_article():
    page = f'<body><div class="sidebar"><article><p>{BLOCK}</p></article></div><main><article><p>{ARTICLE}</p></article></main></body>'
    assert html.main_text(page) == ARTICLE.strip()


def test_comments_as_articles_go():
    comments = "".join(f'<article class="comment"><p>{BLOCK}</p></article>' for _ in range(5))
    assert html.main_text(f"<body><article><p>{ARTICLE}</p></article><section>{comments}</section></body>") == ARTICLE.strip()
    assert html.main_text(f'<body><article><p>{ARTICLE}</p><div class="reader-responses"><p>{BLOCK}</p></div></article></body>') == ARTICLE.strip()
