import math
import time

import pytest

from lantern.llm import html

STORY = "".join(f"<p>Paragraph {k} of the story with a number of words that goes on for a while.</p>" for k in range(9))
TEXT = "\n\n".join(f"Paragraph {k} of the story with a number of words that goes on for a while." for k in range(9))
MENU = "<nav><ul>" + "<li><a href=x>menu</a></li>" * 6 + "</ul></nav>"


@pytest.mark.parametrize("around", ['<form id="aspnetForm">{}</form>', '<div class="content has-sidebar">{}</div>', '<div class="layout sidebar-right">{}</div>', '<div id="page" class="with-sidebar"><main>{}</main></div>', "<article>{}</article>", "<b>{}</b>"])
def test_wrappers_keep_their_text(around):
    assert html.main_text(f"<body>{MENU}{around.format(STORY)}<footer>The end</footer></body>") == TEXT


@pytest.mark.parametrize("aside", ['<div class="sidebar"><p>Short aside of another kind.</p></div>', "<form><p>Sign up for more</p></form>", '<section id="comments"><p>I say something to this.</p></section>', "<aside><p>Other stories</p></aside>"])
def test_boilerplate_goes(aside):
    assert html.main_text(f"<body>{MENU}<div>{STORY}</div>{aside}</body>") == TEXT


@pytest.mark.parametrize(
    "page",
    ["<p " * 200_000, "<div>" * 50_000 + "deep", "<div>" * 50_000 + "</x>" * 50_000, "<p a=\"> <p a='> " * 50_000, "<b>" * 50_000 + "<hr>" * 50_000, "<nav>" + "<i>" * 50_000 + "</b>" * 50_000, "<a href='" * 50_000 + ">", "<li>" * 50_000, "<x " + 'a="b" ' * 150_000],
)
def test_long_odd_pages_end(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 15


def test_cut_off_tags():
    tag = "<p " + " ".join(f'data-{k}="{k}"' for k in range(40))
    assert html.main_text(f"<div>{STORY}{tag}") == TEXT
    assert html.main_text(f'<div>{STORY}<p title="open') == TEXT


def plain(node, body):
    """Density and sum of every node, from the definition."""
    nodes = [c for c in node.children if isinstance(c, html.Node)]
    inside = [x for c in nodes for x in plain(c, body)]
    everything = lambda n: [n, *[x for c in n.children if isinstance(c, html.Node) for x in everything(c)]]
    chars = lambda n: sum(len(" ".join(c.split())) for x in everything(n) for c in x.children if isinstance(c, str))
    links = lambda n: sum(chars(x) for x in everything(n) if x.tag == "a")

    def density(n):
        c, lc, t, lt = chars(n), links(n), max(len(everything(n)) - 1, 1), sum(x.tag == "a" for x in everything(n))
        if not c:
            return 0.0
        base = max(math.log(c / max(c - lc, 1) * lc + links(body) / max(chars(body), 1) * c + math.e), 1 + 1e-9)
        return max(c / t * math.log(c / max(lc, 1) * (t / max(lt, 1)) + 1e-9, base), 0.0)

    return [(node, density(node), sum(map(density, nodes))), *inside]


@pytest.mark.parametrize("page", [f"<div><h1>Head</h1>{STORY}</div><ul><li><a href=x>one</a><li>two <b>bold <i>x</i></b></ul>", "<p>a<p>b <a>c</a>", "", "<b><a>x</a>y</b>z"])
def test_densities_by_definition(page):
    root = html.parse(page)
    html.weigh(root)
    for node, density, total in plain(root, root):
        assert node.density == pytest.approx(density) and node.sum == pytest.approx(total)


def test_density_decides_within_main():
    links = "".join(f"<li><a href=x>Another story number {k} about something</a></li>" for k in range(40))
    assert html.main_text(f"<main><div>{STORY}</div><div><ul>{links}</ul></div></main>") == TEXT


def test_empty_table(spark):
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
