"""Pages with expected text: without telling names, with misleading ones, with odd markup; labels against brute force."""

import random
import time

import numpy as np
import pytest

from treestat.llm import html_text as H
from treestat.llm.tables import table

LINKS = "".join(f'<li><a href="/{k}">{w}</a></li>' for k, w in enumerate("Home News Sport Money Travel About Contact".split()))
ONE = "The council met on Tuesday to vote on the new bridge, which has been planned since the flood of last year."
TWO = "Members asked for a report on the costs, the traffic and the trees that would have to go; it is due in May."
THREE = "Nobody spoke against the plan, but some wanted to wait until the autumn before any work begins on the site."
BODY = f"<h1>Council votes on bridge</h1><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p>"
TEXT = "\n\n".join(["Council votes on bridge", ONE, TWO, THREE])

#: Pages that say nothing by names: the classifier and the cut decide.
PLAIN = {
    "lists of links around": (f"<div><ul>{LINKS}</ul></div><div>{BODY}</div><div><ul>{LINKS}</ul></div>", TEXT),
    "links before": (f"<table><tr><td><ul>{LINKS}</ul></td><td>{BODY}</td></tr></table>", TEXT),
    "a paragraph of one link": (f"<div><ul>{LINKS}</ul></div><div>{BODY}<p><a href='/r'>Read the report of the council on the bridge.</a></p><p>{ONE}</p></div>", f"{TEXT}\n\nRead the report of the council on the bridge.\n\n{ONE}"),
    "a short quotation": (f"<div><ul>{LINKS}</ul></div><div>{BODY}<blockquote>No!</blockquote><p>{ONE}</p></div>", f"{TEXT}\n\nNo!\n\n{ONE}"),
    "a line of code": (f"<div>{BODY}<pre>x = 1;</pre><p>{TWO}</p></div><div><ul>{LINKS}</ul></div>", f"{TEXT}\n\nx = 1;\n\n{TWO}"),
    "foreign names": (f"<div class='x1'><ul>{LINKS}</ul></div><div class='zq' id='k7'>{BODY}</div>", TEXT),
}
#: Pages whose names mislead.
MISLEADING = {
    **{f"{tag} {c}": (f"<html><body{f' class="{c}"' if tag == 'body' else ''}><div{f' class="{c}"' if tag == 'div' else ''}>{BODY}</div></body></html>", TEXT)
       for c in ("has-sidebar", "layout no-sidebar", "header-fixed", "ad-free", "single social-science", "page-with-comments", "nav-open") for tag in ("body", "div")},
    "a form around all": (f"<body><form id='form1'><div>{BODY}</div></form></body>", TEXT),
    "a wrapper called header-content": (f"<div class='header-content'>{BODY}</div>", TEXT),
    "named sections of an article": (f"<div class='social-history'>{BODY}</div><div class='sidebar'><p>{ONE}</p></div><footer>All rights</footer>", TEXT),
}
#: Pages whose names tell.
TELLING = {
    "comments worded like the article": (f"<div class='post'>{BODY}</div><div class='comments-area'><p>{ONE}</p><p>{TWO}</p></div>", TEXT),
    "an advert in the article": (f"<article>{BODY[:-4]}</p><div class='ad'>{ONE}</div></article>", TEXT),
    "cookie notice and site header": (f"<div class='site-header'><p>{TWO}</p></div><div id='cookie-notice'>{ONE}</div><main>{BODY}</main><div class='widget-area'><p>{ONE}</p></div>", TEXT),
    "a notice as long as the article": (f"<main>{BODY}</main><div class='newsletter-box'>{'<p>' + ONE + '</p>' * 4}</div>", TEXT),
    "an article in an open page": (f"<body class='has-sidebar nav-open'><div class='layout sidebar-right'><article>{BODY}</article><aside><p>{ONE}</p></aside></div></body>", TEXT),
}
#: Markup that is cut off or odd.
ODD = {
    "unterminated tag": (f"<article>{BODY}<a href=", f"{TEXT}\n\n<a href="),
    "unterminated quote": (f"<article>{BODY}</article><nav title='x", f"{TEXT}"),
    "less than": ("<article><p>a < b and b <c and <3</p></article>", "a < b and b <c and <3"),
    "quoted end": ("<article><p title=\"a>b\">text</p></article>", "text"),
}


@pytest.fixture(scope="module")
def weights(spark):
    return H.train(table(spark, "/root/testdata/sf0.01", "pages"))


@pytest.mark.parametrize("name", [*PLAIN, *MISLEADING, *TELLING])
def test_page(weights, name):
    page, want = (PLAIN | MISLEADING | TELLING)[name]
    assert H.content(page, weights) == want


def test_odd_markup(weights):
    for page, want in ODD.values():
        assert H.content(page, weights).startswith(want[:-7]) and "title" not in H.content(page, weights)


def test_classifier_and_cut_decide(weights):
    """How many of the pages change without the classifier and without the cut."""
    pages = [p for p, _ in (PLAIN | MISLEADING | TELLING).values()]
    uncut = lambda p: "\n\n".join(t for (t, _, _), c in zip(f, H.costs(f, weights)) if c > 0) if (f := H.blocks(p)) else ""
    whole = [H.content(p, weights) for p in pages]
    without_classifier = sum(a != H.content(p, weights * 0) for a, p in zip(whole, pages))
    without_cut = sum(a != uncut(p) for a, p in zip(whole, pages))
    print("pages", len(pages), "change without classifier", without_classifier, "without cut", without_cut)
    assert without_classifier >= 4 and without_cut >= 1


def test_labels_equal_brute_force(weights):
    rng = random.Random(3)
    parts = [f"<p>{ONE}</p>", "<p>Short.</p>", "<li><a>Link</a></li>", "<h2>Head</h2>", "<div class='ad'>Buy</div>", "<aside>See</aside>", "<div class='social-x'>Text, of some kind.</div>", f"<div>{TWO}</div>"]
    for _ in range(150):
        page = "".join(rng.choice(["<div>", "</div>", "<article>", "</article>", *parts, *parts]) for _ in range(rng.randint(1, 9)))
        found = H.blocks(page)
        if not found:
            continue
        cost, edges = H.costs(found, weights), H.smoothness(found)
        energy = lambda side: sum(-c for c, s in zip(cost, side) if s) + sum(w for a, b, w in edges if side[a] != side[b])
        best = min(energy([k >> i & 1 for i in range(len(found))]) for k in range(1 << len(found)))
        assert abs(energy(H.min_cut(cost.tolist(), edges)) - best) < 1e-9


def test_ties_of_the_cut():
    """Equal costs of both labels: content, by the side that the flow leaves unreached."""
    assert H.min_cut([1.0, -1.0], [(0, 1, 5.0)]) == H.min_cut([1.0, -1.0], [(0, 1, 5.0)])
    assert H.min_cut([0.0, 0.0], []) == [True, True]


@pytest.mark.parametrize("page", ["<a " * 300_000, "<b>" * 40_000 + "<div></div>" * 40_000, "<div>" * 40_000 + "</section>" * 40_000, "<! " * 100_000, "<i><div>" + "<b>" * 30_000 + "</i>" * 30_000, "<nav>" * 20_000 + "x" + "</nav>y" * 20_000])
def test_tokenizer_is_linear(page):
    took = []
    for n in (len(page) // 8, len(page)):
        began = time.process_time()
        H.blocks(page[:n])
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.05)


def test_names():
    assert H._named("no-sidebar") == H._named("has-comments") == H._named("grid") == 0
    assert H._named("sidebar") == H._named("comments-area") == H._named("siteFooter") == -H.TELLING
    assert H._named("social-science") == -H.HINT and H._named("postBody") == H._named("entry-content") == H.TELLING
    assert np.isfinite(H.told([])).all()
