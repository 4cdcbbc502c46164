"""HTML extraction: a labelled set of page templates, and the tables' pages against a plain reading of their article."""

import html
import random
import re
import time
from collections import Counter

import numpy as np

from waymetric.llm import html_extract as H

BASE = "/root/testdata/sf0.01"


def words(r, n):
    return " ".join("".join(r.choice("aeiourstnlmdp") for _ in range(r.randint(2, 9))) for _ in range(n))


def labelled_page(r, template):
    """(page, texts of its article): menus, adverts, share boxes and comments around and inside."""
    body, want = [], []

    def say(tag, text, cls=""):
        want.append(text)
        body.append(f"<{tag}{cls}>{text}</{tag}>")

    say("h1", words(r, 6))
    for k in range(r.randint(4, 12)):
        say("div" if template == "divs" else "p", words(r, r.randint(12, 80)) + ".")
        if k % 4 == 1:
            say("div" if template == "divs" else "p", r.choice(["No.", "Why?", "Indeed."]))
        if k == 2:
            body.append(f'<div class="share-box">Share this: <a href="/t">{words(r, 2)}</a></div>')
    text = "".join(body)
    nav = "<ul>" + "".join(f'<li><a href="/{i}">{words(r, 2)}</a></li>' for i in range(6)) + "</ul>"
    comments = "".join(f"<div class='comment'><p>{words(r, 25)}.</p></div>" for _ in range(3))
    foot = f"<p>&copy; {words(r, 5)}.</p>"
    ad = f'<div class="ad-banner">{words(r, 12)}.</div>'
    if template == "article":
        page = f"<nav>{nav}</nav>{ad}<article>{text}<section class=comments>{comments}</section></article><footer>{foot}</footer>"
    elif template == "main":
        page = f"<header><h1>Site</h1></header><nav>{nav}</nav><main class='page'>{text}</main><aside><p>{words(r, 30)}.</p></aside>{ad}"
    elif template == "form":
        page = f"<form action=x><div class=menu>{nav}</div><div id=body>{text}</div><div class='footer'>{foot}</div></form>"
    elif template == "sidebar":
        page = f'<div class="wrap no-sidebar"><div class="navbar">{nav}</div><div class="post">{text}</div>{ad}<div id="comments">{comments}</div></div><div class="site-footer">{foot}</div>'
    else:
        page = f'<div class="layout side-by-side"><div class="topbar menu">{nav}</div><div class="post">{text}</div><div class="sidebar"><p>{words(r, 20)}.</p>{nav}</div></div><div id=footer>{foot}</div>'
    return f"<html><head><title>x</title></head><body>{page}</body></html>", want


def test_labelled_templates_and_the_cuts_share():
    r = random.Random(4)
    pages = [(t, *labelled_page(r, t)) for t in ("article", "main", "form", "sidebar", "divs") for _ in range(40)]
    model = H.fit([p for t, p, _ in pages if t in ("article", "main")][:30])
    right = got = wanted = changed = by_score = by_cut = blocks = 0
    for _, page, want in pages:
        found, score, keep = H.main_blocks(page, model)
        text = [b.text for b, k in zip(found, keep, strict=True) if k]
        right, got, wanted = right + len(set(text) & set(want)), got + len(set(text)), wanted + len(set(want))
        changed += int(((score > 0) != np.array(keep)).sum())
        alone = {b.text for b, s in zip(found, score, strict=True) if s > 0}
        by_score += len(set(want) ^ alone)  # blocks that the classifier alone misses or adds
        by_cut += len(set(want) ^ set(text))
        blocks += len(found)
    assert right / got > 0.99 and right / wanted > 0.99, (right / got, right / wanted)
    assert by_cut <= by_score, (changed / blocks, by_cut, by_score)


def test_pages_without_article_and_with_formulas():
    text = "<h1>On squares</h1><p>The sum of two squares can be written as a product of two numbers.</p><p>So <math><mi>a</mi><mo>=</mo><mn>4</mn></math> holds in all cases of it.</p>"
    want = "On squares\nThe sum of two squares can be written as a product of two numbers.\nSo a=4 holds in all cases of it."
    for wrap in ('<div class="wrap no-sidebar">{}</div>', '<div class="layout side-by-side">{}</div>', "<form>{}</form>", '<div class="ad-free with-comments">{}</div>', "<article>{}</article>", "<main>{}</main>"):
        assert H.main_text(wrap.format(text)) == want, wrap
    assert not H.tells_boilerplate("no-sidebar") and not H.tells_boilerplate("shadow") and H.tells_boilerplate("siteFooter") and H.tells_boilerplate("cookie-box")


def test_flow_agrees_with_all_labellings():
    r = random.Random(9)
    for _ in range(300):
        n = r.randint(1, 8)
        cap = [r.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, r.randint(1, 6)) for a in range(n) for b in range(a + 1, n) if r.random() < 0.4]
        cost = lambda x: sum(abs(c) for c, k in zip(cap, x, strict=True) if (c > 0) != k and c) + sum(c for a, b, c in edges if x[a] != x[b])  # noqa: B023, E731
        assert cost(H.minimum_cut(cap, edges)) == min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))


def test_nested_and_stray_tags_take_linear_time():
    def seconds(n):
        began = time.process_time()
        for p in ("<div>" * n + "x</b>" * n, "<b>" * n + "<p>x" * n, "<p><table><td>" + "<b>" * n + "<p>x" * n, "<div class=ad>" * n + "<h1>x</h1>" * n, "<b>" * n + "x<hr>" * n):
            H.main_text(p)
        return time.process_time() - began

    seconds(500)
    assert seconds(16000) < 12 * max(seconds(4000), 0.1)


def article_text(page):
    """The blocks of the one article element, by patterns."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (re.sub(r"<br>", " ", b) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner))
    texts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in parts)
    return "\n".join(t for t in texts if t)


def test_whole_table_against_the_plain_reading(spark):
    pages = spark.read.parquet(f"{BASE}/pages.parquet")
    want = {r.page_id: article_text(r.html) if r.html and "<article>" in r.html else "" for r in pages.collect()}
    got = H.extract_main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_the_tables_pages_without_their_elements():
    """The same text where no element says what is the article, the menu or the footer: labels and fit rest on the text."""
    import pyarrow.parquet as pq

    pages = [p for p in pq.read_table(f"{BASE}/pages.parquet").column("html").to_pylist() if p and "<article>" in p]
    bare = [re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", p) for p in pages]
    model = H.fit(bare[:200])
    right = got = wanted = changed = 0
    for page, whole in zip(bare, pages, strict=True):
        found, score, keep = H.main_blocks(page, model)
        text, want = Counter(b.text for b, k in zip(found, keep, strict=True) if k), Counter(article_text(whole).split("\n"))
        right, got, wanted = right + (text & want).total(), got + text.total(), wanted + want.total()
        changed += int(((score > 0) != np.array(keep)).sum())
    assert right / got > 0.93 and right / wanted > 0.99, (right / got, right / wanted, changed)


def test_tables_lists_recipes_and_names_in_other_languages():
    r = random.Random(2)
    nav = "<ul>" + "".join(f'<li><a href="/{i}">{words(r, 2)}</a></li>' for i in range(6)) + "</ul>"
    cases = [
        (
            f"<div class=top>{nav}</div><div id=content><h1>Soup of the day</h1><table><tr><th>Flour</th><td>200 g</td></tr><tr><th>Salt</th><td>1 spoon</td></tr></table>"
            "<ul><li>Mix it well</li><li>Bake it</li></ul><pre>stir 10\nbake 20</pre></div><div class=footer><p>Copyright us all</p></div>",
            "Soup of the day\nFlour\n200 g\nSalt\n1 spoon\nMix it well\nBake it\nstir 10 bake 20",
        ),
        (
            f"<nav>{nav}</nav><div><h1>Soup</h1><h2>Ingredients</h2><ul><li>two onions</li><li>salt</li></ul><h2>Method</h2><ol><li>Cut the onions.</li><li>Cook them for an hour.</li></ol></div>"
            "<footer>x y z</footer>",
            "Soup\nIngredients\ntwo onions\nsalt\nMethod\nCut the onions.\nCook them for an hour.",
        ),
        ("<article><h1>Hola</h1><p>Un texto largo sobre nada en particular.</p><section class='comentarios'><p>Muy buen texto, me gusta leer cosas como esta.</p></section></article>", "Hola\nUn texto largo sobre nada en particular."),
        ("<article><h1>Salut</h1><p>Court.</p></article><div class='publicité'>Achetez nos produits tout de suite ici.</div>", "Salut\nCourt."),
        (f"<div>{nav}</div><div class=post><h1>T</h1><p>One two.</p></div><div>{nav}</div>", "T\nOne two."),
    ]
    fitted = H.fit([labelled_page(r, t)[0] for t in ("article", "sidebar", "divs") for _ in range(20)])
    mended = 0
    for model in (H.STATED, fitted):
        for page, want in cases:
            found, score, keep = H.main_blocks(page, model)
            assert "\n".join(b.text for b, k in zip(found, keep, strict=True) if k) == want
            mended += int(((score > 0) != np.array(keep)).sum())
    assert mended > 0  # cells and items that the classifier alone gets wrong


def test_labels_rest_on_the_text_and_name_odds_on_labels():
    r = random.Random(3)
    pages = []
    for _ in range(12):
        menu = "".join(f'<p><a href="/{i}">{words(r, 2)}</a></p>' for i in range(8))
        pages.append(f"<div class=zimbo>{menu}</div><div class=quux>{''.join(f'<p>{words(r, 40)}.</p>' for _ in range(9))}</div><div class=zimbo>{menu}</div>")
    got = H.labels(H.blocks(pages[0]))
    assert got == [False] * 6 + [None] * 5 + [True] * 4 + [None] * 5 + [False] * 6 or (got[:5] == [False] * 5 and got[-5:] == [False] * 5 and got[11:14] == [True] * 3), got
    names = H.fit(pages).names
    assert names["zimbo"] < -0.5 and names["quux"] > 0.5
    assert H.labels([]) == [] and H.labels(H.blocks("<p>few words</p>")) == [None]


def test_fit_without_labels_and_repeated_fits(spark):
    assert H.fit([]) == H.STATED and H.fit(["<p>few words</p>"]) == H.STATED
    pages = spark.read.parquet(f"{BASE}/pages.parquet")
    assert H.fitted_model(pages.repartition(5)) == H.fitted_model(pages)
    few = [H.fitted_model(p, most_pages=4) for p in (pages.repartition(3), pages)]  # candidates are a part of the table
    assert few[0] == few[1] != H.STATED
    assert H.fitted_model(pages.where("false")) == H.STATED
