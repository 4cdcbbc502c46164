"""Operator 7: main text of web pages by a minimum cut over their blocks.

A page becomes a row of text blocks.  A linear classifier over text density, links,
sentence marks and position gives each block log odds within a bound; the elements
around it and the names of the nearest one add to them, no more than the bound.  The
sum is the capacity of the block's edge to the content or the boilerplate terminal;
neighbouring blocks and blocks of one parent are tied by smoothness edges on the same
scale, so that a short paragraph, a cell or a list item goes with what is around it.
The minimum cut separates the two.

The classifier starts from stated weights and is fitted on a bounded sample of the
table.  Its labels come from the text alone, not from any element: the run of blocks
with the most words outside links is content, what lies clear of that run is not.  The
same labels tell which class names and ids hold content, in any language.  Pages are
independent, so that extraction runs inside the tasks of one scan.
"""

from __future__ import annotations

import html as html_entities
import re
import unicodedata
from collections import Counter, deque
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without content, with raw or undisplayed text, and inline ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title object canvas select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var"
    " math mi mn mo mrow msup msub mfrac msqrt mtext semantics annotation svg g text tspan".split()
) | {"br", "wbr", "img"}
#: A start tag that ends an open element of these names; every block start ends a paragraph.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
#: Elements that an implied end does not reach beyond.
SCOPES = frozenset("ul ol dl table td th button article section div main aside nav header footer form body html".split())

# Parts of class names, ids and roles that tell boilerplate (English, Spanish, French, German), and parts that make a name say something else.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay"
    " newsletter subscribe subscription signup nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets related recommended recommendations share sharing social footer"
    " masthead topbar toolbar comment comments commentlist disqus reply replies respond pagination pager tagcloud skip copyright legal disclaimer login search complementary contentinfo dialog"
    " anuncio anuncios publicidad patrocinado aviso avisos boletin suscripcion suscribirse navegacion migas lateral relacionados recomendados compartir pie comentario comentarios respuestas buscar"
    " publicite annonce annonces pub bandeau temoins avertissement abonnement inscription barre ariane connexes recommandes partager partage pied commentaire commentaires reponses recherche"
    " werbung anzeige anzeigen hinweis hinweise meldung abonnieren navigationsleiste seitenleiste verwandte empfohlen teilen fusszeile kommentar kommentare antworten suche impressum datenschutz".split()
)
NEUTRAL_WORDS = frozenset("no non not has with without by layout wrap wrapper content main article page".split())
BOILERPLATE_TAGS = frozenset("nav footer aside dialog menu".split())
FORM_TAGS = frozenset("form fieldset button".split())
CONTENT_TAGS = frozenset("article main".split())
PARAGRAPHS = frozenset("p pre blockquote li dt dd td th figcaption h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

FEATURES = ("bias", "log_words", "link_share", "sentence", "heading", "page_edge", "density", "rights")
#: Log odds of the classifier before it sees labels; the fit is drawn towards them.
PRIOR = (-1.2, 0.6, -4.0, 0.8, 1.0, -0.5, 1.0, -4.0)
#: The fit: pages at most, how many times as many are looked at, their length at most, the weight of all their blocks together and of the prior.
FIT_PAGES, FIT_CANDIDATES, FIT_PAGE_CHARS, FIT_ROWS, FIT_PRIOR = 256, 8, 65536, 100.0, 1.0
#: Labels: words that a block of a page's run has to pay for, words of a run at least, blocks at its ends that stay without a label.
RUN_COST, RUN_WORDS, RUN_MARGIN = 10, 100, 3
#: Names: pages of the sample that have one at least, bound of their log odds.
NAME_PAGES, NAME_MOST = 3, 1.0
#: Bound of what the text says, and what the elements around a block add.
MOST = 2.5
MARKUP = {"content": 1.5, "outside": -1.5, "flagged": -4.0, "boilerplate": -4.0, "plain": 0.0}
# Smoothness: between neighbours, over their distance in the tree, and between blocks of one parent.
NEIGHBOUR, SIBLING, ACROSS = 2.0, 1.0, 0.25
#: Capacities are whole numbers of this fraction.
SCALE = 1000

_TOKEN = re.compile(r"""<!--|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<""")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)  # what a block of rights begins with
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    source: int  # characters of the page that it takes
    place: str  # what the elements around it say: content, boilerplate or plain
    flag: list  # [True] while its flagged container is no mere wrapper
    tag: str
    parent: int
    depth: int
    names: tuple  # parts of the names of the nearest element that has any


class Model(NamedTuple):
    """The classifier's weights (see FEATURES), and the log odds for content of parts of names."""

    weights: tuple[float, ...]
    names: dict[str, float]


STATED = Model(PRIOR, {})


_PLAIN = [False]


def name_parts(name: str) -> list[str]:
    """Its words, in lower case and without accents."""
    plain = name if name.isascii() else "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c))
    return [p.lower() for p in _PART.findall(plain)]


def tells_boilerplate(name: str) -> bool:
    """Whether a class, id or role names boilerplate: any of its parts does, and none makes it a layout or a negation."""
    parts = set(name_parts(name))
    return bool(parts & BOILERPLATE_WORDS) and not parts & NEUTRAL_WORDS


def _reads(tag: str, attrs: str, above: str) -> tuple[str, bool, tuple]:
    """Place of an element's text, whether the element is flagged, and the parts of its names."""
    if above == "boilerplate" or tag in BOILERPLATE_TAGS or (tag == "header" and above != "content"):
        return "boilerplate", False, ()
    flagged, names = tag in FORM_TAGS, ()
    if attrs and tag not in ("html", "body"):
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
                return "boilerplate", False, ()
            if name in ("class", "id", "role"):
                flagged = flagged or any(tells_boilerplate(v) for v in value.split())
                names += tuple(name_parts(value))
    return ("content" if tag in CONTENT_TAGS and not flagged else above), flagged, names


def blocks(page: str) -> list[Block]:
    """The blocks of a page in its order."""
    out: list[Block] = []
    stack: list[tuple[str, str, list, int, tuple]] = [("", "plain", _PLAIN, 0, ())]  # tag, place, flag, number, names
    holders = [stack[0]]  # the open elements that are not inline
    newest = 0
    open_tags: Counter = Counter()
    scopes: list[Counter] = [Counter()]  # open elements within each scope
    raised: list[list] = []  # flags of open elements
    text: list[str] = []
    linked = number = pos = begin = 0
    end = len(page)

    def close(upto: int, leaf: bool = False) -> None:
        nonlocal linked, begin
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                tag, _, _, own, _ = holders[-1]
                # a paragraph's parent is what holds it, that of text between other blocks is its element
                parent = holders[-2][3] if len(holders) > 1 and (tag in PARAGRAPHS or (leaf and own == newest)) else own
                out.append(Block(whole, min(linked, len(whole)), max(upto - begin, len(whole)), stack[-1][1], stack[-1][2], tag, parent, len(scopes), stack[-1][4]))
            text.clear()
        linked, begin = 0, upto

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            t = html_entities.unescape(raw) if "&" in raw else raw
            text.append(t)
            if open_tags["a"]:
                linked += len(t.strip())

    def pop(to: int) -> None:
        while len(stack) > to:
            tag, _, flag, own, _ = stack.pop()
            if own == holders[-1][3]:
                holders.pop()
            open_tags[tag] -= 1
            if tag in SCOPES:
                scopes.pop()
            scopes[-1][tag] -= 1
            if raised and raised[-1] is flag and stack[-1][2] is not flag:
                raised.pop()

    while pos < end:
        m = _TOKEN.search(page, pos)
        if not m:
            say(page[pos:])
            break
        say(page[pos : m.start()])
        before, pos = m.start(), m.end()
        tag = m[2]
        if tag is None:
            if m[0] == "<!--":
                at = page.find("-->", pos)
                pos = end if at < 0 else at + 3
            elif m[0] == "<":
                if page[pos : pos + 1].isalpha() or page[pos : pos + 1] == "/":
                    at = page.find(">", pos)  # a broken tag
                    pos = end if at < 0 else at + 1
                else:
                    text.append("<")
            continue
        tag = tag.lower()
        inline = tag in INLINE
        if m[1]:
            if not inline:
                close(before, True)
            if open_tags[tag] > 0:
                at = len(stack) - 1
                while stack[at][0] != tag:
                    at -= 1
                pop(at)
            continue
        if not inline:
            close(before)
            if tag not in VOID or tag == "hr":
                for name in ("p", *ENDS.get(tag, ())):
                    if scopes[-1][name] > 0 and not (name == tag and tag in SCOPES):
                        at = len(stack) - 1
                        while stack[at][0] != name:
                            at -= 1
                        pop(at)
                if tag in ("td", "th", "tr") and any(stack[-1][0] == n for n in ENDS[tag]):
                    pop(len(stack) - 1)
        elif tag == "br":
            text.append(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            m = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, pos)
            pos = m.end() if m else end
            continue
        number += 1
        place, flagged, names = _reads(tag, m[3], stack[-1][1])
        flag = stack[-1][2]
        if flagged:
            flag = [True]
            raised.append(flag)
        elif place != "boilerplate" and (tag == "h1" or tag in CONTENT_TAGS) and raised:
            for f in raised:  # what holds the page's heading or article is a wrapper
                f[0] = False
            raised.clear()
        stack.append((tag, place, flag, number, names or stack[-1][4]))
        if not inline:
            holders.append(stack[-1])
            newest = number
        open_tags[tag] += 1
        scopes[-1][tag] += 1
        if tag in SCOPES:
            scopes.append(Counter())
    close(end)
    return out


def places(found: list[Block]) -> list[str]:
    """What the markup says of each block: content, outside (of the page's article), flagged, boilerplate or plain."""
    framed = any(b.place == "content" and not b.flag[0] for b in found)
    return ["boilerplate" if b.place == "boilerplate" else "flagged" if b.flag[0] else "content" if b.place == "content" else "outside" if framed else "plain" for b in found]


def features(found: list[Block]) -> np.ndarray:
    n = len(found)
    rows = []
    for i, b in enumerate(found):
        words = b.text.count(" ") + 1
        rows.append(
            (
                1.0, min(words, 60).bit_length(), b.linked / len(b.text), b.text[-1] in ".!?\"'”»…:", b.tag in HEADINGS, abs(2 * (i + 0.5) / n - 1), len(b.text) / b.source,
                bool(_RIGHTS.match(b.text)),
            )
        )
    return np.array(rows, float).reshape(n, len(FEATURES))


def scores(found: list[Block], model: Model = STATED) -> np.ndarray:
    """Log odds of each block for content: of its text, of its names and of the elements around it.

    A box amid the text has that text's labels, so that names which tell boilerplate don't gain by them.
    """
    named = [max(-NAME_MOST, min(0.0 if b.flag[0] else NAME_MOST, sum(model.names.get(x, 0.0) for x in b.names))) for b in found]
    return np.clip(features(found) @ np.asarray(model.weights), -MOST, MOST) + np.array(named) + np.array([MARKUP[p] for p in places(found)])


def labels(found: list[Block]) -> list[bool | None]:
    """Labels that the text alone gives: the run of most words outside links is content.

    A block's words outside links, less RUN_COST and less its words inside them, are
    summed; the first run of the greatest sum counts, if it has RUN_WORDS.  RUN_MARGIN
    blocks on both sides of either end have no label (None).
    """
    gains, words = [], []
    for b in found:
        n, share = b.text.count(" ") + 1, b.linked / len(b.text)
        words.append(n)
        gains.append(n * (1 - 2 * share) - RUN_COST)
    best, at, run, start = 0.0, (0, 0), 0.0, 0
    for i, g in enumerate(gains):
        if run <= 0:
            run, start = 0.0, i
        run += g
        if run > best:
            best, at = run, (start, i + 1)
    lo, hi = at
    if sum(words[lo:hi]) < RUN_WORDS:
        return [None] * len(found)
    return [None if min(abs(i + 0.5 - lo), abs(i + 0.5 - hi)) < RUN_MARGIN else lo <= i < hi for i in range(len(found))]


def fit(pages: list[str]) -> Model:
    """Weights of most posterior probability under the stated ones, and names' log odds; the stated model without labels.

    All blocks together weigh FIT_ROWS at most, content and the rest alike, so that the
    scale of the scores does not grow with the sample.
    """
    x, y, counts = [np.zeros((0, len(FEATURES)))], [], {}
    for page in pages:
        found = blocks(page)
        got = labels(found)
        use = [i for i, k in enumerate(got) if k is not None]
        x.append(features(found)[use])
        y += [float(got[i]) for i in use]
        here: dict[str, list[int]] = {}
        for i in use:
            for name in set(found[i].names):
                here.setdefault(name, [0, 0])[got[i]] += 1
        for name, (no, yes) in here.items():  # a page says one thing of a name
            c = counts.setdefault(name, [0, 0])
            c[yes > no] += 1
    x, y = np.concatenate(x), np.array(y)
    w = prior = np.array(PRIOR)
    if len(y):
        each = np.where(y > 0, 1 / max(1.0, y.sum()), 1 / max(1.0, (1 - y).sum())) * min(FIT_ROWS, len(y)) / 2
        for _ in range(30):  # Newton's steps, cut short where they overshoot
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (each * (y - p)) - FIT_PRIOR * (w - prior)
            step = np.linalg.solve((x.T * (each * p * (1 - p))) @ x + FIT_PRIOR * np.eye(len(w)), slope)
            w = w + step / max(1.0, float(np.abs(step).max()))
    odds = {n: round(float(np.log((yes + 1) / (no + 1))) / 2, 4) for n, (no, yes) in sorted(counts.items()) if no + yes >= NAME_PAGES}
    return Model(tuple(np.round(w, 4).tolist()), odds)


def fitted_model(df: DataFrame, html_col: str = "html", most_pages: int = FIT_PAGES) -> Model:
    """The classifier fitted on at most most_pages pages of at most FIT_PAGE_CHARS characters.

    Some FIT_CANDIDATES x most_pages pages are looked at, those with small hashes; those
    of them with the least hashes are the sample.  So tasks send the driver a bounded
    number of pages together, whatever the size of the table.
    """
    html, key = F.col(html_col), F.xxhash64(html_col)
    share = min(1.0, FIT_CANDIDATES * most_pages / max(1, df.count()))
    small = key <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.lit(True)
    sample = df.where(small & (F.length(html) <= FIT_PAGE_CHARS)).select(html.alias("html"))
    return fit([r.html for r in sample.orderBy(F.xxhash64("html"), "html").limit(most_pages).collect()])


def smoothness(found: list[Block]) -> list[tuple[int, int, int]]:
    """Edges (block, block, capacity) between neighbours and between blocks of one parent."""
    edges, last, kind = [], {}, places(found)
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            far = 0 if a.parent == b.parent else 1 + abs(a.depth - b.depth)
            edges.append((i - 1, i, int(SCALE * NEIGHBOUR * (1.0 if kind[i - 1] == kind[i] else ACROSS) / (1 + far))))
        if b.parent in last and last[b.parent] != i - 1:
            edges.append((last[b.parent], i, int(SCALE * SIBLING)))
        last[b.parent] = i
    return [e for e in edges if e[2] > 0]


def minimum_cut(capacity: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the blocks on the content side of a minimum cut.

    capacity: above 0 from the content terminal, below 0 to the boilerplate one.
    Blocks whose terminal capacity is at least that of all their free edges have the
    same label in some minimum cut whatever the others are, so that they are settled
    first and pull their neighbours; what a block with one neighbour has to send goes
    through that.  The rest falls into connected parts, in each of which a flow of
    shortest augmenting paths, level by level, decides.  Ties go to the boilerplate
    side.
    """
    n = len(capacity)
    cap, near = list(capacity), [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    label: list[bool | None] = [None] * n
    gone: dict[int, int] = {}  # blocks that take their only neighbour's label
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or i in gone:
            continue
        if abs(cap[i]) >= sum(near[i].values()):
            label[i] = cap[i] > 0
            for j, c in near[i].items():
                cap[j] += c if label[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
        elif len(near[i]) == 1:  # its flow can only go through its neighbour, whose label it takes
            (j,) = near[i]
            cap[j] += cap[i]
            del near[j][i]
            near[i] = {}
            gone[i] = j
            todo.append(j)
    for start in range(n):
        if label[start] is not None or start in gone:
            continue
        part, seen = [start], {start}
        for i in part:
            more = [j for j in near[i] if j not in seen]
            seen.update(more)
            part += more
        content = _flow_side(part, cap, near)
        for i in part:
            label[i] = i in content
    for i, j in reversed(gone.items()):
        label[i] = label[j]
    return [bool(x) for x in label]


def _flow_side(part: list[int], cap: list[int], near: list[dict[int, int]]) -> set[int]:
    """The blocks of a connected part that a greatest flow leaves within reach of the content terminal."""
    left = {i: dict(near[i]) for i in part}
    give, take = {i: max(cap[i], 0) for i in part}, {i: max(-cap[i], 0) for i in part}
    while True:
        level = {i: 0 for i in part if give[i] > 0}
        todo, done = deque(level), False
        while todo:
            u = todo.popleft()
            done = done or take[u] > 0
            for v, c in left[u].items():
                if c > 0 and v not in level:
                    level[v] = level[u] + 1
                    todo.append(v)
        if not done:
            return set(level)
        ways = {u: iter([v for v in left[u] if level.get(v) == level[u] + 1]) for u in level}
        for s in [i for i in part if give[i] > 0]:
            path = [s]
            while path and give[s] > 0:
                u = path[-1]
                if take[u] > 0:
                    most = min(give[s], take[u], *(left[a][b] for a, b in zip(path[:-1], path[1:], strict=True)))
                    give[s] -= most
                    take[u] -= most
                    for a, b in zip(path[:-1], path[1:], strict=True):
                        left[a][b] -= most
                        left[b][a] += most
                    at = next((k for k in range(len(path) - 1) if left[path[k]][path[k + 1]] == 0), len(path) - 1)
                    path = path[: at + 1]
                    continue
                v = next((w for w in ways[u] if left[u][w] > 0), None)
                if v is None:
                    path.pop()
                else:
                    path.append(v)


def main_blocks(page: str, model: Model = STATED) -> tuple[list[Block], np.ndarray, list[bool]]:
    """All blocks, their scores, and whether the cut puts them on the content side."""
    found = blocks(page)
    s = scores(found, model)
    return found, s, minimum_cut((SCALE * s).astype(int).tolist(), smoothness(found)) if found else []


def main_text(page: str, model: Model = STATED) -> str:
    """The main text of one page, blocks joined by newlines; empty if there is none."""
    found, _, keep = main_blocks(page, model)
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def _extract(model: Model):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(p.as_py() or "", model) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    return run


def extract_main_text(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """One row per input row: id_col, url_col, text, n_chars (code points).

    Null and empty pages, and pages without main text, have an empty text.  Markup
    may be broken in any way: open elements, comments and quotes end with the page.
    Formulas and drawn text inside the article belong to it; what a page shows only
    without scripts, and form controls, do not.  Ids and URLs pass through, null or
    repeated; other columns are ignored.  Without a model one is fitted on
    a sample of df, which reads the table once more (see fitted_model); equal
    tables give equal models.  A page takes time in proportion to its length, but
    for the flow among blocks that neither classifier nor neighbours settle.
    """
    model = fitted_model(df, html_col) if model is None else model
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return src.mapInArrow(_extract(model), "id long, url string, text string").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars")
    )
