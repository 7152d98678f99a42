"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at block-level tags.  A block has its word count and
link density, those of the blocks before and after it, and what encloses it.  A
small tree, grown on the blocks of the labelled pages below, says which blocks
are main text.  Every labelled page stands there twice: as it is, and with all
its tags and names that tell what they enclose taken away, so that the tree also
learns pages on which only words, links and neighbours tell.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracelake.llm.session import bounded_batches, table

RESULT = "page_id long, url string, text string, n_chars long"
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Their content is no text of the page.
DROPPED = frozenset("script style head noscript template svg iframe object canvas select button textarea audio video title".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ASIDE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
ASIDE_NAMES = frozenset(
    "ad ads advert advertisement banner sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended sidebar menu navbar nav navigation breadcrumb breadcrumbs footer masthead topbar comment comments reply replies respond disqus discussion widget pagination pager toolbar legal copyright tags".split()
)
MAIN_NAMES = frozenset("article content main post entry story body".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: Before a name, these say that something else is about it, as in has-sidebar.
ABOUT = frozenset("has with no without".split())
FEATURES = ("nearest", "aside", "main", "heading", "words", "links", "words before", "links before", "words after", "links after")


class Block(NamedTuple):
    text: str
    words: int
    link_words: int
    nearest: int
    aside: bool
    main: bool
    heading: bool
    label: bool


class Open(NamedTuple):
    """nearest: whether the innermost element that tells anything is of the main text (1) or beside it (-1)."""

    tag: str
    nearest: int
    aside: bool
    main: bool
    gone: bool
    label: bool


def words_in_names(attributes: str) -> tuple[set[str], set[str]]:
    """Words of the element's names, and the names that are one word."""
    found = " ".join(next(filter(None, m), "") for m in NAMES.findall(attributes))
    names = [re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) for name in found.split()]
    return {w for name in names for k, w in enumerate(name) if not (k and name[k - 1] in ABOUT)}, {name[0] for name in names if len(name) == 1}


def opened(tag: str, attributes: str, inside: Open) -> Open:
    """What an element adds to what encloses it.

    Names of the whole page say what the page has, and those of an article what it
    is about, so only an article's one-word names can put it beside the main text.
    <main> is not beside it, whatever encloses it.
    """
    words, alone = words_in_names(attributes) if "=" in attributes and tag not in ("html", "body") else (set(), set())
    beside = (alone if tag == "article" else words if tag != "main" else set()) & ASIDE_NAMES
    main_here = tag in ("article", "main") or bool(words & MAIN_NAMES)
    aside_here = tag in ASIDE_TAGS or bool(beside) or (not inside.main and (tag == "header" or "header" in words))
    gone = inside.gone or tag in DROPPED or bool(attributes and HIDDEN.search(attributes))
    nearest = -1 if aside_here else 1 if main_here else inside.nearest
    return Open(tag, nearest, aside_here or (inside.aside and tag != "main"), inside.main or main_here, gone, inside.label or "data-main" in attributes)


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, without empty ones."""
    out: list[Block] = []
    stack = [Open("", 0, False, False, False, False)]
    parts: list[str] = []
    linked: list[str] = []
    in_link, heading, at = 0, False, 0
    still_open: Counter[str] = Counter()

    def close() -> None:
        nonlocal heading
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            inside = stack[-1]
            out.append(Block(text, text.count(" ") + 1, len(html.unescape(" ".join(linked)).split()), inside.nearest, inside.aside, inside.main, heading, inside.label))
        parts.clear()
        linked.clear()

    def add(text: str) -> None:
        if text and not stack[-1].gone:
            parts.append(text)
            if in_link:
                linked.append(text)

    def push(element: Open) -> None:
        stack.append(element)
        still_open[element.tag] += 1

    def pop() -> str:
        tag = stack.pop().tag
        still_open[tag] -= 1
        return tag

    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            add(" ")
        elif tag in BLOCK_TAGS or tag in DROPPED:
            if tag in BLOCK_TAGS:
                close()
                heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            if closing:
                if still_open[tag]:  # else it closes nothing, and what is open is not searched
                    while pop() != tag:
                        pass
            elif tag == "body":  # whatever the head left open ends here
                while len(stack) > 1:
                    pop()
                push(opened(tag, attributes, stack[0]))
            elif tag not in VOID and not (attributes.endswith("/") and tag == "svg"):
                while len(stack) > 1 and stack[-1].tag in (CLOSES_ITSELF.get(tag, ()) if tag in CLOSES_ITSELF else ("p",) if tag in BLOCK_TAGS else ()):
                    pop()
                if tag in RAW:
                    end = re.compile(f"</{tag}[\\s>/]", re.I).search(page, at)
                    at = page.find(">", end.start()) + 1 or len(page) if end else len(page)
                else:
                    push(opened(tag, attributes, stack[-1]))
    add(page[at:])
    close()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """One row per block, in the order of FEATURES.  Beyond the first and last block there are none with words."""
    if not blocks:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b.words for b in blocks], float)
    links = np.array([min(1.0, b.link_words / b.words) for b in blocks])
    before = lambda x: np.concatenate([[0.0], x[:-1]])
    after = lambda x: np.concatenate([x[1:], [0.0]])
    flags = [np.array([getattr(b, name) for b in blocks], float) for name in FEATURES[:4]]
    return np.stack([*flags, words, links, before(words), before(links), after(words), after(links)], axis=1)


class Node(NamedTuple):
    share: float
    feature: int = -1
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 2) -> Node:
    """A classification tree by Gini impurity."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return Node(share)
    best = (1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            n = int(low.sum())
            if least <= n <= len(y) - least:
                p, q = y[low].mean(), y[~low].mean()
                gain = share * (1 - share) - (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) / len(y)
                if gain > best[0] + 1e-12:
                    best = (gain, f, float(cut))
    if best[1] < 0:
        return Node(share)
    low = x[:, best[1]] <= best[2]
    return Node(share, best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def classify(tree: Node, x: np.ndarray) -> np.ndarray:
    if tree.feature < 0:
        return np.full(len(x), tree.share >= 0.5)
    low = x[:, tree.feature] <= tree.at
    out = np.empty(len(x), bool)
    out[low], out[~low] = classify(tree.low, x[low]), classify(tree.high, x[~low])
    return out


_FLOOD = "The committee met in the spring to hear reports on the state of the river, and its members agreed that the old weirs should be repaired before the autumn floods came."
_PRICES = "Prices rose a little in the second quarter, the survey found."
_TRAIN = "Le train de nuit entre les deux villes sera remis en service au printemps prochain, a annoncé la compagnie, qui promet des voitures neuves, un wagon-restaurant et des billets moins chers que l'avion ; les syndicats, eux, attendent de voir."
_MARKET = "El mercado abre temprano y los vecinos llegan con sus cestas antes de que salga el sol."
_FOREST = "Im Wald hinter dem Dorf stehen Buchen, die älter sind als die Kirche, und wer dort im Herbst geht, hört außer dem Wind nichts."
_BOAT = "Nobody remembered who had built the boat. It had always lain at the end of the pier, its paint gone grey, its ropes green with weed, and children were told not to climb into it. In the year of the great storm it broke loose in the night, crossed the bay by itself and came to rest on the far shore without a scratch, which the older people in the town took for a sign, though they could not agree of what."
_SHORT = ["So be it.", "Done.", "¿Y después?", "Alors on attend.", "That was in May.", "Mehr wusste er nicht."]
_SALE = "Save up to half on boots, coats and bags this week only, while stock lasts, in all our shops and online."
_COOKIES = "We use cookies to improve this site. By staying you agree to that use of cookies."
_REPLY = "I walked there last year and I can tell you that it is not like that at all, the path is closed from October on."
_LETTER = "Subscribe to our letter and get all the news of the week in one mail."
_RIGHTS = "&copy; 2020 River News &middot; all rights reserved, no part may be copied without leave."


def _links(*names: str) -> str:
    return "".join(f'<li><a href="/{n}">{n}</a></li>' for n in names)


_HEADS = ["Three ways to cross the river without a boat", "Old weirs, new money: who pays for the works this time", "What the storm left behind on the shore", "Bread, coats and coal: the prices of one long winter in nine charts", "A night on the last train", "The man who counts the trees of the parish, one by one, every year"]


#: The labelled table's pages: blocks inside an element with data-main are main text.
LABELLED = [
    f'<body><nav><ul>{_links("Home", "News", "Weather", "Sport")}</ul></nav><article data-main><h1>River works begin</h1><p>{_FLOOD}</p><p>{_SHORT[0]}</p><p>{_PRICES}</p><p>{_SHORT[1]}</p></article><footer>{_RIGHTS}</footer></body>',
    f'<body><header><a href="/">The Daily</a><p>Since 1901</p></header><div class="cookie-notice"><p>{_COOKIES}</p></div><main data-main><h1>La feria</h1><p>{_MARKET}</p><ul><li>manzanas</li><li>peras</li></ul><p>{_MARKET} {_PRICES}</p></main><aside><h3>Related</h3><p>{_PRICES}</p></aside><footer><p>Contact us at the office in town.</p></footer></body>',
    f'<body><div><ul>{_links("Start", "Shop", "About")}</ul></div><div data-main><p>{_FLOOD}</p><p>{_TRAIN} {_PRICES}</p><p>{_SHORT[3]}</p><p>{_FLOOD}</p></div><div><a href="/x">Terms</a> <a href="/y">Privacy</a></div></body>',
    f'<body><div><a href="/a">Un</a></div><div><a href="/b">Deux</a></div><div data-main><p>{_TRAIN}</p><p>{_PRICES}</p><p>{_TRAIN}</p></div><div>Fait par nous</div><div><a href="/y">Mentions</a></div></body>',
    f'<body><article><div data-main><h2>Notes</h2><p>{_PRICES}</p><p>{_SHORT[4]}</p><p>{_FLOOD}</p><p>{_BOAT}</p></div><div class="share"><a href="/s">Share this</a> <a href="/t">Print</a></div><section class="comments"><h3>2 comments</h3><p>{_REPLY}</p><p>I agree.</p><p><a href="/r">Reply</a></p></section></article></body>',
    f'<body><article><div data-main><p>{_BOAT}</p><p>{_SHORT[0]}</p></div><form><p>{_LETTER}</p></form><div class="ad"><p>{_SALE}</p></div><div data-main><p>{_PRICES}</p><h2>More</h2><p>{_FLOOD}</p></div></article><div class="sidebar"><p>{_FLOOD}</p><p><a href="/t">Top stories of this week</a></p></div></body>',
    f'<body><div class="ad">{_SALE}</div><article data-main><h1>A walk</h1><p>{_PRICES}</p><p>Then <a href="/w">we went</a> home over the hill.</p><p>{_SHORT[1]}</p></article><nav><ul>{_links("1", "2", "3")}</ul></nav></body>',
    f'<body><main><article data-main><p>Be.</p><p>To it.</p><p>{_BOAT}</p></article><p><a href="/n">Next story</a></p><p><a href="/o">Older stories</a></p></main><footer><p>{_RIGHTS}</p></footer></body>',
    f'<body><p><a href="/h">Home</a></p><p>Menu</p><p data-main>{_FLOOD} {_BOAT}</p><p data-main>{_PRICES} {_PRICES}</p><p data-main>{_FLOOD}</p><p>Back to top</p></body>',
    f'<body><nav>{_links("Wald", "Dorf", "Karte")}</nav><div class="ad">Jetzt kaufen.</div><article data-main><h1>Die Buchen</h1><p>{_FOREST}</p><p>{_SHORT[5]}</p><p>{_FOREST} {_FOREST}</p></article><footer>Impressum und alles, was dazu gehört.</footer></body>',
    f'<body><ul>{_links("Inicio", "Noticias", "Deportes", "Cultura", "Contacto")}</ul><div class="banner">Hoy no hay periódico.</div><article data-main><h1>Al amanecer</h1><p>{_MARKET}</p><p>{_SHORT[2]}</p><p>{_MARKET} {_FLOOD}</p><blockquote>{_SHORT[0]}</blockquote><p>{_BOAT}</p></article><footer>&copy; 2021 El Vecino</footer></body>',
    f'<body><table><tr><td><a href="/1">Forum</a></td><td><a href="/2">Members</a></td></tr></table><div data-main><h2>The boat</h2><p>{_BOAT}</p><p>{_SHORT[4]}</p><p>{_BOAT}</p><p>{_PRICES}</p></div><div>Posted in <a href="/sea">Sea</a>, <a href="/old">Old days</a></div><div>3 people liked this</div></body>',
    f'<body><div>Skip to content</div><div><a href="/l">Log in</a> or <a href="/j">join</a></div><div data-main><p>{_TRAIN}</p><p>{_TRAIN} {_BOAT}</p><p>{_SHORT[3]}</p><p>{_TRAIN}</p></div><div>Lire aussi</div><div><a href="/p">Les prix montent encore</a></div><div><a href="/q">Le pont est fermé</a></div></body>',
    f'<body><nav><ul>{_links("Home", "Archive")}</ul></nav><article data-main><h1>Storm</h1><p>{_BOAT}</p><p>{_SHORT[4]}</p><p>{_FLOOD}</p><p>{_SHORT[0]}</p></article></body>',
    f'<body><article data-main><h1>Buchen</h1><p>{_FOREST}</p><p>{_PRICES}</p></article><nav><ul>{_links("Older stories from the woods", "What the mayor said about the trees", "Maps of all our walks")}</ul></nav></body>',
    f'<body><p data-main>{_BOAT}</p><p data-main>{_MARKET}</p><p data-main>{_SHORT[2]}</p><p data-main>{_FLOOD}</p></body>',
    f'<body><header><a href="/">Le Quotidien</a></header><main data-main><p>{_TRAIN}</p><p>{_MARKET}</p><p>Voir <a href="/g">la gare</a>.</p></main><aside><a href="/1">Les trains de nuit ailleurs en Europe</a> <a href="/2">Ce que coûte un billet</a></aside><footer><a href="/m">Mentions légales et conditions de vente</a></footer></body>',
    f'<body class="post-1 has-sidebar single"><div class="wrap with-sidebar"><article class="post tags-news comment-open"><div data-main><h1>The pier</h1><p>{_BOAT}</p><p>{_FLOOD}</p><p>{_PRICES}</p></div></article></div></body>',
    f'<body><article data-main><p>{_MARKET}</p></article></body>',
    f'<body><article data-main><p>{_FLOOD}</p><p>{_BOAT}</p></article><div class="related"><p><a href="/b">Why boots cost more this year than they did last year</a></p><p><a href="/c">The mayor on trees, dogs and the price of bread in the town</a></p></div></body>',
    f'<body><article data-main><h1>Storm</h1><p>{_BOAT}</p><p>{_PRICES} {_FLOOD}</p></article><div class="related"><ul>{_links(*_HEADS)}</ul></div></body>',
    f'<body><nav>{_links(*_HEADS[::-1])}</nav><main data-main><p>{_FLOOD}</p><p>{_FOREST}</p></main><aside><p><a href="/w">{_HEADS[5]}</a></p><p><a href="/v">{_HEADS[0]}</a></p></aside></body>',
    f'<body><div class="content" data-main><p>{_PRICES}</p><p>{_TRAIN}</p></div><div class="promo"><p><a href="/w">{_HEADS[1]}</a></p><p><a href="/v">{_HEADS[3]}</a></p><p><a href="/u">{_HEADS[4]}</a></p></div></body>',
    f'<body><div class="story" data-main><h1>Le train</h1><p>{_TRAIN}</p></div><ul class="sidebar-links"><li><a href="/1">Ce que coûte un billet de train de nuit en Europe cette année</a></li></ul></body>',
    f'<body><div><a href="/h">Home</a></div><p data-main>{_BOAT}</p><p data-main>{_BOAT}</p><p data-main>{_TRAIN} {_FLOOD}</p></body>',
    f'<body><p data-main>{_TRAIN}</p><p data-main>{_FLOOD} {_FOREST}</p></body>',
    f'<body><main data-main><h1>Le train</h1><p>{_TRAIN}</p><p>{_SHORT[3]}</p></main></body>',
    f'<body><article data-main><p>{_BOAT}</p><p><a href="/a">{_MARKET}</a> {_SHORT[2]}</p><p>{_FLOOD}</p><p><a href="/b">{_PRICES}</a></p></article></body>',
    f'<body><article data-main><h1>Sources</h1><p>{_FOREST}</p><ul><li><a href="/1">The survey of the woods in full</a></li><li><a href="/2">Maps</a></li></ul><p>{_SHORT[5]}</p></article><footer><p>{_RIGHTS}</p></footer></body>',
    f'<body><div class="content" data-main><p>{_FOREST}</p><p><a href="/k">Karte</a></p></div><div class="share"><p><a href="/s">Share this story with all your friends</a></p></div></body>',
    f'<body><main><article data-main><p>{_FLOOD}</p><p>{_PRICES}</p></article><div class="related"><article class="card"><h3><a href="/m">The market opens</a></h3><p>{_MARKET}</p></article></div><div class="comments"><article class="comment"><div class="content"><p>{_REPLY}</p></div></article></div></main></body>',
    f'<body><div class="main"><div class="entry-content" data-main><p>{_TRAIN}</p><p>{_PRICES}</p></div><div class="newsletter-box"><p>{_LETTER}</p></div><div class="cookie-bar"><p>{_COOKIES} {_SALE}</p></div></div></body>',
    f'<body><article data-main><h1>Prices</h1><p>{_PRICES}</p><p>{_SHORT[1]}</p></article><div class="related"><p><a href="/b">Why boots cost more this year than last year</a></p></div><div id="comments"><p>{_REPLY}</p></div></body>',
]
TELLING = re.compile(r"(?<=<)(/?)(?:nav|header|footer|aside|article|main|section|form)\b|\s(?:class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


def untold(page: str) -> str:
    """The page with plain divisions in place of tags that tell what they enclose, and without names."""
    return TELLING.sub(lambda m: f"{m[1]}div" if m[1] is not None else "", page)


def labelled_table(pages: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of the pages, each as it is and untold."""
    pages = LABELLED if pages is None else pages
    cut = [blocks_of(p) for page in pages for p in (page, untold(page))]
    return np.concatenate([features(b) for b in cut]), np.array([b.label for p in cut for b in p], float)


def main_text(page: str | None, tree: Node) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, keep in zip(blocks, classify(tree, features(blocks))) if keep)


def extract_text(pages: DataFrame) -> DataFrame:
    """The main text of every page.

    pages: page_id, url, html; other columns are not read.  Null and empty pages
    and pages without main text give "".  Broken markup is read as far as it
    goes, in time that grows with the page's length.  A null page_id or url
    stays.  Repeated rows give one row each.  An empty table gives no rows.  A
    page is worked on whole, however long, in about 20 times its size of memory.
    """
    bounded_batches(pages.sparkSession)
    tree = grow(*labelled_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(pages["page_id"].cast("long"), pages["url"].cast("string"), pages["html"].cast("string")).mapInArrow(run, RESULT)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_extraction": op2_html_extraction}
ORACLES: dict[str, str] = {}
