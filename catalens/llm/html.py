"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks in page order. A block's features are its word count, its link density, those of
both neighbours, and whether the nearest element that says so marks an article or a page's surroundings. A decision tree,
trained on a small labelled table, keeps or drops each block. The table is a rule (`labelled_pages`): some hundred small
pages, many of which say nowhere what is article and what is not, so counts and neighbours decide there; and lists of links
within articles, which no mark gives away.

Scripts, styles and text areas hold raw text up to their end tag. Other elements without text for readers are skipped to
theirs; one that is never closed ends with its parent or at the next block. A head ends at the first content. Paragraphs, list
items, cells, rows and terms end where the next one begins, as they do in HTML.

Defined results: a null page is the empty page with the empty text; broken markup is read to its end, an unfinished tag at
the end is dropped; pages of any length are read whole, in time linear in them; a block at a threshold of the tree goes to the
lower side; rows are independent, so repeated rows give repeated results; an empty table gives an empty result; columns that
are not asked for are not read, and those that are keep their values whatever they are called.
"""

from __future__ import annotations

import random
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without text for readers, elements that break lines, and names that mark what an element holds.
RAW = "script|style|textarea"
SKIPPED = frozenset("noscript template svg iframe object select button".split())
#: Skipped elements that a second start tag of theirs ends, what may stand in a head, and what ends no unclosed element.
FLAT = frozenset("select button iframe noscript".split())
HEAD = frozenset("title meta link base noscript template".split())
WITHIN = frozenset("option legend br hr".split())
BREAKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AROUND = frozenset("nav footer header aside form menu dialog".split())
INSIDE = frozenset("article main".split())
AROUND_NAMES = frozenset(
    "ad ads advert adverts advertisement alert announcement banner breadcrumb breadcrumbs comment commentary comments consent cookie cookies discussion disqus feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
    "pager pagination popular popup privacy promo promoted promotion promotions recommended recommendations related replies reply response responses search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser teasers toolbar trending widget".split()
)
INSIDE_NAMES = frozenset("article articlebody entry post story".split())
#: A name that ends in one of these is of a thing, not of the place that the words before it name: header-image.
THINGS = frozenset("image img photo picture media video background".split())
#: What a start tag ends, if it is open within the elements after it.
ENDS = {
    **{t: (("p",), ("table", "td", "th", "caption")) for t in "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()},
    "li": (("li",), ("ul", "ol", "menu")),
    **{t: (("dt", "dd"), ("dl",)) for t in ("dt", "dd")},
    **{t: (("td", "th"), ("table", "tr")) for t in ("td", "th")},
    **{t: (("tr",), ("table",)) for t in ("tr", "tbody", "tfoot")},
}
INLINE_KEPT = frozenset("a abbr b bdi bdo cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<shut>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: A slash at a tag's end closes it unless it belongs to a value without quotes.
_VALUE = re.compile(r"=\s*[^\s\"'=]+/\Z")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")

FEATURES = ("marked", "words", "links", "words_before", "links_before", "words_after", "links_after")


def _mark(tag: str, rest: str) -> int:
    """1 where an element marks an article, -1 where it marks what is around one, else 0."""
    if tag in INSIDE:
        return 1
    if tag in AROUND:
        return -1
    if rest and tag != "body" and tag != "html":
        said = 0
        for found in _NAMES.findall(rest):
            for name in "".join(found).split():
                parts = [x.lower() for x in _PARTS.findall(name)]
                if not parts or parts[-1] in THINGS:
                    continue
                if any(x in AROUND_NAMES for x in parts):
                    return -1
                said = said or int(any(x in INSIDE_NAMES for x in parts))
        return said
    return 0


def _empty(rest: str) -> bool:
    return rest.endswith("/") and not _VALUE.search(rest)


def _ends(tokens: list[re.Match]) -> dict[int, int]:
    """Where the skipped elements that are closed begin and end, as places in tokens."""
    waiting: dict[str, list[int]] = {}
    ends = {}
    for i, m in enumerate(tokens):
        tag = (m["tag"] or "").lower()
        if tag in SKIPPED:
            own = waiting.setdefault(tag, [])
            if m["shut"]:
                if own:
                    ends[own.pop()] = i
            elif not _empty(m["rest"]):
                if tag in FLAT:
                    own.clear()
                own.append(i)
    return ends


def blocks(page: str) -> list[tuple[str, int, float, int]]:
    """(text, words, link density, mark) of each block with text, in page order."""
    found: list[tuple[str, int, float, int]] = []
    opened: list[tuple[str, int]] = []
    #: Where in opened the elements of each name are.
    places: dict[str, list[int]] = {}
    marks, parts, linked, links, at = [0], [], 0, 0, 0

    def close() -> None:
        nonlocal linked
        if parts:
            words = unescape("".join(parts)).split()
            if words:
                found.append((" ".join(words), len(words), min(1.0, linked / len(words)), marks[-1]))
            parts.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece.split())

    def end_from(place: int) -> None:
        nonlocal links
        while len(opened) > place:
            name, depth = opened.pop()
            places[name].pop()
            del marks[depth:]
        links = 0

    def last(names: tuple) -> int:
        return max((own[-1] for name in names if (own := places.get(name))), default=-1)

    tokens = list(_TOKEN.finditer(page))
    ends, skip_to = _ends(tokens), -1
    # An element that is skipped but never closed ends with its parent or at the first block; head and title by their own rules.
    loose, inner, head, title = "", [], False, False
    for i, m in enumerate(tokens):
        if i <= skip_to:
            at = m.end()
            continue
        if not loose:
            piece = page[at : m.start()]
            if head and not title and piece.strip():
                head = False
            if not head:
                text(piece)
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if loose:
            if m["shut"]:
                if tag in inner:
                    while inner.pop() != tag:
                        pass
                    continue
                loose = ""
            elif tag == loose or (tag in BREAKS and tag not in WITHIN):
                loose = ""
            else:
                if tag not in VOID and not _empty(m["rest"]):
                    inner.append(tag)
                continue
        if tag == "head":
            head, title = not m["shut"], False
            continue
        if head:
            if m["shut"]:
                title = title and tag != "title"
                continue
            if tag in HEAD:
                title = tag == "title"
            else:
                head = False
        if tag in SKIPPED:
            if i in ends:
                skip_to = ends[i]
            elif not m["shut"] and not _empty(m["rest"]):
                loose, inner = tag, []
            continue
        if head:
            continue
        if tag == "a":
            links = max(0, links + (-1 if m["shut"] else 1))
            continue
        if tag in BREAKS:
            close()
        if not m["shut"] and tag in ENDS:
            ended, within = ENDS[tag]
            if (place := last(ended)) > last(within):
                end_from(place)
        if tag in VOID or tag in INLINE_KEPT:
            continue
        if not m["shut"]:
            mark = _mark(tag, m["rest"])
            places.setdefault(tag, []).append(len(opened))
            opened.append((tag, len(marks)))
            if mark:
                marks.append(mark)
        elif own := places.get(tag):
            end_from(own[-1])
    if not loose and not (head and title):
        text(page[at:])
    close()
    return found


def features(found: list[tuple]) -> list[tuple]:
    """FEATURES of each block."""
    none = ("", 0, 0.0, 0)
    rows = []
    for i, (_, words, links, mark) in enumerate(found):
        before, after = found[i - 1] if i else none, found[i + 1] if i + 1 < len(found) else none
        rows.append((mark, words, links, before[1], before[2], after[1], after[2]))
    return rows


def train_tree(rows: list[tuple], labels: list[int], depth: int = 8, least: int = 4):
    """A binary decision tree by Gini impurity: a label, or (feature, threshold, tree up to it, tree above)."""
    return _grown(np.array(rows, float).reshape(len(labels), -1), np.array(labels, int), depth, least)


def _grown(x: np.ndarray, y: np.ndarray, depth: int, least: int):
    ones, n = int(y.sum()), len(y)
    if not depth or ones in (0, n) or n < 2 * least:
        return int(2 * ones > n)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values, so_far, left = x[order, f], np.cumsum(y[order])[:-1], np.arange(1, n)
        impurity = so_far * (1 - so_far / left) + (ones - so_far) * (1 - (ones - so_far) / (n - left))
        impurity[(values[1:] == values[:-1]) | (left < least) | (n - left < least)] = np.inf
        at = int(np.argmin(impurity))
        if np.isfinite(impurity[at]) and (best is None or impurity[at] < best[0] - 1e-9):
            best = (impurity[at], f, float((values[at] + values[at + 1]) / 2))
    if best is None:
        return int(2 * ones > n)
    _, f, cut = best
    low = x[:, f] <= cut
    sides = [_grown(x[part], y[part], depth - 1, least) for part in (low, ~low)]
    return sides[0] if sides[0] == sides[1] and isinstance(sides[0], int) else (f, cut, *sides)


def decide(tree, row: tuple) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str, tree) -> str:
    found = blocks(page)
    return " ".join(b[0] for b, row in zip(found, features(found), strict=True) if decide(tree, row))


def labelled_pages(seed: int = 8, pages: int = 250) -> list[str]:
    """The labelled table: small pages whose blocks that belong to the main text begin with k, others with d."""
    r = random.Random(seed)

    def words(letter: str, low: int, high: int) -> str:
        return " ".join(letter + r.choice(("an", "en", "in", "or", "um")) for _ in range(r.randint(low, high)))

    def linked(letter: str, low: int = 1, high: int = 3) -> str:
        return f"<a href=/>{words(letter, low, high)}</a>"

    def links(n: int) -> str:
        # Menus, or lists of headlines.
        most = r.choice((3, 3, 9))
        each = [linked("d", 1, most) for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}" for x in each) + "</ul>" if r.random() < 0.6 else "".join(f"<div>{x}</div>" for x in each)

    def paragraph() -> str:
        kind = r.random()
        if kind < 0.15:
            return f"<p>{words('k', 1, 3)}.</p>"
        if kind < 0.3:
            return f"<p>{words('k', 8, 30)} {linked('k')} {words('k', 3, 20)}</p>"
        return f"<{(tag := r.choice(('p', 'p', 'div')))}>{words('k', 5, 60)}.</{tag}>"

    made = []
    for _ in range(pages):
        body = [f"<h1>{words('k', 3, 9)}</h1>"] * (r.random() < 0.5) + [paragraph() for _ in range(r.randint(2, 8))]
        # Paragraphs that are links, among others; and a list of links without a mark, at the end or within.
        for _ in range(r.randint(0, 2)):
            body.insert(r.randint(1, len(body) - 1), f"<p>{linked('k', 1, 9)}</p>")
        if r.random() < 0.4:
            body.insert(r.choice((1, len(body))), links(r.randint(3, 6)))
        article = r.choice(("<article>{}</article>", "<main>{}</main>", "<div class=post>{}</div>", "<div>{}</div>", "{}", "<section>{}</section>")).format("".join(body))
        menu = r.choice(("<nav>{}</nav>", "<div class=menu>{}</div>", "<div>{}</div>", "{}")).format(links(r.choice((1, 1, 2, 4, 6, 8))))
        # Words between links, and words that only a mark tells from the article's.
        menu += f"<div>{words('d', 1, 2)}</div>{links(r.randint(2, 3))}" if r.random() < 0.4 else ""
        around = [
            f"<header>{linked('d')} {words('d', 2, 6)}</header>",
            f"<div class=ad>{words('d', 3, 12)}</div>",
            f"<aside>{words('d', 5, 50)}</aside>",
            f"<form>{words('d', 2, 6)}</form>",
            f"<div id=cookie-notice>{words('d', 8, 30)}</div>",
        ]
        after = [f"<div class=comments><p>{words('d', 2, 40)}</p><p>{words('d', 1, 9)}</p></div>", f"<div class=related>{links(3)}</div>", links(r.randint(1, 5))]
        page = [x for x in around[:2] if r.random() < 0.4] + [menu] * (r.random() < 0.85) + [x for x in around[2:] if r.random() < 0.3] + [article] + [x for x in after if r.random() < 0.4]
        page += [f"<footer>{words('d', 3, 20)}</footer>"] * (r.random() < 0.6)
        made.append("".join(page))
    return made


def labelled_blocks(pages: list[str] | None = None) -> tuple[list[tuple], list[int]]:
    """Features and labels of the labelled table."""
    rows, labels = [], []
    for page in labelled_pages() if pages is None else pages:
        found = blocks(page)
        rows += features(found)
        labels += [int(b[0][0] == "k") for b in found]
    return rows, labels


def _extract(tree, n_kept: int):
    def run(batches):
        for batch in batches:
            pages = batch.column(n_kept).to_pylist()
            texts = [main_text(p or "", tree) for p in pages]
            cols = [*(batch.column(i) for i in range(n_kept)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:n_kept], "text", "n_chars"])

    return run


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html", tree=None) -> DataFrame:
    """The columns in keep, `text` and `n_chars` of every page."""
    tree = train_tree(*labelled_blocks()) if tree is None else tree
    rows = pages.select(*keep, F.col(html).cast("string").alias("__html"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[: len(keep)])
    return rows.mapInArrow(_extract(tree, len(keep)), f"{kinds}, text string, n_chars bigint")

