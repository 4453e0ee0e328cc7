"""Main text of web pages by tag-path ratios (operator 7).

A page becomes blocks: runs of text between block-level tags, each with the
path of open tags from the root (class and id are part of a step).  For each
path the text length, punctuation and number of blocks and the share of link
text are summed; the score of a path is the log of its length per block times
a punctuation ratio, fused by product.  Scores are smoothed over neighbouring
blocks in page order with a Gaussian window, so a short paragraph or heading
between long ones gains and a lone long line among menus loses.  Blocks whose
path's mean smoothed score passes a threshold from the page's own spread select
the content node: the outermost article or main that holds the most of the
selected text, or else the deepest element that does.  Its blocks are the text,
in page order, without those under paths that are never article text (menus,
headers and footers of the page, forms, scripts, notices, adverts, comments by
readers).  Where the node is no article, selected blocks beside it, headings
before its end and plain text between selected blocks belong to the text, too.

Inside an article a name alone settles only the clear cases.  An element whose
name may also be the author's ("notice", "tags", "ad-hoc") stays if the ratios
of its paths are those of the article's own paragraphs and it has sentences;
one whose name speaks of readers among other things ("user-comments",
"editor-comment") goes if no paragraph of the article follows it, and is
weighed like the others if one does.

Defined results: null, empty or markup-free html works (text outside all tags
is one block); a page without content gives the empty string; unclosed,
misnested and unknown tags are handled as browsers do for the common cases;
repeated rows give repeated results; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bruit.llm.common import map_pandas, pick, table


@dataclass(frozen=True)
class HtmlParams:
    """``sigma``: width of the smoothing in blocks; ``spread``: part of the standard deviation below the mean
    that a path's score may lie."""

    sigma: float = 1.0
    spread: float = 0.8


INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Elements with markup of another kind, where a tag that ends in "/>" is closed; what is in them makes no block.
FOREIGN = frozenset({"svg", "math"})
#: Elements in them that hold html again.
HOSTS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: Start tags of html that end them where no host is open.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p"
    " pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Elements that never hold article text.
OUT = RAW | frozenset(
    "head nav header footer aside form button select option input menu dialog object audio video canvas map datalist svg"
    " annotation annotation-xml".split()
)
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|popup|modal|newsletter|subscribe"
    r"|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|masthead|toolbar|pagination|pager|share|sharing|social"
    r"|comments?|comment-\w+|replies|disqus|related|recommend\w*|tags|widget|login|signup|search|skip)(?:$|[\s_-])",
    re.I,
)
#: Words that such names are made of; inside an article a name says something only if all its parts are such words
#: or the general ones ("ad-slot", but neither "side-effects" nor "promo-code").
KNOWN = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo cookie cookies consent gdpr notice popup modal newsletter"
    " subscribe subscription nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer masthead toolbar pagination pager share"
    " sharing social comment comments replies disqus related recommend recommended tags widget login signup search skip".split()
)
#: Those that an author may also use for running text: the ratios decide.
UNSURE = frozenset("notice tags side promo related banner skip search".split())
ADS = frozenset("ad ads advert adverts advertisement adsense sponsor sponsored".split())
READERS = frozenset("comment comments commenter commenters replies disqus".split())
ANSWERS = frozenset("responses response feedback discussion discussions reviews letters posts".split())
PEOPLE = frozenset("reader readers user users visitor visitors member members".split())
GENERAL = frozenset(
    "area bar block body bottom box button buttons card container content form group header icon icons inner item items label left links list"
    " main middle module outer panel posts right row section site slot text title top unit wrap wrapper zone".split()
)
PARTS = re.compile(r"[-_]+")
#: "has-sidebar" and the like describe what stands beside an element.
BESIDE = re.compile(r"\b(?:no|with|without|has|hide)[-_]\w+", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADER_OK = frozenset({"article", "main"})
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
SCOPES = frozenset("table ul ol dl td th div section article main body html nav aside header footer select".split())
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: Where a tag may end, or a quoted value begins.
STOP = re.compile(r"=\s*([\"'])|>")
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """``node`` is the innermost block element; ``path`` numbers the steps from the root to it; ``doubt`` the
    doubtful element around it, from 1."""

    path: int
    node: int
    doubt: int = 0
    article: bool = False
    tag: str = ""
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""


@dataclass
class Tree:
    """Block elements in page order, 0 being the root: tag, and the element around each; doubtful elements, and
    whether their names speak of readers."""

    tags: list[str] = field(default_factory=lambda: [""])
    above: list[int] = field(default_factory=lambda: [0])
    readers: list[bool] = field(default_factory=lambda: [False])


@dataclass
class _Open:
    tag: str
    node: int
    path: int
    out: bool
    inline: bool
    article: bool
    foreign: int | None
    doubt: int


def _tag_end(html: str, at: int) -> int:
    """Place of the ">" that ends the tag, the page's length if there is none.

    A quoted value may hold a ">".  If its quote isn't closed up to the page's end, the tag ends at the next ">".
    """
    while (m := STOP.search(html, at)) is not None:
        if m[1] is None:
            return m.start()
        done = html.find(m[1], m.end())
        if done < 0:
            end = html.find(">", m.end())
            return end if end >= 0 else len(html)
        at = done + 1
    return len(html)


def _in_value(rest: str) -> bool:
    """Whether the slash that ends a tag belongs to an unquoted value."""
    cut = max(rest.rfind(c) for c in " \t\n\r\f\"'") + 1
    return "=" in rest[cut:] or rest[:cut].rstrip().endswith("=")


def _outside(name: str) -> bool:
    """Whether class and id say that an element, which no article holds, isn't part of the text."""
    return bool(NAMES.search(BESIDE.sub("", name)))


def _inside(name: str) -> str:
    """What class and id say of an element inside an article: "out", "readers" or "unsure" (both doubtful), or ""."""
    said = ""
    for token in BESIDE.sub("", name).lower().split():
        words = [w for w in PARTS.split(token) if w]
        signs = KNOWN.intersection(words)
        if signs and all(w in KNOWN or w in GENERAL for w in words):
            if not signs <= UNSURE:
                return "out"
            said = said or "unsure"
        elif READERS.intersection(words) or PEOPLE.intersection(words) and ANSWERS.intersection(words):
            said = "readers"
        elif words and (words[0] in ADS or words[-1] in ADS):
            if any(c.isdigit() for w in words for c in w):
                return "out"
            said = said or "unsure"
    return said


def blocks(html: str) -> tuple[list[Block], Tree]:
    """Text blocks in page order, without those of elements that never hold article text.

    Work grows with the page's length: the places of open elements are kept by tag as the stack grows, so no tag
    walks down the stack but over what it closes.
    """
    stack: list[_Open] = []
    opened: dict[str, list[int]] = defaultdict(list)  # places of open elements in the stack, by tag
    solid: list[int] = []  # places of those that aren't inline
    p_at: list[int] = []  # places in the stack of open p, and of what hides them
    wall: list[int] = []
    tree, paths = Tree(), {}
    found: list[Block] = []
    now: Block | None = None
    at, links = 0, 0

    def take(raw: str) -> None:
        nonlocal now
        top = stack[-1] if stack else None
        if top and top.out:
            return
        if now is None:
            now = Block(top.path, top.node, top.doubt, top.article) if top else Block(0, 0)
            now.tag = tree.tags[now.node]
            found.append(now)
        text = unescape(raw)
        now.parts.append(text)
        if links:
            now.link_chars += len(text.strip())

    def close(k: int) -> None:
        nonlocal links, now
        while len(stack) > k:
            o = stack.pop()
            opened[o.tag].pop()
            links -= o.tag == "a"
            if not o.inline:
                now = None
        for places in (p_at, wall, solid):
            while places and places[-1] >= k:
                places.pop()

    size = len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            take(html[at:])
            break
        if lt > at:
            take(html[at:lt])
        if html.startswith(("<!", "<?"), lt):
            for start, stop in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                if html.startswith(start, lt):
                    end = html.find(stop, lt + len(start))
                    at = end + len(stop) if end >= 0 else size
                    break
            continue
        m = NAME.match(html, lt + 1)
        if m is None:
            if html.startswith("</", lt) and html[lt + 2 : lt + 3].strip():  # an end tag without a name is a comment
                end = html.find(">", lt)
                at = end + 1 if end >= 0 else size
                continue
            take("<")  # a bare "<" is text
            at = lt + 1
            continue
        stop = _tag_end(html, m.end())
        rest, at = html[m.end() : stop], min(size, stop + 1)
        if stop == size:  # the page ends inside a tag
            break
        tag, end = m[2].lower(), m[1] == "/"
        if end:
            k = opened[tag][-1] if opened[tag] else -1
            if k >= 0 and not (tag in INLINE and solid and solid[-1] > k):
                close(k)
            elif tag in ("p", "br"):
                now = None
            continue
        if tag in BREAKOUT:
            while stack and (k := stack[-1].foreign) is not None:
                close(k)
        foreign = tag in FOREIGN or bool(stack) and stack[-1].foreign is not None
        if not foreign and tag not in INLINE:
            now = None
            if tag in CLOSED_BY:
                own = CLOSED_BY[tag]
                bar = max((opened[t][-1] for t in SCOPES - own if opened[t]), default=-1)
                over = [opened[t] for t in own if opened[t] and opened[t][-1] > bar]
                if tag == "tr":  # a row ends the row before it, not only its cell
                    outermost = min((places[bisect_right(places, bar)] for places in over), default=-1)
                else:
                    outermost = max((places[-1] for places in over), default=-1)
                if outermost >= 0:
                    close(outermost)
            elif tag not in VOID and p_at and not (wall and wall[-1] > p_at[-1]):
                close(p_at[-1])
        if foreign and rest.endswith("/") and not _in_value(rest) or not foreign and tag in VOID:
            continue
        attrs = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTR.finditer(rest)} if rest else {}
        name = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        top = stack[-1] if stack else None
        in_article = bool(top and top.article)
        out = bool(top and top.out) or hidden or attrs.get("role", "").lower() in ROLES
        if tag in OUT and not (tag == "header" and in_article):
            out = True
        inline = foreign or tag in INLINE
        doubt = top.doubt if top else 0
        if not out and name and tag not in ("html", "body", "article", "main"):
            if not in_article:
                out = _outside(name)
            elif not (opened["pre"] or opened["code"]):  # names inside are those of a highlighter
                said = _inside(name)
                out = said == "out" or inline and said == "unsure"
                if not (out or inline or doubt) and said:
                    tree.readers.append(said == "readers")
                    doubt = len(tree.readers) - 1
        node, path = (top.node, top.path) if top else (0, 0)
        if not inline:
            tree.tags.append(tag)
            tree.above.append(node)
            node = len(tree.tags) - 1
            path = paths.setdefault((path, tag, " ".join(sorted(name.split()))), len(paths) + 1)
        within = len(stack) if tag in FOREIGN else None if not inline or tag in HOSTS else top.foreign if top else None
        if tag == "p":
            p_at.append(len(stack))
        elif tag in ("td", "th", "object", "button"):
            wall.append(len(stack))
        opened[tag].append(len(stack))
        if not inline:
            solid.append(len(stack))
        stack.append(_Open(tag, node, path, out, inline, in_article or tag in HEADER_OK, within, doubt))
        links += tag == "a"
        if tag in RAW and not foreign:
            done = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            at = done.start() if done else size
    for b in found:
        b.text = SPACE.sub(" ", "".join(b.parts)).strip()
    return [b for b in found if b.text], tree


def path_ratios(found: list[Block]) -> dict[int, float]:
    """For each path the log of its length per block, its punctuation and its share of link text, fused."""
    chars: dict = defaultdict(int)
    marks: dict = defaultdict(int)
    linked: dict = defaultdict(int)
    count: dict = defaultdict(int)
    for b in found:
        chars[b.path] += len(b.text)
        marks[b.path] += len(PUNCTUATION.findall(b.text))
        linked[b.path] += min(b.link_chars, len(b.text))
        count[b.path] += 1
    return {
        k: math.log1p(chars[k] / count[k]) * (1.0 + math.log1p(marks[k] / count[k])) * (1.0 - linked[k] / chars[k])
        for k in count
    }


def without_doubtful(found: list[Block], tree: Tree, p: HtmlParams) -> list[Block]:
    """Blocks without those of doubtful elements that aren't text of the article.

    An article that has no paragraphs beside doubtful elements keeps these.
    """
    own = [k for k, b in enumerate(found) if b.article and not b.doubt and b.tag not in HEADINGS]
    if len(tree.readers) == 1 or not own:
        return found
    ratios = path_ratios(found)
    values = [ratios[found[k].path] for k in own]
    mean = sum(values) / len(values)
    least = mean - p.spread * math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    chars, weight, marks, last = defaultdict(int), defaultdict(float), defaultdict(int), {}
    for k, b in enumerate(found):
        if b.doubt:
            chars[b.doubt] += len(b.text)
            weight[b.doubt] += len(b.text) * ratios[b.path]
            marks[b.doubt] += len(PUNCTUATION.findall(b.text))
            last[b.doubt] = k
    stays = {
        d
        for d, n in chars.items()
        if weight[d] >= least * n and marks[d] >= 2 and not (tree.readers[d] and last[d] > own[-1])
    }
    return [b for b in found if not b.doubt or b.doubt in stays]


def path_scores(found: list[Block], p: HtmlParams) -> list[float]:
    """For each block the smoothed, fused ratio of its path."""
    fused = path_ratios(found)
    reach = max(1, round(2 * p.sigma))
    weights = [math.exp(-0.5 * (d / p.sigma) ** 2) for d in range(-reach, reach + 1)]
    raw = [fused[b.path] for b in found]
    out = []
    for i in range(len(raw)):
        near = [(w, raw[j]) for w, j in zip(weights, range(i - reach, i + reach + 1), strict=True) if 0 <= j < len(raw)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def main_text(html: str | None, p: HtmlParams = HtmlParams()) -> str:
    found, tree = blocks(html or "")
    found = without_doubtful(found, tree, p)
    if not found:
        return ""
    scores = path_scores(found, p)
    by: dict = defaultdict(list)
    for b, s in zip(found, scores, strict=True):
        by[b.path].append(s)
    mean = sum(scores) / len(scores)
    dev = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    chosen = {k for k, v in by.items() if sum(v) / len(v) >= mean - p.spread * dev}
    # Selected text of each element, what is in it included: an element comes after the one around it.
    n = len(tree.tags)
    size, held = [0] * n, [False] * n
    for b in found:
        size[b.node] += len(b.text) * (b.path in chosen)
        held[b.node] = True
    for k in range(n - 1, 0, -1):
        size[tree.above[k]] += size[k]
        held[tree.above[k]] |= held[k]
    largest: dict[int, int] = {}
    for k in range(1, n):
        if held[k] and (tree.above[k] not in largest or size[k] > size[largest[tree.above[k]]]):
            largest[tree.above[k]] = k
    # The node: from the root down to an article, or as long as one child holds most of the selected text.
    node = 0
    while tree.tags[node] not in ("article", "main"):
        best = largest.get(node)
        if best is None or tree.tags[best] in ("p", "li", "td", "h1", "h2", "h3", "pre", "blockquote", "dd", "ul", "ol", "table"):
            break
        if size[best] < 0.7 * size[node] or not size[best]:
            break
        node = best
    below = [False] * n
    below[node] = True
    for k in range(node + 1, n):
        below[k] = below[tree.above[k]]
    # An article's own blocks all belong to it.
    if tree.tags[node] in ("article", "main"):
        return " ".join(b.text for b in found if below[b.node])
    root = tree.tags[node] in ("", "html", "body")
    plain = [b.link_chars < 0.5 * len(b.text) for b in found]
    heading = [b.tag in HEADINGS for b in found]
    within = [not root and below[b.node] for b in found]
    sure = [b.path in chosen and (ok or inner or root) or inner and ok for b, ok, inner in zip(found, plain, within, strict=True)]
    at = [k for k, x in enumerate(sure) if x]
    first, last = (at[0], at[-1]) if at else (0, -1)
    inside = [
        b
        for k, b in enumerate(found)
        if sure[k] or heading[k] and (root or k < last) or plain[k] and first < k < last
    ]
    return " ".join(b.text for b in inside)


def extract(pages: DataFrame, p: HtmlParams = HtmlParams()) -> DataFrame:
    """(page_id, url, text) of (page_id, url, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 500):
                part = b.iloc[k : k + 500]
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": [main_text(h, p) for h in part["html"]]})

    rows = pick(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    return map_pandas(rows, run, "page_id long, url string, text string")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
