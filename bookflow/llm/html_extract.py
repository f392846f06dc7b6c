"""Main text of web pages from the events of the standard library's streaming parser.

1. The parser's events become lines: the text of one block (decoded, white space collapsed), the tags that came with it
   and the container it stands in.
2. A line's signal is the logarithm of its text-to-tag ratio, times a prior between 0 and 1 from the page's own markup: 0
   in elements that the article never includes (menus, footers, forms, ...), a part for classes, ids and roles that name
   such things and for lines outside the page's article or main element, else 1.
3. Signals are smoothed with a Gaussian over neighbouring lines, times the prior again, and clustered by two-means: lines
   at or above the threshold are content.
4. Content lines select regions: from the page down, a container stays when enough of its text is content; of a container
   that stays, the lines beside each other are kept or dropped together, however short one of them is; headings go with
   what follows them.

Defined results: null or empty html, or a page with nothing but menus and the like, gives the empty text; unclosed and
stray tags are tolerated, a head ends where the body's first element or text begins; pages of any length and depth are
read whole, in linear time; repeated rows give equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.bpe import rows_of

# Element names of HTML by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template head title svg iframe object audio video canvas select datalist textarea".split())
HEAD = set("html head base link meta noscript script style template title".split())
FURNITURE = set("nav header footer aside form menu dialog".split())
BLOCK = set("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold text rather than parts of a page: their lines belong to the container around them.
LEAVES = HEADINGS | set("p li dt dd pre address figcaption summary br hr option legend".split())
#: Containers of parts of a text, not of parts of a page.
PASSAGES = set("ul ol dl table tbody thead tfoot tr td th blockquote figure details fieldset".split())
ARTICLES = ("article", "main")
#: Elements that the end tag of an inline element doesn't reach across.
BARRIERS = ("article", "main", "section", "body", "td", "table")
#: Elements that an opening tag of the kind closes, up to the nearest element of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status".split())
#: Words of a class or id that name what isn't the article, alone or as a part between hyphens, underscores and capitals.
MARKS = set(
    "ad ads advert adverts advertisement advertising adsense adslot banner banners sponsor sponsored sponsors promo promos promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars aside rail footer footers masthead toolbar topbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus replies respond widget widgets pagination pager hidden".split()
)
#: Words that often do, but name sections of articles as well.
WEAK_MARKS = set("share sharing social related recommended recommendations trending teaser search copyright disclaimer legal".split())
#: Words that say that a marked container holds the article all the same, unless one of the second set stands with them.
ARTICLE_MARKS = set("article post entry story content main body text".split())
FIRM_MARKS = set("ad ads comment comments sidebar nav menu footer".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Priors of marked containers and of lines outside the article or main element.
MARKED, WEAKLY_MARKED, OUTSIDE = 0.1, 0.8, 0.3
#: Part of a container's text that must be content.
KEEPS = 0.25
SIGMA = 1.0


class Lines(HTMLParser):
    """Collects lines (text, tags, container, heading) and containers (parent, tag, own prior).

    Open elements are found by their names' positions in the stack, so no event walks the stack.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # tag, container, silent
        self.at: dict[str, list[int]] = {}  # positions of each open tag
        self.blocks: list[int] = []  # positions of open blocks
        self.parents, self.tags_of, self.own = [-1], ["root"], [1.0]
        self.lines: list[tuple[str, int, int, bool]] = []
        self.text: list[str] = []
        self.tags = 0

    def _last(self, names) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def _where(self) -> tuple[int, bool]:
        return self.open[-1][1:] if self.open else (0, False)

    def _end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.lines.append((text, max(1, self.tags), self._where()[0], any(self.at.get(h) for h in HEADINGS)))
            self.tags = 0

    def _pop(self, to: int) -> None:
        if self.blocks and self.blocks[-1] >= to:
            self._end_line()
            while self.blocks and self.blocks[-1] >= to:
                self.blocks.pop()
        for tag, *_ in self.open[to:]:
            self.at[tag].pop()
        del self.open[to:]

    def _end_head(self) -> None:
        if self.at.get("head"):
            self._pop(self.at["head"][-1])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in HEAD:
            self._end_head()
        if tag in BLOCK:
            self._end_line()
        self.tags += 1
        if tag in VOID:
            return
        if tag in CLOSES:
            closed, bound = CLOSES[tag]
            while (k := self._last(closed)) > self._last(bound):
                self._pop(k)
        elif tag in BLOCK and (k := self._last(("p",))) >= 0 and k == self.blocks[-1]:
            self._pop(k)  # a block ends an open paragraph, and what that left open in line
        container, silent = self._where()
        own = prior_of(tag, attrs, bool(self.at.get("article") or self.at.get("main")))
        if tag in BLOCK and tag not in LEAVES or own < 1:
            self.parents.append(container)
            self.tags_of.append(tag)
            self.own.append(own)
            container = len(self.parents) - 1
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        elif own < 1:  # an inline element with a prior of its own is a line of its own
            self._end_line()
            self.blocks.append(len(self.open))
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, container, silent or tag in SILENT))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self._end_line()
        self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        k = self._last((tag,))
        if k >= 0 and (tag in BLOCK or k > self._last(BARRIERS)):
            self._pop(k)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self._end_head()
        if not self._where()[1]:
            self.text.append(data)


def prior_of(tag: str, attrs: list, in_article: bool) -> float:
    """The prior that an element's own name and attributes give to the text inside."""
    if tag in FURNITURE and not (tag == "header" and in_article):  # an article's own header holds its title
        return 0.0
    if tag in ("html", "body", "main"):
        return 1.0
    prior = 1.0
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and UNSEEN.search(value):
            return 0.0
        if name == "role" and value in ROLES:
            prior = min(prior, MARKED)
        if name in ("class", "id") and value:
            for word in value.split():
                parts = {p.lower() for p in WORDS.findall(word)}
                if parts & ARTICLE_MARKS and not parts & FIRM_MARKS:
                    continue
                prior = min(prior, MARKED if parts & MARKS else WEAKLY_MARKED if parts & WEAK_MARKS else 1.0)
    return prior


def threshold(values: np.ndarray) -> float:
    """The boundary of two clusters of numbers (two-means); below all of them where there is one cluster."""
    low, high = float(values.min()), float(values.max())
    if high <= 2 * low:
        return low
    cut = (low + high) / 2
    for _ in range(30):
        a, b = values[values < cut], values[values >= cut]
        new = (a.mean() + b.mean()) / 2 if len(a) and len(b) else cut
        if new == cut:
            break
        cut = new
    return float(cut)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian means over neighbouring lines; beyond the page's ends there is no text."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(values, kernel / kernel.sum(), "full")[reach : reach + len(values)]


def ratios(sizes: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """A line's signal: the logarithm of its text-to-tag ratio."""
    return np.log1p(sizes / tags)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser._end_head()
    parser._end_line()
    return " ".join(chosen(parser.lines, parser.parents, parser.tags_of, parser.own))


def chosen(lines: list, parents: list[int], tags_of: list[str], own: list[float]) -> list[str]:
    """The texts of the lines that belong to the article."""
    sizes = np.array([len(x[0]) for x in lines], float)
    home = [x[2] for x in lines]
    prior, inside = priors(sizes, home, parents, tags_of, own)
    line_prior = np.array([prior[c] for c in home])
    if any(inside):
        line_prior *= np.array([1.0 if inside[c] or heading and tags_of[c] != "root" and prior[c] == 1 else OUTSIDE for c, (_, _, _, heading) in zip(home, lines)])
    value = line_prior * smooth(line_prior * ratios(sizes, np.array([x[1] for x in lines], float))) if lines else sizes
    candidate = value > 0
    if not candidate.any():
        return []
    content = candidate & (value >= threshold(value[candidate]))
    # Text and content text of each container, weighed by the prior: its own lines' and its whole tree's.
    n = len(parents)
    direct, direct_content, tree, tree_content, first, last = (np.zeros(n) for _ in range(6))
    first[:], last[:] = len(lines), -1
    counts = candidate & ~np.array([x[3] for x in lines])
    for k in np.flatnonzero(counts if counts.any() else candidate).tolist():  # headings have no say where there is other text
        c = home[k]
        direct[c] += sizes[k] * line_prior[k]
        if content[k]:
            direct_content[c] += sizes[k] * line_prior[k]
            first[c], last[c] = min(first[c], k), k
    tree[:], tree_content[:] = direct, direct_content
    starts = np.full(n, len(lines))
    for k in range(len(lines) - 1, -1, -1):
        starts[home[k]] = k
    for c in range(n - 1, 0, -1):  # a container comes after its parent
        p = parents[c]
        tree[p] += tree[c]
        tree_content[p] += tree_content[c]
        starts[p] = min(starts[p], starts[c])
    holds = (direct_content > 0) & (direct_content >= KEEPS * direct)
    stays = [True] * n
    for c in range(1, n):
        p = parents[c]
        marked = own[c] < 1
        enough = tree_content[c] > 0 and (inside[c] and tags_of[c] in ARTICLES or tree_content[c] >= KEEPS * tree[c])
        beside = not marked and tags_of[c] in PASSAGES and holds[p] and first[p] < starts[c] < last[p]
        stays[c] = stays[p] and (bool(enough) or beside or not marked and inside[p] and tags_of[c] not in ARTICLES)
    keep = [bool(candidate[k] and stays[c] and (content[k] or holds[c] or inside[c] and direct[c] < tree[c])) for k, c in enumerate(home)]
    for k in range(len(lines) - 2, -1, -1):
        c = home[k]
        if lines[k][3] and not keep[k] and candidate[k] and (stays[c] or stays[parents[c]] and own[c] == 1):
            keep[k] = keep[k + 1]
    return [x[0] for x, kept in zip(lines, keep) if kept]


def priors(sizes: np.ndarray, home: list[int], parents: list[int], tags_of: list[str], own: list[float]) -> tuple[list[float], list[bool]]:
    """Each container's prior, and whether it is in the page's article or main element.

    The page's article is the one with the highest prior, then the most text: whatever the names of the containers around
    it say, they hold the article, so they count as unmarked. Other article elements count where nothing marks them.
    """
    n = len(parents)
    tree = [0.0] * n
    for c, size in zip(home, sizes.tolist()):
        tree[c] += size
    for c in range(n - 1, 0, -1):
        tree[parents[c]] += tree[c]
    prior = list(own)
    for c in range(1, n):
        prior[c] = min(prior[parents[c]], own[c])
    named = [c for c in range(1, n) if tags_of[c] in ARTICLES and tree[c] and own[c]]
    inside = [False] * n
    if named:
        best = max(named, key=lambda c: (prior[c], tree[c], -c))
        around, own = parents[best], list(own)
        while around > 0:
            own[around] = 1.0
            around = parents[around]
        for c in range(1, n):
            prior[c] = min(prior[parents[c]], own[c])
            inside[c] = inside[parents[c]] or c == best or tags_of[c] in ARTICLES and prior[c] == 1
    return prior, inside


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches):
        for batch in (part for whole in batches for part in rows_of(whole)):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
