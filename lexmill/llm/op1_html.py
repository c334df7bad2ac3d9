"""Main text of HTML pages: flat text blocks, classified by a small decision tree.

A page is cut into flat blocks of text at block-level tags. A block is described by its words, its link density, the
same of its neighbours, and by the elements it stands in; a decision tree trained on the labelled pages below keeps or
drops it. Names of classes say what an element is for only where the whole name does (sidebar, but not has-sidebar), and
not where the element wraps the page's main part. Nothing is kept of a page but its blocks, one page at a time. The
scanner only moves forward: its time is proportional to the page, whatever is left open in it.
"""

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.batches import slices

# Elements by their part in a page, from the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "iframe legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = "script|style|textarea|title|noscript|iframe|template|svg|math|object|select|xmp|noembed|noframes"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav aside footer menu dialog button fieldset search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id and role that say what an element is for, and words that undo a later one (has-sidebar).
HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsors sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail "
    "footer header masthead comment comments respond reply replies disqus discussion notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup login search form share sharing "
    "social related recommended recommendations widget toolbar pagination pager copyright disclaimer contentinfo complementary skip hidden".split()
)
UNDONE = frozenset("has no with without not non is".split())
OF_ARTICLE = frozenset("article entry post story content section".split())
_CLOSES = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*", re.I) for name in RAW.split("|")}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]*)")
_VALUE = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "aside", "hint", "article", "heading")
#: The labelled pages: keep40 stands for 40 words of main text, drop3 for three words of anything else.
LABELLED = [
    "<nav><ul><li><a>drop1</a><li><a>drop2</a><li><a>drop1</a></ul></nav><article><h1>keep5</h1><p>keep40<p>keep3<p>keep60<p>keep25</article><footer>drop6</footer>",
    "<header>drop3<nav><a>drop1</a></nav></header><main><h1>keep6</h1><p>keep30<ul><li><a>keep4</a><li>keep8</ul><p>keep1</main><aside><h3>drop2</h3><p>drop30</aside><footer><p>drop20</footer>",
    "<div class=menu><a>drop1</a></div><div class=cookie-notice><p>drop25</div><article><header><h1>keep7</h1><p>keep18</header><p>keep50<figure><figcaption>keep9</figcaption></figure><p>keep45</article>",
    "<div class='ad'>drop9</div><article><p>keep12<div class=ad>drop6</div><p><a>keep6</a><p>keep44<blockquote>keep15</blockquote><table><tr><td>keep2<td>keep1</table></article>",
    "<article><h2>keep4</h2><p>keep70<section class=comments><h3>drop1</h3><p>drop35<p>drop12</section><form><label>drop2</label></form><div class=related><a>drop5</a></div></article>",
    "<form><label>drop1</label><button>drop1</button></form><main><p>keep2<p>keep33<aside>drop14</aside><footer>drop5</footer><p>keep3</main><div class=newsletter><p>drop16</div>",
    "<div><a>drop1</a></div><div><a>drop2</a></div><div><a>drop1</a></div><h1>keep6</h1><div>keep55</div><div>keep35</div><div>keep4</div><div>keep48</div><div><a>drop3</a></div><div><a>drop2</a></div>",
    "<ul><li><a>drop2</a><li><a>drop3</a><li><a>drop2</a></ul><h2>keep4</h2><p>keep28<p>keep30<h3>keep3</h3><p>keep60<p>keep12<ul><li><a>drop1</a><li><a>drop2</a></ul>",
    "<p><a>drop4</a></p><p><a>drop2</a> <a>drop2</a> drop1</p><h1>keep9</h1><p>keep20<p>keep1<p>keep22</p><div><a>drop1</a></div><div>drop3</div><div><a>drop2</a></div>",
    "<div><h3>drop2</h3><a>drop4</a></div><div><a>drop5</a></div><p>keep38<p>keep41<div><a>drop6</a></div><div><a>drop5</a></div><h4>drop2</h4><div><a>drop3</a></div>",
    "<p>keep30", "<p>keep4", "<h1>keep3</h1><p>keep14<p>keep2", "keep1", "<p>keep9<p>keep60", "<h1>keep5</h1>",
    "<div class=sidebar><h3>drop3</h3><p>drop40<p>drop22</div><h1>keep5</h1><p>keep40<p>keep8<div class=comments><p>drop50<p>drop8</div><div class=footer>drop15</div>",
    "<div class=header><h2>drop4</h2><p>drop8</div><p>keep33<p>keep50<div class=share>drop2 <a>drop1</a></div><p>keep5<nav><a>drop2</a> drop1</nav>",
    "<header><h1>drop4</h1><p>drop10</header><div><h2>keep6</h2><p>keep35<p>keep10<p>keep44</div><footer><p>drop9<p><a>drop2</a></footer>",
    "<article><h1>keep3</h1><p><a>keep3</a><p><a>keep8</a><p>keep30<nav><a>drop3</a></nav><p>keep20<div class=related><a>drop6</a></div><p>keep2<ul><li><a>keep2</a><li><a>keep3</a></ul><aside><a>drop4</a></aside></article>",
    "<main><p>keep60<div class=share><a>drop2</a></div><p>keep50<footer><a>drop3</a></footer><p>keep2<p><a>keep1</a><p>keep3<p><a>keep12</a></main><nav><a>drop1</a></nav>",
    "<article><p><a>keep2</a></article><article><p>keep2<p><a>keep9</a><form><a>drop2</a></form><p>keep40<div class=ad><a>drop9</a></div><p>keep40<nav><a>drop2</a></nav></article>",
    "<main><section class=comments><p>drop20<p><a>drop1</a><p>drop30</section><p>keep3<aside><p>drop20<p><a>drop2</a></aside><p><a>keep3</a></main>",
]


def labelled() -> list[tuple]:
    """Rows of FEATURES and the label, from the labelled pages."""
    words = lambda m: " ".join([m[1]] * int(m[2]))
    out = []
    for page in LABELLED:
        found = blocks(re.sub(r"(keep|drop)(\d+)", words, page))
        out += [(*x, int(b[0].startswith("keep"))) for b, x in zip(found, described(found), strict=True)]
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12):
    """A CART tree by Gini impurity: nested (feature, threshold, below, above) or a class."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return int(2 * y.sum() >= len(y))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            impurity = sum(part.sum() * (1 - part.sum() / len(part)) for part in (y[low], y[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut))
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, f, cut = best
    low = x[:, f] <= cut
    return (f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def train(rows=None):
    """The decision tree of the labelled pages (or of other rows like theirs)."""
    table = np.array(rows or labelled(), float)
    return grow(table[:, :-1], table[:, -1])


class _Tags:
    """The tags of a page in order, and the text between them; every step moves forward."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def _find(self, what: str, at: int) -> int:
        """Where `what` is next, or the end; what is not found once is not looked for again."""
        found = -1 if what in self.gone else self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
            return len(self.page)
        return found

    def _attributes(self, at: int) -> tuple[str, int]:
        """(class, id and role of the tag whose attributes begin at `at`, joined; where the tag ends)."""
        page, end, said = self.page, len(self.page), []
        while at < end and page[at] != ">":
            m = _ATTRIBUTE.match(page, at)
            name, at = m[1].lower(), m.end()
            if eq := _VALUE.match(page, at):
                at = eq.end()
                quote = page[at : at + 1]
                close = self._find(quote, at + 1) if quote in ('"', "'") and quote else end
                if close < end:
                    value, at = page[at + 1 : close], close + 1
                else:
                    m = _BARE.match(page, at)
                    value, at = m[0], m.end()
                if name in ("class", "id", "role"):
                    said.append(value)
        return " ".join(said), min(at + 1, end)

    def __iter__(self):
        """(text before, tag name or None, whether it closes, class, id and role)."""
        page, at, end = self.page, 0, len(self.page)
        while at < end:
            lt = self._find("<", at)
            text = page[at:lt]
            if lt >= end:
                yield text, None, False, ""
                return
            closing = page.startswith("/", lt + 1)
            m = _NAME.match(page, lt + 1 + closing)
            if page.startswith("<!--", lt):
                at = min(end, self._find("-->", lt + 4) + 3)
                yield text, None, False, ""
            elif m:
                name = m[0].lower()
                said, at = self._attributes(m.end())
                if name in _CLOSES and not closing:
                    shut = _CLOSES[name].search(page, at)
                    at = min(end, shut.end() + 1) if shut else end
                    name = None
                yield text, name, closing, said
            elif closing or page[lt + 1 : lt + 2] in ("!", "?"):
                at = min(end, self._find(">", lt) + 1)
                yield text, None, False, ""
            else:
                at = lt + 1
                yield text + "<", None, False, ""


def hinted(said: str) -> bool:
    """Whether a class, id or role names something other than main text."""
    for token in said.lower().split():
        parts = re.split(r"[-_]+", token)
        undone = next((i for i, p in enumerate(parts) if p in UNDONE), len(parts))
        for i, p in enumerate(parts[:undone]):
            pair = p + parts[i + 1] if i + 1 < undone else p
            if (p in HINTS or pair in HINTS) and not (p == "header" and OF_ARTICLE & set(parts)):
                return True
    return False


def blocks(page: str) -> list[tuple]:
    """(text, words, links, aside, hint, article, heading) for each flat text block, in page order."""
    out: list[tuple] = []
    stack: list[tuple] = []  # tag, aside, article, heading, and the numbers of the elements around it that have a telling name
    named: list[list] = []  # for each such element: its words outside other asides, and whether it holds a main part
    open_: dict[str, int] = {}  # tags on the stack
    text: list[str] = []
    linked, anchor, words_in_all = 0, False, 0
    state: tuple = (0, 0, 0, ())

    def close() -> None:
        nonlocal linked, words_in_all
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                n = whole.count(" ") + 1
                out.append((whole, n, min(1.0, linked / n), *state))
                if not state[0]:
                    words_in_all += n
                    for k in state[3]:
                        named[k][0] += n
            text.clear()
        linked = 0

    def pop(to: int) -> None:
        for gone in stack[to:]:
            open_[gone[0]] -= 1
        del stack[to:]

    for before, name, closing, said in _Tags(page):
        if before:
            text.append(before)
            if anchor:
                linked += len(before.split())
        if name is None:
            continue
        if name == "br":
            text.append(" ")
        elif name == "a":
            anchor = not closing
        elif name in BLOCKS:
            close()
            if name in VOID:
                continue
            if closing:
                if open_.get(name):
                    pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            else:
                while stack and stack[-1][0] == name and name in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
                    pop(len(stack) - 1)
                if stack and stack[-1][0] == "p":
                    pop(len(stack) - 1)
                aside, article, _, within = stack[-1][1:] if stack else (0, 0, 0, ())
                if name in ("main", "h1"):
                    for k in within:
                        named[k][1] = True
                by_name = name == "form" or (hinted(said) if said and name not in ("html", "body", "article", "main") and not (article and name == "header") else False)
                if by_name and len(within) < 16:
                    within = (*within, len(named))
                    named.append([0, False])
                aside = aside or int(name in ASIDE or (name == "header" and not article))
                stack.append((name, aside, article or int(name in ("article", "main")), int(name in HEADINGS), within))
                open_[name] = open_.get(name, 0) + 1
            state = stack[-1][1:] if stack else (0, 0, 0, ())
    close()
    # an element that holds the title or the main part, and half of the words, wraps the page whatever its name is
    telling = [not (main and 2 * n >= words_in_all) for n, main in named]
    return [(t, n, links, aside, int(any(telling[k] for k in within)), article, heading) for t, n, links, aside, article, heading, within in out]


def described(found: list[tuple]) -> list[tuple]:
    """The FEATURES of each block."""
    none = (None, 0, 0.0)
    return [(*b[1:3], *before[1:3], *after[1:3], *b[3:]) for before, b, after in zip([none, *found], found, [*found[1:], none], strict=False)]


def main_text(page: str | None, tree) -> str:
    """The kept blocks of a page, joined by blank lines."""
    found = blocks(page or "")
    kept = []
    for b, x in zip(found, described(found), strict=True):
        node = tree
        while isinstance(node, tuple):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        if node:
            kept.append(b[0])
    return "\n\n".join(kept)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html).

    A narrow map over whole pages, in time and memory proportional to the page, however long it is. Null and empty html
    give empty text; broken markup is read as far as it goes (open comments, scripts and tags end with the page). Nulls in page_id or url are passed on; repeated rows give
    repeated rows; other columns are not read; an empty table gives an empty table.
    """
    tree = train()

    def run(batches):
        for b in slices(batches):
            found = [main_text(h, tree) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
