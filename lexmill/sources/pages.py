"""Detail pages of official documents: title, body, number, status, dates, attachments and related titles.

A table function builds the elements of one page, each a span over the page's texts, and hands out what the page says by
ordered rules: the first selector with an element of enough text gives the body. What is read out of those texts (number,
status, dates) are JVM expressions over its columns.
"""

from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import identifiers as I

# Where bodies stand, most telling first, as (tag or any, attribute, parts of its value that must all occur;
# an id must be equal); texts that are no part of a body; marks of notes on repeals; kinds of files; words of a status.
SELECTORS = (
    (None, "id", "zoom"), (None, "id", "htmlContent"), (None, "id", "conntentNR"), (None, "class", "TRS_Editor"), ("div", "class", "article"), ("div", "class", "currency", "cont"),
    ("div", "class", "detials"), ("div", "class", "info-cont"), ("div", "class", "container", "content"), ("div", "class", "content"), ("div", "class", "con"),
)
NOISE_STARTS = ("当前位置：", "字体：", "分享到：", "收藏", "订阅", "语音播报", "扫一扫", "【打印】", "纠错或建议", "用户登录", "忘记密码", "登 录", "没有账号", "关联解读", "关联文件", "关联问答", "网站纠错", "责任编辑")
NOISE = {"相关政策文件", "相关解读", "关联解读", "关联文件", "关联问答", "注释", "分享", "打印", "下载", "收藏", "订阅", "返回顶部", "正文"}
NOTE_CLASSES = {"zs", "zscont"}
FILE_KINDS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "wps", "et")
STATUS = {"尚未生效": "尚未生效", "已废止": "已废止", "全文废止": "已废止", "全文失效": "已废止", "部分失效": "部分失效", "部分废止": "部分失效", "失效": "已废止", "废止": "已废止", "现行有效": "现行有效", "有效": "现行有效"}
#: Characters of an element that is taken for the body at once, of a body at all, of a title, of a text that may be a number.
BODY_ENOUGH, BODY_LEAST, TITLE_LEAST, NUMBER_MOST = 100, 30, 9, 150

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_LIKE = {"li": {"ul", "ol"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "option": {"select"}, "dd": {"dl"}, "dt": {"dl"}}
_DROPPED = {"script", "style", "noscript"}


class Element:
    __slots__ = ("attributes", "first", "last", "parent", "start", "stop", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: int, at: int, first: int):
        self.tag, self.attributes, self.parent, self.start, self.first = tag, attributes, parent, at, first
        self.stop = self.last = -1


class Page(HTMLParser):
    """The elements of a page in order; an element's texts and descendants are spans, so nothing is copied."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements, self.texts, self.open, self.dropped = [], [], [], 0
        self.feed(html)
        self.close()
        while self.open:
            self._end()

    def _end(self) -> None:
        e = self.elements[self.open.pop()]
        e.stop, e.last = len(self.texts), len(self.elements)
        self.dropped -= e.tag in _DROPPED

    def _end_to(self, tags: set[str], within: set[str]) -> None:
        """End the innermost open element of these tags, unless one of `within` is nearer."""
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.elements[self.open[depth]].tag
            if tag in tags:
                while len(self.open) > depth:
                    self._end()
                return
            if tag in within:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._end_to({"p"}, _ENDS_P - {"p"} | {"td", "li"})
        if tag in _LIKE:
            self._end_to({tag}, _LIKE[tag])
        self.elements.append(Element(tag, {k: v or "" for k, v in attrs}, self.open[-1] if self.open else -1, len(self.texts), len(self.elements) + 1))
        self.open.append(len(self.elements) - 1)
        self.dropped += tag in _DROPPED
        if tag in _VOID:
            self._end()

    def handle_endtag(self, tag):
        self._end_to({tag}, set())

    def handle_data(self, data):
        if not self.dropped:
            self.texts.append(data)

    def text(self, e: Element) -> str:
        return " ".join("".join(self.texts[e.start : e.stop]).split())

    def within(self, e: Element):
        return self.elements[e.first : e.last]

    def select(self, rule: tuple) -> list[Element]:
        tag, name, *parts = rule
        fits = (lambda v: v == parts[0]) if name == "id" else (lambda v: all(p in v for p in parts))
        return [e for e in self.elements if (tag is None or e.tag == tag) and (v := e.attributes.get(name)) is not None and fits(v)]


def body_of(page: Page, selectors) -> str | None:
    """Paragraphs of the longest element of the first selector that has one of BODY_ENOUGH characters, else of the longest
    of the first selector that has any; an element without paragraphs is one. Labels of the page are left out, and too
    short a body is none."""
    spare = None
    for rule in selectors:
        found = [(len(page.text(e)), -i, e) for i, e in enumerate(page.select(rule))]
        if found:
            best = max(found, key=lambda x: x[:2])
            if best[0] >= BODY_ENOUGH:
                spare = best
                break
            spare = spare or best
    if spare is None:
        return None
    paragraphs = [t for e in page.within(spare[2]) if e.tag == "p" and len(t := page.text(e)) >= 2 and t not in NOISE and not t.startswith(NOISE_STARTS)]
    body = "\n".join(paragraphs or [page.text(spare[2])])
    return body if len(body) >= BODY_LEAST else None


def title_of_page(page: Page) -> str | None:
    """What the page calls its article, else its first long enough h1, else its title."""
    named = [e.attributes.get("content", "") for e in page.elements if e.tag == "meta" and e.attributes.get("name", "").lower() == "articletitle"]
    for tag in ("h1", "title"):
        named += [page.text(e) for e in page.elements if e.tag == tag][:1]
    return next((t for x in named if len(t := " ".join(x.split())) >= TITLE_LEAST), None)


def number_lines(page: Page) -> list[str]:
    """Short texts that hold 号, but for notes that say who repealed the document."""
    out, notes = [], set()
    for i, e in enumerate(page.elements):
        if e.parent in notes or NOTE_CLASSES & set(e.attributes.get("class", "").split()):
            notes.add(i)
        elif sum(map(len, page.texts[e.start : e.stop])) <= 4 * NUMBER_MOST and "号" in (t := page.text(e)) and len(t) <= NUMBER_MOST and not any(f"本文{x}{y}" in t for x in ("", "全文", "部分") for y in ("废止", "失效")):
            out.append(t)
    return list(dict.fromkeys(out))


def links_of(page: Page, base: str) -> tuple[list[dict], list[str]]:
    """Attached files by web address, each once, and titles of related documents."""
    files, related = {}, []
    sets = set()
    for i, e in enumerate(page.elements):
        if e.parent in sets or "artsets" in e.attributes.get("class", ""):
            sets.add(i)
        if e.tag != "a":
            continue
        said, href = page.text(e), e.attributes.get("href", "")
        if i in sets and len(said) > 4:
            related.append(said)
        kind = href.split("?")[0].rpartition(".")[2].lower()
        if kind in FILE_KINDS:
            try:
                full = urljoin(base, href)
            except ValueError:  # no address at all
                continue
            if full.lower().startswith(("http://", "https://")):  # others could run a script where they are shown
                files.setdefault(full, {"url": full, "filename": said or href.rpartition("/")[2], "kind": kind})
    return list(files.values()), related


_PARTS = "title string, body string, number_lines array<string>, status_lines array<string>, attachments array<struct<url:string,filename:string,kind:string>>, related array<string>"


def page_parts(html: str | None, base: str | None, selectors=SELECTORS) -> tuple:
    page = Page(html or "")
    files, related = links_of(page, base or "")
    status = [page.text(e) for e in page.elements if "arc_date" in e.attributes.get("class", "")]
    return title_of_page(page), body_of(page, selectors), number_lines(page), [s for s in status if s], files, related


def details(pages: DataFrame, published: Column | None = None, selectors=SELECTORS) -> DataFrame:
    """pages (page_id, url, html) as (page_id, url, title, body, number, status, written, effective, attachments, related).

    A null or empty page has nulls and empty lists. `published` is a day already known, which checks the number and the
    effective day where the page has none itself: a number five years or more later isn't the document's, and it takes
    effect no earlier than it was written, nor five years later. Repeated rows give repeated rows; an empty table gives an
    empty one.
    """

    @F.udtf(returnType=_PARTS)
    class Parts:
        def eval(self, html: str, base: str):
            yield page_parts(html, base, selectors)

    known = F.lit(None).cast("date") if published is None else published.cast("date")
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), known.alias("known"))
    found = rows.lateralJoin(Parts(F.col("html").outer(), F.col("url").outer()))
    status = F.lit(None).cast("string")
    for word, meaning in reversed(STATUS.items()):
        status = F.when(F.contains(F.array_join("status_lines", "\n"), F.lit(word)), meaning).otherwise(status)
    day = F.get(F.filter(F.transform("status_lines", lambda s: F.regexp_extract(s, r"成文日期[:：]\s*(20\d\d[-/年]\d{1,2}[-/月]\d{1,2})", 1)), lambda x: x != ""), 0)
    written = F.try_to_date(F.regexp_replace(F.regexp_replace(day, "[/年月]", "-"), r"-(\d)(?=-|$)", "-0$1"), "yyyy-MM-dd")
    number = F.get(F.filter(F.flatten(F.transform("number_lines", lambda t: F.concat(I.every(I.tight(t), I.ANNOUNCED), I.every(I.tight(t), I.BRACKETED)))), lambda n: n != ""), 0)
    found = found.select("page_id", "url", "title", "body", I.without_lead_in(number).alias("number"), status.alias("status"), F.coalesce(written, F.lit(None).cast("date")).alias("written"), F.coalesce(written, "known").alias("day"), "attachments", "related")
    late = I.number_year(F.col("number"), 9999) - F.year("day") >= 5
    return found.select(
        "page_id", "url", "title", "body", F.when(F.coalesce(late, F.lit(False)), None).otherwise(F.col("number")).alias("number"), "status", "written",
        I.starting_day(F.col("body"), F.col("day")).alias("effective"), "attachments", "related",
    )
