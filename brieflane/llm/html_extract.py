"""Main text of web pages by two passes over text blocks (operator 8).

A page is cut into blocks at block-level tags. Pass 1 decides what it can: blocks inside
navigation, header, footer, form and comment elements, and blocks made of links, are
boilerplate; long blocks, or blocks dense in stop words, are text; where the page marks its
article, blocks outside it are boilerplate and links inside it are no sign of it. Short blocks stay
undecided. Pass 2 gives an undecided block the label of its nearest decided neighbours: the common
label of both, else that of the nearer one (the following one on a tie, as a heading belongs to what
it heads). Where nothing was decided to be text, the page is a short one: undecided blocks are its text.

A class or id marks boilerplate by whole names only, and not around the page's only article or
most of its long text.

Every step takes time in proportion to the page, whatever its markup is.

Rules: null and empty pages give an empty text; unclosed, unknown and stray tags are passed
over, and a tag that another one begins in is text (an unclosed script or style has the rest of the page); <head> ends where body text begins;
references without a meaning stay as they are; every input row gives one output row; other
columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brieflane.llm.common import map_texts

#: Common function words of the languages at hand.
STOP_WORDS = frozenset("""
the of and a to in is you that it he was for on are as with his they i at be this have from or one had by but not
what all were we when your can said there use an each which she do how their if will up about out many then them
der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass
sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man
le la les de des du un une et à il que qui dans en ne pas ce pour sur se plus par avec au sont son nous vous mais
comme est ou si leur on cette ses été elle fait aux était tout sans peut
el los las y que se del por con no una su para es al lo como más pero sus le ya o este sí porque esta entre cuando
muy sin sobre también me hasta hay donde quien desde todo nos durante
di che non per sono della dei con una nel alla più anche come ma gli os do da não uma dos ao het een van en dat op
""".split())

#: Elements whose whole content is no text of the page.
SILENT = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select",
          "button", "audio", "video", "title")
#: What may stand in <head>; any other tag, and text, ends it.
HEAD = {"head", "base", "link", "meta", "script", "style", "noscript", "template", "title", "object"}
#: Elements that hold boilerplate.
APART = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
#: Elements that hold the article.
ARTICLE = {"article", "main"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt",
          "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
          "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary",
          "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An open one of these ends where another one begins.
ENDS = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"},
        "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option", "optgroup"}}
#: Words in class, id, role and aria-label that mark boilerplate.
HINT = re.compile(r"ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side|"
                  r"footer|masthead|cookies?|consent|notices?|alert|gdpr|popup|modal|overlay|comments?|replies|reply|"
                  r"respond|disqus|share|sharing|social|related|recommend\w*|newsletter|subscri\w*|sign-?up|login|"
                  r"search\w*|pagination|pager|tags|widget|toolbar|skip|copyright|legal|byline-links|"
                  r"complementary|contentinfo|navigation|dialog", re.I)
#: Words that may stand beside them in one name: a name with any other word is no mark.
BESIDE = re.compile(r"top|bottom|left|right|main|site|page|global|primary|secondary|header|head|foot|inner|outer|upper|lower|"
                    r"wrap\w*|container|box|area|section|block|bar|row|col|column|panel|pane|group|list|items?|links?|"
                    r"buttons?|btns?|icons?|form|field|input|results?|thread|text|title|body|overlay|slot|unit|"
                    r"posts?|articles?|stories|story|news|media|up|in|out|to|this|the|and|for|js|l|m|s|x|\d\w*", re.I)
#: Marks that are never around an article, however much text they hold.
FIRM = re.compile(r"comments?|replies|reply|respond|disqus|cookies?|consent|gdpr", re.I)
MAIN_HINT = re.compile(r"role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody\b", re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|([^<]+|<)", re.S)
CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in SILENT}
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
LETTERS = re.compile(r"[^\W\d_]+")

LONG, SHORT, DENSE, LINKED = 140, 60, 0.08, 0.4


def mark(attributes: str) -> str:
    """"firm", "loose" or "" (none): whether a name in the attributes marks boilerplate. A name
    counts as a whole: ``share-buttons`` is a mark, ``has-sidebar`` is none."""
    found = ""
    for key, *values in ATTRIBUTE.findall(attributes):
        value = values[0] or values[1] or values[2]
        for name in [value] if key.lower() == "aria-label" else value.split():
            words = [w for w in re.split(r"[\s_-]+", name) if w]
            hints = [w for w in words if HINT.fullmatch(w)]
            if HINT.fullmatch(name) or (hints and all(HINT.fullmatch(w) or BESIDE.fullmatch(w) for w in words)):
                if any(FIRM.fullmatch(w) for w in words):
                    return "firm"
                found = "loose"
    return found


class Marks:
    """Boilerplate marks, each inside the one before it (``parent``, -1 for none)."""

    def __init__(self):
        self.loose: list[bool] = []
        self.parent: list[int] = []
        self.article: list[bool] = []      # the mark stands inside an article
        self.all_article: list[bool] = []  # ... and so do those around it

    def add(self, loose: bool, article: bool, parent: int) -> int:
        self.loose.append(loose)
        self.parent.append(parent)
        self.article.append(article)
        self.all_article.append(article and (parent < 0 or self.all_article[parent]))
        return len(self.loose) - 1


def blocks(page: str) -> list[tuple[str, float, bool, bool]]:
    """(text, share of it in links, inside boilerplate, inside an article) in page order."""
    out: list[tuple[str, float, bool, bool, int]] = []
    # open elements: name, boilerplate, article, the innermost mark they are in
    stack: list[tuple[str, bool, bool, int]] = []
    opened: Counter = Counter()
    marks = Marks()
    text: list[str] = []
    linked = [0]
    links = 0
    head = False
    unclosed: set[str] = set()

    def flush():
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            _, apart, article, within = stack[-1] if stack else ("", False, False, -1)
            out.append((joined, min(1.0, linked[0] / len(joined)), apart, article, within))
        text.clear()
        linked[0] = 0

    at, last = 0, page.rfind(">")
    while at < len(page):
        if at > last and not page.startswith("<!--", at):  # no tag ends any more
            end = page.find("<!--", at)
            data, at = page[at:end if end >= 0 else len(page)], end if end >= 0 else len(page)
            close = name = attributes = None
        else:
            m = TOKEN.match(page, at)
            at = m.end()
            close, name, attributes, data = m.groups()
        if data is not None:
            if head and data.strip():
                head = False
            text.append(data)
            if links:
                linked[0] += len(data.strip())
            continue
        if name is None:  # comments, declarations
            continue
        name = name.lower()
        if name in CLOSE:
            # one that is not closed is passed over, as its tag alone; a script or style has the rest
            if not close and not SELF_CLOSED.search(attributes):
                end = None if name in unclosed else CLOSE[name].search(page, at)
                if end:
                    at = end.end()
                elif name in ("script", "style"):
                    at = len(page)
                else:
                    unclosed.add(name)
            if name in HEAD:
                continue
        if name == "head":
            head = not close
            continue
        if head and not close and name not in HEAD:
            head = False
        if close:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCKS:
                flush()
                if opened[name]:
                    links = 0
                    while True:
                        gone = stack.pop()[0]
                        opened[gone] -= 1
                        if gone == name:
                            break
            continue
        if name == "a":
            links = 0 if SELF_CLOSED.search(attributes) else 1
        elif name == "br":
            text.append(" ")
        elif name in BLOCKS:
            flush()
            links = 0
            while stack and name in ENDS.get(stack[-1][0], ()):
                opened[stack.pop()[0]] -= 1
            if name in VOID:
                continue
            _, apart, article, within = stack[-1] if stack else ("", False, False, -1)
            inside = name in ARTICLE or bool(attributes and MAIN_HINT.search(attributes))
            marked = "" if inside or name in ("body", "html") or not attributes else mark(attributes)
            if marked:
                within = marks.add(marked == "loose", article, within)
            outside = name in APART or (name == "header" and not article)
            stack.append((name, apart or outside, article or inside, within))
            opened[name] += 1
    flush()
    void = void_marks(out, marks)
    return [(t, share, apart or (within >= 0 and not void[within]), article) for t, share, apart, article, within in out]


def void_marks(out: list[tuple[str, float, bool, bool, int]], marks: Marks) -> list[bool]:
    """For each mark, whether it and all marks around it are void: loose ones that stand around the
    page's only article, or around most of the long text (of the article, if one stands outside all
    marks, else of the page)."""
    n_marks = len(marks.loose)

    def alone(block) -> bool:
        return block[3] and not block[2] and (block[4] < 0 or marks.all_article[block[4]])

    free = any(alone(block) for block in out)
    every, held, article_in = 0, [0] * n_marks, [False] * n_marks
    for block in out:
        text, linked, apart, article, within = block
        if apart or (free and not alone(block)):
            continue
        n = len(text) if len(text) >= LONG and linked <= LINKED else 0
        every += n
        if within >= 0:
            held[within] += n
            article_in[within] = article_in[within] or article
    for i in range(n_marks - 1, -1, -1):  # a mark comes after those around it
        around = marks.parent[i]
        if around >= 0:
            held[around] += held[i]
            article_in[around] = article_in[around] or article_in[i]
    void = [False] * n_marks
    for i in range(n_marks):
        own = marks.loose[i] and ((article_in[i] and not marks.article[i]) or 2 * held[i] > every)
        void[i] = own and (marks.parent[i] < 0 or void[marks.parent[i]])
    return void


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    marked = any(article and not apart for _, _, apart, article in found)
    labels: list[bool | None] = []
    for text, linked, apart, article in found:
        words = LETTERS.findall(text.lower())
        dense = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        if apart or (marked and not article) or (linked > LINKED and not marked):
            labels.append(False)
        elif len(text) >= LONG or (len(text) >= SHORT and dense >= DENSE):
            labels.append(True)
        else:
            labels.append(None)
    if True not in labels:  # a short page
        labels = [label is None for label in labels]
    # in a marked article neither what stands outside nor an inserted part (aside, share list)
    # says anything about its short blocks
    voters = [i for i, x in enumerate(labels) if x is not None and (not marked or (found[i][3] and not found[i][2]))]
    kept, k = [], 0
    for i, label in enumerate(labels):
        while k < len(voters) and voters[k] < i:
            k += 1
        if label is None:
            before = voters[k - 1] if k else None
            after = voters[k] if k < len(voters) else None
            if before is None and after is None:
                label = True
            elif before is None or after is None or labels[before] == labels[after]:
                label = labels[before if after is None else after]
            else:
                label = labels[before if i - before < after - i else after]
        if label:
            kept.append(found[i][0])
    return " ".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of ``pages``."""
    kind = pages.schema[id_col].dataType.simpleString()

    def make():
        def work(part):
            texts = [main_text(x) for x in part.column(1).to_pylist()]
            return [part.column(0), part.column(2), texts, [len(t) for t in texts]]
        return work

    slim = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"),
                        F.col(url_col).cast("string").alias("url"))
    out = map_texts(slim, f"id {kind}, url string, text string, n_chars bigint", make)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
