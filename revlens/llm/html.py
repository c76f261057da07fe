"""Operator 7: main text of a page by line-block distribution.

Markup is stripped to lines, one for each block element. A line weighs the
characters of its text outside links, on every page; lines of menus, headers,
footers, sidebars, notices, adverts, forms and comments weigh nothing. The
weights are summed over a sliding window of lines. Where the sum rises over a
threshold is a surge point, where it falls to nothing, or where an <article>
or <main> begins or ends, a dive point; an <article> with a surge point is one
stretch. The heaviest stretch is main text, and others that weigh a share of
it. Lines in an <article> or <main> count BONUS times here, so the mark tips
the balance, but a page that marks only teasers keeps its unmarked body.

A kept <article> loses only its boilerplate lines, and a <main> that holds the
heaviest stretch keeps all its stretches, whatever they weigh. Elsewhere a
stretch starts at a heading up to WINDOW lines before its surge point.

Reader comments are known by the names of their elements, and by structure:
blocks that follow the text and each begin with a name and a time.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3        # lines in a window
SURGE = 86        # characters in a window at which text may begin
SHARE = 0.25      # a stretch is kept if it weighs so much of the heaviest one
BONUS = 2         # times that a marked stretch weighs against an unmarked one
GAP = 6           # lines between two stretches, at most, that belong to the text around them
LINK_SHARE = 0.5  # a line with more of its text in links weighs nothing
BYLINE = 80       # characters of a line, at most, that says who wrote a comment and when
LEAD = 3          # lines, at most, in which a comment says so
ACTION = 40       # characters of a line, at most, that offers to answer a comment

# Element names by their role.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table
tbody td tfoot th thead tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style noscript template textarea title iframe noframes noembed xmp svg math object canvas".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
OUTER = frozenset("nav footer aside form menu dialog button select datalist head".split())
CLASSES = frozenset("""ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie
cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo
promoted related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar
widget""".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
MONTHS = """jan january januar janvier enero feb february februar février febrero mar march märz mars marzo apr april avril abril
may mai mayo jun june juni juin junio jul july juli juillet julio aug august août agosto sep sept september septembre septiembre
oct okt october oktober octobre octubre nov november novembre noviembre dec dez december dezember décembre diciembre""".split()
THREADS = frozenset("discussion discussions thread threads responses reactions conversation kommentare commentaires comentarios".split())
TITLES = "comments? responses? replies reactions? discussion conversation kommentare? commentaires? comentarios? antworten respuestas".split()
ANSWERS = "reply report quote permalink antworten melden répondre signaler responder".split()

_WHEN = re.compile(rf"""\b\d{{4}}-\d\d?-\d\d?\b|\b\d\d?([./])\s?\d\d?\1\s?\d{{2,4}}\b|\b\d\d?:\d\d\b
    |\b\d\d?(?:st|nd|rd|th|\.)?\s(?:de\s)?(?:{"|".join(MONTHS)})\b|\b(?:{"|".join(MONTHS)})\.?\s\d\d?\b
    |\b(?:\d+|an?|one)\s(?:second|sec|minute|min|hour|hr|day|week|month|year)s?\sago\b|\byesterday\b
    |\bvor\s\d+\s\w|\bil\sy\sa\s\d+\s\w|\bhace\s\d+\s\w|\b(?:says|said|wrote|writes|schrieb|écrit|escribió)\s?:$""", re.X | re.I)
_TITLE = re.compile(rf"(?:(?:\d+|no|all|reader|readers['’]|user|latest) )?(?:{'|'.join(TITLES)})(?: ?\(?\d+\)?)?:?", re.I)
_COMMENT = re.compile("comment|kommentar|comentario", re.I)
_ACTION = re.compile(rf"(?:{'|'.join(ANSWERS)})\b|.*\b(?:{'|'.join(ANSWERS)})$", re.I)
_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>"']+|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)""", re.S)
_LOOSE = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)>", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PART = re.compile(r"[\s_-]+")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _is_outer(name: str, attrs: str, in_article: bool) -> bool:
    """Whether an element holds no main text."""
    if name in OUTER or name == "header" and not in_article:
        return True
    for key, value in _ATTR.findall(attrs) if attrs else ():
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" and value != "until-found" or key == "aria-hidden" and value == "true" or key == "style" and _HIDES.search(value):
            return True
        if name in ("body", "html", "article", "main"):
            continue
        parts = set(_PART.split(value.lower()))
        if key in ("class", "id") and parts & CLASSES and not (in_article and parts & CLASSES <= {"header"}):
            return True
        if key == "role" and parts & ROLES:
            return True
    return False


def _in_thread(attrs: str) -> bool:
    """Whether an element's class or id may name a list of comments; a section of an article may have such a name too."""
    return any(k.lower() in ("class", "id") and THREADS & set(_PART.split(v.strip("\"'").lower())) for k, v in _ATTR.findall(attrs)) if attrs else False


class Lines:
    """The lines of a page: text, characters in links, whether they hold main text, the marked element they lie in, whether a heading.

    Marked elements count from 1 (0: none), even numbers for <article>, odd
    ones for <main>. The outermost <article> counts, or else the outermost <main>.
    """

    def __init__(self, page: str):
        self.lines: list[tuple[str, int, bool, int, bool]] = []
        self._parts: list[str] = []
        self._linked = 0
        self._stack: list[tuple[str, bool, int, bool, int]] = []  # name, no main text, marked element, hides by its own attributes, block
        self._links = 0
        self._marks = 0
        self.blocks: list[tuple[int, str, bool]] = [(0, "", False)]  # the block around it, name, named like a list of comments
        self.where: list[int] = []  # the block of each line
        self._scan(page)
        for i in sorted(comment_lines(self.lines, self.where, self.blocks)):
            self.lines[i] = (*self.lines[i][:2], False, *self.lines[i][3:])

    def _text(self, raw: str) -> None:
        if raw:
            self._parts.append(raw)
            if self._links:
                self._linked += len(raw.strip())

    def _close_line(self) -> None:
        if self._parts:
            text = " ".join(entities.unescape("".join(self._parts)).split())
            if text:
                _, outer, mark, _, block = self._stack[-1] if self._stack else ("", False, 0, False, 0)
                heading = any(x[0] in HEADINGS for x in self._stack)
                self.lines.append((text, min(self._linked, len(text)), not outer, mark, heading))
                self.where.append(block)
            self._parts, self._linked = [], 0

    def _scan(self, page: str) -> None:
        at = 0
        while True:
            start = page.find("<", at)
            if start < 0:
                self._text(page[at:])
                break
            self._text(page[at:start])
            m = _TAG.match(page, start) or _LOOSE.match(page, start)
            if m is None:  # a bare "<" is text
                self._text("<")
                at = start + 1
                continue
            at = m.end()
            if m.group().startswith("<![CDATA["):
                self._text(_escaped(m.group()[9:].removesuffix("]]>")))
            elif name := m.groupdict().get("name"):
                at = self._tag(page, at, name.lower(), bool(m["end"]), m["attrs"])
        self._close_line()

    def _tag(self, page: str, at: int, name: str, end: bool, attrs: str) -> int:
        if name == "br":
            self._parts.append(" ")
            return at
        if name in BLOCKS:
            self._close_line()
        if end:
            self._pop(name)
            return at
        if name in RAW and not attrs.endswith("/"):
            m = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            return m.end() if m else len(page)
        if name in VOID:
            return at
        if name == "p" and self._stack and self._stack[-1][0] == "p":
            self._pop("p")
        _, outer, mark, _, block = self._stack[-1] if self._stack else ("", False, 0, False, 0)
        if name in BLOCKS:
            self.blocks.append((block, name, _in_thread(attrs)))
            block = len(self.blocks) - 1
        if name in ("article", "main") and not mark:
            outer = any(x[3] for x in self._stack)  # an unclosed menu doesn't swallow the article, a list of comments does
        if name == "main" and not mark or name == "article" and (not mark or _is_main(mark)):
            self._marks += 2
            mark = self._marks - (name == "main")
        if name == "a":
            self._links += 1
        hides = _is_outer(name, attrs, mark > 0)
        self._stack.append((name, outer or hides, mark, hides and name not in OUTER, block))
        return at

    def _pop(self, name: str) -> None:
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == name:
                if name not in BLOCKS and any(x[0] in BLOCKS for x in self._stack[i + 1:]):
                    del self._stack[i]  # an inline element that ends inside another block
                else:
                    del self._stack[i:]
                break
        self._links = sum(x[0] == "a" for x in self._stack) if name == "a" or self._links else 0


def _lead(lines: list[tuple[str, int, bool, int, bool]], stamped: list[bool], a: int, b: int) -> int | None:
    """The line among the first ones of a block that says when it was written, if text follows it."""
    for i in range(a, min(a + LEAD, b - 1)):
        if len(lines[i][0]) > (ACTION if lines[i][4] else BYLINE):
            return None
        if stamped[i]:
            return i
    return None


def comment_lines(lines: list[tuple[str, int, bool, int, bool]], where: list[int], blocks: list[tuple[int, str, bool]]) -> set[int]:
    """Lines of reader comments by their structure, after text that weighs enough for a surge.

    Comments are blocks of one name inside another block, at least half of
    the blocks from the first to the last of them, that each begin with a time
    and go on. A further sign is asked for: a title of comments before them, a
    name of the block around them, an offer to answer in most of them; or,
    outside an <article>, three of them with different names before the time.
    Under a title of comments that a time follows (two, if the title may be
    that of a section), lines that aren't dealt into blocks are comments too,
    up to the next heading.
    """
    stamped = [inner and len(t) <= BYLINE and bool(_WHEN.search(t)) for t, _, inner, _, _ in lines]
    if not any(stamped):
        return set()
    first, last = [len(lines)] * len(blocks), [-1] * len(blocks)
    for i, k in enumerate(where):
        first[k], last[k] = min(first[k], i), i
    inside = defaultdict(list)
    for k in range(len(blocks) - 1, 0, -1):  # a block is numbered after the one around it
        if last[k] >= 0:
            p = blocks[k][0]
            first[p], last[p] = min(first[p], first[k]), max(last[p], last[k])
            inside[p].append(k)
    before = [0]
    for x in weights(lines):
        before.append(before[-1] + x)
    titles = {i for i, x in enumerate(lines) if x[2] and len(x[0]) <= ACTION and _TITLE.fullmatch(x[0]) and before[i] > SURGE}
    found: set[int] = set()
    for p, kids in inside.items():
        kids = [k for k in reversed(kids) if blocks[k][1] not in HEADINGS and blocks[k][1] not in OUTER]
        leads = {k: at for k in kids if (at := _lead(lines, stamped, first[k], last[k] + 1)) is not None}
        if len(leads) < 2 or len({blocks[k][1] for k in leads}) > 1:
            continue
        items, a = list(leads), first[next(iter(leads))]
        b = last[items[-1]] + 1
        if before[a] <= SURGE or 2 * len(items) < sum(a <= first[k] < b for k in kids):
            continue
        title = next((i for i in range(a - 1, max(first[p], a - LEAD) - 2, -1) if i in titles), None)
        answers = sum(any(len(lines[i][0]) <= ACTION and _ACTION.match(lines[i][0]) for i in range(first[k], last[k] + 1)) for k in items)
        if title is None and not blocks[p][2] and 2 * answers <= len(items):
            who = {_who(lines, first[k], leads[k]) for k in items}
            if lines[a][3] and not _is_main(lines[a][3]) or len(items) < 3 or len(who) < 2 or "" in who:
                continue
        found.update(range(a if title is None else title, b))
    for i in titles - found:
        if any(stamped[i + 1:i + 1 + LEAD]):
            p = where[i]
            while last[p] == i and p:
                p = blocks[p][0]
            end = i + 1
            while end <= last[p] and (not lines[end][4] or any(stamped[end:end + LEAD])):
                end += 1
            if _COMMENT.search(lines[i][0]) or sum(stamped[i + 1:end]) > 1:
                found.update(range(i, end))
    return found


def _who(lines: list[tuple[str, int, bool, int, bool]], a: int, at: int) -> str:
    """What stands before the time of a comment if it may be a name, else nothing."""
    text = " ".join(lines[i][0] for i in range(a, at + 1))
    m = _WHEN.search(text)
    name = text[:m.start()].strip(" ,|·–—-") if m else ""
    return name if len(name) <= ACTION and any(c.isalpha() for c in name) and not any(lines[i][4] for i in range(a, at + 1)) else ""


def _escaped(text: str) -> str:
    """Text that unescaping gives back as it is."""
    return text.replace("&", "&amp;")


def _is_main(mark: int) -> bool:
    return mark % 2 == 1


def weights(lines: list[tuple[str, int, bool, int, bool]]) -> list[int]:
    """Characters that count for each line."""
    return [len(t) - linked if inner and linked <= LINK_SHARE * len(t) else 0 for t, linked, inner, _, _ in lines]


def _surges(w: list[int], threshold: float) -> list[tuple[int, int]]:
    """(surge, dive) line ranges."""
    sums = [sum(w[i:i + WINDOW]) for i in range(len(w))]
    found, i = [], 0
    while i < len(w):
        if sums[i] <= threshold or not w[i]:
            i += 1
            continue
        j = i
        while j < len(w) and sums[j]:
            j += 1
        found.append((i, j))
        i = j
    return found


def _least(mark: int, best: int) -> float:
    """Share of the heaviest stretch's weight, which lies in element ``best``, that one in element ``mark`` needs."""
    if bool(mark) != bool(best) or _is_main(best) and mark and not _is_main(mark):
        return SHARE * BONUS  # unmarked text beside a marked body, or cards beside a body that isn't an article
    return SHARE


def stretches(w: list[int], marks: list[int], inner: list[bool]) -> list[tuple[int, int]]:
    """Line ranges of the text that is kept; none runs over the border of a marked element.

    A light stretch stays if only a few lines, none of them boilerplate, lie
    between it and one that is kept: a closing paragraph after a list of links.
    """
    edges = [0, *(i for i in range(1, len(w)) if marks[i] != marks[i - 1]), len(w)]
    parts = list(zip(edges, edges[1:], strict=False))
    raised = [x * BONUS if mark else x for x, mark in zip(w, marks, strict=True)]
    threshold = min(SURGE, max((sum(raised[i:min(i + WINDOW, b)]) for a, b in parts for i in range(a, b)), default=0) / 2)
    found = []
    for a, b in parts:
        surges = [(a + i, a + j) for i, j in _surges(raised[a:b], threshold)]
        found += [(a, b)] if surges and marks[a] and not _is_main(marks[a]) else surges
    if not found:
        return []
    best = max(found, key=lambda x: sum(raised[x[0]:x[1]]))
    heaviest, mark = sum(w[best[0]:best[1]]), marks[best[0]]
    kept = [_is_main(mark) and marks[a] == mark or sum(w[a:b]) >= _least(marks[a], mark) * heaviest for a, b in found]
    for way in (range(1, len(found)), range(len(found) - 2, -1, -1)):
        for i in way:
            near = i - 1 if way.step > 0 else i + 1
            kept[i] = kept[i] or kept[near] and _joined(found[min(i, near)], found[max(i, near)], marks, inner)
    return [x for x, k in zip(found, kept, strict=True) if k]


def _joined(one: tuple[int, int], two: tuple[int, int], marks: list[int], inner: list[bool]) -> bool:
    """Whether what lies between two stretches belongs to the text."""
    gap = range(one[1], two[0])
    return len(gap) <= GAP and len({marks[i] for i in range(one[1] - 1, two[0] + 1)}) == 1 and all(inner[i] for i in gap)


def _from_heading(start: int, least: int, lines: list[tuple[str, int, bool, int, bool]], w: list[int]) -> int:
    """Where a stretch begins whose surge point is ``start``: at the headings before it, but not before ``least``."""
    first, i = start, start - 1
    while i >= max(least, first - WINDOW) and lines[i][2] and lines[i][3] == lines[start][3] and (w[i] or lines[i][4]):
        if lines[i][4]:
            first = i
        elif first < start:
            break  # only headings that follow each other
        i -= 1
    return first


def main_text(page: str) -> str:
    """The kept lines, joined by newlines."""
    lines = Lines(page).lines
    w, marks, inner = weights(lines), [x[3] for x in lines], [x[2] for x in lines]
    kept, end, last = [], 0, None
    for a, b in stretches(w, marks, inner):
        if marks[a] and not _is_main(marks[a]):
            kept += [lines[i][0] for i in range(a, b) if inner[i]]
        elif last and _joined(last, (a, b), marks, inner):
            kept += [lines[i][0] for i in range(last[1], b) if w[i] or i < a]  # what lies between goes with them
        else:
            first = _from_heading(a, end, lines, w)
            kept += [lines[i][0] for i in range(first, b) if w[i] or i < a]
        end, last = b, (a, b)
    return "\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(x.as_py() or "") for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())], names=["page_id", "url", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and the main text of each whole page.

    Nulls and edges: a null or empty page, and one without main text, gives
    the empty text; null ids and urls stay null; broken markup is read as far
    as it goes; repeated rows give repeated results; an empty table gives an
    empty result; other columns are ignored.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(_extract, "page_id long, url string, text string")
