"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block tags. Pass 1 decides blocks by what holds them (menus, headers, footers, sidebars, notices,
adverts, forms and comments are boilerplate), by link density, by length and by stop-word density. Pass 2 gives each short
undecided block the label of its nearest decided neighbour among the blocks of the same holder (if two are as
near, text wins). Of blocks without a decided neighbour those of an article are text. Stop words only speak for a block: where the
long blocks of a page hardly have any, its language is another one and they are text by length and links alone. If nothing of a page
is decided as text, all blocks are text that no boilerplate holder and no link density rejects.

A class, id or role word makes no boilerplate of a holder that has most of the page's long blocks with few links, and more text
in them than stands freely elsewhere; one that names comments only counts for the page if no long block stands freely elsewhere.
An element without text (a picture, a button, a player) goes from its start tag to its end tag; without an end tag before its
holder ends, only its own tag goes. Scripts, styles and comments that nothing ends run to the end of the page, as in browsers. A tag whose
quotes don't close ends at the next `>`; without one its `<` is text. Tokens are found in one pass forward: what was scanned in vain is not
scanned again, so a page costs time in proportion to its length whatever it holds.

Null and empty pages have an empty text. Repeated rows get the same text each. An empty table gives an empty result. Pages of
any length are worked on whole, one at a time. Columns named like the result stay: the result's name gets underscores.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fresh, over_texts, struct

_TEXT = struct("text string, n_blocks bigint, n_kept bigint")
_DECLARED = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"""[>"']""")
#: Elements whose content is not markup: code, which may run to the end of the page, and text, which must be ended.
_CODE = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in ("script", "style")}
_RAW = {n: re.compile(rf"[^<]*(?:<(?!/?{n}[\s/>])[^<]*)*</{n}(?=[\s/>])[^>]*>", re.I) for n in ("title", "textarea", "iframe")}
#: Elements without text of the page whose content is tags; the raw ones are whole tokens.
_SKIPPED = frozenset("noscript template svg math object canvas audio video select button".split())
_UNQUOTED = re.compile(r"""=\s*[^\s"']+/\Z""")
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav "
    "ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_HOLDERS = frozenset("article aside body center details dialog div dl fieldset figure footer form header main menu nav ol section table tbody td th tr ul li".split())
_JUNK = frozenset("nav footer aside form menu dialog fieldset".split())
#: Words of class, id or role that mark boilerplate.
_JUNK_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|side-?bar|menu|nav|navbar|navigation|"
    r"breadcrumbs?|footer|masthead|topbar|site-header|page-header|comments?|commentlist|respond|reply|replies|disqus|share|sharing|social|newsletter|subscribe|signup|related|recommend(?:ed|ations)?|login|search|"
    r"complementary|contentinfo|toolbar|pagination|pager|widget)(?:$|[\s_-])", re.I)
_COMMENT_NAME = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|reply|replies|disqus)(?:$|[\s_-])", re.I)
#: Function words of the four languages of the corpus.
STOP_WORDS = frozenset((
    "a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their they this to was we were which will with you "
    "aber als am an auch auf aus bei das dem den der des die ein eine einen einer er es für hat ich im in ist mit nicht noch oder sich sie sind über um und von war wie zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con de del el en es esta este ha la las le lo los más me mi no o para pero por que se si sin sobre su sus un una y").split())
#: Words from which on a block is long, the link density that is too high, and the stop-word densities outside an article.
LONG, LINKS, STOP_HIGH, STOP_LOW = 8, 0.5, 0.2, 0.08


class _Holder:
    """marked: a class, id or role in force makes it boilerplate; mark: the number of the innermost holder with such a word, or -1."""
    __slots__ = ("name", "junk", "article", "comments", "marked", "mark")

    def __init__(self, name, junk, article, comments, marked, mark):
        self.name, self.junk, self.article, self.comments, self.marked, self.mark = name, junk, article, comments, marked, mark


class _Token(NamedTuple):
    start: int
    end: int
    name: str = ""
    ending: bool = False
    attributes: str = ""


class _Scanner:
    """Ends of tags of one page."""

    def __init__(self, page: str):
        self.page, self.seen, self.stop, self.doomed, self.last = page, 0, -1, set(), page.rfind(">")

    def _next_stop(self, at: int) -> int:
        """The next of > and the quotes; a stretch without any is searched once."""
        if not self.seen <= at <= self.stop:
            m = _STOP.search(self.page, at)
            self.seen, self.stop = at, m.start() if m else len(self.page)
        return self.stop

    def tag_end(self, at: int) -> int:
        """The place after the > that ends a tag whose attributes begin at `at`; -1 if there is none."""
        if at > self.last:
            return -1
        first, opened = at, []
        while True:
            at = self._next_stop(at)
            if at < len(self.page) and self.page[at] == ">":
                return at + 1
            close = -1
            if at < len(self.page) and at not in self.doomed:
                opened.append(at)
                close = self.page.find(self.page[at], at + 1)
            if close < 0:  # no > outside of quotes: remember the quotes that led here
                self.doomed.update(opened)
                return self.page.find(">", first) + 1
            at = close + 1


def _tokens(page: str) -> list[_Token]:
    """Tags (with a name), and declarations, code and raw elements (without), in one pass."""
    out, scan, at = [], _Scanner(page), page.find("<")
    while at >= 0:
        end = at + 1
        if page.startswith(("<!", "<?"), at):
            end = _DECLARED.match(page, at).end()
            out.append(_Token(at, end))
        elif m := _TAG.match(page, at):
            name, ending, stop = m[2].lower(), bool(m[1]), scan.tag_end(m.end())
            if stop > 0:
                attributes = page[m.end():stop - 1]
                closed = attributes.endswith("/") and not _UNQUOTED.search(attributes)
                inner = None
                if not ending and name in _CODE:
                    inner = _CODE[name].search(page, stop)
                    end = inner.end() if inner else len(page)
                    out.append(_Token(at, end))
                elif not ending and not closed and name in _RAW and (inner := _RAW[name].match(page, stop)):
                    end = inner.end()
                    out.append(_Token(at, end))
                else:
                    end = stop
                    out.append(_Token(at, end, name, ending, attributes))
        at = page.find("<", end)
    return out


def _skips(tokens: list[_Token]) -> dict[int, int]:
    """For start tags of _SKIPPED the end tag, if it comes before the holder around them ends (numbers of tokens)."""
    out, stack, count = {}, [], dict.fromkeys(_SKIPPED | _HOLDERS, 0)
    for i, m in enumerate(tokens):
        name = m.name
        if name not in count:
            continue
        if not m.ending:
            if not m.attributes.endswith("/") or _UNQUOTED.search(m.attributes):
                stack.append((name, i))
                count[name] += 1
        elif count[name]:
            other = None
            while other != name:
                other, at = stack.pop()
                count[other] -= 1
            if name in _SKIPPED:
                out[at] = i
    return out


def _main(found: list[tuple[str, int, _Holder]], marks: list[tuple[int, int, bool, bool]]) -> frozenset[int]:
    """Marked holders (numbers of tokens) that are the page's main ones. marks: token, mark around, in force around, of comments."""
    blocks_in, long_in, plain_in, free = ([0] * (len(marks) + 1) for _ in range(4))  # the last: outside of all
    for text, linked, up in found:
        if linked > LINKS * len(text):
            continue
        if not up.junk and not up.marked:
            plain_in[up.mark] += len(text)
        if len(text.split()) >= LONG:
            blocks_in[up.mark] += 1
            long_in[up.mark] += len(text)
            if not up.junk:
                free[up.mark if up.marked else -1] += 1
    for i in range(len(marks) - 1, -1, -1):
        for c in (blocks_in, long_in, plain_in):
            c[marks[i][1]] += c[i]
    out, plain, clear = set(), free[-1], []
    for i, (token, around, inherited, comments) in enumerate(marks):
        main = (2 * blocks_in[i] > blocks_in[-1] and long_in[i] > plain_in[-1] - plain_in[i] and not (comments and plain)
                and (not inherited or clear[around]))
        clear.append(main)
        if main:
            out.add(token)
            plain += free[i]
    return frozenset(out)


def blocks(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, code points in links, in boilerplate, in an article) of each block that has text."""
    tokens = _tokens(page)
    skips = _skips(tokens)
    found, marks = _cut(page, tokens, skips, frozenset())
    main = _main(found, marks) if marks else None
    if main:
        found, _ = _cut(page, tokens, skips, main)
    return [(text, linked, up.junk or up.marked, up.article) for text, linked, up in found]


def _cut(page: str, tokens: list[_Token], skips: dict[int, int], main: frozenset[int]) -> tuple[list, list]:
    """(text, code points in links, holder) of each block that has text, and the marked holders; words on holders of main say nothing."""
    out, text, linked, in_link, marks = [], [], 0, 0, []
    stack = [_Holder("", False, False, False, False, -1)]

    def close():
        nonlocal linked
        joined = _SPACE.sub(" ", "".join(text)).strip()
        if joined:
            out.append((joined, min(linked, len(joined)), stack[-1]))
        text.clear()
        linked = 0

    def add(raw):
        nonlocal linked
        if raw:
            s = html.unescape(raw) if "&" in raw else raw
            text.append(s)
            if in_link:
                linked += len(s.strip())

    at = past = 0
    for i, m in enumerate(tokens):
        if i < past:
            continue
        add(page[at:m.start])
        if i in skips:
            past = skips[i] + 1
            at = tokens[skips[i]].end
            continue
        at, name, ending = m.end, m.name, m.ending
        if not name:
            continue
        if name == "a":
            in_link = 0 if ending else 1
        if name not in _BLOCKS:
            continue
        if name == "br":
            text.append(" ")
            continue
        close()
        if name not in _HOLDERS:
            continue
        if ending:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if stack[k].name in ("article", "main") and name in ("div", "section", "ul", "ol", "li", "td", "tr", "table"):
                    break  # a stray end tag doesn't close an article
            in_link = 0
        else:
            up = stack[-1]
            attributes = m.attributes
            named = " ".join(x for g in _NAMES.findall(attributes) for x in g if x) if attributes.strip() and i not in main else ""
            said = bool(named and _COMMENT_NAME.search(named))
            comments = up.comments or said
            article = name in ("article", "main") and not comments
            own = said or bool(named and name != "body" and not article and _JUNK_NAME.search(named))
            if own:
                marks.append((i, up.mark, up.marked, said))
            mark = len(marks) - 1 if own else up.mark
            if article:
                stack.append(_Holder(name, False, True, False, False, mark))
            else:
                junk = up.junk or name in _JUNK or (name == "header" and not up.article)
                stack.append(_Holder(name, junk, up.article, comments, up.marked or own, mark))
            if attributes.rstrip().endswith("/"):
                stack.pop()
    add(page[at:])
    close()
    return out, marks


def labels(found: list[tuple[str, int, bool, bool]]) -> list[bool]:
    """Which blocks are text."""
    out: list[bool | None] = []
    sizes = [len(text.split()) for text, *_ in found]
    stop_words = [sum(w.strip(".,;:!?\"'()").lower() in STOP_WORDS for w in text.split()) for text, *_ in found]
    open_ = [not junk and linked <= LINKS * len(text) for text, linked, junk, _ in found]
    long_ = [i for i, n in enumerate(sizes) if open_[i] and n >= LONG]
    foreign = sum(stop_words[i] for i in long_) < STOP_LOW * sum(sizes[i] for i in long_)
    for (text, linked, junk, article), n_words, n_stops in zip(found, sizes, stop_words):
        words, stops = range(n_words), n_stops / n_words
        if junk or linked > LINKS * len(text):
            out.append(False)
        elif article:
            out.append(True if len(words) >= LONG or stops >= STOP_HIGH else None)
        elif len(words) < LONG:
            out.append(None)
        else:
            out.append(True if stops >= STOP_HIGH or foreign else None)
    # boilerplate holders aren't neighbours: an advert between two paragraphs says nothing about them
    for article in (True, False):
        mine = [i for i, b in enumerate(found) if b[3] == article and not b[2]]
        decided = [i for i in mine if out[i] is not None]
        k = 0
        marks = {}
        for i in mine:
            if out[i] is not None:
                continue
            while k < len(decided) and decided[k] < i:
                k += 1
            before, after = (decided[k - 1] if k else None), (decided[k] if k < len(decided) else None)
            if before is None and after is None:
                marks[i] = article
            elif before is None or after is None:
                marks[i] = out[after if before is None else before]
            elif i - before == after - i:
                marks[i] = out[before] or out[after]
            else:
                marks[i] = out[before if i - before < after - i else after]
        for i, x in marks.items():
            out[i] = x
    return [bool(x) for x in out] if any(out) else open_


def main_text(page: str) -> tuple[str, int, int]:
    """(text, blocks, blocks kept)."""
    found = blocks(page)
    kept = [b[0] for b, ok in zip(found, labels(found)) if ok]
    return " ".join(kept), len(found), len(kept)


def extract(pages: DataFrame, html_column: str = "html", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """(pages' columns `keep` and a struct: text, n_blocks, n_kept; its name)."""
    out = fresh(pages, "main")
    return over_texts(pages, html_column, out, _TEXT, lambda t: [pa.array(c, f) for c, f in zip(
        zip(*(main_text((x or b"").decode()) for x in t)), (pa.string(), pa.int64(), pa.int64()))], keep), out
