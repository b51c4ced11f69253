"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Its article is what stands in `article` or `main` elements, if these hold most of the
page's text; short articles that hold a link are teasers. Pass one decides blocks: those within menus, headers, footers, sidebars,
notices, adverts, forms or comments (by tag, or by a name in class, id or role), those outside the article and those of mostly links are
boilerplate; a form, or a container whose longer name has such a word in it, only if it doesn't hold most of the page's text (of comments: if it has no article or
main headline); long blocks with many stop words are text. Pass two gives each ambiguous block the label of its nearest decided neighbours in
its own container. Where the two sides differ, a block of the article is text, and another one takes the nearer side's label (at
equal distance: text); without a decided neighbour a block is text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LINKS, STOPS, LONG = 0.5, 0.2, 60
#: Least share of a page's text outside boilerplate that its articles hold, and of the longest article's text that a teaser stays below.
ARTICLE, TEASER = 0.4, 0.2
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """the of and to in a is that for it was with as on be at by this are or from an not but had his they
    der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es an
    le la les de du et un une est que qui dans pour pas sur au ce il elle avec en
    el los las del que y se una con por para su al lo como""".split()
)
#: Elements whose content is no text, or is never the article.
_RAW = frozenset("script style noscript template textarea title iframe svg math object canvas".split())
_APART = frozenset("nav footer aside form header dialog menu button select head".split())
_ARTICLE = frozenset(("article", "main"))
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY = {"p": frozenset("p div ul ol li table h1 h2 h3 h4 h5 h6 section article aside header footer nav form blockquote pre main hr dl figure fieldset address".split()), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}
#: Names in class, id or role of what isn't the article.
_MARKS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb
    breadcrumbs sidebar side rail widget footer header masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter
    subscribe subscription signup login share sharing social related recommended comment comments replies disqus reply
    complementary contentinfo""".split()
)
#: Words that a compound name of a container may have beside such a name, as in site-header or comments-area.
_BESIDE = frozenset("site page top bottom left right main global primary secondary box bar area list block section container wrapper panel unit slot links link items item buttons button group form policy posts area inner outer".split())
#: Words that tell in any compound name of a container what it holds, those of reader comments first; and words beside them that say it holds something else.
_COMMENTS = frozenset("comment comments commentlist disqus replies responses discussion discussions".split())
_STRONG = _COMMENTS | frozenset("sidebar footer ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo related recommended share sharing social newsletter cookie cookies breadcrumb breadcrumbs".split())
_OTHERWISE = frozenset("has with without no show hide open closed enabled disabled".split())
#: Most of a page's text that a suspected container or form holds.
SUSPECT = 0.5
_HEADS = frozenset(("header", "masthead", "banner"))
_CONTAINERS = frozenset("div section ul ol dl table figure span".split())
_START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_STOP = re.compile(r">|=\s*([\"'])")
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}


def _apart(name: str, attributes: str, article: int = 0) -> bool:
    """Whether an element isn't of the article: by its tag, a whole name, or a container's compound name of such names only. A paragraph is never judged by its name."""
    if name in _APART:
        return name != "form" and not (article and name == "header")  # an article's own header holds its headline
    if name in ("html", "body", "p", "form") or name in _ARTICLE or not attributes:
        return False
    marks = _MARKS - _HEADS if article else _MARKS
    for part in _names(attributes):
        said = {w.lower() for w in _WORD.findall(part)}
        if part.lower() in marks or (name in _CONTAINERS and said & marks and said <= _MARKS | _BESIDE):
            return True
    return False


def _names(attributes: str) -> list[str]:
    return [part for value in _NAMED.findall(attributes) for part in value.strip("\"'").split()]


def _suspected(name: str, attributes: str) -> str:
    """What an element is suspected of by a word in its name: "comments", "other" or nothing."""
    if name == "form":
        return "other"
    if name not in _CONTAINERS and name != "li":
        return ""
    said = [{w.lower() for w in _WORD.findall(part)} for part in _names(attributes)]
    said = [x for x in said if x & _STRONG and not x & _OTHERWISE]
    return "comments" if any(x & _COMMENTS for x in said) else "other" if said else ""


def tags(page: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(begin, end, name, attributes, whether an end tag) of the tags of a page; raw elements whole, with a name of "", comments and declarations with "!".

    A > in a quoted value doesn't end a tag. Once a tag never ends by that rule, it and all later ones end at the next >, so that a page
    of any faults is read once.
    """
    at, quotes = 0, True
    while m := _START.search(page, at):
        begin = m.start()
        if m[1]:
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 3
            yield begin, end, "!", "", False
        elif m[2]:
            end = page.find(">", m.end()) + 1 or len(page)
            yield begin, end, "!", "", False
        else:
            name, end = m[4].lower(), -1
            i = m.end()
            while quotes and (s := _STOP.search(page, i)):
                if not s[1]:
                    end = s.start()
                    break
                i = page.find(s[1], s.end()) + 1
                if not i:
                    break
            if end < 0:
                quotes, end = False, page.find(">", m.end())
                if end < 0:
                    return  # no tag ends any more
            attributes, end = page[m.end() : end], end + 1
            if name in _RAW and not m[3] and not attributes.endswith("/"):
                close = _ENDS[name].search(page, end)
                end = len(page) if not close else page.find(">", close.end()) + 1 or len(page)
                yield begin, end, "", "", False
            else:
                yield begin, end, name, attributes, bool(m[3])
        at = end


def blocks(page: str) -> tuple[list[tuple[str, int, bool, int]], set[int]]:
    """(text, characters in links, boilerplate by place, number of its article or 0) of each block with text; the numbers that are `main`."""
    found, parts, linked = [], [], 0
    stack: list[tuple[str, bool, int, tuple[int, ...]]] = []  # name, apart, article, suspected containers around
    suspects: list[list] = []  # what each is suspected of, whether it has an article or main headline
    articles, at, in_link, mains = 0, 0, 0, set()

    def close() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            found.append((text, min(linked, len(text)), *(stack[-1][1:] if stack else (False, 0, ()))))
        parts.clear()
        linked = 0

    for begin, end, name, attributes, ending in tags(page):
        if begin > at:
            parts.append(page[at:begin])
            if in_link:
                linked += len(" ".join(unescape(parts[-1]).split()))
        at = end
        if name in ("", "!"):  # comments, raw elements and declarations part words, not blocks
            parts.append("" if name else " ")
            continue
        if name == "a":
            in_link = 0 if ending else 1
        if name in _INLINE:
            if name in ("br", "img", "input"):
                parts.append(" ")
            if not _apart(name, "" if ending else attributes) and not (ending and any(s[0] == name for s in stack)):
                continue
        close()
        if ending:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in _ARTICLE and name not in _ARTICLE and name not in ("body", "html"):
                    break  # a stray end tag doesn't end an article
        else:
            while stack and name in _CLOSED_BY.get(stack[-1][0], ()):
                stack.pop()
            apart, article, around = stack[-1][1:] if stack else (False, 0, ())
            if name == "h1" or name in _ARTICLE:
                for k in around:
                    suspects[k][1] = True
            if name in _ARTICLE and not apart and (not article or article in mains):
                articles += 1
                article = articles
                mains |= {article} if name == "main" else set()
            if name not in _VOID and not attributes.rstrip().endswith("/"):
                apart = apart or _apart(name, attributes, article)
                if not apart and (kind := _suspected(name, attributes)):
                    around = (*around, len(suspects))
                    suspects.append([kind, False])
                stack.append((name, apart, article, around))
    parts.append(page[at:])
    close()
    guilty = _guilty(found, suspects)
    return [(text, linked, apart or any(k in guilty for k in around), article) for text, linked, apart, article, around in found], mains


def _guilty(found: list[tuple[str, int, bool, int, tuple[int, ...]]], suspects: list[list]) -> set[int]:
    """The suspected containers that are boilerplate."""
    holds, total = [0] * len(suspects), 0
    for text, linked, apart, _, around in found:
        if not apart:
            total += len(text) - linked
            for k in around:
                holds[k] += len(text) - linked
    return {k for k, (kind, heads) in enumerate(suspects) if (not heads if kind == "comments" else holds[k] <= SUSPECT * total)}


def _stop_density(text: str) -> float:
    w = text.lower().split()
    return sum(x.strip(".,;:!?") in STOP_WORDS for x in w) / len(w)


def _scope(found: list[tuple[str, int, bool, int]], mains: set[int]) -> tuple[bool, set[int]]:
    """Whether the page's articles hold its main text, and the numbers of those that are teasers."""
    size: dict[int, int] = {}
    links: set[int] = set()
    for text, linked, apart, article in found:
        if not apart:
            size[article] = size.get(article, 0) + len(text) - linked
            if linked:
                links.add(article)
    own = {k: n for k, n in size.items() if k}
    most = max(own.values(), default=0)
    marked = bool(own) and sum(own.values()) >= ARTICLE * sum(size.values())
    least = TEASER * most if marked else float("inf")
    return marked, {k for k in links if k and k not in mains and size[k] < least}


def main_text(page: str | None) -> str:
    """Blocks of the main text in page order, one to a line; empty for null, empty and textless pages."""
    found, mains = blocks(page or "")
    marked, teasers = _scope(found, mains)
    inside = [not apart and article not in teasers and (not marked or article > 0) for _, _, apart, article in found]
    labels: list[bool | None] = []
    decided: dict[int, list[int]] = {}
    for i, (text, linked, _, article) in enumerate(found):
        if not inside[i] or linked > LINKS * len(text):
            labels.append(False)
        else:
            labels.append(True if len(text) >= LONG and _stop_density(text) >= STOPS else None)
        if inside[i] and labels[i] is not None:
            decided.setdefault(article, []).append(i)
    out = []
    for i, label in enumerate(labels):
        if label is None:
            near = decided.get(found[i][3], [])
            k = bisect_left(near, i)
            sides = [j for j in (*near[max(0, k - 1) : k], *near[k : k + 1])]
            if not sides or any(labels[j] for j in sides) and (marked or len(sides) < 2):
                label = True
            else:
                label = max((abs(i - j) == min(abs(i - x) for x in sides)) and labels[j] for j in sides)
        if label:
            out.append(found[i][0])
    return "\n".join(out)


def extract(page: Column) -> Column:
    """Main text of each page, a row for a row: null, empty and textless pages give the empty text, an empty table no rows, repeated rows
    the same text; pages of any length are read whole, and once. Only the given column is read, so other columns can't clash."""

    @F.pandas_udf(StringType())
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in pages], dtype=object)

    return run(page)
