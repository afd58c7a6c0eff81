"""Main text of web pages by minimum-cut labelling.

A page becomes a list of blocks (runs of text between block-level tags). A linear
classifier over a block's words, links and place gives the cost of calling it
boilerplate or content; these costs, of at most some 150 either way, are the
capacities from the source and to the sink. Neighbours in page order and blocks of
one parent are joined by smoothness edges, and each block inside an ``article`` or
``main`` region is tied to a node of that region, which has a cost of its own. The
minimum cut, found by Dinic's maximum flow, labels all blocks together: a single
word or a linked line inside an article stays with it, a chatty line inside a menu
goes with the menu.

Words in class, id and role are evidence, not verdicts. Words of a place or of what may
stand beside an article (sidebar, form, related, ad) count only for elements that hold
less than half of the page's plain words, since a wrapper is often named after its
neighbours, and never for ``article`` and ``main`` themselves. Tags and words that name
something else for sure (nav, aside, comments, cookies) count whatever their size, as
comments are often longer than the article; but if the cut then keeps nothing at all,
those that hold half of the page's plain words or more do not count. The classifier's
weights are stated below, not fitted.

Defined results: null and empty pages give an empty text; text that no tag
surrounds is a block; unclosed tags and quotes end where the page ends; scripts that
open with a slash at the end are not thereby closed; text that is not displayed
(hidden attribute or style) is no block, nor is what stands in for scripts and media
(noscript, object, audio, video, canvas) and the source text of formulas; formulas
themselves are text; scripts without spaces count two characters
as a word; null ids and urls are kept; repeated rows each get a row; an empty table
gives an empty result; other columns, whatever their names, are not read. A very long
page is read whole, in memory linear in its length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.process_cache import frugal
from corpusmill.plans.staging import small_batches, table

_OPEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)|<[!?][^>]*(?:>|\Z)", re.S)
_BARE = re.compile(r"[^>\"']*")
# a value is consumed with its name, so words inside quotes are never taken for names
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Kinds of HTML elements.
BLOCKS = frozenset("address article aside blockquote body br-none button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg annotation annotation-xml object canvas audio video title".split())
NEVER = frozenset("nav footer aside menu dialog button select head search".split())
WEAK = frozenset("header form fieldset".split())
GOOD = frozenset("article main".split())
CLOSES_P = BLOCKS - {"button", "option", "optgroup"}
# Words in class, id and role that name what an element holds, whole or as a prefix.
BAD_WORDS = frozenset("adslot comment comments disqus respond replies reply cookie cookies consent gdpr newsletter outbrain taboola".split())
BAD_STARTS = ("advert", "comment", "cookie", "newsletter")
# Words that name a place on the page, or what may stand beside an article.
PLACE_WORDS = frozenset("ad ads adv contentinfo complementary notice notices alert promo promotion sponsor sponsored share sharing social related recommended subscribe subscription copyright disclaimer banner sidebar aside nav navbar navigation menu menubar footer popup modal overlay signup login breadcrumb breadcrumbs pagination pager widget toolbar masthead search form skip".split())
PLACE_STARTS = ("sidebar", "breadcrumb", "navig", "footer", "sponsor")
# Fixed values: "content-with-sidebar" names no sidebar, "comments-open" no comments
NOT_ITSELF = frozenset("with has no non without hide show".split())
STATES = frozenset("open opened closed enabled disabled on off allowed free".split())
GOOD_WORDS = frozenset("article content post entry story main prose articlebody maincontent".split())

# Weights of the linear classifier, in units of capacity.
BASE, WORD, MOST_WORDS, STOP, HEADING, INSIDE, LINKS, LINKS_INSIDE, REGION, SOFT = 40, 3, 60, 25, 30, 35, 80, 10, 100, 90
# Smoothness: to the block before, to the last block of one parent, to another region, to the region's node; and the node's own cost.
NEXT_TO, SAME_PARENT, ACROSS, TO_REGION, REGION_COST = 20, 12, 4, 45, 200
_NO_SPACES = re.compile("[\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")


def _n_words(s: str) -> int:
    """Words; of scripts without spaces, pairs of characters."""
    n = len(s.split())
    return n if s.isascii() else max(n, len(_NO_SPACES.findall(s)) // 2)


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where the ">" of the tag stands whose attributes begin at ``at``, or the page's end.

    A ">" inside a quoted value of any length ends no tag. If that leaves none, because a
    quote is unclosed, the first ">" counts. ``dead`` collects the opening quotes of such
    vain scans: a later scan that meets one stops there, so a page costs linear time.
    """
    pos, seen = at, []
    while (pos := _BARE.match(page, pos).end()) < len(page):
        if page[pos] == ">":
            return pos
        if pos in dead:
            break
        seen.append(pos)
        pos = page.find(page[pos], pos + 1) + 1
        if not pos:
            break
    dead.update(seen)
    first = page.find(">", at)
    return len(page) if first < 0 else first


def _region(tag: str, attrs: str) -> tuple[int, int, int, int, int]:
    """(bad, place, soft, good, hidden) marks of one element."""
    bad, place, soft, good, hidden = int(tag in NEVER), 0, int(tag in WEAK), int(tag in GOOD), 0
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "style":
                bare = "".join(value.split())
                hidden |= "display:none" in bare or "visibility:hidden" in bare
            elif key == "hidden":
                hidden = 1
            elif key == "aria-hidden":
                hidden |= value == "true"
            elif key in ("class", "id", "role") and tag not in ("html", "body"):
                for name in value.split():
                    parts, before = re.findall(r"[a-z]+", name), ""
                    if tag in GOOD and len(parts) > 1:
                        continue  # a compound names a state or the page, not what the article is
                    for w, after in zip(parts, parts[1:] + [""]):
                        if before not in NOT_ITSELF:
                            bad |= (w in BAD_WORDS or w.startswith(BAD_STARTS)) and after not in STATES
                            place |= tag not in GOOD and (w in PLACE_WORDS or w.startswith(PLACE_STARTS))
                        soft |= w == "header"
                        good |= w in GOOD_WORDS
                        before = w
    return int(bad), int(place), int(soft), 0 if bad else int(good), int(hidden)


def blocks(page: str) -> list[dict]:
    """Blocks in page order: text, words, linked words, parent and region number, marks, tag."""
    out: list[dict] = []
    # open block-level elements: tag, innermost bad mark, inside good, number, hidden, region, innermost place and soft mark
    stack: list[tuple] = [("", -1, 0, 0, 0, -1, -1, -1)]
    marks: list[list[int]] = []  # first block, block after the last, the mark of its kind around
    closes: list[list[int]] = [[]]  # the marks that end with each open element
    text: list[str] = []
    linked, in_link, made, at, n = 0, 0, 1, 0, len(page)
    unclosed: set[str] = set()
    dead: set[int] = set()
    link_depth = 0  # open elements when the last link began: it ends with the innermost of them
    inline: set[str] = set()  # inline elements that a region mark has opened as blocks

    def end() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined and not stack[-1][4]:
                tag, bad, good, _, _, region, place, soft = stack[-1]
                words = _n_words(joined)
                out.append({"text": joined, "words": words, "linked": min(linked, words), "parent": stack[-2][3] if len(stack) > 1 else 0, "hard": bad, "place": place, "soft": soft, "good": good, "region": region, "tag": tag})
            text.clear()
        linked = 0

    def close(k: int) -> None:
        """Close all open elements from the k-th on."""
        for ms in closes[k:]:
            for m in ms:
                marks[m][1] = len(out)
        del stack[k:], closes[k:]

    def mark(around: int) -> int:
        marks.append([len(out), -1, around])
        closes[-1].append(len(marks) - 1)
        return len(marks) - 1

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            if "&" in raw:
                raw = entities.unescape(raw)
            text.append(raw)
            if in_link:
                linked += _n_words(raw)

    while at < n:
        m = _OPEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        until = _tag_end(page, at, dead)
        tag, closing, attrs = m[2].lower(), bool(m[1]), page[at:until]
        at = until + 1
        if tag in RAW and not closing:
            # a slash closes foreign elements only
            if not (attrs.endswith("/") and tag in ("svg", "math")) and tag not in unclosed:
                ends = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                if ends:
                    at = ends.end()
                elif tag in ("script", "style"):
                    break
                else:
                    unclosed.add(tag)  # no end in the rest of the page either: its text counts
            text.append(" ")
        elif tag == "a":
            in_link, link_depth = int(not closing), len(stack)
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCKS or (not closing and tag not in VOID and (tag in inline or attrs and any((r := _region(tag, attrs))[i] for i in (0, 1, 4)))):
            end()
            if tag in VOID:
                continue
            if tag not in BLOCKS:
                inline.add(tag)  # from now on its nesting counts
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                in_link = in_link and int(len(stack) >= link_depth)
            else:
                if tag in CLOSES_P and stack[-1][0] == "p":
                    close(len(stack) - 1)
                if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == tag:
                    close(len(stack) - 1)
                in_link = in_link and int(len(stack) >= link_depth)
                _, bad, good, _, hidden, region, place, soft = stack[-1]
                b, p, s, g, h = _region(tag, attrs)
                b = b or int(good and tag in ("form", "fieldset"))
                closes.append([])
                if g:
                    good, region, soft = 1, made, -1
                elif b:
                    good, region = 0, -1
                if b:
                    bad = mark(bad)
                if p:
                    place = mark(place)
                if s and not g:
                    soft = mark(soft)
                stack.append((tag, bad, good, made, hidden or h, region, place, soft))
                made += 1
        elif closing and tag in inline and any(e[0] == tag for e in stack[1:]):
            end()
            close(max(k for k in range(1, len(stack)) if stack[k][0] == tag))
    end()
    close(1)
    _weigh_marks(out, marks)
    return out


def _weigh_marks(bs: list[dict], marks: list[list[int]]) -> None:
    """Turn mark numbers into 0 or 1: a mark around half of the page's plain words or more is none.
    A hard mark stays; ``narrow`` says whether it would not."""
    upto = [0]
    for b in bs:
        upto.append(upto[-1] + b["words"] - b["linked"])
    counts: list[int] = []
    for first, after, around in marks:  # outer marks come first
        small = 2 * (upto[after] - upto[first]) < upto[-1]
        counts.append(int(small or around >= 0 and counts[around]))
    for b in bs:
        b["narrow"], b["hard"] = int(b["hard"] >= 0 and counts[b["hard"]]), int(b["hard"] >= 0)
        for k in ("place", "soft"):
            b[k] = counts[b[k]] if b[k] >= 0 else 0


def costs(b: dict) -> int:
    """Positive: cost of calling the block boilerplate; negative: of calling it content."""
    marked = b["hard"] or b["place"]
    inside = b["good"] and not marked
    score = -BASE + min(WORD * b["words"], MOST_WORDS) + INSIDE * inside
    score -= REGION if marked else SOFT if b["soft"] else 0
    score -= (LINKS_INSIDE if inside else LINKS) * b["linked"] // max(b["words"], 1)
    if b["text"][-1] in ".!?…。！？\"”’" and b["words"] > 3:
        score += STOP
    if b["tag"] in ("h1", "h2", "h3", "h4", "h5", "h6") and not b["linked"]:
        score += HEADING
    return score


def problem(bs: list[dict]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """(costs, smoothness edges) of the blocks and then of their regions."""
    cost, links, last, regions = [costs(b) for b in bs], [], {}, {}
    places = [(b["hard"], b["place"], b["soft"], b["region"]) for b in bs]
    for i, b in enumerate(bs):
        if i:
            links.append((i - 1, i, NEXT_TO if places[i] == places[i - 1] else ACROSS))
        j = last.get(b["parent"])
        if j is not None and places[i] == places[j]:
            links.append((j, i, SAME_PARENT))
        last[b["parent"]] = i
        if b["region"] >= 0 and not (b["hard"] or b["place"]):
            r = regions.get(b["region"])
            if r is None:
                r = regions[b["region"]] = len(cost)
                cost.append(REGION_COST)
            links.append((i, r, TO_REGION))
    return cost, links


def min_cut(cost: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """True where a block stays on the content side of the minimum cut (Dinic)."""
    n = len(cost)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[int] = []

    def link(u: int, v: int, c: int, back: int) -> None:
        head[u].append(len(to))
        to.append(v)
        cap.append(c)
        head[v].append(len(to))
        to.append(u)
        cap.append(back)

    for v, c in enumerate(cost):
        if c > 0:
            link(s, v, c, 0)
        elif c < 0:
            link(v, t, -c, 0)
    for u, v, c in links:
        link(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, [s]
        for u in queue:
            for e in head[u]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[v] >= 0 for v in range(n)]
        arc, path, u = [0] * (n + 2), [], s
        while True:
            if u == t:
                least = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= least
                    cap[e ^ 1] += least
                first = next(k for k, e in enumerate(path) if not cap[e])
                u = to[path[first] ^ 1]
                del path[first:]
                continue
            while arc[u] < len(head[u]):
                e = head[u][arc[u]]
                if cap[e] and level[to[e]] == level[u] + 1:
                    break
                arc[u] += 1
            else:
                if u == s:
                    break
                e = path.pop()
                u = to[e ^ 1]
                arc[u] += 1
                continue
            path.append(e)
            u = to[e]


def labels(bs: list[dict]) -> list[bool]:
    """True for the blocks that are content."""
    cost, links = problem(bs)
    # with one sign nothing can be cut: the labels are those of the costs
    keep = [c > 0 for c in cost] if min(cost) > 0 or max(cost) <= 0 else min_cut(cost, links)
    return keep[: len(bs)]


def main_text(page: str | None) -> str:
    bs = blocks(page or "")
    if not bs:
        return ""
    keep = labels(bs)
    if not any(keep) and any(b["hard"] > b["narrow"] for b in bs):
        # what holds the page is no comment or menu, whatever it is called
        bs = [b | {"hard": b["narrow"]} for b in bs]
        keep = labels(bs)
    return "\n".join(b["text"] for b, k in zip(bs, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(frugal(run), "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
