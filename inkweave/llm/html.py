"""Main text of web pages by equivalence classes of tokens across the pages of a host.

1. Every page is read once, in time that grows with its length, into tokens: its tags by the path of elements they stand
   in, and its text blocks by path and text.  The result is written, and all later steps read it.
2. Of each host and token the vector of its counts over the host's distinct pages is summed up as a fingerprint (a sum of
   hashes of page and count), by grouped sums with partial aggregation, so a host of any size needs one row a token.
3. Tokens with equal vectors form a class.  A class is valid if it is on ``LEAST_SHARE`` of the host's pages; its tags
   have to come once a page.  Valid classes nest from the most to the least frequent: the tags of the most frequent one
   part the page into slots, and each tag of a later class stands in one of these, at its mean place, and opens a nested
   slot there.  The nested classes are the host's template; their texts are its constants.
4. The blocks of a page stand in the slots between the template's tags.  For each outer slot, with all that is nested in
   it, its text, and how much of it is links, is summed up over the host's pages; a slot is one of main text if links
   are the smaller part of it and it has at least a tenth of what the fullest slot has.
5. A page loses the template's constants.  Of the other blocks, those inside article (else main) elements are its text; a
   page without such elements keeps the blocks in slots of main text.  Elements that are by name or mark no part of an
   article (nav, aside, form, comments, adverts ...) go everywhere; inside an article a mark counts only if the whole
   class or id says so, and only on elements that hold others.

A host's pages are never gathered: pages join the one row of their host's template, which has at most as many tokens as
its pages have divided by the least share, and adaptive execution can split a large host.

Defined results: a null or empty page has an empty text; a page without a host belongs to the host ''; hosts with fewer
than ``LEAST_PAGES`` distinct pages have no template, since everything is frequent there; rows that repeat a page_id stay
apart, and copies of a page count once in vectors; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.common import settle

#: A template token is on this share of a host's pages at least, and the host has this many pages at least.
LEAST_SHARE, LEAST_PAGES = 0.5, 4
#: A constant inside an article is on this share of the pages at least.
ARTICLE_SHARE = 0.9
#: Of the fullest slot's text, the least share that a slot of main text has; most of its text that may be links.
SLOT_SHARE, LINKED_SHARE = 0.1, 0.6

# Element names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe object svg math canvas audio video select textarea title".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
DROPPED = set("nav footer aside form script style noscript template iframe object svg math canvas audio video select textarea title head button dialog menu fieldset option datalist".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
HOLDS_ITEMS = ("ul", "ol", "dl", "table", "select", "article", "body")
HOLDS_INLINE = ("table", "article", "main", "body", "nav", "footer", "aside", "form")
CONTAINERS = set("div section ul ol dl table".split())
# Words in class, id and role that mark what is not the article.
MARKS = set(
    "ad ads adsense adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs masthead header topbar footer sidebar sidebars aside "
    "complementary contentinfo cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond "
    "search login pagination pager toolbar widget widgets skip hidden".split()
)
#: Words that may stand beside such a word in a class that says what the whole element is.
WITH_MARKS = set("area bar block box buttons container group inner items label links list outer row section slot thread top bottom unit wrap wrapper".split())
CONTENT_MARKS = {"articlebody", "entrycontent", "postcontent", "articlecontent", "postbody", "storybody", "maincontent", "article", "post", "entry", "story", "content"}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
#: Flags of a block.
BAD, ARTICLE, MAIN, CONTAINER, LINKED, LISTED = 1, 2, 4, 8, 16, 32


def _marked(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """(not of the article, of the article) by class, id, role, itemprop and hiding."""
    if not attributes or name in ("html", "body", "main", "article"):
        return False, False
    bad = good = False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "style":
            bad |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif key == "hidden":
            bad |= m.start() == 0 or attributes[m.start() - 1].isspace()
        elif key == "aria-hidden":
            bad |= value.lower() == "true"
        else:
            for one in value.split():
                parts = [w.lower() for w in _WORD.findall(one)]
                if "".join(parts) in CONTENT_MARKS or key == "role" and one.lower() in ("main", "article"):
                    good = True
                elif in_article:
                    bad |= name in CONTAINERS and any(w in MARKS for w in parts) and all(w in MARKS or w in WITH_MARKS for w in parts)
                elif parts and parts[0] not in ("has", "with", "no", "is", "not", "without") and any(w in MARKS for w in parts):
                    bad = True
    return bad and not good, good


class _Stack:
    """Open elements; the last place of each name is kept, so that nothing is searched for element by element."""

    TOP = ("", 0, 0, False)

    def __init__(self) -> None:
        self.open: list[tuple] = []  # (name, path hash, flags, marked inline element)
        self.blocks: list[tuple] = [self.TOP]  # those that are not inline
        self.at: dict[str, list[int]] = defaultdict(list)

    def push(self, e: tuple) -> None:
        self.at[e[0]].append(len(self.open))
        self.open.append(e)
        if e[0] not in INLINE:
            self.blocks.append(e)

    def cut(self, k: int) -> None:
        """Closes the elements from place k on."""
        while len(self.open) > k:
            e = self.open.pop()
            self.at[e[0]].pop()
            if e[0] not in INLINE:
                self.blocks.pop()

    def last(self, names) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def close(self, name: str) -> None:
        k = self.last((name,))
        if k >= 0 and not ((name in INLINE or name in ("p", "li")) and self.last(HOLDS_INLINE) > k):
            self.cut(k)

    def close_items(self, name: str) -> None:
        k = self.last(CLOSED_BY.get(name, ()))
        if k >= 0 and k > self.last(HOLDS_ITEMS):
            self.cut(k)


def read_page(page: str) -> tuple[list[tuple[str, int, int, int]], list[int]]:
    """The text blocks of a page (text, token, flags, number of tags before) and the tokens of its tags, in order."""
    blocks: list[tuple[str, int, int, int]] = []
    tags: list[int] = []
    stack = _Stack()
    buffer: list[str] = []
    linked = [0, 0]  # characters inside links, all

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                _, path, flags, _ = stack.blocks[-1]
                flags |= (linked[0] * 10 >= linked[1] * 6) * LINKED | (stack.last(("ul", "ol", "menu")) >= 0) * LISTED
                blocks.append((text, xxhash.xxh3_64_intdigest(text, path), flags, len(tags)))
            linked[0] = linked[1] = 0

    def note(text: str) -> None:
        if text:
            if stack.open and stack.open[-1][3] and not stack.blocks[-1][2] & BAD:
                return  # in a marked inline element
            buffer.append(text)
            n = len(text.strip())
            linked[1] += n
            if stack.at.get("a"):
                linked[0] += n

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            note(page[at:])
            break
        note(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            if lt + 1 < n and (page[lt + 1].isalpha() or page[lt + 1] == "/"):
                end = page.find(">", lt)  # a broken tag
                at = n if end < 0 else end + 1
            else:
                note("<")
                at = lt + 1
            continue
        at = m.end()
        closing, name, attributes = (m[1], m[2].lower(), m[3]) if m[2] else (m[4], m[5].lower(), m[6])
        inline = name in INLINE
        if not inline:
            flush()
        elif name == "br":
            buffer.append(" ")
        if closing:
            if name == "p" and not stack.at.get("p"):
                continue
            stack.close(name)
            if not inline:
                tags.append(xxhash.xxh3_64_intdigest(f"/{name}", stack.open[-1][1] if stack.open else 0))
            continue
        if name in CLOSES_P and stack.at.get("p"):
            stack.close("p")
        stack.close_items(name)
        above = stack.open[-1] if stack.open else stack.TOP
        path = above[1] if inline else xxhash.xxh3_64_intdigest(name, above[1])
        if not inline:
            tags.append(path)
        if name in VOID:
            continue
        flags = above[2]
        marked, good = _marked(name, attributes, bool(flags & ARTICLE))
        bad = bool(flags & BAD) or name in DROPPED or marked or name == "header" and not flags & (ARTICLE | MAIN)
        if name in ("article", "main") and not any(stack.at.get(d) for d in (*DROPPED, "header")):
            bad = bool(flags & BAD) and bool(flags & ARTICLE) and name == "article"  # a marked wrapper around the article does not hide it
        if name in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{name}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if attributes.rstrip().endswith("/") and not inline and name not in CLOSES_P:
            continue
        flags |= (name == "article") * ARTICLE | (name == "main") * MAIN | good * CONTAINER
        if inline:  # its block's badness holds; its own only hides its text
            stack.push((name, path, flags, above[3] or marked))
        else:
            stack.push((name, path, flags & ~BAD | bad, False))
    flush()
    return blocks, tags


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _lists(of: list[list], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, of)]), pa.int32()), pa.array([x for one in of for x in one], kind))


_BLOCKS = ("text", "token", "flags", "place")
_TOKENS = ("t", "n", "p", "x")


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, _row, host, content (hash of the page), tags, blocks (text, token, flags, place), tokens (t, times, first place, is text)."""
    host = F.lower(F.coalesce(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    page = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", F.monotonically_increasing_id().alias("_row"), host.alias("host"), F.xxhash64(page).alias("content"), page.alias("html"))
    kept = [c for c in rows.columns if c != "html"]

    def run(batches):
        for b in batches:
            all_tags, all_blocks, all_tokens = [], [], []
            for page in b.column("html"):
                blocks, tags = read_page(page.as_py())
                tags = [_signed(t) for t in tags]
                blocks = [(x[0], _signed(x[1]), x[2], x[3]) for x in blocks]
                seen: dict[tuple[int, bool], list[int]] = {}
                for t, p, x in (*((t, p, False) for p, t in enumerate(tags)), *((t[1], t[3], True) for t in blocks)):
                    seen.setdefault((t, x), [0, p])[0] += 1
                all_tags.append(tags)
                all_blocks.append(blocks)
                all_tokens.append([(t, n, p, x) for (t, x), (n, p) in seen.items()])
            flat = lambda of, k, kind: _lists([[e[k] for e in one] for one in of], kind)
            parts = lambda of, names, kinds: [flat(of, k, kind) for k, kind in zip(range(len(names)), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in kept), _lists(all_tags, pa.int64()), *parts(all_blocks, _BLOCKS, (pa.string(), pa.int64(), pa.int32(), pa.int32())), *parts(all_tokens, _TOKENS, (pa.int64(), pa.int32(), pa.int32(), pa.bool_()))],
                [*kept, "tags", *_BLOCKS, *_TOKENS],
            )

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, _row long, host string, content long, tags array<long>, text array<string>, token array<long>, flags array<int>, place array<int>, t array<long>, n array<int>, p array<int>, x array<boolean>"
    return rows.mapInArrow(run, schema)


def classes(read: DataFrame, least_share: float = LEAST_SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, n_pages and the frequent classes: array of (pages, class, tokens: array of (mean place, token, is text, most))."""
    one = settle(read.groupBy("host", "content").agg(F.min("_row").alias("_row")))
    totals = settle(one.groupBy("host").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= least_pages))
    token = F.explode(F.arrays_zip("t", "n", "p", "x")).alias("e")
    each = read.join(one.select("_row"), "_row", "left_semi").select("host", "_row", token).select("host", "e.*", F.xxhash64("_row", "e.n").alias("v"))
    # The vectors' sum is taken in two halves that cannot overflow.
    low, high = F.col("v").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("v", 32)
    counted = each.groupBy("host", "t", "x").agg(F.count("*").alias("pages"), F.max("n").alias("most"), F.sum(low).alias("low"), F.sum(high).alias("high"), F.sum("p").alias("p"))
    frequent = counted.join(totals, "host").filter(F.col("pages") >= least_share * F.col("n_pages"))
    grouped = frequent.groupBy("host", "n_pages", "pages", "low", "high").agg(F.sort_array(F.collect_list(F.struct((F.col("p") / F.col("pages")).alias("place"), F.col("t").alias("token"), F.col("x").alias("is_text"), "most"))).alias("tokens"))
    return grouped.groupBy("host", "n_pages").agg(F.sort_array(F.collect_list(F.struct("pages", F.xxhash64("low", "high").alias("class"), "tokens")), asc=False).alias("classes"))


def nested(found: list[dict]) -> list[tuple[int, bool, int, int]]:
    """(token, is text, pages, outer slot) of the template of one host.  A slot is named by the tag that it follows."""
    template: list[tuple[int, bool, int, int]] = []
    lines: list[tuple[float, int]] = []  # (mean place, outer slot) of the tags so far, by place
    for c in found:  # from the most frequent on
        places = [p for p, _ in lines]
        outermost = not lines
        fresh = []
        for t in c["tokens"]:
            if not t["is_text"] and t["most"] > 1:
                continue
            k = bisect_left(places, t["place"])
            slot = t["token"] if outermost and not t["is_text"] else lines[k - 1][1] if k else 0
            template.append((t["token"], t["is_text"], c["pages"], slot))
            if not t["is_text"]:
                fresh.append((t["place"], slot))
        lines = sorted([*lines, *fresh])
    return template


def templates(read: DataFrame) -> DataFrame:
    """host, n_pages, token, is_text, pages, slot: arrays over the tokens of the host's template."""

    def run(batches):
        for b in batches:
            out = [nested(c) for c in b.column("classes").to_pylist()]
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("n_pages"), *(_lists([[e[k] for e in one] for one in out], kind) for k, kind in enumerate(kinds))], ["host", "n_pages", "token", "is_text", "pages", "slot"])

    return classes(read).mapInArrow(run, "host string, n_pages long, token array<long>, is_text array<boolean>, pages array<long>, slot array<long>")


def slots_of(tags: list[int], places: list[int], fixed: dict[int, int]) -> list[int]:
    """For each block, by its place among the page's tags, the outer slot of the last tag of the template before it; else 0."""
    out, at, last = [], 0, 0
    for p in places:
        while at < p:
            last = fixed.get(tags[at], last)
            at += 1
        out.append(last)
    return out


def main_text(blocks: list[tuple], constants: dict[int, int], n_pages: int, slot: list[int], main_slots: set[int] | None) -> str:
    """The text of the blocks (text, token, flags, place), each in its slot, that belong to the article.  main_slots: None where the host has no template."""
    good = [(b, s) for b, s in zip(blocks, slot, strict=True) if not b[2] & BAD]
    inside = [b for b, _ in good if b[2] & ARTICLE] or [b for b, _ in good if b[2] & MAIN]
    if inside:
        own = [b for b in inside if constants.get(b[1], 0) < ARTICLE_SHARE * max(1, n_pages)]
        # An article that is mostly constant is one that the host repeats, not a frame around it.
        return "\n".join(b[0] for b in (own if 2 * sum(len(b[0]) for b in own) > sum(len(b[0]) for b in inside) else inside))
    free = [(b, s) for b, s in good if b[1] not in constants]
    boxed = [b for b, _ in free if b[2] & CONTAINER]
    rest = boxed or [b for b, s in free if (main_slots is None or s in main_slots) and not (b[2] & LINKED and b[2] & LISTED)]
    return "\n".join(b[0] for b in rest)


_TEMPLATE = ("fixed", "fixed_text", "fixed_pages", "fixed_slot")


def _template(b: pa.RecordBatch, k: int) -> tuple[dict[int, int], dict[int, int]]:
    """The tags of the template at row k with their outer slots, and its constants with their pages."""
    rows = list(zip(*((b.column(c)[k].as_py() or []) for c in _TEMPLATE), strict=True))
    return {t: s for t, x, _, s in rows if not x}, {t: n for t, x, n, _ in rows if x}


def slot_totals(placed: DataFrame) -> DataFrame:
    """host, main_slots: the slots of main text of each host with a template, by sums over its pages."""

    def run(batches):
        for b in batches:
            sums: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0])
            last, fixed, constants = None, {}, {}
            for k in range(len(b)):
                host = b.column("host")[k].as_py()
                if host != last:
                    last, (fixed, constants) = host, _template(b, k)
                texts, tokens, flags, place = (b.column(c)[k].as_py() for c in _BLOCKS)
                for s, x, t, f in zip(slots_of(b.column("tags")[k].as_py(), place, fixed), texts, tokens, flags, strict=True):
                    if not f & BAD and t not in constants:
                        own = sums[host, s]
                        own[0] += len(x)
                        own[1] += len(x) if f & LINKED else 0
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in sums], pa.string()), *(pa.array(c, pa.int64()) for c in ([s for _, s in sums], [v[0] for v in sums.values()], [v[1] for v in sums.values()]))], ["host", "slot", "chars", "linked"])

    part = placed.filter("n_pages is not null").select("host", "tags", *_BLOCKS, *_TEMPLATE).mapInArrow(run, "host string, slot long, chars long, linked long")
    slots = settle(part.groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked")))
    most = slots.groupBy("host").agg(F.max(F.col("chars") - F.col("linked")).alias("most"))
    enough = (F.col("linked") <= LINKED_SHARE * F.col("chars")) & (F.col("chars") - F.col("linked") >= SLOT_SHARE * F.col("most"))
    return slots.join(most, "host").groupBy("host").agg(F.collect_list(F.when(enough, F.col("slot"))).alias("main_slots"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages."""
    read = settle(parsed(pages))
    known = settle(templates(read).toDF("host", "n_pages", *_TEMPLATE))
    placed = read.select("page_id", "url", "host", "tags", *_BLOCKS).join(known, "host", "left")
    joined = placed.join(settle(slot_totals(placed)), "host", "left")

    def run(batches):
        for b in batches:
            texts, last = [], None
            fixed, constants, main_slots, n_pages = {}, {}, None, 0
            for k in range(len(b)):
                host = b.column("host")[k].as_py()
                if host != last:
                    last, (fixed, constants), n_pages = host, _template(b, k), b.column("n_pages")[k].as_py() or 0
                    main_slots = set(b.column("main_slots")[k].as_py() or []) if n_pages else None
                blocks = list(zip(*(b.column(c)[k].as_py() for c in _BLOCKS), strict=True))
                texts.append(main_text(blocks, constants, n_pages, slots_of(b.column("tags")[k].as_py(), [x[3] for x in blocks], fixed), main_slots))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
