"""Main text of web pages by template deduction from equivalence classes.

*Tokens.*  An element's token is its path of tags and classes; a text run's token
is its words under the token of its element.  A page has occurrence counts of
tokens; a token's occurrence vector is its counts over all pages of a host.

*Classes.*  Tokens of a host with equal vectors are a class.  Vectors are
compared by an order-free sum of hashes of (page, count), so each page adds its
part on its own and a host with a third of all pages is aggregated, not
gathered.  A class is valid if it covers at least half of the host's pages, has
two tokens or more, and its elements nest: each one's ancestors are in valid
classes too.

*Template and slots.*  The valid classes, nested by path, are the template: its
elements, and the words of the text runs in a class with such an element.  (A
text run also needs ``DIFFERING`` pages that differ in their longest run, by a hash
of it, so that copies of one article do not make it a template.)  What the template leaves are
its slots.  The main slot is the innermost template element that occurs once in
each of its pages, can hold blocks, and has most of the text left in the host's
slots, links aside.  An ``article`` or ``main`` breaks ties: the slot is not
sought below it, and it is taken where no other element stands out.  Hosts of
fewer than ``MIN_PAGES`` pages use the template of all pages taken together.

All elements have tokens and classes, menus, adverts and footers too, so what the
main slot leaves out is decided by the template, whatever it is called.  Template
elements inside the slot whose text is mostly links on the host's pages are
furniture as well.

*Extraction.*  A page's text is what its main slot holds, without the template's
words and furniture.  Inside the slot, where a page has parts of its own, names
break ties: elements that are furniture by tag or role, or by a class or id that
says so (``_NAMES``), go; names that an article may use as well (``_ODD_NAMES``)
count only where most of the element's text is links.  A page without the main
slot goes by its own ``article`` or ``main``, or else by its blocks that are not
mostly links, both without furniture by tag and name.

Templates are broadcast under ``broadcast_bytes``, else joined by host.  Parsing
takes time in proportion to the page, however it is malformed or nested.

Defined cases: null or empty html gives the empty text; malformed markup is read
as far as it goes; a null URL, or one without a host, shares one nameless host;
repeated pages count each; ties of slots go to the deeper one, then the larger,
then the smaller token; very long pages are read whole, one at a time; an empty
table has no templates and no rows.  Columns of the pages are kept, whatever
their names; ``into`` replaces one of that name.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import BROADCAST_BYTES, short_batches, spare_name, written
from trailspark.llm.urlfilter import host_of

MIN_SUPPORT = 0.5
MIN_SHARE = 0.7
#: Pages that a host needs for a template of its own, and different longest runs that the pages of a template's text run need.
MIN_PAGES = 8
DIFFERING = 5
ALL = "*"

_RAW = "script|style|noscript|template|svg|iframe|textarea|select|canvas|title"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop)\s*+(?:=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that can be a main slot.
_HOLDS_BLOCKS = frozenset("article aside blockquote body center dd div dl figure html main ol section table tbody td tr ul".split())
_FURNITURE = frozenset("aside button dialog fieldset footer form head menu nav".split())
_SUFFIX = r"(?:[-_](?:box|bar|list|wrapper|container|section|area|block|links?|form|slot|unit|banner|notice|menu|top|bottom|left|right|thread|item|body|text))*"
_NAMES = re.compile(
    r"(?:ads?|adverts?|advertis\w*|sponsor\w*|nav|navbar|navigation|menu|sidebar|breadcrumbs?|footer|masthead|cookies?|consent|notices?"
    rf"|notifications?|popup|modal|newsletter|comments?|respond|responses|reader[-_]\w+|disqus\w*|pagination|pager|toolbar){_SUFFIX}"
    r"|(?:site|page|main|top|left|right|side|bottom|user|reader|primary|secondary|global)[-_](?:ads?|header|footer|nav|navigation|menu|sidebar|banner|comments?|bar)",
    re.I,
)
_ODD_NAMES = re.compile(rf"(?:promo\w*|banner|alerts?|overlay|subscribe|subscription|signup|login|search|discussion|social|share|sharing|related|recommended|widget|skip){_SUFFIX}", re.I)
_HEADERS = frozenset(("header", "banner"))
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
_MAIN = frozenset(("article", "main"))
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = _BLOCK - {"body", "html", "head"}
_SIGN = 1 << 63


def _digest(text: str, under: int) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), under & (2 * _SIGN - 1)) - _SIGN


class _Open:
    """An element: its token, and what holds for all inside it."""

    __slots__ = ("drop", "link", "main", "named", "odd", "parent", "tag", "token")

    def __init__(self, tag, token, parent, named, drop, main, link, odd):
        self.tag, self.token, self.parent, self.named, self.drop, self.main, self.link, self.odd = tag, token, parent, named, drop, main, link, odd


def _element(tag: str, attributes: str, parent: _Open) -> _Open:
    found = {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    classes = found.get("class", "").split()
    role = found.get("role", "").lower()
    main = tag in _MAIN or role in _MAIN or found.get("itemprop", "").lower() == "articlebody"
    named, head, odd = False, False, parent.odd
    if tag not in ("html", "body"):
        if main:
            named = any(_NAMES.fullmatch(c) for c in classes) and not parent.main and tag != "main" or parent.main and any(re.match("(?i)comment", c) for c in classes)
        else:
            names = [*classes, *found.get("id", "").split()]
            named = tag in _FURNITURE or role in _ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or any(_NAMES.fullmatch(c) for c in names)
            head = (tag == "header" or any(c.lower() in _HEADERS for c in names)) and not parent.main
            if odd is None and not named and any(_ODD_NAMES.fullmatch(c) for c in names):
                odd = [0, 0]  # characters inside, and those in links
    token = _digest(tag + "".join(f".{c}" for c in sorted(set(classes))), parent.token)
    return _Open(tag, token, parent, named, parent.drop or named or head, main or parent.main, parent.link or tag == "a", odd)


class _Stack:
    """The open elements; each question takes the same time however many there are."""

    def __init__(self, root: _Open):
        self.items, self.at, self.blocks, self.mains = [root], defaultdict(list), [], []

    def push(self, element: _Open) -> None:
        place = len(self.items)
        self.items.append(element)
        self.at[element.tag].append(place)
        if element.tag in _BLOCK:
            self.blocks.append(place)
        if element.tag in _MAIN:
            self.mains.append(place)

    def cut(self, place: int) -> None:
        while len(self.items) > place:
            tag = self.items.pop().tag
            self.at[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()
            if tag in _MAIN:
                self.mains.pop()

    def close(self, tag: str) -> None:
        if open_ := self.at.get(tag):
            inner = self.mains[-1] if self.mains else 0
            if open_[-1] >= inner or tag in ("body", "html"):  # a stray end tag does not close the article
                self.cut(open_[-1])

    def close_before(self, tag: str) -> None:
        """What an opening tag closes: the innermost block, if it is of a kind that ends here."""
        ends = (("p",) if tag in _ENDS_P else ()) + _CLOSED_BY.get(tag, ())
        if not ends:
            return
        last = max((self.at[t][-1] for t in ends if self.at.get(t)), default=0)
        if last and last >= (self.blocks[-1] if self.blocks else 0):
            self.cut(last)


def segments(text: str) -> Iterator[tuple[str, _Open, bool]]:
    """(raw text, element, starts a block); each element opened is also given with empty text."""
    stack, at, fresh = _Stack(_Open("", 0, None, False, False, False, False, None)), 0, True
    for m in _TOKEN.finditer(text):
        if m.start() > at:
            yield text[at : m.start()], stack.items[-1], fresh
            fresh = False
        at = m.end()
        if not (tag := m[3]):
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            fresh = True
        if m[2]:
            stack.close(tag)
        elif tag == "br":
            yield "\n", stack.items[-1], fresh
        elif tag not in _VOID:
            stack.close_before(tag)
            element = _element(tag, m[4], stack.items[-1])
            yield "", element, fresh
            if not m[4].endswith("/"):
                stack.push(element)
    if at < len(text):
        yield text[at:], stack.items[-1], fresh


def _plain(raw: str) -> str:
    return " ".join(html_lib.unescape(raw).split())


#: Kinds of tokens.
PAGE, ELEMENT, RUN = 0, 1, 2


def tokens(text: str | None) -> tuple[list[tuple], int]:
    """(token, parent, kind, tag, count, characters of text outside links inside, and of links) of a page, and a hash of its longest text run."""
    found: dict[int, list] = {0: [0, None, PAGE, "", 1, 0, 0]}
    longest = ""
    for raw, element, _ in segments(text or ""):
        if not raw:
            if (row := found.get(element.token)) is not None:
                row[4] += 1
            else:
                found[element.token] = [element.token, element.parent.token, ELEMENT, "article" if element.main and not element.parent.main else element.tag, 1, 0, 0]
        elif not (said := _plain(raw)):
            continue
        elif element.link:
            found[element.token][6] += len(said)
        else:
            token = _digest(f" {said}", element.token)
            row = found.setdefault(token, [token, element.token, RUN, "", 0, 0, 0])
            row[4] += 1
            row[5] += len(said)
            longest = max(longest, said, key=len)
    for row in reversed(found.values()):  # parents come before what they hold
        if row[1] is not None:
            found[row[1]][5] += row[5]
            found[row[1]][6] += row[6]
    found[0][1] = 0  # a null would make numbers of all parents inexact
    return [tuple(r) for r in found.values()], _digest(longest, 1)


def deduce(rows: list) -> tuple[list[int], list[int], list[int]]:
    """Main slots, text runs, and furniture inside the slots, of the template of one host; ``rows``: token, parent, kind, tag, pages, n, signature, chars, linked, differing."""
    known = {r["token"]: r for r in rows}
    whole = known.get(0)
    if whole is None:
        return [], [], []
    above = {r["token"]: r["parent"] if r["token"] else None for r in rows}
    classes: dict[tuple, list] = defaultdict(list)
    for r in rows:
        if r["pages"] >= MIN_SUPPORT * whole["pages"]:
            classes[r["pages"], r["signature"]].append(r)
    valid = {r["token"] for rs in classes.values() if len(rs) > 1 for r in rs if r["kind"] != RUN} | {0}
    depth: dict[int, int] = {0: 0}

    def place(token: int) -> int:
        """Depth of a template element; -1 if an ancestor is in no valid class."""
        chain = []
        while token not in depth:
            chain.append(token)
            if token not in valid:
                depth[token] = -1
                break
            token = above[token]
            if token not in known:
                depth[token] = -1
        for t in reversed(chain):
            at = depth[above[t]] if t in valid else -1
            depth[t] = at + 1 if at >= 0 else -1
        return depth[chain[0]] if chain else depth[token]

    elements = [r for r in rows if r["kind"] == ELEMENT and r["token"] in valid and place(r["token"]) > 0]
    placed = {r["token"] for r in elements} | {0}
    runs = [r for rs in classes.values() if any(r["token"] in placed for r in rs) for r in rs if r["kind"] == RUN and bin(r["differing"] & (2 * _SIGN - 1)).count("1") >= DIFFERING]
    left = {r["token"]: r["chars"] for r in rows}
    for r in runs:
        token = r["parent"]
        while token in known:
            left[token] -= r["chars"]
            token = above[token]
    once = [r for r in elements if r["n"] == r["pages"] and r["tag"] in _HOLDS_BLOCKS]
    full = [r for r in once if left[r["token"]] >= max(1, MIN_SHARE * left[0])]
    mains = {r["token"] for r in full if r["tag"] in _MAIN}

    def below_main(token: int) -> bool:
        while (token := above.get(token)) is not None:
            if token in mains:
                return True
        return False

    best = max((r for r in full if not below_main(r["token"])), key=lambda r: (depth[r["token"]], left[r["token"]], -r["token"]), default=None)
    slots = [best["token"]] if best is not None and best["tag"] not in ("body", "html") else []
    if not slots:
        named = {r["token"] for r in elements if r["tag"] in _MAIN}
        slots = sorted(t for t in named if above[t] not in named)
    links = sorted(r["token"] for r in elements if r["tag"] in _HOLDS_BLOCKS and r["linked"] > r["chars"] and r["token"] not in slots)
    return slots, sorted(r["token"] for r in runs), links


#: Where an element is: outside the main slots, inside, or inside something that goes.
OUTSIDE, INSIDE, GONE = 0, 1, 2


def extract(text: str | None, slots: list[int] = (), runs: list[int] = (), links: list[int] = ()) -> str:
    """The blocks of the main slots, or of the page's own article if it has none of them, without the template's text runs and lists of links."""
    slots, runs, links = set(slots), set(runs), set(links)
    held: dict[int, int] = {}
    blocks: list[list[tuple]] = []
    in_slot = in_main = False

    def inside(element: _Open) -> int:
        chain = []
        while element is not None and id(element) not in held:
            chain.append(element)
            element = element.parent
        where = OUTSIDE if element is None else held[id(element)]
        for e in reversed(chain):
            if where == OUTSIDE and e.token in slots:
                where = INSIDE  # whatever the slot or what holds it is called
            elif where == INSIDE and (e.named or e.token in links):
                where = GONE
            held[id(e)] = where
            kept.append(e)
        return where

    kept: list[_Open] = []  # so that an id stays that of its element
    for raw, element, fresh in segments(text or ""):
        if fresh and (not blocks or blocks[-1]) or not blocks:
            blocks.append([])
        if not raw:
            continue
        where = inside(element) if slots else OUTSIDE
        if where == GONE or where == OUTSIDE and element.drop or runs and _digest(f" {_plain(raw)}", element.token) in runs:
            continue
        size = len(raw.strip())
        if element.odd is not None:
            element.odd[0] += size
            element.odd[1] += size if element.link else 0
        slot = where == INSIDE
        in_slot, in_main = in_slot or slot and size > 0, in_main or element.main and size > 0
        blocks[-1].append((raw, slot, element.main, element.link, element.odd))
    out = []
    for block in blocks:
        parts = [x for x in block if (x[1] if in_slot else x[2] if in_main else True) and (x[4] is None or 2 * x[4][1] <= x[4][0])]
        words = _plain("".join(x[0] for x in parts))
        if words and not in_slot and not in_main:
            linked = sum(len(x[0].strip()) for x in parts if x[3])
            if 2 * linked > sum(len(x[0].strip()) for x in parts):
                continue
        if words:
            out.append(words)
    return "\n\n".join(out)


_TOKENS = "struct<differing:long,tokens:array<struct<token:long,parent:long,kind:int,tag:string,n:int,chars:long,linked:long>>>"
_TEMPLATE = "slots array<long>, runs array<long>, links array<long>"


def templates(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(host, slots, runs, links) of each host with pages enough, and of all pages under ``ALL``: a written table."""
    short_batches(pages.sparkSession)
    names = ("token", "parent", "kind", "tag", "n", "chars", "linked")

    def tokenise(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [tokens(t) for t in texts]
            bits = [1 << x % 64 for _, x in found]
            yield pd.DataFrame({"differing": [b - 2 * _SIGN if b == _SIGN else b for b in bits], "tokens": [[dict(zip(names, r, strict=True)) for r in rows] for rows, _ in found]})

    read = F.pandas_udf(tokenise, _TOKENS)
    rows = pages.select(F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"), F.xxhash64(page_id).alias("page"), read(F.col(html)).alias("t"))
    rows = rows.select("host", "page", "t.differing", F.explode("t.tokens").alias("t")).select("host", "page", "differing", "t.*")
    # partial sums add up in any order: a page contributes hash(page, count) to a token's vector
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("signature")
    total = [F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.bit_or("differing").alias("differing")]
    of_host = rows.groupBy("host", "token", "parent", "kind", "tag").agg(F.count("*").alias("pages"), vector, *total)
    # a text run on fewer pages is no template
    of_host, _ = written(of_host.where((F.col("kind") != RUN) | (F.col("pages") >= MIN_PAGES)), "page-tokens")
    pooled = of_host.groupBy("token", "parent", "kind", "tag").agg(F.sum("pages").alias("pages"), F.sum("signature").cast("decimal(38,0)").alias("signature"), *total)
    every = pooled.select(F.lit(ALL).alias("host"), *(c for c in of_host.columns if c != "host"))
    known = of_host.select(*every.columns).unionByName(every)
    whole = known.where(F.col("kind") == PAGE).select("host", F.col("pages").alias("of")).where((F.col("of") >= MIN_PAGES) | (F.col("host") == ALL))
    frequent = known.join(whole, "host").where(F.col("pages") >= MIN_SUPPORT * F.col("of"))
    row = F.struct("token", "parent", "kind", "tag", "pages", "n", F.col("signature").cast("string").alias("signature"), "chars", "linked", "differing")
    lists = frequent.groupBy("host").agg(F.collect_list(row).alias("rows"))  # at most twice the tokens of a mean page

    def choose(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for lists in batches:
            yield pd.DataFrame([deduce(list(rows)) for rows in lists], columns=["slots", "runs", "links"])

    return written(lists.select("host", F.pandas_udf(choose, _TEMPLATE)("rows").alias("t")).select("host", "t.*"), "page-templates")[0]


def extract_main(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", into: str = "main_text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with the column ``into``."""
    found = templates(pages, page_id=page_id, url=url, html=html)
    general = found.where(F.col("host") == ALL).first()
    common = (general.slots, general.runs, general.links) if general else ((), (), ())
    key, host, template = (spare_name(pages, f"template_{x}") for x in ("key", "host", "of"))
    found = found.where(F.col("host") != ALL).select(F.col("host").alias(host), F.struct("slots", "runs", "links").alias(template))
    size = found.agg(F.sum(F.octet_length(host) + 8 * (F.size(f"{template}.slots") + F.size(f"{template}.runs") + F.size(f"{template}.links")) + 64)).first()[0] or 0
    found = F.broadcast(found) if size <= broadcast_bytes else found

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for texts, *parts in batches:
            yield pd.Series([extract(t, *(common if own[0] is None else map(list, own))) for t, own in zip(texts, zip(*parts, strict=True), strict=True)], dtype=object)

    joined = pages.withColumn(key, F.coalesce(host_of(F.col(url)), F.lit(""))).join(found, F.col(key) == F.col(host), "left")
    return joined.withColumn(into, F.pandas_udf(run, "string")(F.col(html), *(F.col(f"{template}.{c}") for c in ("slots", "runs", "links")))).drop(key, host, template)
