"""HTML extraction by template deduction from equivalence classes.

Pages of one host come from a template, and the tokens of one part of it occur equally often on every page:

1. **Tokens.** Each page is cut into tags, whose role is the path of block elements above them, and whole text blocks.
2. **Classes.** Over all pages of a host, tokens with the same occurrence vector make an equivalence class. Vectors are
   compared by support, total and three order-free sums of hashes, which aggregate before the shuffle, so that no task
   holds a host. A class counts if it is large and frequent enough; its tokens are ordered by their mean place.
3. **Validity.** All pages are read again with the classes of their host. A class is valid if its tokens come in that
   order, round after round, and each round lies within one and the same gap of the classes around it, on nine pages of
   ten at least. Others are dropped. Classes so nest into the host's template.
4. **Slots** are the gaps: the text between two neighbouring tokens of a class, inside a gap of the class around it.
   Over all pages each slot has its statistics: letters, letters in links, and how often it repeats the page's title.
5. **Main text.** The slot with most letters outside links and outside vetoed elements is the centre. The innermost element of the template around
   it is the main region, widened to the element above as long as that adds nothing but headlines, further prose, or
   what the tag ``article`` or ``main`` holds. If the region has no menus in it, all of its slots are taken; if it is a
   container of menus, too, the centre, headlines and slots of much prose are. Text that the pages share is template,
   except in a region that is a part of the page and has no menus, where it belongs to the articles, and on pages that
   have no other.

Tag names and classes never choose: but for that widening they only veto blocks in elements such as ``nav`` or ``form``
or of classes such as ``ad``, which are left out and make no centre. Hosts with fewer than ``least_pages`` pages are one group, the pool, whose vectors are
the sums of theirs. Only pages that neither their host's nor the pool's template fits are read by tag names alone.

Style: Arrow maps parse pages one by one; classes and slots are found by DataFrame aggregation, and one small group of
slots is judged for each host. Pages are never shuffled while the templates are small enough to be broadcast.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, named, slices, table

# Elements by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template", "svg", "math")
FURNITURE = frozenset("nav header footer aside form script style noscript template iframe textarea title head select button svg math dialog menu label fieldset object canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
MAIN = frozenset(("article", "main"))
#: Words in class, id or role that mark furniture, and those that mark the main text.
FURNITURE_NAMES = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar side widget footer header masthead comment comments disqus reply replies respond "
    "share sharing social cookie cookies consent notice alert popup modal newsletter subscribe signup login related recommended pagination pager skip search toolbar legal copyright complementary contentinfo form hidden".split()
)
#: Of these, those that are also common words of a text's subject: inside the main text they veto as whole names only.
COMMON_NAMES = frozenset("side form hidden legal social search skip".split())
MAIN_NAMES = frozenset("article content main post entry story body text maincontent articlebody".split())

#: Template tokens that may be broadcast, at some 80 bytes each; parts that the pages of a host are dealt into beyond that.
BROADCAST_TOKENS, SALTS = 1_000_000, 64
#: The group of all hosts with few pages; no host has this name.
POOL = "*"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>|</?[a-zA-Z][^<>]*>?|</?\Z|[^<]++|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_PART = re.compile(r"[A-Za-z]+")
_HEADING = re.compile(r"h[1-6]\Z")
#: What an opening tag closes when it is still open, and where that search stops.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BARRIER = frozenset("table ul ol dl div section article main body html nav aside footer header form blockquote select".split())


@dataclass
class Options:
    """A class is on ``share`` of the group's pages, on ``least_pages`` at least, and has ``least_tokens`` tokens; of
    prose is a slot that holds ``prose`` of the centre's letters on its pages; of menus one with half its letters in links."""

    share: float = 0.9
    least_pages: int = 4
    least_tokens: int = 3
    prose: float = 0.2
    broadcast_tokens: int = BROADCAST_TOKENS
    broadcast_hosts: int = 1_000_000  # at some 50 bytes each


@dataclass
class Block:
    """A text block: its normalised text, the index of its token, the tokens of the elements around it, and its tags."""

    text: str
    at: int
    elements: tuple[int, ...]
    furniture: bool
    main: bool
    heading: bool
    link_chars: int


@dataclass
class Page:
    """Tokens in order, text blocks in order, the title, and the tokens of elements that are named main."""

    tokens: list[int] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    title: str = ""
    hints: set[int] = field(default_factory=set)


@dataclass(slots=True)
class _Open:
    """An open element, with what holds for all text in it: the role, the elements around, and what their tags say."""

    element: str
    path: str
    elements: tuple[int, ...]
    furniture: bool
    main: bool
    heading: bool
    link: bool
    block: bool
    opening: bool = False  # the header of an article, whose headings are the article's


_ROOT = _Open("", "", (), False, False, False, False, False)
@dataclass(slots=True)
class _Tag:
    """What a tag's text says, wherever it stands."""

    element: str
    closing: bool
    block: bool
    role: str = ""
    alone: bool = False  # holds nothing
    raw: bool = False  # holds no tags
    furniture: bool = False
    subject: bool = False  # only for parts of names that are common words
    main: bool = False
    heading: bool = False


_known_tags: dict[str, _Tag] = {}
_known_hashes: dict[str, int] = {}


def _tag(text: str) -> _Tag:
    """A tag by its text, remembered, as most come again and again."""
    if (found := _known_tags.get(text)) is not None:
        return found
    element = _NAME.match(text)[1].lower()
    out = _Tag(element, text[1] == "/", element in BLOCKS)
    if not out.closing:
        words, whole, hidden = set(), set(), False
        out.role = element
        for m in _ATTRIBUTE.finditer(text) if _TELLING.search(text) else ():
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                hidden = True
            elif key == "style":
                hidden |= "display:none" in value.lower().replace(" ", "")
            elif key in ("class", "id", "role"):
                out.role += "." + re.sub(r"\d+", "#", value)
                whole |= set(value.lower().split())
                words |= {w.lower() for w in _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value))}
        out.alone = element in VOID or text.endswith("/>") and not out.block and element not in RAW
        out.raw = element in RAW and element not in ("noscript", "template", "svg", "math")
        out.heading = bool(_HEADING.match(element))
        # a page's header is furniture, an article's own heading isn't
        named_ = words & FURNITURE_NAMES if element not in ("html", "body", *MAIN) and not out.heading else set()
        out.furniture = hidden or element in FURNITURE or bool(named_)
        out.subject = out.furniture and not hidden and element not in FURNITURE and named_ <= COMMON_NAMES - whole
        out.main = element in MAIN or bool(words & MAIN_NAMES) and element in ("div", "section", "td")
    if len(_known_tags) > 20_000:
        _known_tags.clear()
    if len(text) < 200:
        _known_tags[text] = out
    return out


def _hash(key: str) -> int:
    """63 bits of the key's hash, remembered for tags, which come again and again."""
    h = _known_hashes.get(key)
    if h is None:
        h = xxhash.xxh64_intdigest(key) >> 1
        if len(_known_hashes) > 20_000:
            _known_hashes.clear()
        if len(key) < 500:
            _known_hashes[key] = h
    return h


def read(text: str) -> Page:
    """A page's tokens and text blocks. Broken pages are read as far as they go."""
    out = Page()
    tokens, blocks = out.tokens, out.blocks
    stack: list[_Open] = [_ROOT]
    parts: list[str] = []
    links, at, owner = 0, 0, _ROOT

    def flush() -> None:
        nonlocal links
        if parts:
            whole = "".join(parts)
            block = " ".join((html.unescape(whole) if "&" in whole else whole).split())
            if block:
                blocks.append(Block(block, len(tokens), owner.elements, owner.furniture, owner.main, owner.heading, links))
                tokens.append(xxhash.xxh64_intdigest(f"text {owner.path} {block}") >> 1)
            parts.clear()
        links = 0

    def close(n: int) -> None:
        if parts and any(x.block for x in stack[n:]):
            flush()
        del stack[n:]

    while m := _TOKEN.match(text, at):
        at, token = m.end(), m[0]
        if token in ("<", "</") and at == len(text):  # a tag that the page's end cuts off
            continue
        if token[0] != "<" or token == "<":
            if not parts:
                owner = stack[-1]
            if parts or not token.isspace():
                parts.append(token)
                if stack[-1].link:
                    links += len(token)
            continue
        if token.startswith("<![CDATA["):
            if not parts:
                owner = stack[-1]
            parts.append(token[9:].removesuffix("]]>"))
            continue
        if token[1] in "!?":
            continue
        tag = _tag(token)
        element = tag.element
        if tag.closing:
            for n in range(len(stack) - 1, 0, -1):
                own = stack[n]
                if own.element == element:
                    h = _hash("end " + own.path if own.block else f"end {own.path}/{element}")
                    close(n)
                    tokens.append(h)
                    break
                if own.element in _BARRIER and element not in _BARRIER:
                    break
            if tag.block and parts:
                flush()
            continue
        if tag.block:
            if parts:
                flush()
            closes = _CLOSES.get(element, ())
            for n in range(len(stack) - 1, 0, -1) if closes or element != "li" else ():
                if stack[n].element in _BARRIER:
                    break
                if stack[n].element in closes or stack[n].element == "p":
                    close(n)
                    break
        elif element == "br":
            if not parts:
                owner = stack[-1]
            parts.append("\n")
        up = stack[-1]
        own = f"{up.path}/{tag.role}"
        h = _hash("tag " + own)
        tokens.append(h)
        if tag.alone:
            continue
        if element in MAIN:
            out.hints.add(h)
        if tag.raw:
            end = re.compile(rf"</{re.escape(element)}\s*>", re.I).search(text, at)
            stop = end.start() if end else len(text)
            if element in ("title", "textarea"):
                flush()
                if element == "title" and not out.title:
                    out.title = " ".join(html.unescape(text[at:stop]).split())
            at = end.end() if end else stop
            continue
        holds = tag.block or element in RAW
        veto = tag.furniture and not (tag.subject and up.main)
        opening = element == "header" and up.main and not up.furniture or up.opening
        # elements that only wrap text leave the role of what they hold as it is
        stack.append(_Open(
            element, own if holds else up.path, (*up.elements, h) if holds else up.elements, veto or up.furniture and not (up.opening and tag.heading),
            tag.main or up.main and (not veto or opening), tag.heading or up.heading, element == "a" or up.link, holds, opening and not (veto and element != "header"),
        ))
    flush()
    return out


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))


# --- classes --------------------------------------------------------------------------------------------------------


def page_tokens(pages: DataFrame) -> DataFrame:
    """``(host, page, token, n, place, hint)`` from ``(host, html)``: how often each token is on the page, and where first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            host, page, token, n, place, hint = [], [], [], [], [], []
            for h, t in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                if not t:
                    continue
                p = read(t)
                count, first = Counter(p.tokens), {}
                for i, k in enumerate(p.tokens):
                    first.setdefault(k, i)
                host += [h] * len(count)
                page += [xxhash.xxh64_intdigest(t) >> 1] * len(count)
                token += count.keys()
                n += count.values()
                place += map(first.__getitem__, count)
                hint += [k in p.hints for k in count]
            yield pa.RecordBatch.from_arrays(
                [pa.array(host, pa.string()), pa.array(page, pa.int64()), pa.array(token, pa.int64()), pa.array(n, pa.int32()), pa.array(place, pa.int32()), pa.array(hint, pa.bool_())],
                ["host", "page", "token", "n", "place", "hint"],
            )

    return pages.select("host", "html").mapInArrow(run, "host string, page long, token long, n int, place int, hint boolean")


_SUMS = ("total", "v1", "v2", "v3", "places", "support")


def vectors(tokens: DataFrame, o: Options = Options()) -> DataFrame:
    """``(host, token, support, total, v1, v2, v3, places, most, hint, pages)``: occurrence vectors of hosts and of the pool.

    Equal vectors have equal sums of 31-bit hashes over (page, count), in any order; a page that comes twice counts
    twice. Sums over the hosts of the pool are the pool's.
    """
    part = lambda k: F.sum(F.xxhash64("page", "n", F.lit(k)).bitwiseAND(F.lit((1 << 31) - 1)))
    each = tokens.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("support"), F.sum("n").alias("total"), part(1).alias("v1"), part(2).alias("v2"), part(3).alias("v3"),
        F.sum(F.col("place").cast("long")).alias("places"), F.max("n").alias("most"), F.bool_or("hint").alias("hint"),
    )
    each = checkpointed(each)
    # the token with most pages stands for their number: every page starts with one that nearly all have
    size = checkpointed(each.groupBy("host").agg(F.max("support").alias("pages")))
    # of a large host, what stands on fewer pages is in no class, and so its texts meet in no task
    large = each.where(F.col("support") >= o.least_pages).join(size.where(F.col("pages") >= o.least_pages), "host")
    small = size.where(F.col("pages") < o.least_pages)
    total, hosts = small.agg(F.sum("pages"), F.count(F.lit(1))).first()
    few = small.select("host")
    pool = each.join(F.broadcast(few) if hosts <= o.broadcast_hosts else few, "host", "left_semi")
    pool = pool.groupBy("token").agg(*(F.sum(c).alias(c) for c in _SUMS), F.max("most").alias("most"), F.bool_or("hint").alias("hint"))
    pool = pool.select(F.lit(POOL).alias("host"), "*", F.lit(total or 0).cast("long").alias("pages"))
    return large.unionByName(pool.select(large.columns))


def classes(found: DataFrame, o: Options = Options()) -> DataFrame:
    """``(host, tokens)``: for each group of pages its classes, as an array of ``(token, class, place, size, once, hint)``.

    The length of the array is bounded by the template: tokens on most pages of the group.
    """
    frequent = found.where((F.col("support") >= o.share * F.col("pages")) & (F.col("support") >= o.least_pages))
    order = F.struct((F.col("places") / F.col("support")).alias("mean"), "token", "hint")
    grouped = frequent.groupBy("host", "support", "total", "v1", "v2", "v3").agg(F.sort_array(F.collect_list(order)).alias("t"), F.max("most").alias("most"))
    grouped = grouped.where(F.size("t") >= o.least_tokens)
    # the largest classes come first
    one = F.struct((-F.col("support")).alias("s"), (-F.size("t")).alias("z"), "v1", "v2", "v3", "t", (F.col("most") == 1).alias("once"))
    listed = grouped.groupBy("host").agg(F.sort_array(F.collect_list(one)).alias("c"))
    token = lambda c, k: F.transform(c["t"], lambda t, i: F.struct(t["token"].alias("token"), k.alias("class"), i.alias("place"), F.size(c["t"]).alias("size"), c["once"].alias("once"), t["hint"].alias("hint")))
    return listed.select("host", F.flatten(F.transform("c", token)).alias("tokens"))


# --- slots ----------------------------------------------------------------------------------------------------------


class Template:
    """The classes of a group of pages as they are matched with a page."""

    def __init__(self, tokens: list[dict] | None, valid: list[int] | None = None):
        keep = None if valid is None else set(valid)
        self.tokens = {t["token"]: (t["class"], t["place"], t["size"], t["once"]) for t in tokens or () if keep is None or t["class"] in keep}
        self.sizes = {c: size for c, _, size, _ in self.tokens.values()}

    def walk(self, page: Page) -> tuple[list[str], dict[int, tuple[int, list[str]]]]:
        """The chain of gaps at each block, and for each class its faults and the chains in which its rounds lie.

        A chain names, from the outermost class to the innermost, the class and the token last seen of it. A class is
        open from its first token on, to the end of the page if its tokens come once, else to the last of the round.
        """
        chains, seen, at = [], {}, 0
        open_: dict[int, list] = {}  # class: token last seen, chain around it
        around = lambda c=None: "/".join(f"{k}.{v[0]}" for k, v in open_.items() if k != c)
        for i, token in enumerate(page.tokens):
            known = self.tokens.get(token)
            if known is not None:
                c, place, size, once = known
                faults = seen.setdefault(c, [0, []])
                if place == 0:
                    if c in open_:
                        faults[0] += 1
                        del open_[c]
                    open_[c] = [0, around()]
                    faults[1].append(open_[c][1])
                elif c not in open_:
                    faults[0] += 1
                    open_[c] = [place, around()]
                else:
                    mine = open_[c]
                    faults[0] += mine[0] + 1 != place
                    mine[0] = place
                    if place == size - 1:
                        outer = "/".join(f"{k}.{v[0]}" for k, v in list(open_.items())[: list(open_).index(c)])
                        faults[0] += outer != mine[1]
                        if not once:
                            del open_[c]
            if at < len(page.blocks) and page.blocks[at].at == i:
                chains.append(around())
                at += 1
        for c, mine in open_.items():
            seen[c][0] += mine[0] != self.sizes[c] - 1
        return chains, {c: (v[0], v[1]) for c, v in seen.items()}

    def around(self, block: Block) -> list[str]:
        """The elements of the template that hold a block, outermost first, as class and place; only those that come once."""
        found = (self.tokens.get(e) for e in block.elements)
        return [f"{t[0]}.{t[1]}" for t in found if t is not None and t[3]]


def slot_rows(pages: DataFrame) -> DataFrame:
    """``(host, kind, key, around, pages, free, chars, links, titles, kept)`` from ``(host, html, tokens)``, summed over each batch.

    kind ``class``: the pages of a class and, as free, those with faults; ``nest``: the rounds of a class by the chain
    around them; ``slot``: letters outside the template and of all blocks, letters in links, pages whose title repeats a
    block, and letters outside template, links and vetoed elements.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Templates()
        for b in slices(batches, "html"):
            sums: dict[tuple[str, str, str, str], list[int]] = {}
            for host, t, tokens in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("tokens"), strict=True):
                if not t or not tokens.is_valid:
                    continue
                template, page = known.get(host, tokens), read(t)
                chains, seen = template.walk(page)
                for c, (faults, rounds) in seen.items():
                    _add(sums, (host, "class", str(c), ""), 1, faults > 0, 0, 0, 0, 0)
                    for chain in rounds:
                        _add(sums, (host, "nest", str(c), chain), 1, 0, 0, 0, 0, 0)
                slots: dict[tuple[str, str], list[int]] = {}
                for block, chain in zip(page.blocks, chains, strict=True):
                    n = len(block.text)
                    x = slots.setdefault((chain, " ".join(template.around(block))), [0, 0, 0, 0, 0])
                    free = page.tokens[block.at] not in template.tokens
                    x[0] += n * free
                    x[1] += n
                    x[2] += min(n, block.link_chars)
                    x[3] |= 2 * n >= len(page.title) > 0 and block.text in page.title or len(page.title) > 10 and page.title in block.text
                    x[4] += max(0, n - block.link_chars) * (free and not block.furniture)
                for (chain, elements), x in slots.items():
                    _add(sums, (host, "slot", chain, elements), 1, *x)
            keys, values = list(sums), list(sums.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in keys], pa.string()) for i in range(4)] + [pa.array([v[i] for v in values], pa.int64()) for i in range(6)],
                ["host", "kind", "key", "around", "pages", "free", "chars", "links", "titles", "kept"],
            )

    rows = pages.mapInArrow(run, "host string, kind string, key string, around string, pages long, free long, chars long, links long, titles long, kept long")
    return rows.groupBy("host", "kind", "key", "around").agg(*(F.sum(c).alias(c) for c in ("pages", "free", "chars", "links", "titles", "kept")))


def _add(sums: dict, key: tuple, *values: int) -> None:
    have = sums.setdefault(key, [0] * len(values))
    for i, v in enumerate(values):
        have[i] += int(v)


class _Templates:
    """Templates by group, made once in a task for each."""

    def __init__(self) -> None:
        self.known: dict[str, Template] = {}

    def get(self, host: str, tokens: pa.Scalar, valid: list[int] | None = None) -> Template:
        if host not in self.known:
            if len(self.known) > 1000:
                self.known.clear()
            self.known[host] = Template(tokens.as_py(), valid)
        return self.known[host]


def judged(rows: pd.DataFrame, hints: set[str], o: Options) -> dict:
    """What is main on the pages of one group: ``valid`` classes, ``region`` (an element), its main ``slots``, whether
    the ``whole`` region is main, and whether text that is ``shared`` by the pages is.

    The rows are those of ``slot_rows`` for one group; ``hints``: elements named main. Nothing is found without text.
    """
    sound = []
    for c, mine in rows[rows["kind"] == "class"].groupby("key"):
        nest = rows[(rows["kind"] == "nest") & (rows["key"] == c)]["pages"]
        if mine["free"].sum() <= (1 - o.share) * mine["pages"].sum() and len(nest) and nest.max() >= o.share * nest.sum():
            sound.append(c)
    kept = lambda text, by: by.join(x for x in text.split(by) if x.split(".")[0] in sound)
    slots: dict[tuple[str, tuple[str, ...]], list[int]] = {}
    for r in rows[rows["kind"] == "slot"].itertuples():
        key = kept(r.key, "/"), tuple(kept(r.around, " ").split())
        have = slots.setdefault(key, [0] * 6)
        for i, v in enumerate((r.pages, r.free, r.chars, r.links, r.titles, r.kept)):
            have[i] += v
    nothing = {"valid": [], "region": "", "whole": False, "shared": False, "slots": []}
    # without text of its own that isn't vetoed, a page shows what it has
    measures = (lambda x: x[5], lambda x: max(0, x[1] - x[3]), lambda x: max(0, x[2] - x[3]))
    prose = next((m for m in measures if any(map(m, slots.values()))), measures[-1])
    if not sound or not slots or not any(map(prose, slots.values())):
        return nothing
    centre = max(slots, key=lambda k: (prose(slots[k]), k))
    mean = lambda k: prose(slots[k]) / slots[k][0]
    headline = lambda k: 2 * slots[k][4] >= slots[k][0]
    menu = lambda k: 2 * slots[k][3] >= slots[k][2]
    much = lambda k: not menu(k) and (headline(k) or mean(k) >= o.prose * mean(centre) and slots[k][0] >= o.prose * slots[centre][0])
    inside = lambda e: {k for k in slots if not e or e in k[1]}
    chain = centre[1]
    n = len(chain) - 1
    while n > 0:
        more = inside(chain[n - 1]) - inside(chain[n])
        if chain[n - 1] in hints or chain[n] not in hints and all(map(much, more)):
            n -= 1
        else:
            break
    region = chain[n] if chain else ""
    whole = bool(region) and not any(menu(k) and slots[k][0] >= o.prose * slots[centre][0] for k in inside(region)) or region in hints
    chosen = [k for k in inside(region) if whole or k == centre or much(k)]
    shared = whole and (len(inside(region)) < len(slots) or not any(slots[k][1] for k in inside(region)))
    return {"valid": sorted(map(int, sound)), "region": region, "whole": whole, "shared": shared, "slots": sorted({k[0] for k in chosen})}


def templates(pages: DataFrame, o: Options = Options()) -> DataFrame:
    """``(host, tokens, main)`` for each group of pages with a template: its classes, and what is main, as JSON.

    ``pages`` has (host, html). A template without a main part isn't there.
    """
    found = checkpointed(classes(vectors(page_tokens(pages), o), o))
    rows = slot_rows(_with_templates(pages, found, o))
    hints = found.select("host", F.transform(F.filter("tokens", lambda t: t["hint"]), lambda t: F.concat_ws(".", t["class"], t["place"])).alias("hints"))

    def judge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # one group's slots, as many as its template has gaps
        said = judged(pdf, set(pdf["hints"].iloc[0]), o)
        return pd.DataFrame([(key[0], json.dumps(said))] if said["valid"] else [], columns=["host", "main"])

    main = rows.join(hints, "host").groupBy("host").applyInPandas(judge, "host string, main string")
    return checkpointed(found.join(main, "host"))


def _with_templates(pages: DataFrame, found: DataFrame, o: Options) -> DataFrame:
    """The pages with the columns of their host's template, or else the pool's; ``host`` is the group that has it.

    While the templates are small they are broadcast, and pages stay where they are.
    """
    kept = [c for c in found.columns if c != "host"]
    own = found.where(F.col("host") != POOL).withColumn("own", F.lit(True))
    pool = found.where(F.col("host") == POOL)
    if (found.agg(F.sum(F.size("tokens"))).first()[0] or 0) <= o.broadcast_tokens:
        joined = pages.join(F.broadcast(own), "host", "left")
    else:  # a host may have any part of the pages, so its pages are dealt out and its template is copied
        spread = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = pages.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(spread, ["host", "salt"], "left").drop("salt")
    # one row, whose length the pool's template bounds
    one = pool.select(*(F.col(c).alias(f"p_{c}") for c in kept)).unionByName(pages.sparkSession.range(1).select(*(F.lit(None).cast(found.schema[c].dataType).alias(f"p_{c}") for c in kept)))
    one = one.agg(*(F.first(f"p_{c}", ignorenulls=True).alias(f"p_{c}") for c in kept))
    joined = joined.crossJoin(F.broadcast(one))
    group = F.when(F.col("own"), F.col("host")).otherwise(F.lit(POOL))
    return joined.select(*(c for c in pages.columns if c != "host"), group.alias("host"), *(F.when(F.col("own"), F.col(c)).otherwise(F.col(f"p_{c}")).alias(c) for c in kept))


# --- the text -------------------------------------------------------------------------------------------------------


def by_tags(page: Page) -> str:
    """Text of a page that no template fits: what its tags name main, or else all that they don't name furniture."""
    slots = [b for b in page.blocks if not b.furniture]
    inside = [b for b in slots if b.main]
    if inside:
        return "\n".join(b.text for b in inside)
    # no tag says it: all slots from the first to the last one that is more than links, or a heading
    body = [i for i, b in enumerate(slots) if 2 * b.link_chars <= len(b.text) or b.heading]
    return "\n".join(b.text for b in slots[body[0] : body[-1] + 1]) if body else ""


def by_template(page: Page, template: Template, main: dict) -> str | None:
    """Text of the main slots; None if the page lacks the main region, so that the template doesn't fit it."""
    chains, _ = template.walk(page)
    slots, out, fits = set(main["slots"]), [], not main["region"]
    for block, chain in zip(page.blocks, chains, strict=True):
        inside = not main["region"] or main["region"] in template.around(block)
        fits |= inside
        if not inside or block.furniture:
            continue
        if (main["whole"] or chain in slots) and (main["shared"] or page.tokens[block.at] not in template.tokens):
            out.append(block.text)
    return "\n".join(out) if fits else None


def main_text(page: str | None, template: Template | None = None, main: dict | None = None) -> str:
    """Text of the blocks that hold the article."""
    if not page:
        return ""
    read_ = read(page)
    text = by_template(read_, template, main) if template is not None else None
    return by_tags(read_) if text is None else text


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", options: Options = Options()) -> DataFrame:
    """``(page_id, url, text, n_chars, by_template)`` for each row; the last tells whether a template decided.

    Null or empty html gives an empty text. A null url, or one without a host, belongs to the host of no name. Repeated
    pages support a class like others. Broken pages are read as far as they go: open elements end with the page. An
    empty table gives an empty result; other columns are not read.
    """
    slim = pages.select(named(id_col).alias("id"), named(url_col).alias("url"), host_of(named(url_col)).alias("host"), named(html_col).alias("html"))
    known = templates(slim.select("host", "html"), options)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, mains = _Templates(), {}
        for b in slices(batches, "html"):
            texts, said = [], []
            for host, t, tokens, main in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("tokens"), b.column("main").to_pylist(), strict=True):
                text = None
                page = read(t) if t else None
                if page is not None and main:
                    if main not in mains:
                        if len(mains) > 1000:
                            mains.clear()
                        mains[main] = json.loads(main)
                    text = by_template(page, made.get(host, tokens, mains[main]["valid"]), mains[main])
                said.append(text is not None)
                texts.append("" if page is None else by_tags(page) if text is None else text)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(said, pa.bool_())], ["id", "url", "text", "n_chars", "by_template"])

    joined = _with_templates(slim, known, options).select("id", "url", "host", "html", "tokens", "main")
    return joined.mapInArrow(run, f"id {kind}, url string, text string, n_chars long, by_template boolean").withColumnRenamed("id", id_col)


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
