"""HTML extraction by template deduction from equivalence classes.

A page is read as a tree of elements, inline ones included, and text blocks. Its
tokens are elements, told apart by their *place* (signatures and ordinals of all
ancestors; a signature is the tag with its class), and text blocks, told apart by
the path of signatures above them and their words. Over the distinct pages of a
host each token has an occurrence vector, its times on each page, kept as sums of
hashes of (page, times), so any number of pages adds up in one aggregation.

1. *Classes.* Tokens of a host with equal vectors on at least ``SUPPORT`` of its
   pages form an equivalence class. An element needs company in its class; a text
   needs at least ``MIN_PAGES`` pages of the host to be told from content.
2. *Validity.* A class must nest: its tokens' parents are in the template too. It
   must be ordered: on ``ORDERED`` of the pages the class's tokens below one
   parent stand in the same order; an unordered one divides nothing.
3. *Slots.* What lies inside a template element that holds blocks and after its last ordered
   template child is a slot; text tokens of the template fill no slot. Every
   slot's free text and link text is summed over the host.
4. *Choice.* From the root the template is followed down while one child holds
   ``DOMINANT`` of the free text; it stops at an article or main element, which
   so only decides how far. The slots below are the main text. A page without
   that element, or a host under ``MIN_PAGES`` pages, is judged by the template
   of the page itself, and there an article on the page comes first.

Menus, forms, adverts and the like are marked by tag (``nav``, ``form`` ...) or by
a class made only of words for them (``ad``, ``cookie-notice``; not
``search-methods``); what is so marked is no slot's text.

Reading is linear in the page whatever it holds: every ``<`` that opens a tag
consumes it, quotes count only after ``=``, and open elements are counted by tag.

Defined results: null or empty html gives an empty text; a null url is a host of
its own; unclosed and misnested tags are closed by their ancestors; a tag that
the page's end cuts off is dropped, as browsers do; repeated rows each give a
row and count once for the template; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import chunks, texts, tune, written

SUPPORT = 0.5
MIN_PAGES = 8
ORDERED = 0.9
DOMINANT = 0.8
#: Template entries, of about 24 bytes, up to which the templates of all hosts are broadcast.
SMALL_TEMPLATE = 400_000

_TOKEN = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|(?!["'])))*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]*+)))?""")
_RAW = frozenset("script style noscript template iframe textarea".split())
_CLOSERS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split())
_CLOSES_P = _BLOCK - {"html", "body", "head", "title"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("article main section div table ul ol dl body aside nav footer header form blockquote".split())
#: Blocks that hold text rather than other blocks; they divide no slot.
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre caption summary".split())
_OTHER_TAGS = frozenset("nav footer aside form head title button dialog menu label fieldset select".split())
#: Words for matter other than main text, and words that may stand beside them in a class.
_OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored menu nav navbar navigation breadcrumb breadcrumbs sidebar side footer header masthead cookie cookies consent notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments reply replies respond disqus widget search pagination pager toolbar complementary contentinfo skip".split()
)
_BESIDE = frozenset("area bar block body box btn button buttons card container content footer form group header icon item items label left link links list main media page panel post posts right section site slot text thread title top bottom unit wrap wrapper site global primary secondary".split())


def _marks(tag: str, attributes: str) -> list[str]:
    """Values of class, id and role."""
    if "=" not in attributes:
        return []
    found = {}
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name in ("class", "id", "role"):
            found.setdefault(name, m[2] or m[3] or m[4] or "")
    return [found[n] for n in ("class", "id", "role") if found.get(n)]


def _other(tag: str, marks: list[str], in_article: bool) -> bool:
    """Whether an element is marked as other matter than main text."""
    if tag in _OTHER_TAGS or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "main"):
        return False
    for value in marks:
        for name in value.split():
            words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
            told = _OTHER_WORDS.intersection(words)
            if told and not (in_article and told == {"header"}) and all(w in _OTHER_WORDS or w in _BESIDE for w in words):
                return True
    return False


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


ROOT = _hash("")


OTHER, ARTICLE, MAIN, LINK = 1, 2, 4, 8
_ENDS = {t: _SAME.get(t, frozenset()) | ({"p"} if t in _CLOSES_P else frozenset()) | ({"a"} if t == "a" else frozenset()) for t in _BLOCK | set(_SAME) | {"a"}}


class Shape:
    """A page without its words: elements in order with their place and the element they are named below, and blocks."""

    __slots__ = ("place", "up", "holds", "words", "element", "before", "free", "link", "stops")

    def __init__(self, place: list[int], up: list[int], holds: list[bool], words: list[int], element: list[int], before: list[int], free: list[int], link: list[int], stops: list[int]):
        self.place, self.up, self.holds = place, up, holds  # the root is element 0; leaves and inline elements hold no others
        self.words, self.element, self.before = words, element, before  # text token, element, elements opened before its end
        self.free, self.link = free, link  # characters outside and inside links
        self.stops = stops  # places of articles and mains

    def slots(self, elements: dict[int, int], words: set[int]) -> tuple[list[tuple[int, int, int]], dict[int, list[int]]]:
        """(container, last template child before it, block) of each free block, and the template children of each parent in order."""
        inner, last, children, out, e = [0] * len(self.place), {}, defaultdict(list), [], 1
        for b, until in enumerate([*self.before, len(self.place)]):
            while e < until:
                at = inner[self.up[e]]
                if self.holds[e] and self.place[e] in elements:
                    inner[e], last[at] = e, self.place[e]
                    children[self.place[at]].append(self.place[e])
                else:
                    inner[e] = at
                e += 1
            if b < len(self.words) and self.words[b] not in words:
                at = inner[self.element[b]]
                out.append((self.place[at], last.get(at, 0), b))
        return out, children


class Page:
    """Elements and text blocks of one page in order. Element 0 is the root."""

    def __init__(self, source: str):
        #: (parent, element it is named below, place, path, tag, flags, innermost block)
        nodes: list[tuple[int, int, int, int, str, int, int]] = [(-1, -1, ROOT, ROOT, "", 0, 0)]
        #: (element, pieces of (element, text)) of each block.
        blocks: list[tuple[int, list[tuple[int, str]]]] = []
        before: list[int] = []
        stack, opened = [0], defaultdict(int)
        nth: dict[tuple[int, str], int] = defaultdict(int)
        pieces: list[tuple[int, str]] = []
        self.nodes, self.blocks, self.before = nodes, blocks, before
        search, unescape, at, end = _TOKEN.search, html.unescape, 0, len(source)

        def flush() -> None:
            if not all(t.isspace() for _, t in pieces):
                blocks.append((nodes[stack[-1]][6], pieces.copy()))
                before.append(len(nodes))
            pieces.clear()

        def shut(k: int) -> None:
            for e in stack[k:]:
                opened[nodes[e][4]] -= 1
            del stack[k:]

        while at < end:
            m = search(source, at)
            if m is None:
                break
            if m.start() > at:
                t = source[at : m.start()]
                pieces.append((stack[-1], unescape(t) if "&" in t else t))
            at = m.end()
            closing, tag, attributes = m.groups()
            if tag is None:
                continue
            tag = tag.lower()
            block = tag in _BLOCK
            if block:
                if pieces:
                    flush()
            elif tag in ("br", "td", "th"):
                pieces.append((stack[-1], " "))
                block = tag != "br"
            if closing:
                if opened[tag] > 0:
                    if nodes[stack[-1]][4] == tag:
                        opened[tag] -= 1
                        stack.pop()
                    else:
                        shut(next(i for i in range(len(stack) - 1, 0, -1) if nodes[stack[i]][4] == tag))
                continue
            if tag in _RAW:
                close = _CLOSERS[tag].search(source, at)
                at = close.start() if close else end
                continue
            ends = _ENDS.get(tag)
            if ends and any(opened[t] > 0 for t in ends):
                for i in range(len(stack) - 1, 0, -1):
                    name = nodes[stack[i]][4]
                    if name in ends:
                        shut(i)
                        break
                    if name in _SCOPE:
                        break
            if tag in _VOID:
                continue
            top = stack[-1]
            marks = _marks(tag, attributes) if "=" in attributes else ()
            sign = f"{tag}.{re.sub(r'[0-9]+', '0', marks[0])}" if marks else tag
            flags, outer = nodes[top][5:]
            n = nth[outer, sign] = nth[outer, sign] + 1
            if not flags & OTHER:
                if _other(tag, marks, bool(flags & ARTICLE)):
                    flags |= OTHER
                elif tag == "article":
                    flags |= ARTICLE
                elif tag == "main" or "main" in marks:
                    flags |= MAIN
            if tag == "a":
                flags |= LINK
            named = nodes[outer]
            new = len(nodes)
            nodes.append((top, outer, _hash(f"{named[2]}/{sign}[{n}]"), _hash(f"{named[3]}/{sign}") if block else named[3], tag, flags, new if block else outer))
            stack.append(new)
            opened[tag] += 1
        if at < end:
            t = source[at:]
            pieces.append((stack[-1], unescape(t) if "&" in t else t))
        flush()

    def text(self, b: int) -> str:
        """A block's text without pieces marked as other matter."""
        return " ".join("".join([t for e, t in self.blocks[b][1] if not self.nodes[e][5] & OTHER]).split())

    def shape(self) -> Shape:
        nodes, free, link, words = self.nodes, [], [], []
        for element, pieces in self.blocks:
            inside = [0, 0]
            for e, t in pieces:
                if not nodes[e][5] & OTHER:
                    inside[nodes[e][5] & LINK > 0] += len(t.strip())
            free.append(inside[0])
            link.append(inside[1])
            words.append(_hash(f"{nodes[element][3]}\0{' '.join(''.join([t for _, t in pieces]).split())}"))
        stops = [x[2] for x in nodes if x[4] in ("article", "main") and not x[5] & OTHER]
        return Shape([x[2] for x in nodes], [x[1] for x in nodes], [x[6] == e and x[4] not in _LEAF for e, x in enumerate(nodes)], words, [e for e, _ in self.blocks], self.before, free, link, stops)

    def main_text(self, host: Host | None = None) -> str:
        """Main text by the template of the host; by that of the page itself where the host's has no place on it."""
        shape = self.shape()
        if host and host.elements:
            free, _ = shape.slots(host.elements, host.words)
            inside = host.below()
            chosen = [b for box, gap, b in free if box in inside and not host.only_links(box, gap)]
            # Where the container is on the page and the template fills it, the page has no main text; nothing else takes its place.
            if chosen or host.container in shape.place:
                return self._joined(chosen, host.container, free)
        # The page as its own template: its places occur once and are one class.
        own = dict(zip(shape.place, (shape.place[u] if u >= 0 else None for u in shape.up)))
        free, _ = shape.slots(own, host.words if host else set())
        for flag in (ARTICLE, MAIN):
            if any(x[5] & flag and not x[5] & OTHER for x in self.nodes):
                return self._joined([b for _, _, b in free if self.nodes[self.blocks[b][0]][5] & flag], None, free)
        mass: dict[tuple[int, int], tuple[int, int]] = {}
        for box, _, b in free:
            x, y = mass.get((box, 0), (0, 0))
            mass[box, 0] = (x + shape.free[b], y + shape.link[b])
        alone = Host(own, set(), mass, set()).settle(set())
        inside = alone.below()
        return self._joined([b for box, _, b in free if box in inside and not alone.only_links(box, 0)], alone.container, free)

    def _joined(self, chosen: list[int], container: int | None, free: list[tuple[int, int, int]]) -> str:
        if chosen and container is not None and container != ROOT:
            # Headings right above the container name what it holds.
            up = {x[1] for x in self.nodes if x[2] == container}
            above = [b for _, _, b in free if b < chosen[0] and self.nodes[self.blocks[b][0]][4] in ("h1", "h2") and self.nodes[self.blocks[b][0]][1] in up]
            chosen = above + chosen
        return "\n\n".join([t for t in map(self.text, chosen) if t])


class Host:
    """The template of one host: its elements with their parents, its texts, and what its slots hold."""

    def __init__(self, parents: dict[int, int], words: set[int], mass: dict[tuple[int, int], tuple[int, int]], unordered: set[int]):
        self.elements, self.words, self.mass, self.unordered = parents, words, mass, unordered
        self.container, self.inside = ROOT, None

    def settle(self, stops: set[int]) -> Host:
        """Follow the free text down from the root."""
        total, kids = defaultdict(int), defaultdict(list)
        for (box, _), (plain, _) in self.mass.items():
            total[box] += plain
        for t, p in self.elements.items():
            kids[p].append(t)
        order = [ROOT]
        for t in order:
            order += kids[t]
        for t in reversed(order[1:]):
            total[self.elements[t]] += total[t]
        self.kids = kids
        at = ROOT
        while at not in stops and kids[at] and total[at]:
            best = max(kids[at], key=lambda c: (total[c], c))
            if total[best] < DOMINANT * total[at]:
                break
            at = best
        self.container = at
        return self

    def below(self) -> set[int]:
        """Template elements in the container."""
        if self.inside is None:
            order = [self.container]
            for t in order:
                order += self.kids[t]
            self.inside = set(order)
        return self.inside

    def only_links(self, box: int, gap: int) -> bool:
        plain, link = self.mass.get((box, 0 if gap in self.unordered else gap), (0, 0))
        return link > 4 * plain


def _host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


_SHAPE = "host string, page long, place array<long>, up array<int>, holds array<boolean>, words array<long>, element array<int>, before array<int>, free array<int>, link array<int>, stops array<long>"
_FIELDS = {"place": pa.int64(), "up": pa.int32(), "holds": pa.bool_(), "words": pa.int64(), "element": pa.int32(), "before": pa.int32(), "free": pa.int32(), "link": pa.int32(), "stops": pa.int64()}


def shapes(pages: DataFrame) -> DataFrame:
    """host, page (a hash), and the shape of each distinct page of a host: what the template is deduced from, without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            found = [Page(t).shape() for t in texts(part.column("text")).to_pylist()]
            cols = [pa.array([getattr(x, n) for x in found], pa.list_(k)) for n, k in _FIELDS.items()]
            yield pa.RecordBatch.from_arrays([part.column("host"), part.column("page"), *cols], names=["host", "page", *_FIELDS])

    held = pages.select(_host().alias("host"), F.col("html").alias("text"), F.xxhash64("html").alias("page"))
    return held.mapInArrow(run, _SHAPE).dropDuplicates(["host", "page"])


def template(shapes: DataFrame, support: float = SUPPORT, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, class, token, parent (of elements), is_text, pages, all (pages of the host): the nested classes of each host."""
    hosts = shapes.groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    parents = F.transform("up", lambda u: F.when(u >= 0, F.get("place", u)))
    elements = shapes.select("host", "page", F.explode(F.arrays_zip("place", parents.alias("parent"))).alias("t")).select("host", "page", F.col("t.place").alias("token"), "t.parent", F.lit(1).alias("times"), F.lit(False).alias("is_text"))
    words = shapes.select("host", "page", F.explode("words").alias("token")).groupBy("host", "page", "token").agg(F.count(F.lit(1)).cast("int").alias("times"))
    words = words.select("host", "page", "token", F.lit(None).cast("long").alias("parent"), "times", F.lit(True).alias("is_text"))
    mark = F.xxhash64("page", "times")
    # Halves of the hash, so that the sums of any number of pages stay within a long.
    sums = [F.count(F.lit(1)).alias("pages"), F.sum(mark.bitwiseAND(0x7FFFFFFF)).alias("v1"), F.sum(F.shiftrightunsigned(mark, 33)).alias("v2")]
    tokens = elements.unionByName(words).groupBy("host", "token", "parent", "is_text").agg(*sums)
    tokens = tokens.join(hosts, "host").where((F.col("pages") >= F.lit(support) * F.col("all")) & (F.col("all") >= min_pages))
    often = written(tokens.withColumn("class", F.xxhash64("host", "v1", "v2", "pages")), "html-often")
    company = often.groupBy("host", "class").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("host", "class")
    elements = often.where("not is_text").join(company, ["host", "class"], "left_semi")
    # A class nests where its elements' parents are in the template; one whose parents are not hangs in the air.
    above = elements.select("host", F.col("token").alias("parent")).distinct()
    nested = elements.join(above, ["host", "parent"], "left_semi").unionByName(elements.where("parent is null"))
    return nested.unionByName(often.where("is_text")).select("host", "class", "token", "parent", "is_text", "pages", "all")


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the pages of a batch: free and link text of slots (box, gap), orders (box, class, order) and stops (box)."""
    for part in batches:
        total: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
        rows = zip(*[part.column(c).to_pylist() for c in ("host", "elements", "template", *_FIELDS)])
        for host, elements, template, *fields in rows:
            page, kind = Shape(*fields), {x["token"]: x["class"] for x in elements}
            free, children = page.slots(kind, set(template))
            for box, gap, b in free:
                at = total[host, "slot", box, gap, 0]
                at[0] += page.free[b]
                at[1] += page.link[b]
            for box, inside in children.items():
                of = defaultdict(list)
                for t in inside:
                    of[kind[t]].append(t)
                for c, order in of.items():
                    if len(order) > 1:
                        total[host, "order", box, c, _hash(str(order))][0] += 1
            for box in kind.keys() & page.stops:
                total[host, "stop", box, 0, 0][0] += 1
        keys = list(total)
        kinds = {"host": pa.string(), "kind": pa.string(), "box": pa.int64(), "gap": pa.int64(), "order": pa.int64()}
        yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in keys], t) for i, t in enumerate(kinds.values())], *[pa.array([total[k][i] for k in keys], pa.int64()) for i in (0, 1)]], names=[*kinds, "n", "m"])


def _few(known: DataFrame, size) -> DataFrame:
    """Pages are not moved for a template that is counted to be small; beyond that they are dealt by host, and AQE splits large hosts."""
    return F.broadcast(known) if (known.agg(F.sum(size)).first()[0] or 0) <= SMALL_TEMPLATE else known


def slots(pages: DataFrame, support: float = SUPPORT, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, elements (token, parent, class), template (text tokens), slots (box, gap, free, link), unordered (tokens), stops."""
    seen = written(shapes(pages), "html-shapes")
    rows = written(template(seen, support, min_pages), "html-template")
    known = rows.groupBy("host").agg(
        F.collect_list(F.when(~F.col("is_text"), F.struct("token", "parent", "class"))).alias("elements"),
        F.collect_set(F.when(F.col("is_text"), F.col("token"))).alias("template"),
    )
    known = written(known, "html-hosts")
    held = seen.join(_few(known, F.size("elements") + F.size("template") + 4), "host")
    sums = held.mapInArrow(_slot_rows, "host string, kind string, box long, gap long, order long, n long, m long").groupBy("host", "kind", "box", "gap", "order").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    sums = written(sums, "html-slots")
    orders = sums.where("kind = 'order'").groupBy("host", "box", F.col("gap").alias("class")).agg((F.max("n") / F.sum("n")).alias("share"))
    loose = orders.where(F.col("share") < ORDERED).select("host", F.col("box").alias("parent"), "class")
    loose = rows.where("not is_text").join(loose, ["host", "parent", "class"], "left_semi").groupBy("host").agg(F.collect_set("token").alias("unordered"))
    held = sums.where("kind <> 'order'").groupBy("host").agg(
        F.collect_list(F.when(F.col("kind") == "slot", F.struct("box", "gap", "n", "m"))).alias("slots"),
        F.collect_set(F.when(F.col("kind") == "stop", F.col("box"))).alias("stops"),
    )
    return known.join(held, "host").join(loose, "host", "left")


def _settled(elements: list, words: list, slot: list, unordered: list | None, stops: list) -> Host:
    """The host's template with its container."""
    loose = set(unordered or ())
    mass: dict[tuple[int, int], tuple[int, int]] = {}
    for x in slot:
        key = x["box"], 0 if x["gap"] in loose else x["gap"]
        a, b = mass.get(key, (0, 0))
        mass[key] = (a + x["n"], b + x["m"])
    return Host({x["token"]: x["parent"] for x in elements}, set(words), mass, loose).settle(set(stops))


def extracted(pages: DataFrame, support: float = SUPPORT, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    tune(pages.sparkSession)
    known = written(slots(pages, support, min_pages), "html-known")
    held = pages.select("page_id", "url", F.col("html").alias("text"), _host().alias("host")).join(_few(known, F.size("elements") + F.size("template") + F.size("slots") + 4), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            settled: dict[str, Host | None] = {}
            out = []
            some = part.column("elements").is_valid().to_pylist()
            for i, (name, source) in enumerate(zip(part.column("host").to_pylist(), texts(part.column("text")).to_pylist())):
                if name not in settled:
                    settled[name] = _settled(*[part.column(c)[i].as_py() for c in ("elements", "template", "slots", "unordered", "stops")]) if some[i] else None
                out.append(Page(source).main_text(settled[name]))
            yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return held.mapInArrow(run, "page_id long, url string, text string, n_chars long")
