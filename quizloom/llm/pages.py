"""HTML extraction by template deduction over the pages of a host.

1. Tokens.  A page's tokens are its elements, told apart by their paths (tag, class, id and,
   where a container has neither, its number among such siblings), as far as they give
   structure, and its blocks of text, each with the path around it.
2. Equivalence classes.  For each host, tokens with the same occurrence vector - the same
   number of occurrences on every page - form a class.  Pages with one and the same main text, as
   a page's own elements tell it, are copies and count as one page: an article under many
   addresses isn't the host's fixed text.  A vector isn't gathered: it is summed up as two sums of
   hashes of (page, count), so that a host with a third of all pages is a partial aggregate
   like any other.
3. Template.  A class is valid if it has at least ``MIN_TOKENS`` tokens and occurs on at
   least ``MIN_PAGES`` and half of the host's pages.  Valid classes nest by their paths.
   The template is their elements and their texts, which are the host's fixed text.
4. Slots.  What varies between the template's elements are its slots.  The main slot is
   found from the root inwards: the template element that holds most of the varying text
   of the one around it, over all pages of the host; an article or main that is a template
   element inside it narrows it further.
5. Fixed text in the main slot.  A fixed text there is the host's only if the pages that have it
   differ in what else they have in the slot, and have more of that than of fixed text; else it
   belongs to an article that several pages share, and stays.
6. Extraction.  A page's text is what it has in the main slot, less the host's fixed text and less
   elements nested in the slot that are furniture by element, role or name.  If nothing would be
   left of a slot, its fixed text stays.

Without a template, and where less than one part in ``DOUBTFUL`` of a host's text varies (its pages
may be versions of one, so that what varies tells nothing about where the article is), names and
roles decide alone: the main slot is the page's largest article, else its main, else the innermost element that
holds most of the text of the one around it.  Names make no furniture of an element that is
or holds that slot.

A page without its host's main slot, or on a host without a template, is judged by its own
elements.

Defined results: a null html is empty, so is its text; pages with a null or malformed url
share no template; equal pages and repeated rows give equal rows (copies count as one page of
the host); unclosed and misnested elements are closed as their parents are; an empty
table gives none; hosts that are partly copies lose no article; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Container, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written

MIN_TOKENS, MIN_PAGES = 3, 5
#: Where less than one part in so many of a host varies, the main slot is told by names, not by what varies.
DOUBTFUL = 5
#: Bytes of main slots and fixed texts that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20

# Element names of HTML by their role.
RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|title"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav header footer aside form button dialog menu head fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
FURNITURE_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|banner|cookies?|consent|gdpr|notice|notification|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead"
    r"|comments?|replies|respond|disqus|promo\w*|sponsor\w*|share|sharing|social|related|recommended|newsletter|subscribe|signup|popup|modal|overlay|widget|toolbar|pagination|pager)(?:$|[-_\s])",
    re.I,
)
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSES_OWN = frozenset("li dt dd tr td th option".split())
CONTAINERS = frozenset("div section table tr td".split())
TEXTUAL = HEADINGS | frozenset("p li td tr ul ol table blockquote pre dl dd dt".split())

_ATTRIBUTES = r"""(?:"[^"]*"|'[^']*'|[^'">])*"""
MARKUP = re.compile(rf"<!--.*?(?:-->|$)|<({RAW})\b{_ATTRIBUTES}>.*?(?:</\1\s*>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|$)", re.S | re.I)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def token_of(path: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\n{text}") - (1 << 63)


def tag_of(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0]


class Page:
    """Elements and blocks of a page in order, and what of them isn't furniture by the page itself."""

    def __init__(self, source: str):
        self.blocks: list[tuple[tuple[str, ...], str]] = []  # of what isn't furniture
        self.elements = elements = []  # (parent, tag, path, in furniture by element or role, named like furniture, furniture itself)
        self.found: list[tuple[int, str]] = []  # all blocks with their innermost elements
        found, siblings = self.found, Counter()
        stack: list[tuple[str, int]] = []  # (tag, element)
        text: list[str] = []

        def end_block() -> None:
            if text:
                joined = " ".join(entities.unescape("".join(text)).split())
                if joined:
                    found.append((stack[-1][1] if stack else -1, joined))
                text.clear()

        def pop(tag: str, within: frozenset[str] = frozenset()) -> None:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    end_block()
                    del stack[i:]
                    return
                if stack[i][0] in within:
                    return

        at = 0
        for m in MARKUP.finditer(source):
            if m.start() > at:
                text.append(source[at : m.start()])
            at = m.end()
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in INLINE:
                continue
            if tag in VOID:
                if tag == "hr":
                    end_block()
                else:
                    text.append(" ")
                continue
            if m[2]:
                pop(tag)
                continue
            if tag in CLOSES_P:
                pop("p", frozenset(("article", "main", "section", "div", "td", "body")))
            elif tag in CLOSES_OWN:
                pop(tag, frozenset(("ul", "ol", "dl", "table", "select")))
            end_block()
            named = {k.lower(): a or b or c for k, a, b, c in NAMED.findall(m[4])} if m[4] else {}
            parent = stack[-1][1] if stack else -1
            label = self._label(tag, named)
            if label in CONTAINERS:
                siblings[parent, label] += 1
                if siblings[parent, label] > 1:
                    label = f"{tag}.[{siblings[parent, tag]}]"
            own = self._is_furniture(tag, named, [t for t, _ in stack])
            path = f"{elements[parent][2]}/{label}" if stack else label
            stack.append((tag, len(elements)))
            elements.append((parent, tag, path + "!" * own, own or (parent >= 0 and elements[parent][3]), self._is_named(tag, named), own))
        text.append(source[at:])
        end_block()
        self._settle()

    @staticmethod
    def _label(tag: str, named: dict[str, str]) -> str:
        names = ".".join((named.get("class") or "").split()) + "#" * bool(named.get("id")) + (named.get("id") or "")
        return f"{tag}.{names}" if names else tag

    def _settle(self) -> None:
        """Keeps what isn't furniture; a name makes none of the element that is or holds the main slot."""
        elements, found = self.elements, self.found
        held = [0] * len(elements)
        total = 0
        for at, text in found:
            if at < 0 or not elements[at][3]:
                total += len(text)
                if at >= 0:
                    held[at] += len(text)
        for i in range(len(elements) - 1, -1, -1):
            if elements[i][0] >= 0:
                held[elements[i][0]] += held[i]
        slot = -1
        for tag in ("article", "main"):
            if slot < 0:
                slot = max((i for i, e in enumerate(elements) if e[1] == tag and held[i]), key=lambda i: (held[i], -i), default=-1)
        if slot < 0:
            main = {i for i, n in enumerate(held) if 2 * n > total}
        else:
            main = set()
            while slot >= 0:
                main.add(slot)
                slot = elements[slot][0]
        gone: list[bool] = []
        around: list[tuple[str, ...]] = []
        for i, (parent, _, path, furniture, named, _) in enumerate(elements):
            gone.append(furniture or (parent >= 0 and gone[parent]) or (named and i not in main))
            around.append((*(around[parent] if parent >= 0 else ()), path))
        self.blocks = [(around[at] if at >= 0 else (), text) for at, text in found if at < 0 or not gone[at]]

    @staticmethod
    def _is_furniture(tag: str, named: dict[str, str], around: list[str]) -> bool:
        if tag in FURNITURE:
            # an article's own header holds its headings
            return not (tag == "header" and any(t in MAIN for t in around))
        return named.get("role", "").lower() in FURNITURE_ROLES

    @staticmethod
    def _is_named(tag: str, named: dict[str, str]) -> bool:
        if tag in ("html", "body", "main", "header") or tag in HEADINGS:
            return False
        return any(FURNITURE_NAMES.search(named.get(k) or "") for k in ("class", "id"))

    def tokens(self) -> Iterator[tuple[str, int | None, int, int]]:
        """(path, text's hash or None for an element, occurrences, characters of text)."""
        held = [0] * len(self.elements)
        texts: Counter = Counter()
        sizes: dict[tuple[str, int], int] = {}
        for at, text in self.found:
            path = self.elements[at][2] if at >= 0 else ""
            token = (path, token_of(path, text))
            texts[token] += 1
            sizes[token] = len(text)
            if at >= 0:
                held[at] += len(text)
        for i in range(len(held) - 1, -1, -1):
            if self.elements[i][0] >= 0:
                held[self.elements[i][0]] += held[i]
        times, chars = Counter(), Counter()
        for i, e in enumerate(self.elements):
            times[e[2]] += 1
            chars[e[2]] += held[i]
        yield from ((path, None, n, chars[path]) for path, n in times.items())
        yield from ((*token, n, n * sizes[token]) for token, n in texts.items())

    def blocks_in(self, slot: str) -> list[tuple[int, str]] | None:
        """(token, text) of the blocks in the host's main slot but for nested furniture; None if the page hasn't the slot."""
        n = len(self.elements)
        inside, gone, held = [False] * n, [False] * n, [0] * n
        for at, text in self.found:
            if at >= 0:
                held[at] += len(text)
        for i in range(n - 1, -1, -1):
            if self.elements[i][0] >= 0:
                held[self.elements[i][0]] += held[i]
        whole = sum(held[i] for i, e in enumerate(self.elements) if e[2] == slot)
        header = [False] * n
        for i, (parent, tag, path, _, named, furniture) in enumerate(self.elements):
            if parent >= 0 and inside[parent]:
                inside[i], header[i] = True, header[parent] or tag == "header"
                gone[i] = gone[parent] or furniture or (named and 2 * held[i] <= whole)
            else:
                inside[i] = path == slot
        if True not in inside:
            return None
        # of an article's header only the headings
        return [
            (token_of(self.elements[at][2], text), text)
            for at, text in self.found
            if at >= 0 and inside[at] and not gone[at] and (not header[at] or self.elements[at][1] in HEADINGS)
        ]

    def text_in(self, slot: str, fixed: Container[int]) -> str | None:
        """The text in the host's main slot but for its fixed text, unless that is all there is."""
        blocks = self.blocks_in(slot)
        if blocks is None:
            return None
        return "\n".join(x for token, x in blocks if token not in fixed) or "\n".join(x for _, x in blocks) or None

    def own_text(self) -> str:
        """The text that the page's own elements, names and roles tell."""
        return self.text_of(main_slot(self.chars()))

    def chars(self) -> dict[str, int]:
        """Characters of text in each element that isn't furniture."""
        found: dict[str, int] = {}
        for paths, text in self.blocks:
            for p in set(paths):
                found[p] = found.get(p, 0) + len(text)
        return found

    def text_of(self, slot: str | None) -> str:
        parts = []
        for paths, text in self.blocks:
            if slot is not None and slot not in paths:
                continue
            if any(p.rpartition("/")[2].partition(".")[0] == "header" for p in paths) and paths[-1].rpartition("/")[2].partition(".")[0] not in HEADINGS:
                continue  # of an article's header only the headings
            parts.append(text)
        return "\n".join(parts)


def main_slot(chars: dict[str, int]) -> str | None:
    """The path of the main slot among elements that hold text and aren't furniture."""
    mains = [p for p, n in chars.items() if tag_of(p) in MAIN and n]
    if mains:
        return _largest_main(mains, chars)
    root = max((p for p in chars if "/" not in p), key=lambda p: (chars[p], p), default=None)
    return root and _innermost(root, chars)


def _largest_main(mains: list[str], chars: dict[str, int]) -> str:
    articles = [p for p in mains if tag_of(p) == "article"] or mains
    # nested articles belong to the outermost
    return max((p for p in articles if not any(p.startswith(q + "/") for q in articles)), key=lambda p: (chars[p], p))


def _innermost(at: str, chars: dict[str, int]) -> str:
    """From an element inwards, as long as one element holds most of the text."""
    while True:
        inner = [p for p in chars if p.startswith(at + "/") and "/" not in p[len(at) + 1 :] and tag_of(p) not in TEXTUAL and p[-1] != "!"]
        best = max(inner, key=lambda p: (chars[p], p), default=None)
        if best is None or 2 * chars[best] <= chars[at]:
            return at
        at = best


def deduced_slot(elements: list[tuple[str, int]], fixed: list[tuple[int, str, int]]) -> str | None:
    """The main slot of a template of elements (path, characters) and fixed texts (token, path, characters)."""
    varying = dict(elements)
    for _, path, n in fixed:
        at = path
        while at:
            if at in varying:
                varying[at] -= n
            at = at.rpartition("/")[0]
    roots = [p for p in varying if "/" not in p]
    if not roots:
        return None
    root = max(roots, key=lambda p: (varying[p], p))
    if DOUBTFUL * varying[root] < dict(elements)[root] or not varying[root]:
        return None
    slot = _innermost(root, varying)
    mains = [p for p in varying if p.startswith(slot + "/") and tag_of(p) in MAIN and varying[p]]
    return _largest_main(mains, varying) if mains else slot


def _host(url):
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def templates(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, template, fixed): the elements (path, chars) and texts (token, path, chars) of the host's valid classes."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["host", "page", "path", "token", "n", "chars"], [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]  # page: its main text
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = []
                for host, source in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                    page = Page(source)
                    text = xxhash.xxh3_64_intdigest(page.own_text()) - (1 << 63)
                    rows.extend((host, text, *token) for token in page.tokens())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    named = pages.select(_host(F.col(url)).alias("host"), F.col(html).alias("html")).where("host IS NOT NULL AND html IS NOT NULL")
    found = named.mapInArrow(tokens, "host string, page long, path string, token long, n long, chars long")
    part = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), "page", "n"), F.lit(1 << 31)))
    # copies count as one page, which has what any of them has
    found = found.groupBy("host", "path", "token", "page").agg(F.max("n").alias("n"), F.max("chars").alias("chars"))
    vectors = found.groupBy("host", "path", "token").agg(part(1).alias("v1"), part(2).alias("v2"), F.count(F.lit(1)).alias("on_pages"), F.sum("chars").alias("chars"))
    # tokens of few pages go before anything is joined or gathered; a host that loses its most frequent path so has no valid class
    vectors = written(vectors.where(F.col("on_pages") >= MIN_PAGES))
    hosts = vectors.groupBy("host").agg(F.max("on_pages").alias("host_pages"))
    often = vectors.join(hosts, "host").where("2 * on_pages >= host_pages").drop("host_pages")
    same = ["host", "v1", "v2", "on_pages"]
    valid = often.groupBy(*same).agg(F.count(F.lit(1)).alias("n_tokens")).where(F.col("n_tokens") >= MIN_TOKENS).select(*same)
    tokens_of = often.join(valid, same, "left_semi")
    elements = F.when(F.col("token").isNull(), F.struct("path", "chars"))
    texts = F.when(F.col("token").isNotNull(), F.struct("token", "path", "chars"))
    return tokens_of.groupBy("host").agg(F.array_sort(F.collect_list(elements)).alias("template"), F.array_sort(F.collect_set(texts)).alias("fixed"))


def main_slots(found: DataFrame) -> DataFrame:
    """(host, slot, fixed): the main slot of each host's template and the tokens of the fixed texts in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                host, template, fixed = (c[i].as_py() for c in batch.columns)
                texts = [(t["token"], t["path"], t["chars"]) for t in fixed]
                slot = deduced_slot([(t["path"], t["chars"]) for t in template], texts)
                inside = [token for token, path, _ in texts if slot is not None and f"{path}/".startswith(f"{slot}/")]
                yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([slot], pa.string()), pa.array([inside], pa.list_(pa.int64()))], names=["host", "slot", "fixed"])

    return found.select("host", "template", "fixed").mapInArrow(run, "host string, slot string, fixed array<long>").where("slot IS NOT NULL")


def _beside(named: DataFrame, slots: DataFrame, how: str) -> DataFrame:
    """Pages with their host's slot and fixed texts, which are broadcast if they are small."""
    size = slots.agg(F.sum(F.octet_length("host") + F.octet_length("slot") + 8 * F.size("fixed"))).first()[0] or 0
    joined = named.join(F.broadcast(slots) if size <= BROADCAST_BYTES else slots, "host", how)
    return joined.select("page_id", "url", "html", "host", "slot", "fixed")


def _pages_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[Page, str | None, str | None, frozenset[int]]]]]:
    """Slices of batches of (page_id, url, html, host, slot, fixed) with their parsed pages."""
    host, slot, fixed = None, None, frozenset()
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            piece, found = batch.slice(start, 1024), []
            for i, (source, name, path) in enumerate(zip(*(piece.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                if path is not None and (name, path) != (host, slot):
                    host, slot, fixed = name, path, frozenset(piece.column(5)[i].as_py())
                found.append((Page(source or ""), name, path, fixed))
            yield piece, found


def settled(named: DataFrame, slots: DataFrame) -> DataFrame:
    """Main slots with those fixed texts that are the host's: the rest of the slot differs and outweighs them."""
    doubtful = slots.where(F.size("fixed") > 0)
    if doubtful.isEmpty():
        return slots

    def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _pages_of(batches):
            rows = []
            for page, host, slot, fixed in found:
                blocks = page.blocks_in(slot) or []
                rest = [x for token, x in blocks if token not in fixed]
                digest, size = xxhash.xxh3_64_intdigest("\n".join(rest)) - (1 << 63), sum(map(len, rest))
                out = sum(len(x) for token, x in blocks if token in fixed)
                rows.extend((host, token, digest, size, out) for token in {token for token, _ in blocks if token in fixed})
            if rows:
                kinds = (pa.string(), *[pa.int64()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["host", "token", "rest", "size", "out"])

    told = _beside(named, doubtful, "inner").mapInArrow(rests, "host string, token long, rest long, size long, out long")
    told = told.groupBy("host", "token").agg((F.min("rest") != F.max("rest")).alias("differ"), (F.sum("size") > F.sum("out")).alias("outweighed"))
    own = told.where("differ AND outweighed").groupBy("host").agg(F.array_sort(F.collect_list("token")).alias("own"))
    none = F.array().cast("array<long>")
    return slots.join(own, "host", "left").select("host", "slot", F.coalesce("own", none).alias("fixed"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    named = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), _host(F.col(url)).alias("host"))
    with scratch() as keep:
        slots = written(main_slots(templates(pages, url, html)))
        known = keep(written(settled(named, slots)))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, found in _pages_of(batches):
            out = []
            for page, _, slot, fixed in found:
                text = page.text_in(slot, fixed) if slot is not None else None
                out.append(page.own_text() if text is None else text)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return _beside(named, known, "left").mapInArrow(texts, f"page_id {pages.schema[key].dataType.simpleString()}, url string, text string, n_chars long")
