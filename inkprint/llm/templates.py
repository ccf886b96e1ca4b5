"""Main text of web pages by deducing the template of each host.

A page is a sequence of tokens: tags, and the runs of text between them, in their place in the tree. For every token of a host the occurrence vector says
how often it comes on each page. Tokens with equal vectors form an equivalence class; a class that is large and
found on nearly all pages of the host was put there by the template, not by the author. Valid classes that come once per page are nested
by their places: the outermost one cuts a page into slots, the next ones cut those slots further. Text of a class belongs to no slot. Where
tags do not tell the article (``article``, ``main``), the article's slots are those of the host with the most text that is
neither links nor scraps, judged over all pages of the host together.

Occurrence vectors are never gathered: each is summed into a signature (pages, occurrences, two sums of hashes of page and count),
so a host with any share of the pages costs each task one row per token. Equal vectors have equal signatures, others
differ but for a chance of about 2 ** -64. Slot statistics are sums as well.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm.base import map_rows
from inkprint.storage import match_rows, materialize

#: A class is valid with so many tokens, on so large a share of the pages of a host that has so many pages at least.
CLASS_TOKENS, SUPPORT, HOST_PAGES = 3, 0.9, 4
#: Share of a page's text that its articles must hold to be all of its main text.
ARTICLE_SHARE = 0.3
#: A slot belongs to the article if no more of its words than this are links, its blocks are at least so long against those of the
#: host's largest slot, and it has at least so many words against it.
LINK_SHARE, BLOCK_SHARE, WORD_SHARE = 0.5, 0.35, 0.02
#: Partial sums that a task holds before it hands them on.
HELD = 200_000

# The element names of HTML that matter here, and the words in class and id by which pages mark their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object".split())
BLOCKS = frozenset((
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
).split())
OUTSIDE = frozenset("head nav footer aside form menu button select dialog".split())
MARKS = frozenset((
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus "
    "footer masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related respond share sharing "
    "sidebar skip social sponsor sponsored subscribe toolbar widget"
).split())
# Words that say nothing beside such a mark ("site-footer"), and elements that are never marked by their names.
NEUTRAL = frozenset("site main page top bottom left right box block container wrapper wrap list item items bar area section global inner outer group".split())
NEVER_MARKED = frozenset("html body main article h1 h2 h3 h4 h5 h6 p".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/>"']*)([^>"']*)>""")
_STOP = re.compile(r"""[>"']""")
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE) for tag in RAW}
# Where a new element ends an open one: the open ones that it ends, kept apart by the elements that shield them.
_ENDS = {"li": "li", "td": "cell", "th": "cell", "tr": "row", "dd": "term", "dt": "term"}
_SHIELDS = frozenset("ul ol table dl div article".split())
_P_SHIELDS = frozenset("div article section td li main body".split())


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


class Node:
    """An open element: its path, whether it is outside the main text, inside an article or a link, and which open elements
    a new one would end: ``open`` maps paragraph, list item, cell, row and term to their depth on the stack."""

    __slots__ = ("tag", "path", "tag_outside", "mark_outside", "article", "link", "open")

    def __init__(self, tag: str, parent: Node | None, marked: bool, depth: int):
        self.tag = tag
        self.path = f"{parent.path}/{tag}" if parent and parent.path.count("/") < 12 else tag
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        self.tag_outside = bool(parent and parent.tag_outside) or tag in OUTSIDE or (tag == "header" and not self.article)
        self.mark_outside = tag != "main" and (marked or bool(parent and parent.mark_outside))
        self.link = tag == "a" or bool(parent and parent.link)
        found = parent.open if parent else {}
        if tag in _P_SHIELDS or tag in _SHIELDS:
            found = {k: d for k, d in found.items() if not (tag in _P_SHIELDS if k == "p" else tag in _SHIELDS)}
        kinds = {"p": ("p",), "li": ("li",), "td": ("cell",), "th": ("cell",), "tr": ("row",), "dd": ("term",), "dt": ("term",)}.get(tag, ())
        self.open = {**found, **dict.fromkeys(kinds, depth)} if kinds else found

    @property
    def outside(self) -> bool:
        return self.tag_outside or self.mark_outside


def is_mark(name: str) -> bool:
    """Whether one class or id name marks a part outside the text: all its words do, or say nothing beside one that does."""
    parts = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
    return any(w in MARKS for w in parts) and all(w in MARKS or w in NEUTRAL for w in parts)


class Scanner:
    """Finds the tags of a page, in time that grows with its length however broken it is."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        # Quotes of either kind after which no other follows, and places of quotes from which no end of a tag is reached.
        self.unmatched: set[str] = set()
        self.doomed: set[int] = set()

    def tag(self, at: int) -> tuple[int, str, str, bool] | None:
        """(end, name, attributes, closing) of the tag at ``at``; no name for comments and declarations, None if it is text."""
        page = self.page
        plain = _PLAIN.match(page, at) if at <= self.last else None
        if plain:
            return plain.end(), plain[2].lower(), plain[3], bool(plain[1])
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return (len(page) if end < 0 else end + 3), "", "", False
        if at > self.last:
            return None
        if page.startswith(("<!", "<?"), at):
            return page.find(">", at) + 1, "", "", False
        name = _NAME.match(page, at)
        if not name:
            return None
        end = self._end(name.end())
        return end + 1, name[1].lower(), page[name.end():end], page[at + 1] == "/"

    def _end(self, at: int) -> int:
        """The ``>`` that ends a tag: the first outside quotes, or the first at all if a quote is never closed."""
        page, start, passed = self.page, at, []
        while True:
            stop = _STOP.search(page, at)
            if stop is None:
                break
            if stop[0] == ">":
                return stop.start()
            if stop.start() in self.doomed:
                break
            passed.append(stop.start())
            close = -1 if stop[0] in self.unmatched else page.find(stop[0], stop.end())
            if close < 0:
                self.unmatched.add(stop[0])
                break
            at = close + 1
        self.doomed.update(passed)
        return page.find(">", start)


def events(page: str):
    """(kind, value, node) in page order: kind 't' for a tag with its path, 'x' for a run of text, 'b' for the edge of a block."""
    scanner, stack, at, text = Scanner(page), [Node("", None, False, 0)], 0, 0
    opened: Counter = Counter()

    def cut(depth: int) -> None:
        opened.subtract(n.tag for n in stack[depth:])
        del stack[depth:]

    while True:
        at = page.find("<" if at <= scanner.last else "<!--", at)
        if at < 0:
            break
        found = scanner.tag(at)
        if found is None:
            at += 1
            continue
        if at > text:
            yield "x", page[text:at], stack[-1]
        at, tag, rest, closing = found
        text = at
        if not tag:
            continue
        if closing:
            if tag in BLOCKS:
                yield "b", "", stack[-1]
            if opened[tag] > 0:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                path = stack[depth].path
                cut(depth)
                yield "t", "/" + path, stack[-1]
            continue
        if tag in BLOCKS:
            yield "b", "", stack[-1]
            for kind in ("row", "cell") if tag == "tr" else (_ENDS.get(tag), "p"):
                depth = stack[-1].open.get(kind)
                if depth:
                    cut(depth)
        names = sorted({n for m in _MARK.findall(rest) for n in "".join(m).split()}) if "=" in rest else []
        node = Node(tag, stack[-1], tag not in NEVER_MARKED and any(map(is_mark, names)), len(stack))
        yield "t", node.path + "".join(f".{n}" for n in names), stack[-1]
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = text = page.find(">", end.end()) + 1 if end and end.end() <= scanner.last else len(page)
        elif tag not in VOID and not rest.endswith("/"):
            stack.append(node)
            opened[tag] += 1
    if text < len(page):
        yield "x", page[text:], stack[-1]


_tag_hashes: dict[str, int] = {}


def token_hash(path: str, run: str = "") -> int:
    """The token of a tag, or of a run of text, in its place. Tags repeat, so theirs are remembered."""
    if run:
        return xxhash.xxh64_intdigest(f"{path}\0{run}") >> 1
    token = _tag_hashes.get(path)
    if token is None:
        if len(_tag_hashes) >= HELD:
            _tag_hashes.clear()
        token = _tag_hashes[path] = xxhash.xxh64_intdigest(path) >> 1
    return token


def _token(kind: str, value: str, node: Node) -> int | None:
    """The token of an event; none for the edge of a block and for white space."""
    if kind == "t":
        return token_hash(value)
    run = " ".join(value.split()) if kind == "x" else ""
    return token_hash(node.path, run) if run else None


def page_tokens(page: str) -> tuple[Counter, dict[int, int]]:
    """Counts of the tokens of a page, and the place where each first comes."""
    tokens = [t for t in (_token(*event) for event in events(page)) if t is not None]
    counts, first = Counter(tokens), {}
    for place, token in enumerate(tokens):
        first.setdefault(token, place)
    return counts, first


SIGNATURE = "host string, token bigint, pages bigint, total bigint, s1 bigint, s2 bigint, place bigint"


def _signatures(batches):
    """Sums per host and token over the rows of a task; token 0 counts the pages."""
    held: dict[tuple[str, int], list[int]] = {}

    def out() -> pa.RecordBatch:
        rows = [(host, token, *sums) for (host, token), sums in held.items()]
        held.clear()
        columns = list(zip(*rows)) or [()] * 7
        kinds = [pa.string()] + [pa.int64()] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "token", "pages", "total", "s1", "s2", "place"],
        )

    for batch in batches:
        ids, hosts, pages = (batch.column(i).to_pylist() for i in range(3))
        for page_id, host, page in zip(ids, hosts, pages):
            counts, first = page_tokens(page or "")
            counts[0], first[0] = 1, 0
            for token, n in counts.items():
                mixed = xxhash.xxh64_intdigest(f"{page_id}/{n}")
                sums = held.get((host, token))
                if sums is None:
                    held[host, token] = [1, n, mixed & 0xFFFFFFFF, mixed >> 32, first[token]]
                else:
                    sums[0] += 1
                    sums[1] += n
                    sums[2] += mixed & 0xFFFFFFFF
                    sums[3] += mixed >> 32
                    sums[4] += first[token]
            if len(held) > HELD:
                yield out()
    yield out()


def distinct_pages(pages: DataFrame) -> DataFrame:
    """page_id, host, html of every different page of a host, once each; page_id is the hash of its content.

    Copies show nothing about a template: what they share may be the article. Hashes are counted, and only pages that
    have copies are shuffled, after each task has left out its own.
    """
    keyed = pages.select(F.md5(F.concat_ws("\0", "host", F.coalesce("html", F.lit(""))).cast("binary")).alias("content"), "page_id", "host", "html")
    copied = materialize(keyed.groupBy("content").agg(F.count("*").alias("n")).where("n > 1").select("content"), "copied")
    single = match_rows(keyed, copied, "content", "left_anti", "page_id").select("content", "host", "html")
    repeated = match_rows(keyed, copied, "content", "left_semi", "page_id").groupBy("content", "host").agg(F.first("html").alias("html"))
    return single.union(repeated).withColumnRenamed("content", "page_id")


def deduce_templates(pages: DataFrame) -> DataFrame:
    """host, classes, once: the valid equivalence classes of each host, outermost first, each in the order of its tokens on the page,
    and how many of them, the first, come once per page.

    ``pages`` has page_id, host and html; every row counts as a page with an id of its own, so copies are to be left out before
    (``distinct_pages``). Hosts with fewer than HOST_PAGES pages have no template.
    """
    partial = pages.select("page_id", "host", "html").mapInArrow(_signatures, SIGNATURE)
    sums = partial.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "total", "s1", "s2", "place")])
    sums = materialize(sums.where(f"pages >= {HOST_PAGES}"), "signatures")
    hosts = sums.where("token = 0").select("host", F.col("pages").alias("host_pages"))
    frequent = sums.where("token != 0").join(hosts, "host").where(F.col("pages") >= SUPPORT * F.col("host_pages"))
    classes = frequent.groupBy("host", "pages", "total", "s1", "s2").agg(
        F.sort_array(F.collect_list(F.struct("place", "token"))).alias("members"),
    ).where(F.size("members") >= CLASS_TOKENS)
    order = F.struct((F.col("total") / F.col("pages")).alias("per_page"), (-F.size("members")).alias("size"), F.col("members.token").alias("tokens"))
    nested = classes.groupBy("host").agg(F.sort_array(F.collect_list(order)).alias("c"))
    return nested.select("host", F.col("c.tokens").alias("classes"), F.size(F.filter("c", lambda c: c["per_page"] == 1)).alias("once"))


class Layout:
    """A parsed page, cut into slots by the template of its host and into blocks of text.

    ``blocks`` holds (slot, text, own, heading, outside, article, words, link_words) in page order. A slot is named by the token of
    the nested template that it follows, 0 at the start; ``own`` says that the block is not made of template text alone.
    """

    def __init__(self, page: str, classes: list[list[int]] | None = None, once: int = 0):
        parsed = list(events(page))
        self.template, self.cuts = _template_of(parsed, classes or [], once)
        self.blocks: list[tuple] = []
        words: list[str] = []
        slot, state = 0, None
        links = 0

        def close() -> None:
            nonlocal state, links
            text = " ".join(html.unescape("".join(words)).split())
            if text and state:
                first_slot, own, node = state
                self.blocks.append((first_slot, text, own, node.tag in HEADINGS, node.outside, node.article, text.count(" ") + 1, links))
            words.clear()
            state, links = None, 0

        for kind, value, node in parsed:
            if kind == "b":
                close()
            elif kind == "t":
                token = token_hash(value) if self.cuts else None
                if token in self.cuts:
                    slot = token
                if value.endswith("/br"):
                    words.append(" ")
            elif state and node.outside and not state[2].outside:
                continue  # an advert inside a paragraph
            elif value.strip():
                if state and state[2].outside != node.outside:
                    close()
                own = not self.template or _token(kind, value, node) not in self.template
                state = (state[0], state[1] or own, state[2]) if state else (slot, own, node)
                links += len(value.split()) if node.link else 0
                words.append(value)
            elif state:
                words.append(value)
        close()

    def by_tags(self) -> bool:
        """Whether articles hold enough of the page's text to be the main text by themselves."""
        inside = sum(b[6] for b in self.blocks if b[5] and not b[4])
        return inside > 0 and inside >= ARTICLE_SHARE * sum(b[6] for b in self.blocks if not b[4] and b[2])

    def text(self, article: frozenset[int] | set[int] | None = None) -> str:
        """The blocks of the article, one line each: those in article elements, else those in the slots ``article``, else all.

        A heading goes with the block that follows it.
        """
        by_tags = self.by_tags()
        out: list[str] = []
        headings: list[str] = []
        for slot, text, own, heading, outside, in_article, _, _ in self.blocks:
            if outside or not own or by_tags and not in_article:
                continue
            if by_tags or not article:
                out.append(text)
            elif slot in article:
                out += [*headings, text]
                headings = []
            elif heading:
                headings.append(text)
            else:
                headings = []
        return "\n".join(out)


def extract(page: str | None, classes: list[list[int]] | None = None, once: int = 0, article: list[int] | None = None) -> str:
    """The main text of one page: its blocks in page order, one line each; white space inside a block is one blank.

    Kept are the blocks of the article's elements, or where a page has none or next to none, those of the slots ``article``, or
    of the whole body, that lie outside menus, headers, footers, sidebars, forms, notices, adverts and comments. A block made
    up of template text alone belongs to no slot. The first ``once`` classes come once per page.
    """
    return Layout(page, classes, once).text(set(article or ())) if page else ""


def _template_of(parsed: list, classes: list[list[int]], once: int) -> tuple[set[int], set[int]]:
    """The template's tokens on this page, and those of them that cut it into slots.

    Classes are taken outermost first. One that is found on the page with enough of its tokens in their order is valid; those that
    come once per page cut the slots that the classes around them left, so that the innermost cut names the slot.
    """
    if not classes:
        return set(), set()
    wanted = {t for c in classes for t in c}
    first: dict[int, int] = {}
    for event in parsed:
        token = _token(*event)
        if token in wanted:
            first.setdefault(token, len(first))
    valid: set[int] = set()
    cuts: set[int] = set()
    for i, members in enumerate(classes):
        places = [first[t] for t in members if t in first]
        if len(places) >= CLASS_TOKENS and places == sorted(places):
            valid.update(members)
            if i < once:
                cuts.update(members)
    return valid, cuts


SLOTS = "host string, slot bigint, words bigint, links bigint, blocks bigint"


def _slot_sums(batches):
    """Sums per host and slot over the pages of a task whose articles are not told by tags."""
    held: dict[tuple[str, int], list[int]] = {}

    def out() -> pa.RecordBatch:
        rows = [(host, slot, *sums) for (host, slot), sums in held.items()]
        held.clear()
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.string()] + [pa.int64()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "slot", "words", "links", "blocks"])

    for batch in batches:
        for host, page, classes, once in zip(*(batch.column(i).to_pylist() for i in range(4))):
            layout = Layout(page or "", classes, once or 0)
            if layout.by_tags():
                continue
            for slot, _, own, heading, outside, _, words, links in layout.blocks:
                if own and not outside and not heading:
                    sums = held.setdefault((host, slot), [0, 0, 0])
                    sums[0] += words
                    sums[1] += links
                    sums[2] += 1
            if len(held) > HELD:
                yield out()
    yield out()


def article_slots(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """host, article: the slots that hold the articles of hosts whose pages do not tell by ``article`` or ``main``.

    ``pages`` are the different pages of the hosts (host, html), ``templates`` has host, classes and once. The largest slot of a host
    is the one with the most words that are no links; others belong to the article too if they are like it.
    """
    untold = pages.where(~F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    sums = untold.join(templates, "host").select("host", "html", "classes", "once").mapInArrow(_slot_sums, SLOTS)
    slots = sums.groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in ("words", "links", "blocks")])
    slots = slots.withColumn("plain", F.col("words") - F.col("links")).withColumn("per_block", F.col("plain") / F.col("blocks"))
    slots = materialize(slots, "slots")
    best = slots.groupBy("host").agg(F.max(F.struct("plain", "per_block", "slot")).alias("best"))
    alike = (
        (F.col("links") <= LINK_SHARE * F.col("words")) & (F.col("per_block") >= BLOCK_SHARE * F.col("best.per_block"))
        & (F.col("plain") >= WORD_SHARE * F.col("best.plain"))
    )
    return slots.join(best, "host").where(alike | (F.col("slot") == F.col("best.slot"))).groupBy("host").agg(F.sort_array(F.collect_list("slot")).alias("article"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Templates are deduced from the different pages of a host: copies, also under other addresses, count once, and a host with fewer
    than HOST_PAGES different pages has no template. Null and empty pages give empty texts. Pages without url are those of one nameless host. Repeated rows stay rows; other
    columns are ignored.
    """
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    different = distinct_pages(rows)
    templates = materialize(deduce_templates(different), "templates")
    told = templates.join(article_slots(different, templates), "host", "left")

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        texts = [extract(h, c, o or 0, a) for h, c, o, a in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    joined = rows.join(told, "host", "left").select("page_id", "url", "html", "classes", "once", "article")
    return map_rows(joined, run, "page_id bigint, url string, text string, n_chars bigint", rows=128)
