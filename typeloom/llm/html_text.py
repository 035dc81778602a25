"""Main text of web pages by equivalence-class template deduction (operator 2).

Pages of a host share a template. Each page is read as a sequence of structural tokens: an element with its
path of tags, classes and ids, or a text together with its path. Tokens that occur equally often on
every page of a host (equal occurrence vectors) form an equivalence class, if they stand in the same nest: a token belongs to the
class around it with its vector, or else to a class within the innermost one around it, so that classes form a tree. Counted are tokens
on at least ``min_share`` of the host's pages (and two pages), texts on ``min_text_share`` of them (and three); copies of one page are no
evidence. Classes of at least ``min_class`` tokens are valid and make up the host's template.
What stands between template tokens are the slots, each known by its innermost template
element. Texts that are template tokens are no content, inside an article either. Slots are labelled by role: those in menus, headers,
footers, sidebars, notices, adverts, forms and reader comments are dropped, which a tag, a role, or the whole of a class or id says: a name with a word
in it that says anything else (``social-policy``) drops nothing, nor does the id of a heading. Of the others, the slots of a page's article element are the text, however long what stands
around it is. Several article elements side by side may be the parts of a list, so what is around them in the main element (the page, if
it has none) counts too, except slots that are lists of links. A page without an article has the text of its main element, else all
slots that are not lists of links. Reading and extraction take time and memory in proportion to the page.

Vectors are compared by sums of hashes of (page, count), which Spark adds up by host and token; so no host's pages
meet in one task. Templates go to the pages by broadcast if they have at most
``broadcast_tokens`` tokens, by a join on the host beyond that.

Defined cases: null or empty html gives an empty text; a null url is a host of its own; pages cut off anywhere
are read to their end; repeated rows are extracted each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg xmp noframes object select".split())
FORMATTING = frozenset("a abbr b bdi bdo big cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var ins del".split())
DROPPED_TAGS = frozenset("head nav footer aside form button menu dialog fieldset audio video canvas datalist".split())
FENCES = frozenset("article main section nav aside header footer body table td th form".split())
LISTS = frozenset("ul ol dl table".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of classes, ids and roles that mark what is not the article, if all other words of the name are of those below.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner popup modal overlay cookie cookies consent gdpr notice notices notification alert "
    "sidebar aside widget nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc footer foot colophon copyright masthead topbar toolbar "
    "share sharing social related recommended trending popular newsletter subscribe subscription signup signin login register search form "
    "complementary contentinfo skip hidden".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist respond replies disqus discussion".split())
HEADER_WORDS = frozenset("header banner".split())
#: Words that say where something stands or what it looks like, not what it is about.
PLACES = frozenset(
    "wrapper wrap container content inner outer box block section area row list items item group panel holder bar slot unit zone space thread trail "
    "site page post entry reader user visitor global top bottom left right upper lower primary secondary main sub mobile desktop sticky fixed floating inline mini "
    "button buttons link links posts articles stories icon icons label message messages cta legal privacy visually wp js ui fb no by for us".split()
)
#: Ends of names that say that something is the article, or around it.
KEPT_WORDS = frozenset("main article post entry story body page text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NEGATED = frozenset("with has no without".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[a-z]+")
_HUMPS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SEEN: dict[str, tuple[bool, bool, bool]] = {}


def name_says(name: str) -> tuple[bool, bool, bool]:
    """Whether a class, id or role marks something to drop, a header, or comments."""
    known = _SEEN.get(name)
    if known is None:
        words = [w for w in _WORDS.findall(_HUMPS.sub(" ", name).lower()) if len(w) > 1]
        found = set(words)
        if _NEGATED & found:
            words, found = [], set()
        about = [w for w in words if w not in PLACES or w in KEPT_WORDS]
        kept = bool(about) and about[-1] in KEPT_WORDS

        def only(wanted: frozenset[str]) -> bool:
            return bool(found & wanted) and found <= wanted | DROPPED_WORDS | HEADER_WORDS | COMMENT_WORDS | PLACES | KEPT_WORDS

        known = (not kept and only(DROPPED_WORDS), not kept and only(HEADER_WORDS), only(COMMENT_WORDS))
        if len(_SEEN) < 10_000:
            _SEEN[name] = known
    return known


NONE, ARTICLE, MAIN = 0, 1, 2
_MASK = (1 << 63) - 1


#: The rest of a tag: quotes count after an equals sign, if they close. Nothing is given back, so this takes linear time.
_REST = re.compile(r"""(?:[^>="']++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+>""")


class Block(NamedTuple):
    """A run of text: what it belongs to, and its place in the page's tree of elements."""

    role: int
    dropped: bool
    text: str
    token: int
    linked: int  # characters that are links
    node: int
    article: int  # the node of the outermost article element around it, 0 outside


class _Open(NamedTuple):
    """An open element; ``fence``, ``stop`` and ``block`` are the places of the innermost ones of these kinds up to it."""

    tag: str
    token: int
    dropped: bool
    role: int
    node: int
    article: int
    in_link: bool
    fence: int
    stop: int
    block: int


class Page:
    """One page's tokens and blocks, and the tree of its elements (``tree``: token and parent of each node)."""

    def __init__(self, html: str | None):
        self.tokens: dict[int, int] = {}
        self.parents: dict[int, int] = {}
        self.texts: set[int] = set()  # tokens that are texts
        self.blocks: list[Block] = []
        self.tree: list[tuple[int, int]] = [(1, -1)]
        self._stack: list[_Open] = [_Open("", 1, False, NONE, 0, 0, False, 0, 0, 0)]
        self._places: dict[str, list[int]] = {}  # of open elements by tag
        self._text: list[str] = []
        self._linked = 0
        self._read(html or "")

    def _flush(self) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            if text:
                top = self._stack[-1]
                own = xxhash.xxh64_intdigest(text, top.token & 0xFFFFFFFF) & _MASK
                self._token(own, top.token)
                self.texts.add(own)
                self.blocks.append(Block(top.role, top.dropped, text, own, self._linked, top.node, top.article))
            self._text.clear()
        self._linked = 0

    def _token(self, token: int, parent: int) -> None:
        self.tokens[token] = self.tokens.get(token, 0) + 1
        # A token that was seen in two parents has none that counts.
        self.parents[token] = parent if self.parents.setdefault(token, parent) == parent else -1

    def _open(self, tag: str, attrs: str) -> None:
        top = self._stack[-1]
        dropped, role, key, main = top.dropped, top.role, tag, tag == "main"
        dropped = dropped or tag in DROPPED_TAGS or (role == NONE and tag == "header")
        for name, value in _ATTR.findall(attrs) if attrs else ():
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "role"):
                for one in value.split() if name != "id" or tag not in HEADINGS else ():
                    drop, header, comments = name_says(one)
                    dropped = dropped or drop or comments or (header and role == NONE)
                    main = main or (one.lower() == "main" and tag in ("div", "section"))
                key += f"|{name}={' '.join(_WORDS.findall(value.lower()))}"
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN_STYLE.search(value)):
                dropped = True
        if tag == "article":
            role = ARTICLE
        elif role == NONE and main:
            role = MAIN
        token = xxhash.xxh64_intdigest(key, top.token & 0xFFFFFFFF) & _MASK
        self._token(token, top.token)
        at = len(self._stack)
        self._stack.append(_Open(tag, token, dropped, role, len(self.tree), top.article or (len(self.tree) if tag == "article" else 0), top.in_link or tag == "a", at if tag in FENCES else top.fence, at if tag in FENCES or tag in LISTS else top.stop, top.block if tag in FORMATTING else at))
        self.tree.append((token, top.node))
        self._places.setdefault(tag, []).append(at)

    def _cut(self, at: int) -> None:
        """Close the element at a place of the stack, and all in it."""
        while len(self._stack) > at:
            self._places[self._stack.pop().tag].pop()

    def _close(self, tag: str) -> None:
        places, top = self._places.get(tag), self._stack[-1]
        if places and not (tag in FORMATTING and top.block > places[-1]) and not (tag not in FENCES and top.fence > places[-1]):
            self._cut(places[-1])

    def _imply(self, tag: str) -> None:
        """Close what the start of ``tag`` closes."""
        if tag in CLOSES_P and self._stack[-1].block and self._stack[self._stack[-1].block].tag == "p":
            self._cut(self._stack[-1].block)
        ends = CLOSED_BY.get(tag)
        while ends:
            last = max((p[-1] for t in ends if (p := self._places.get(t))), default=0)
            if not last or last < self._stack[-1].stop:
                break
            self._cut(last)
            if tag != "tr":
                break

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self._add(html[at:lt])
            if lt >= n:
                break
            mark = html[lt + 1 : lt + 2]
            if mark == "!" or mark == "?":
                if html.startswith("<!--", lt):
                    end = html.find("-->", lt + 2)
                    at = n if end < 0 else end + 3
                else:
                    end = html.find(">", lt)
                    at = n if end < 0 else end + 1
                continue
            closing = mark == "/"
            m = _NAME.match(html, lt + 1 + closing)
            if not m:
                if closing:
                    end = html.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    self._add("<")
                    at = lt + 1
                continue
            tag = m[0].lower()
            rest = _REST.match(html, m.end())
            if not rest:
                break
            at = rest.end()
            end = at - 1
            if tag == "br":
                self._add(" ")
                continue
            inline = tag in FORMATTING
            if not inline:
                self._flush()
            if closing:
                self._close(tag)
            elif tag in VOID:
                continue
            elif tag in RAW:
                if html[end - 1] != "/":
                    close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, at)
                    end = html.find(">", close.end()) if close else -1
                    at = n if end < 0 else end + 1
            else:
                self._imply(tag)
                self._open(tag, html[m.end() : end])
        self._flush()

    def _add(self, text: str) -> None:
        self._text.append(text)
        if self._stack[-1].in_link:
            self._linked += len(text)


def main_text(page: Page, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The blocks of the page's main slots, joined by one space."""
    blocks = [b for b in page.blocks if not b.dropped and b.token not in template]
    slot_of = [0] * len(page.tree)  # by node: the innermost template element around it
    for i, (token, parent) in enumerate(page.tree):
        slot_of[i] = token if token in template else slot_of[parent] if parent >= 0 else 0
    size: dict[int, int] = {}
    linked: dict[int, int] = {}
    for b in blocks:
        slot = slot_of[b.node]
        size[slot] = size.get(slot, 0) + len(b.text)
        linked[slot] = linked.get(slot, 0) + (b.linked if slot else 0)  # what no template delimits is no list of links
    articles = {b.article for b in blocks if b.article}
    if len(articles) == 1:
        return " ".join(b.text for b in blocks if b.article)
    main = any(b.role == MAIN for b in blocks)
    return " ".join(b.text for b in blocks if b.article or (b.role == MAIN and not articles) or ((b.role == MAIN or not main) and 2 * linked[slot_of[b.node]] <= size[slot_of[b.node]]))


def _host(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def _tokens(batches):
    """Per host and token, sums over one partition's pages: pages, vector, parents."""
    held: dict[tuple[str, int], list] = {}

    def flush():
        items = list(held.items())
        held.clear()
        for i in range(0, len(items), 50_000):
            part = items[i : i + 50_000]
            cols = [pa.array([k[0] for k, _ in part]), pa.array([k[1] for k, _ in part], pa.int64())]
            cols += [pa.array([v[j] for _, v in part], pa.int64()) for j in range(8)]
            yield pa.RecordBatch.from_arrays(cols, names=["host", "token", "pages", "vector1", "vector2", "low", "high", "first", "last", "is_text"])

    for batch in batches:
        for key, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            host, page = _host(url), Page(html)
            whole = xxhash.xxh64_intdigest(html or "") & _MASK
            page.tokens[0] = 1  # stands for the page itself
            for token, count in page.tokens.items():
                h = xxhash.xxh64_intdigest(f"{key}:{count}")
                parent = page.parents.get(token, 0)
                old = held.get((host, token))
                if old is None:
                    held[host, token] = [1, h & 0x3FFFFFFF, h >> 34, parent, parent, whole, whole, int(token in page.texts)]
                else:
                    old[0] += 1
                    old[1] += h & 0x3FFFFFFF
                    old[2] += h >> 34
                    old[3], old[4] = min(old[3], parent), max(old[4], parent)
                    old[5], old[6] = min(old[5], whole), max(old[6], whole)
        if len(held) > 300_000:
            yield from flush()
    yield from flush()


def templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_class: int = 2, min_share: float = 0.3, min_text_share: float = 0.9) -> DataFrame:
    """Template tokens by host: ``(host, tokens array<long>)``."""
    rows = pages.select(F.col(id_col).cast("string").alias("k"), F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("h"))
    sums = rows.mapInArrow(_tokens, "host string, token long, pages long, vector1 long, vector2 long, low long, high long, first long, last long, is_text long")
    sums = sums.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("vector1").alias("vector1"), F.sum("vector2").alias("vector2"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("is_text").alias("is_text"))
    sums = cut(sums.filter("pages >= 2"))
    hosts = sums.filter("token = 0").select("host", F.col("pages").alias("of"))
    # Copies of one page say nothing about a template, and an article that many pages copy is not part of one.
    share = F.when(F.col("is_text") == 1, F.lit(min_text_share)).otherwise(F.lit(min_share))
    often = sums.filter("token <> 0 and low = high and first <> last").join(hosts, "host").filter(F.col("pages") >= share * F.col("of")).filter("is_text = 0 or pages >= 3")
    # A host's frequent tokens are at most 1 / min_share times those of a page, however many pages it has.
    often = often.select("host", "token", F.col("low").alias("parent"), F.struct("vector1", "vector2", "pages").alias("vector"), F.col("is_text").cast("boolean").alias("is_text"))
    per_host = often.groupBy("host").agg(F.collect_list(F.struct("token", "parent", "vector", "is_text")).alias("found"))

    def run(batches):
        for batch in batches:
            hosts, tokens = batch.column(0), []
            for found in batch.column(1):
                rows = found.as_py()
                tokens.append(sorted(nested([(r["token"], r["parent"], tuple(r["vector"].values()), r["is_text"]) for r in rows], min_class)))
            yield pa.RecordBatch.from_arrays([hosts, pa.array(tokens, pa.list_(pa.int64()))], names=["host", "tokens"])

    return per_host.mapInArrow(run, "host string, tokens array<long>").filter(F.size("tokens") > 0)


def nested(rows: list[tuple[int, int, tuple, bool]], min_class: int) -> set[int]:
    """The tokens of the tree of valid classes, from ``(token, parent, vector, is_text)``.

    The parent of a frequent token is frequent too, or the root. Elements come before what they hold.
    """
    children: dict[int, list] = {}
    by = {r[0] for r in rows}
    for r in rows:
        children.setdefault(r[1] if r[1] in by else 1, []).append(r)
    ids: dict[tuple, int] = {}  # class by (vector, nest); 0 is the root
    members: list[list[int]] = [[]]
    lines: dict[int, tuple[int, dict]] = {1: (0, {})}  # of an element: its class, and the classes around its content by vector
    todo = [1]
    while todo:
        at = todo.pop()
        inner, around = lines[at]
        for token, _, vector, is_text in children.get(at, ()):
            own = around.get(vector)
            if own is None:
                own = ids.setdefault((vector, inner), len(members))
                if own == len(members):
                    members.append([])
            members[own].append(token)
            if not is_text:
                lines[token] = (own, around if vector in around else around | {vector: own})
                todo.append(token)
    return {t for found in members if len(found) >= min_class for t in found}


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_tokens: int = 1_000_000, **options) -> DataFrame:
    """Main text of every page: ``(page_id, url, text, n_chars)``."""
    found = cut(templates(pages, id_col, url_col, html_col, **options))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    size = found.agg(F.sum(F.size("tokens")).alias("n"), F.count(F.lit(1)).alias("hosts")).first()
    schema = f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long"

    def texts(ids, urls, htmls, template_of):
        out = [main_text(Page(h), template_of(i)) for i, h in enumerate(htmls.to_pylist())]
        return pa.RecordBatch.from_arrays([ids, urls, pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if (size["n"] or 0) + size["hosts"] <= broadcast_tokens:
        table = found.toArrow()
        known = {h: np.asarray(t, dtype=np.int64) for h, t in zip(table["host"].to_pylist(), table["tokens"].to_pylist(), strict=True)}
        shared = pages.sparkSession.sparkContext.broadcast(known)

        def run(batches):
            sets = {h: frozenset(t.tolist()) for h, t in shared.value.items()}
            for b in batches:
                urls = b.column(1).to_pylist()
                yield texts(b.column(0), b.column(1), b.column(2), lambda i, urls=urls: sets.get(_host(urls[i]), frozenset()))

        return rows.mapInArrow(run, schema)

    host = F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#]*@)?([^/?#]*)", 1), F.lit("")))
    joined = rows.withColumn("host", host).join(found, "host", "left").select("page_id", "url", "html", "tokens")

    def run_joined(batches):
        for b in batches:
            held = b.column(3)
            yield texts(b.column(0), b.column(1), b.column(2), lambda i, held=held: frozenset(held[i].as_py() or ()))

    return joined.mapInArrow(run_joined, schema)
