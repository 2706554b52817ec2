"""Main text of web pages: template deduction over the pages of a host, and what is left in its slots."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm.common import bounded, discard, save, table

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|template|textarea)\b(?:"[^"]*"|'[^']*'|[^>"'])*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<[!?][^>]*>""", re.S | re.I)
_LABEL = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_DIGITS = re.compile(r"\d+")
#: Fixed values of HTML: elements without content, elements that start a block, elements apart from an article.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
APART = frozenset("head nav footer aside form button select dialog menu title".split())
APART_WORDS = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice popup promo promoted related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: Words that may stand beside one of these in a class name.
BESIDE = frozenset("area bar block bottom box button buttons container content form group icons inner item items left link links list main module outer page panel post posts right row section site stories text thread title top wrap wrapper".split())
CLOSED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that can be the slot of an article: they hold blocks.
HOLDERS = frozenset("article body center div main section table tbody td tr".split())
#: Share of a host's pages, and number of pages, from which an equivalence class of tokens can be template; tokens that a class has.
SUPPORT, PAGES, MEMBERS = 0.5, 5, 2
#: Share of a host's pages on which a text in a slot is the template's; share of a host's text that makes an element a slot, and of its text, up to which what stands neither in another element that holds blocks nor in the template is too little to keep a wrapper of slots whole.
FIXED, SLOT, WRAP = 0.9, 0.1, 0.01


def is_apart(label: str) -> bool:
    """Whether a class, id or role is, as a whole, that of a menu, advert, comment or the like."""
    words = [w for w in re.split(r"[-_]", label) if w]
    return any(w in APART_WORDS for w in words) and all(w in APART_WORDS or w in BESIDE for w in words)


class Page:
    """A page's elements and blocks of text in order.

    Elements are known by a hash of the names and labels from the root on
    (digits in labels count alike) and by their parent's number. Blocks are
    (element, text, apart, in an article): references decoded, white space as
    one space. apart: inside an element that is never article. Unclosed
    elements end with the one around them, a paragraph at the next block.
    opened: how many elements were open or had been when a block ended.
    """

    def __init__(self, page: str):
        self.path, self.parent, self.holder, self.blocks, self.opened = [0], [0], [False], [], []
        # open elements: name, number, apart, in an article
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        self._said: list[str] = []
        at = 0
        for m in _MARKUP.finditer(page):
            self._said.append(page[at : m.start()])
            at = m.end()
            name = (m[3] or "").lower()
            if not name:
                continue
            if name == "br":
                self._said.append(" ")
            elif m[2]:
                self._close(stack, name)
            else:
                self._open(stack, name, m[4])
        self._said.append(page[at:])
        self._flush(stack)
        del self._said

    def _flush(self, stack) -> None:
        text = " ".join(entities.unescape("".join(self._said)).split())
        self._said.clear()
        if text:
            self.blocks.append((stack[-1][1], text, stack[-1][2], stack[-1][3]))
            self.opened.append(len(self.path))

    def _close(self, stack, name: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == name:
                if name in BLOCK or name in APART or stack[i][2] != stack[i - 1][2]:
                    self._flush(stack)
                del stack[i:]
                return
        if name in BLOCK:
            self._flush(stack)

    def _open(self, stack, name: str, attributes: str) -> None:
        if name in BLOCK or name in APART:
            self._flush(stack)
        ends = ({"p"} if name in BLOCK else set()) | CLOSED_BY.get(name, set())
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in ends:
                del stack[i:]
                break
            if stack[i][0] in BLOCK:
                break
        if name in VOID or attributes.rstrip().endswith("/"):
            return
        _, up, apart, inside = stack[-1]
        labels = " ".join(x.strip("\"'").lower() for x in _LABEL.findall(attributes)).split() if attributes else []
        now = apart or name in APART or name == "header" and not inside or name not in ("html", "body", "article", "main") and any(map(is_apart, labels))
        if now and not apart:
            self._flush(stack)
        number = len(self.path)
        self.path.append(xxhash.xxh64_intdigest(f"{self.path[up]}/{name}.{_DIGITS.sub('#', ' '.join(labels))}") - (1 << 63))
        self.parent.append(up)
        self.holder.append(name in HOLDERS)
        stack.append((name, number, now, inside or name in ("article", "main")))

    def within(self, paths: set[int]) -> list[bool]:
        """For each element whether it or one around it has one of these paths."""
        out: list[bool] = []
        for p, up in zip(self.path, self.parent, strict=True):
            out.append(p in paths or bool(out) and out[up])
        return out

    def tokens(self) -> Iterator[tuple[int, int]]:
        """(path, token) in the page's order: elements (token 0) as they open, blocks as they end."""
        b = 0
        for i, p in enumerate(self.path):
            while b < len(self.blocks) and self.opened[b] <= i:
                yield self.path[self.blocks[b][0]], _token(self.path[self.blocks[b][0]], self.blocks[b][1])
                b += 1
            yield p, 0
        for number, text, *_ in self.blocks[b:]:
            yield self.path[number], _token(self.path[number], text)


def _token(path: int, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\0{text}") - (1 << 63)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of pages with their numbers of occurrences: paths (token 0), with their depth (0 if they are no HOLDERS), the text below them and, for HOLDERS, that in no other of them; and texts at paths, with the path of the HOLDERS element around."""
    names = ["host", "page", "path", "token", "depth", "n", "chars", "direct", "near"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for host, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            page = Page(text or "")
            below, depth, direct, near = ([0] * len(page.path) for _ in range(4))
            for i in range(1, len(page.path)):
                near[i] = i if page.holder[i] else near[page.parent[i]]
            found: dict[tuple[int, int], list[int]] = {}
            for number, said, apart, _ in page.blocks:
                below[number] += 0 if apart else len(said)
                direct[near[number]] += 0 if apart else len(said)
                x = found.setdefault((page.path[number], _token(page.path[number], said)), [0, 0, 0, 0, page.path[near[number]]])
                x[1] += 1
                x[2] += 0 if apart else len(said)
            for i in range(1, len(page.path)):
                depth[i] = depth[page.parent[i]] + 1
            for i in range(len(page.path) - 1, 0, -1):
                below[page.parent[i]] += below[i]
            for i, p in enumerate(page.path):
                x = found.setdefault((p, 0), [depth[i] if page.holder[i] else 0, 0, 0, 0, 0])
                x[1] += 1
                x[2] += below[i]
                x[3] += direct[i]
            for (path, token), figures in found.items():
                for column, value in zip(out, (host, key, path, token, *figures), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(c, pa.int64()) for c in out[1:])], names)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def _nesting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each class on each page (host, html, and its host's tokens that are once on a page: paths, tokens, classes): a hash of its tokens' order, and whether it lies across another.

    A class is open from its first token to its last. What opens inside it has
    to end before its next token: where a class goes on while a later one is
    open, the later one lies across it.
    """
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for host, html, paths, tokens, classes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = dict(zip(zip(paths or (), tokens or (), strict=True), classes or (), strict=True))
            left: dict[int, int] = {}
            seen = [(own[t], t) for t in Page(html or "").tokens() if t in own]
            for c, _ in seen:
                left[c] = left.get(c, 0) + 1
            order, across, stack = {}, set(), []
            for c, t in seen:
                if c not in order:
                    order[c] = xxhash.xxh64()
                    stack.append(c)
                elif c not in across:
                    while stack[-1] != c:
                        across.add(stack.pop())
                order[c].update(repr(t))
                left[c] -= 1
                if not left[c] and c not in across:
                    stack.pop()
            for c, h in order.items():
                for column, value in zip(out, (host, c, h.intdigest() - (1 << 63), int(c in across)), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(x, pa.int64()) for x in out[1:])], ["host", "class", "order", "across"])


def _with_host(pages: DataFrame, hosts: DataFrame, tokens: int) -> DataFrame:
    """pages with the columns of hosts (host, arrays of so many tokens in all); broadcast where these are few, else pages are shuffled."""
    rows = pages.withColumn("host", host_of(F.col("url")))
    return rows.join(F.broadcast(hosts) if tokens <= TOKENS else hosts, "host", "left")


#: Tokens of templates in all up to which templates are broadcast (some 24 bytes each).
TOKENS = 500_000


def classes_of(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens, classes) of pages (page_id, url, html), both saved.

    tokens: host, path, token, class, support, times (its occurrences), depth,
    chars, direct, near. A token's occurrence vector is the list of its numbers of
    occurrences on the host's pages; a sum of page hashes times these numbers
    stands for it, so that vectors are built by a combining aggregation and no
    host's pages are gathered. Tokens of one vector are an equivalence class.
    Copies of a page on a host are one page. classes: host, class, support,
    pages (of the host), members.
    """
    page = F.xxhash64("html")
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).withColumns({"host": host_of(F.col("url")), "page": page})
    copies = save(rows.groupBy("host", "page").agg(F.min(F.struct("page_id", "url")).alias("least"), F.count("*").alias("n")), "html-pages")
    again = bounded(copies.where("n > 1").select(F.col("host").alias("h"), F.col("page").alias("p"), "least"), 200_000)
    once = rows.join(again, (rows["host"] == again["h"]) & (rows["page"] == again["p"]), "left").where(F.col("least").isNull() | F.struct("page_id", "url").eqNullSafe(F.col("least")))
    found = once.select("host", "page", "html").mapInArrow(_occurrences, "host string, page long, path long, token long, depth long, n long, chars long, direct long, near long")
    vector = F.sum((F.shiftright("page", 24) * F.col("n")).cast("decimal(28,0)"))
    tokens = found.groupBy("host", "path", "token").agg(vector.alias("vector"), F.count("*").alias("support"), F.sum("n").alias("times"), F.max("depth").alias("depth"), F.sum("chars").alias("chars"), F.sum("direct").alias("direct"), F.max("near").alias("near"))
    tokens = save(tokens.withColumn("class", F.xxhash64(F.col("vector").cast("string"), "support")).drop("vector"), "html-tokens")
    totals = copies.groupBy("host").agg(F.count("*").alias("pages"))
    classes = save(tokens.groupBy("host", "class", "support").agg(F.count("*").alias("members")).join(totals, "host"), "html-classes")
    discard(copies)
    return tokens, classes


def templates(pages: DataFrame) -> tuple[DataFrame, int]:
    """((host, fixed, slots, wraps), number of tokens in them) of pages (page_id, url, html).

    A class of MEMBERS tokens on SUPPORT of the host's pages, and on PAGES of
    them, can be part of the template. It is, if its tokens that are once on a
    page come in one order on all of them, and if it nests: on every page each
    other class lies outside of it, inside one of its gaps, or around it (a
    class that lies across one opened before is none of the template). fixed:
    the texts on FIXED of the pages. slots: elements of the template that hold
    blocks, once a page, with at least SLOT of the host's text; wraps: whether
    hardly any of it, fixed texts apart, stands in them but for other elements
    that hold blocks.

    A token on half of the pages counts for one of them each time, so a host
    has no more of them than twice the tokens of a page: its arrays are short.
    """
    tokens, classes = classes_of(pages)
    valid = classes.where((F.col("members") >= MEMBERS) & (F.col("support") >= SUPPORT * F.col("pages")) & (F.col("support") >= PAGES)).select("host", "class", "pages")
    own = save(tokens.join(valid, ["host", "class"]), "html-own")
    once = own.where("times = support AND path <> 0")
    lists = once.groupBy("host").agg(*[F.collect_list(c).alias(n) for c, n in (("path", "paths"), ("token", "tokens"), ("class", "classes"))])
    seen = _with_host(pages.select("url", F.col("html").cast("string").alias("html")), lists, once.count()).where("paths IS NOT NULL")
    orders = seen.select("host", "html", "paths", "tokens", "classes").mapInArrow(_nesting, "host string, class long, order long, across long")
    bad = save(orders.groupBy("host", "class").agg(F.min("order").alias("a"), F.max("order").alias("b"), F.max("across").alias("across")).where("a <> b OR across > 0").select("host", "class"), "html-bad")
    kept = save(own.join(bad, ["host", "class"], "left_anti"), "html-template")
    old = kept.where((F.col("token") != 0) & (F.col("support") >= FIXED * F.col("pages")))
    fixed = old.groupBy("host").agg(F.collect_list("token").alias("fixed"))
    every = tokens.where("path = 0 AND token = 0").select("host", F.col("chars").alias("every"))
    slots = kept.where("token = 0 AND depth > 0 AND times = support").join(every, "host").where(F.col("chars") >= SLOT * F.col("every")).where("chars > 0")
    slots = slots.join(old.groupBy("host", F.col("near").alias("path")).agg(F.sum("chars").alias("old")), ["host", "path"], "left")
    slots = slots.groupBy("host").agg(F.collect_list("path").alias("slots"), F.collect_list(F.col("direct") - F.coalesce("old", F.lit(0)) <= WRAP * F.col("chars")).alias("wraps"))
    n = kept.count()
    made = save(fixed.join(slots, "host", "full"), "html-templates")
    for used in (tokens, classes, own, bad, kept):
        discard(used)
    return made, n


def chosen(page: Page, slots: dict[int, bool]) -> set[int]:
    """The paths of the slots that a page's text is taken from: the outermost ones, but for those that only wrap others, in whose place these stand."""
    around, kids = [0] * len(page.path), {}
    for i in range(1, len(page.path)):
        up = page.parent[i]
        around[i] = page.path[up] if page.path[up] in slots else around[up]
        if page.path[i] in slots:
            kids.setdefault(around[i], set()).add(page.path[i])
    out, todo = set(), [*kids.get(0, ())]
    while todo:
        x = todo.pop()
        inner = kids.get(x, set()) - {x}
        if inner and slots[x]:
            todo.extend(inner)
        else:
            out.add(x)
    return out


def main_text(html: str, fixed: set[int], slots: dict[int, bool]) -> str:
    """The blocks in the template's slots and in article or main elements, without the template's own; without either all that are not template."""
    page = Page(html)
    own = page.within(chosen(page, slots)) if slots else [False] * len(page.path)
    blocks = [(text, _token(page.path[number], text) in fixed, own[number] or inside) for number, text, apart, inside in page.blocks if not apart]
    kept = [(text, old) for text, old, inside in blocks if inside]
    if kept:
        free = [text for text, old in kept if not old]
        # a template has less text in a slot than its pages; where it had more, they are copies with small changes
        if 2 * sum(map(len, free)) >= sum(len(text) for text, _ in kept):
            return "\n\n".join(free)
        return "\n\n".join(text for text, _ in kept)
    if any(inside for *_, inside in page.blocks):
        return ""
    return "\n\n".join(text for text, old, _ in blocks if not old)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls, pages, fixed, slots, wraps = (batch.column(i) for i in range(6))
        texts = [main_text(pages[i].as_py() or "", set(fixed[i].as_py() or ()), dict(zip(slots[i].as_py() or (), wraps[i].as_py() or (), strict=True))) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    The text in the slots of the host's template (see templates) and in article
    or main elements, without what stands apart and without the template's own
    texts between. On pages without either: all that stands neither apart nor
    in the template. Null or empty html: the empty text. Null urls and urls
    without a host share one template; a host of under PAGES pages has none.
    Repeated rows: each is returned. Other columns are ignored.
    """
    made, n = templates(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    return _with_host(rows, made, n).select("page_id", "url", "html", "fixed", "slots", "wraps").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, a template for each host."""
    return extract(table(spark, sf_dir, "pages"))
