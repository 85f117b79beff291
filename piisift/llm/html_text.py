"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from one template.  The tokens of a page are its containers, each with its path;
Spark gathers for each host and token an occurrence vector over the host's pages (a set hash of page and
count), and tokens that share a vector form an equivalence class.  Classes that occur on enough pages are
valid; they nest by path into the host's template.  What the template leaves open are slots.  A slot is
main text if it lies under the template's content container and under no container for menus, headers,
footers, sidebars, notices, adverts, forms or comments.  Names of containers propose, the classes' text over all
pages decides: a container that holds half of its host's text or more, and the article or main part with it, is a
wrapper and no sidebar or form, whatever words it carries; a class below the content that reads the same on every
page is the template's own text.  Where no container is named as content, link-heavy classes and classes that read
the same on every page are not text, and the container that holds most of the remaining text is the content.

Blocks are the text between block-level tags and line breaks.  Character references are decoded, white
space becomes one space, and nothing inside the kept slots is dropped or cut.

Defined cases: null html is empty and gives an empty text; pages without a host form a host of their own;
hosts of one page are judged by names alone; a cut-off tag, comment or script ends the page; repeated rows
are extracted alike; an empty table gives no row; other columns of the input are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, written

#: Share of a host's pages, in percent, on which a class must occur, and least number of pages.
SUPPORT_PERCENT, SUPPORT_PAGES = 50, 2
#: Share of a slot's characters inside links, in percent, from which it is a menu.
LINK_PERCENT = 60
#: Hosts with at least one in so many pages of all are hot: at most so many, so their templates are broadcast and
#: their pages stay where they are; the pages of all other hosts are joined to their templates by host.
HOT_HOSTS = 200
#: Pages from which text that never changes is taken for the template's own.
FIXED_PAGES = 5

# Names of HTML elements, and usual names of page parts in class, id and role.
CONTAINERS = frozenset("html body main article section div nav aside header footer form ul ol dl menu table figure "
                       "blockquote fieldset details dialog center iframe button select label object".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption figcaption pre hr br "
                                "address summary legend option hgroup title".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "svg", "math", "head", "xmp", "iframe")
DROPPED = frozenset("nav aside footer form menu button select label dialog iframe object fieldset".split())
CONTENT = frozenset("article main".split())
CONTENT_NAMES = frozenset("article main post entry story".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus dialog footer form header login masthead menu modal nav navbar navigation newsletter notice notices "
    "pager pagination popup promo promoted promotion related recommended rail search share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription toolbar topbar widget alert complementary contentinfo replies".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<!--.*?(?:--!?>|\Z)|<[!?/][^>]*(?:>|\Z)"""
                  r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""", re.DOTALL)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_NAME_WORD = re.compile(r"[a-z]+|\d+")
#: First and last words of names that describe a layout or a state, not what the container is.
LAYOUT_FIRST = frozenset("has with without no is not layout page theme col".split())
LAYOUT_LAST = frozenset("enabled disabled open opened closed layout on off active inactive visible hidden".split())
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in RAW}
ROOT = "html"


def signature(tag: str, attributes: str) -> str:
    """The container as a token: its tag and the names it carries, digits left out."""
    words: list[str] = []
    if attributes:
        for m in _NAMED.finditer(attributes):
            for name in (m[2] or m[3] or m[4] or "").lower().split():
                own = [w for w in _NAME_WORD.findall(name) if not w.isdigit()]
                if len(own) > 1 and (own[0] in LAYOUT_FIRST or own[-1] in LAYOUT_LAST):
                    own = ["-".join(own)]  # "has-sidebar" names no sidebar
                words += own
    return ".".join([tag, *sorted(set(words))])


def read_page(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path of containers, block text, characters in links) of each block, and every container's entry.

    An entry is a block without text: it lets the template see containers that hold nothing themselves.
    """
    out: list[tuple[tuple[str, ...], str, int]] = []
    path: list[str] = []
    tags: list[str] = []
    parts: list[str] = []
    linked: list[int] = []
    in_link = 0

    def close_block() -> None:
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                out.append((tuple(path), text, min(sum(linked), len(text))))
            parts.clear()
            linked.clear()

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at:m.start()])
            if in_link:
                linked.append(m.start() - at)
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue  # comment, doctype or processing instruction
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW and not closing:
            if tag == "head":  # its parts are not text; it ends where the body begins
                stop = re.compile(r"</head\s*>|<body[\s>]", re.IGNORECASE).search(page, at)
                at = end if stop is None else (stop.end() if stop[0].startswith("</") else stop.start())
                continue
            if not attributes.rstrip().endswith("/"):
                stop = _RAW_END[tag].search(page, at)
                at = end if stop is None else stop.end()
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag not in BLOCKS:
            continue
        close_block()
        if tag not in CONTAINERS:
            if tag == "p" or tag[0] == "h":
                in_link = 0
            continue
        if closing:
            if tag in tags:
                while tags and tags.pop() != tag:
                    path.pop()
                path.pop()
                in_link = 0
        elif tag not in ("html", "body") or tag not in tags:
            tags.append(tag)
            path.append(signature(tag, attributes))
            out.append((tuple(path), "", 0))
    close_block()
    return out


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user and port; empty when there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def page_tokens(pages: DataFrame) -> DataFrame:
    """host, page, token (path), n (occurrences), chars, linked, said (hash of its own text) per page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for b in slices(batches):
            host, page, token, n, chars, linked, said = ([] for _ in range(7))
            for h, p, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                found: dict[str, list] = {}
                for path, words, link in read_page(text):
                    cell = found.setdefault(">".join(path), [0, 0, 0, xxhash.xxh3_64()])
                    if words:
                        cell[1] += len(words)
                        cell[2] += link
                        cell[3].update(words.encode("utf-8", "surrogatepass") + b"\0")
                    else:
                        cell[0] += 1
                for t, (a, c, k, x) in found.items():
                    host.append(h)
                    page.append(p)
                    token.append(t)
                    n.append(a)
                    chars.append(c)
                    linked.append(k)
                    said.append(x.intdigest() - (1 << 63))
            yield pa.record_batch([pa.array(host, pa.string()), pa.array(page, pa.int64()), pa.array(token, pa.string()),
                                   *(pa.array(c, pa.int64()) for c in (n, chars, linked, said))],
                                  ["host", "page", "token", "n", "chars", "linked", "said"])

    return pages.select("host", "page", "t").mapInArrow(
        run, "host string, page long, token string, n long, chars long, linked long, said long")


def deduce_templates(pages: DataFrame) -> DataFrame:
    """host, pages (their number), template: its valid equivalence classes, as (token, class, support, chars, linked, fixed).

    Pre-aggregated per task; a host of a third of all pages sends one row per token and task.
    """
    tokens = page_tokens(pages)
    # a page whose containers never open still counts: every page has a token, the empty path at least
    vectors = tokens.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count("*").alias("support"),
        F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        (F.min("said") == F.max("said")).alias("fixed"))
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages"))
    valid = vectors.join(sizes, "host").filter(
        (F.col("support") >= SUPPORT_PAGES) & (100 * F.col("support") >= SUPPORT_PERCENT * F.col("pages")))
    classes = valid.groupBy("host", "vector").agg(
        F.min("support").alias("support"), F.max("pages").alias("pages"),
        F.collect_list(F.struct("token", "chars", "linked", "fixed")).alias("tokens"))
    # frequent tokens alone: at most 100 / SUPPORT_PERCENT times those of an average page
    flat = classes.select("host", "vector", "support", "pages", F.explode("tokens").alias("x"))
    return flat.groupBy("host").agg(F.max("pages").alias("pages"), F.array_sort(F.collect_list(F.struct(
        F.col("x.token").alias("token"), F.col("vector"), "support", "pages", F.col("x.chars").alias("chars"),
        F.col("x.linked").alias("linked"), F.col("x.fixed").alias("fixed")))).alias("template"))


def role(sign: str, inside_content: bool) -> str:
    """What a container is by its names: drop, content or open."""
    tag, *names = sign.split(".")
    if tag in DROPPED or any(n in BOILERPLATE_NAMES for n in names) and tag not in ("html", "body"):
        # names like "post-header" within an article head its text
        if not (inside_content and tag not in DROPPED and set(names) & BOILERPLATE_NAMES <= {"header"}):
            return "drop"
    if tag == "header" and not inside_content:
        return "drop"
    if tag in CONTENT or (tag in ("div", "section") and any(n in CONTENT_NAMES for n in names)):
        return "content"
    return "open"


def wrappers(chars: dict[tuple[str, ...], int]) -> set[tuple[str, ...]]:
    """Containers that names would drop though they hold half of the text and every article or main part that
    names would not drop.

    ``chars``: characters of the text of each container itself.  A comment list that outweighs its
    article is none, as the article lies outside.
    """
    def has_content(path):
        return any(sign.split(".")[0] in CONTENT for sign in path)

    total, out = sum(chars.values()), set()
    while True:
        under: dict[tuple[str, ...], int] = {}
        for path, n in chars.items():
            top = next((path[:k] for k in range(1, len(path) + 1) if path[:k] not in out and dropped_at(path, k, out)), None)
            if top is not None:
                under[top] = under.get(top, 0) + n
        new = {top for top, n in under.items() if 2 * n >= total > 0
               and any(has_content(p) for p in chars if p[:len(top)] == top)
               and not any(has_content(p) and n and not any(dropped_at(p, k, out) for k in range(1, len(p) + 1))
                           for p, n in chars.items() if p[:len(top)] != top)}
        if not new:
            return out
        out |= new


def dropped_at(path: tuple[str, ...], k: int, spared: set[tuple[str, ...]]) -> bool:
    """Whether names drop the path at its k-th container, those above it spared or open."""
    inside = False
    for j, sign in enumerate(path[:k], 1):
        r = role(sign, inside)
        if r == "drop" and path[:j] not in spared:
            return j == k
        inside = inside or r == "content" or sign.split(".")[0] in CONTENT
    return False


class Template:
    """A host's nested classes, with the verdict on each slot."""

    def __init__(self, rows: list[dict]):
        self.tokens = {r["token"]: r for r in rows}
        self.wrappers = wrappers({tuple(t.split(">")): r["chars"] for t, r in self.tokens.items()})
        self.page_wrappers: set[tuple[str, ...]] = set()  # of the page at hand
        self.has_content = any(self._names(tuple(t.split(">")))[1] for t in self.tokens)
        self.content = None if self.has_content else self._largest()

    def _names(self, path: tuple[str, ...]) -> tuple[bool, int]:
        """(dropped, depth of content) by the names along the path: 0 outside, 1 in a content container, 2 in an article."""
        inside = 0
        for k, sign in enumerate(path, 1):
            r = role(sign, inside > 0)
            if r == "drop" and path[:k] not in self.wrappers and path[:k] not in self.page_wrappers:
                return True, inside
            if r == "content" or (r == "drop" and sign.split(".")[0] in CONTENT):
                inside = max(inside, 2 if sign.split(".")[0] == "article" else 1)
        return False, inside

    def _own_text(self, path: tuple[str, ...]) -> bool:
        """Whether a class below the content container reads the same on every page, though the content does not."""
        first = next((k for k, sign in enumerate(path, 1) if role(sign, False) == "content" or sign.split(".")[0] in CONTENT), len(path))
        content = self.tokens.get(">".join(path[:first]))
        if content is None or (content["fixed"] and content["chars"]):
            return False
        below = (self.tokens.get(">".join(path[:k])) for k in range(first + 1, len(path) + 1))
        return any(r is not None and r["chars"] and r["fixed"] and r["support"] >= FIXED_PAGES for r in below)

    def _evidence_drops(self, path: tuple[str, ...]) -> bool:
        """Whether any class along the path is a menu or the template's own text."""
        for k in range(1, len(path) + 1):
            r = self.tokens.get(">".join(path[:k]))
            if r is None or not r["chars"]:
                continue
            if 100 * r["linked"] >= LINK_PERCENT * r["chars"] or (r["fixed"] and r["support"] >= FIXED_PAGES):
                return True
        return False

    def _largest(self) -> str | None:
        """The container below which most of the text lies that neither names nor evidence reject."""
        total: dict[str, int] = {}
        for token, r in self.tokens.items():
            path = tuple(token.split(">"))
            if not self._names(path)[0] and not self._evidence_drops(path):
                for k in range(1, len(path) + 1):
                    up = ">".join(path[:k])
                    total[up] = total.get(up, 0) + r["chars"]
        if not total:
            return None
        most = max(total.values())
        return max((t for t, c in total.items() if 10 * c >= 9 * most), key=lambda t: (t.count(">"), t))

    def keeps(self, path: tuple[str, ...], page_content: int) -> bool:
        """Whether text in this slot is main text, on a page whose deepest content container is of that kind."""
        dropped, inside = self._names(path)
        if dropped:
            return False
        if page_content:
            return inside >= page_content and not self._own_text(path)
        if self._evidence_drops(path):
            return False
        return self.content is None or (">".join(path) + ">").startswith(self.content + ">")


def extract(page: str, template: Template) -> str:
    """Main text of a page: the kept blocks joined by line ends."""
    blocks = read_page(page)
    chars: dict[tuple[str, ...], int] = {}
    for path, text, _ in blocks:
        chars[path] = chars.get(path, 0) + len(text)
    template.page_wrappers = wrappers(chars)  # a page alone, or unlike its host
    content = max((inside for dropped, inside in map(template._names, {p for p, t, _ in blocks if t}) if not dropped), default=0)
    kept: dict[tuple[str, ...], bool] = {}
    out = []
    for path, text, _ in blocks:
        if text:
            if path not in kept:
                kept[path] = template.keeps(path, content)
            if kept[path]:
                out.append(text)
    if not out and not content and template.content:  # a page unlike its host: by names alone
        out = [text for path, text, _ in blocks if text and not template._names(path)[0]]
    return "\n".join(out)


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text of every page."""
    key_type = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"),
                        F.coalesce(F.col(html), F.lit("")).alias("t"))
    numbered = rows.withColumn("page", F.monotonically_increasing_id())  # repeated rows are pages of their own
    templates = written(deduce_templates(numbered), "templates")
    total = templates.agg(F.sum("pages")).first()[0] or 0
    is_hot = F.col("pages") * HOT_HOSTS >= F.lit(total)
    hot = F.broadcast(templates.filter(is_hot).select("host", "template"))  # at most HOT_HOSTS rows
    cold = templates.filter(~is_hot).select("host", "template")
    matched = rows.join(hot, "host").unionByName(
        rows.join(hot.select("host"), "host", "left_anti").join(cold, "host", "left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for b in slices(batches):
            out = []
            hosts, found = b.column(2).to_pylist(), b.column(4)
            for i, (h, t) in enumerate(zip(hosts, b.column(3).to_pylist())):
                if h not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[h] = Template(found[i].as_py() or [])
                out.append(extract(t, known[h]))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.string())], ["key", "url", "text"])

    return (matched.select("key", "url", "host", "t", "template")
            .mapInArrow(run, f"key {key_type}, url string, text string").withColumnRenamed("key", key))


def op4_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars."""
    out = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
