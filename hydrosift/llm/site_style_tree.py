"""Main text of web pages with a site style tree.

Every page is read into blocks: the text between block-level tags, with the
path of styles (tag and classes) that leads to it.  The pages of one host are
merged into one tree of styles, as counts:

* a text's content importance falls with the entropy of its presence, in bits a
  page: whether one of the host's different pages shows it.  It is 1 for a text
  of one page, 0 from the entropy of a ninth of the pages on.  Copies of a page,
  or of an article among other surroundings, are one page, so neither a host's
  size nor its copies change the verdict;
* an inner node's presentation importance comes from the entropy H of its
  sequences of child styles over the different pages: 1 - 2^-H, the share that
  2^H equally frequent sequences leave to the others, scaled so that n pages
  with n sequences have 1;
* a branch's composite importance mixes its own presentation with the content
  importance of what lies below, weighted by text.

Branches of low composite importance, and single texts repeated on enough
different pages, are cut from each page of the host, and with them what its
style says outright to be no article (navigation, headers, footers, sidebars,
notices, adverts, forms, comments) and, outside a marked article, blocks that
are mostly links.  A class or id is weaker: it takes no branch that holds the
article or most of the text; there it only raises the importance asked of it.
The tree judges marked articles too; the mark only protects copies: where most
of a page's marked text is repeated, it is an article that the host shows
often, and stays.

Text: character references decoded, white space inside a block one space,
blocks joined by a newline in page order.

Defined results for odd input: a NULL or empty page has an empty text; a NULL
or odd URL has no host, so the page is judged alone; hosts with few pages have
no evidence and lose only styled boilerplate; repeated rows get a row each; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, let, stage
from .words import slices

# How HTML elements are read.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section
summary table tbody td tfoot th thead tr ul""".split())
VOID_BLOCKS = frozenset(["hr"])
UNREAD = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "select",
          "button", "title", "canvas", "audio", "video", "datalist")
CLOSES_PARAGRAPH = BLOCKS - {"body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
              "th": ("td", "th"), "p": ("p",)}
SCOPES = frozenset(["ul", "ol", "menu", "dl", "table", "div", "section", "article", "main", "aside", "nav", "body"])
LANDMARKS = frozenset(["article", "main"])
BOILERPLATE_TAGS = frozenset(["nav", "header", "footer", "aside", "form", "dialog", "menu", "fieldset", "search"])
BOILERPLATE_ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog",
                               "alert", "menu", "menubar", "toolbar"])
BOILERPLATE_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment
comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal
nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion reactions related
recommended replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription
teaser toolbar widget""".split())

#: Words that also name parts of an article: its heading, lead or notes.
SOFT_WORDS = frozenset("banner copyright disclaimer header masthead notice notices teaser toolbar widget".split())
#: Words beside which a name still says what its other words say ("site-footer").
PLAIN_WORDS = frozenset("""area bar block blocks bottom box button buttons col column container content first form global
group holder icons inner item items last left link links list main outer page panel post posts primary right row
secondary section site slot text title top unit user wrap wrapper""".split())

#: A tag; a quoted value, which may hold ">", starts only after "=".  No part is read twice.
TAG = re.compile(r"<(/?+)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
UNQUOTED_TAG = re.compile(r"<(/?+)([A-Za-z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
UNREAD_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in UNREAD}
NAME = re.compile(r"[^a-z]+")
PLAIN, HINT, SOFT, NAMED = range(4)  # what an element's class and id say


def named_as(names: str) -> int:
    """NAMED: a whole name is a boilerplate word (plain words beside it do not
    count); SOFT: such a word also names parts of an article; HINT: the word is
    only part of a name that says something else ("has-sidebar")."""
    said = PLAIN
    for name in names.split():
        words = {w for w in NAME.split(name) if w}
        found = words & BOILERPLATE_WORDS
        if found:
            whole = words <= BOILERPLATE_WORDS | PLAIN_WORDS
            said = max(said, HINT if not whole else SOFT if found <= SOFT_WORDS else NAMED)
    return said


@dataclass(frozen=True)
class StyleTree:
    """Different pages of a host (and of a single text) from which repetition
    counts as evidence, importance under which a branch or text is cut (and a
    branch named like boilerplate), share of the pages from which a repeated text has no importance, weight of a branch's
    own presentation, weight of marked text in telling pages apart, and rows of
    a host table that may be broadcast."""

    min_pages: int = 4
    threshold: float = 0.2
    named_threshold: float = 0.5
    full_share: float = 1 / 9
    presentation: float = 0.1
    landmark: float = 4.0
    broadcast_rows: int = 200_000


class Page:
    """Blocks of one page: (path, text, linked characters, inside a landmark,
    styled as boilerplate, named like boilerplate), and per inner path the
    sequence of child styles.

    A tag or role is believed at once.  A name is weighed when the page has been
    read: it never takes a branch that holds a landmark or most of the page's
    text (unless a landmark beside it holds a quarter), nor, inside a landmark,
    one whose word also names parts of an article.  What it does not take is
    left to the tree, as named like boilerplate."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str, int, bool, bool, bool]] = []
        self.children: dict[str, list[str]] = {}
        self.stack: list[tuple[str, str, bool, bool, tuple[int, ...]]] = []  # tag, path, landmark, boilerplate, named
        self.named: list[tuple[int, bool]] = []  # what the names of an element say, whether it lies in a landmark
        self.parts: list[str] = []
        self.linked = 0
        self.read: list[tuple[str, str, int, bool, bool, tuple[int, ...]]] = []
        self._read(source)
        taken = self._taken()
        self.blocks = [(*b[:4], b[4] or any(taken[k] for k in b[5]), bool(b[5])) for b in self.read]

    def _taken(self) -> list[bool]:
        """Which of the named elements are boilerplate."""
        below, marked, holds = [0] * len(self.named), [0] * len(self.named), [False] * len(self.named)
        total = in_landmarks = 0
        for _, text, linked, landmark, noise, named in self.read:
            if noise or 2 * linked > len(text) and not landmark:
                continue
            total += len(text)
            in_landmarks += len(text) * landmark
            for k in named:
                below[k] += len(text)
                marked[k] += len(text) * landmark
                holds[k] |= landmark and not self.named[k][1]
        return [not holds[k] and said > HINT and not (inside and said == SOFT)
                and (2 * below[k] <= total or 4 * (in_landmarks - marked[k]) >= total)
                for k, (said, inside) in enumerate(self.named)]

    def _read(self, source: str) -> None:
        """Tag by tag, in one pass.  From a tag whose quotes never close on, tags
        end at their first ">"; a "<" that starts no tag is text."""
        at, begin, in_link, last, tags = 0, 0, False, source.rfind(">"), TAG
        while True:
            start = source.find("<", at)
            if start < 0 or start + 1 >= len(source):
                break
            sign = source[start + 1]
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                self._text(source[begin:start], in_link)
                at = begin = end + 3 if end >= 0 else len(source)
                continue
            if start > last:
                break
            if sign in "!?":
                self._text(source[begin:start], in_link)
                at = begin = source.find(">", start) + 1
                continue
            token = tags.match(source, start)
            if not token and tags is TAG and (sign.isascii() and sign.isalpha() or sign == "/" and source[start + 2:start + 3].isalpha()):
                tags = UNQUOTED_TAG
                token = tags.match(source, start)
            if not token:
                at = start + 1
                continue
            self._text(source[begin:start], in_link)
            at = begin = token.end()
            tag, closing = token.group(2).lower(), bool(token.group(1))
            if tag in UNREAD_END:
                if not closing and not token.group(3).endswith("/"):
                    end = UNREAD_END[tag].search(source, at) if at <= last else None
                    at = begin = end.end() if end else len(source)
            elif tag == "a":
                in_link = not closing
            elif tag == "br":
                self.parts.append(" ")
            elif tag in BLOCKS:
                self._flush()
                if closing:
                    self._close(tag)
                else:
                    self._open(tag, token.group(3))
                    in_link = False
        self._text(source[begin:], in_link)
        self._flush()

    def _text(self, raw: str, in_link: bool) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if in_link:
                self.linked += len(text)

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, path, landmark, boilerplate, named = self.stack[-1] if self.stack else ("", "", False, False, ())
            self.read.append((path, text, min(self.linked, len(text)), landmark, boilerplate, named))
        self.parts, self.linked = [], 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_PARAGRAPH and self.stack and self.stack[-1][0] == "p":
            self.stack.pop()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in SAME_LEVEL.get(tag, ()):
                del self.stack[k:]
                break
            if self.stack[k][0] in SCOPES:
                break
        found = {m.group(1).lower(): (m.group(2) or m.group(3) or m.group(4) or "").lower()
                 for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        names = found.get("class", "").split()
        _, path, landmark, boilerplate, named = self.stack[-1] if self.stack else ("", "", False, False, ())
        label = ".".join([tag, *sorted(names)])
        self.children.setdefault(path, []).append(label)
        if tag in VOID_BLOCKS:
            return
        plain = tag in ("html", "body") or tag in LANDMARKS
        noise = tag in BOILERPLATE_TAGS or found.get("role") in BOILERPLATE_ROLES
        said = PLAIN if plain or not found else named_as(f"{found.get('class', '')} {found.get('id', '')}")
        if said:
            named = (*named, len(self.named))
            self.named.append((said, landmark))
        # an article's own header holds its heading; a page's header does not
        noise = noise and not (tag == "header" and landmark)
        inside = landmark or tag in LANDMARKS or found.get("role") in ("main", "article")
        self.stack.append((tag, f"{path}/{label}", inside, boilerplate or noise, named))

    def _close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, blocks and inner nodes (path, child styles) of every page."""
    block = "struct<path:string,text:string,linked:int,landmark:boolean,noise:boolean,named:boolean>"
    schema = f"page_id long, url string, host string, blocks array<{block}>, inner array<struct<path:string,styles:string>>"
    kinds = [pa.int64(), pa.string(), pa.string(),
             pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("linked", pa.int32()),
                                 ("landmark", pa.bool_()), ("noise", pa.bool_()), ("named", pa.bool_())])),
             pa.list_(pa.struct([("path", pa.string()), ("styles", pa.string())]))]
    names = ["page_id", "url", "host", "blocks", "inner"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                read = [Page(x or "") for x in part.column("html").to_pylist()]
                blocks = [[dict(zip(("path", "text", "linked", "landmark", "noise", "named"), b, strict=True)) for b in p.blocks] for p in read]
                inner = [[{"path": k, "styles": ",".join(dict.fromkeys(v))} for k, v in p.children.items()] for p in read]
                columns = [*(part.column(c) for c in names[:3]), blocks, inner]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k)
                                                  for c, k in zip(columns, kinds, strict=True)], names=names)

    host = F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.when(host != "", host).alias("host"), "html")
    return rows.transform(in_batches, run, schema)


def _linked(block):
    return 2 * block["linked"] > F.length(block["text"])


def _bounded(df: DataFrame, opt: StyleTree) -> DataFrame:
    """Broadcast after counting at most one row over the bound, else as it is."""
    return F.broadcast(df) if df.limit(opt.broadcast_rows + 1).count() <= opt.broadcast_rows else df


def page_texts(read: DataFrame) -> DataFrame:
    """(host, page, path, content, chars, landmark) of the texts that may be
    article; ``page`` is a hash of all of them, so equal pages are one."""
    body = F.filter("blocks", lambda b: ~b["noise"] & (b["landmark"] | ~_linked(b)))
    pages = read.where(F.col("host").isNotNull()).select("host", body.alias("body"), F.xxhash64(
        F.transform(body, lambda b: b["text"])).alias("page"))
    return pages.select("host", "page", F.explode("body").alias("b")).select(
        "host", "page", "b.path", F.xxhash64("b.text").alias("content"), F.length("b.text").alias("chars"), "b.landmark").distinct()


def page_keys(texts: DataFrame, opt: StyleTree) -> DataFrame:
    """(host, page, key): the text that tells a page from others, which is the
    longest for the pages that show it.  Copies of an article share the key
    whatever stands around them; pages with one long notice do not."""
    shared = stage(texts.select("host", "page", "content").distinct().groupBy("host", "content").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1"), "style-shared")
    telling = F.col("chars") * F.when(F.col("landmark"), opt.landmark).otherwise(1.0) / F.coalesce("n", F.lit(1))
    return texts.join(_bounded(shared, opt), ["host", "content"], "left").groupBy("host", "page").agg(
        F.max(F.struct(telling.alias("telling"), "content"))["content"].alias("key"))


def content_importance(share: Column, opt: StyleTree) -> Column:
    """1 less the entropy of being shown by this share of the pages, relative to
    the entropy at ``full_share``; 0 from there on."""
    bits = lambda p: -(p * F.log2(p) + (1 - p) * F.log2(1 - p))
    return 1 - bits(F.least(share, F.lit(opt.full_share))) / bits(F.lit(opt.full_share))


def presentation_importance(pages: str) -> Column:
    """Over rows of (child styles, number of pages): from the entropy of the
    styles, log2 N - sum(n log2 n) / N bits; 1 where one page is all."""
    total = F.sum(pages)
    entropy = F.log2(total) - F.sum(F.col(pages) * F.log2(pages)) / total
    return F.when(total > 1, (1 - F.pow(F.lit(2.0), -entropy)) * total / (total - 1)).otherwise(1.0)


def style_tree(read: DataFrame, opt: StyleTree = StyleTree()) -> tuple[DataFrame, DataFrame]:
    """(host, path, pages, best, importance) of every style node with text below
    it (``best``: of any single node there), and (host, path, content, shown, pages, importance) of the repeated texts.

    All sums are map-side combined, so a host of any size is never gathered."""
    texts = stage(page_texts(read), "style-texts")
    keys = stage(page_keys(texts, opt), "style-keys")
    pages = stage(keys.groupBy("host", "key").count().groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "style-hosts")
    pages = _bounded(pages, opt)
    shown = texts.join(keys, ["host", "page"]).groupBy("host", "path", "content", "key").agg(F.max("chars").alias("chars")).groupBy(
        "host", "path", "content").agg(F.count(F.lit(1)).alias("shown"), F.max("chars").alias("chars")).join(pages, "host")
    contents = stage(shown.withColumn("importance", F.when(F.col("shown") < 2, 1.0).otherwise(
        content_importance(F.col("shown") / F.col("pages"), opt))), "style-contents")
    leaves = contents.groupBy("host", "path").agg(F.sum(F.col("chars") * F.col("shown")).alias("chars"), F.sum(
        F.col("chars") * F.col("shown") * F.col("importance")).alias("important"))
    steps = F.split("path", "/")
    branches = leaves.select("host", "chars", "important", (F.col("important") / F.col("chars")).alias("leaf"), F.explode(F.transform(
        F.sequence(F.lit(2), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))).alias("path")).where(
        F.size(F.split("path", "/")) > 1)
    below = branches.groupBy("host", "path").agg((F.sum("important") / F.sum("chars")).alias("below"), F.max("leaf").alias("best"))
    body = F.filter("blocks", lambda b: ~b["noise"] & (b["landmark"] | ~_linked(b)))
    styled = read.where(F.col("host").isNotNull()).select("host", F.xxhash64(F.transform(body, lambda b: b["text"])).alias("page"), "inner").select(
        "host", "page", F.explode("inner").alias("i")).select("host", "page", "i.path", F.xxhash64("i.styles").alias("styles"))
    counted = styled.join(keys, ["host", "page"]).groupBy("host", "path", "styles", "key").count().groupBy(
        "host", "path", "styles").agg(F.count(F.lit(1)).alias("n"))
    shape = counted.groupBy("host", "path").agg(presentation_importance("n").alias("own"))
    own = F.coalesce("own", F.col("below"))
    nodes = below.join(shape, ["host", "path"], "left").join(pages, "host").select(
        "host", "path", "pages", "best", ((1 - opt.presentation) * F.col("below") + opt.presentation * own).alias("importance"))
    return nodes, contents.where("shown > 1").drop("chars")


def main_text(pages: DataFrame, opt: StyleTree = StyleTree()) -> DataFrame:
    """page_id, url and text of every page."""
    read = stage(read_pages(pages), "style-pages")
    nodes, repeated = style_tree(read, opt)
    enough = F.col("pages") >= opt.min_pages
    common_path = F.when(F.col("importance") < opt.threshold, F.col("path"))
    # a branch with an important node inside is not cut as a whole
    poor = F.greatest("importance", "best") < opt.named_threshold
    cut = nodes.where(enough & poor).groupBy("host").agg(
        F.collect_set(common_path).alias("cut"), F.collect_set("path").alias("cut_named"))
    # a page shows few texts, so few can be on a given share of the pages
    again = repeated.where((F.col("shown") >= opt.min_pages) & (F.col("importance") < opt.threshold)).groupBy("host").agg(
        F.collect_set(F.xxhash64("path", "content")).alias("again"))
    verdicts = _bounded(stage(cut.join(again, "host", "full"), "style-cut"), opt)
    judged = read.join(verdicts, "host", "left")
    for name, kind in (("cut", "string"), ("cut_named", "string"), ("again", "bigint")):
        judged = judged.withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))
    under = lambda b, name: F.exists(name, lambda c: (b["path"] == c) | b["path"].startswith(F.concat(c, F.lit("/"))))
    common = lambda b: (F.array_contains("again", F.xxhash64(b["path"], F.xxhash64(b["text"])))
                        | under(b, "cut") | (b["named"] & under(b, "cut_named")))
    read_as = F.transform(F.filter("blocks", lambda b: ~b["noise"] & (b["landmark"] | ~_linked(b))), lambda b: F.struct(
        b["text"].alias("text"), b["landmark"].alias("landmark"), common(b).alias("common")))
    chars = lambda a: F.aggregate(a, F.lit(0), lambda n, b: n + F.length(b["text"]))
    inside = lambda a: F.filter(a, lambda b: b["landmark"])
    copied = lambda a: 2 * chars(F.filter(inside(a), lambda b: b["common"])) > chars(inside(a))
    kept = let(read_as, lambda a: let(copied(a), lambda c: F.filter(a, lambda b: ~b["common"] | (b["landmark"] & c))))
    return judged.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text"))
