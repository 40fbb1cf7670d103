"""Main text of web pages by consensus host paths (operator 13).

First pass: each page is read into containers and text blocks.  A container's score is
its text outside links and outside what its tag, role or names call boilerplate; the page
votes for the deepest container that holds most of it, by its generalised path: tags and
classes from the root, digits left out, as a 64-bit hash.  Spark counts the votes of each
host; paths with ``share`` of its pages win, so that there are at most 1 / ``share``.
Paths inside the voted containers whose text is the same on half of the host's pages or
more, five at least, while the articles differ, are notices.  Second pass: each page's
blocks are taken from the winning path that it has, its own best container otherwise.
Votes are combined before they are shuffled; what a host has won is a few hashes, written
first, so that a host with most of the pages is joined without gathering them.

Markup is read as browsers read it where that matters: implied ends of paragraphs, list
items and cells, raw text in scripts, comments, unclosed and misnested tags, ends of input
inside a tag.  ``br`` is white space within a block; other block-level tags end it.

Defined results: a null or empty html has empty text, also a page without blocks; pages
without a host do not vote and use their own container; repeated rows are extracted each,
and vote each; an empty table gives an empty result; columns other than page_id, url and
html are left out.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=)*+)>|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
OPEN_END = re.compile(r"<[A-Za-z/!?].*\Z", re.DOTALL)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements that end a paragraph and start blocks; all others are inline.
BLOCK = frozenset("""html head body address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption colgroup template object svg button select option legend label""".split())
#: Block elements that hold text rather than other containers; with a class they count as containers.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote address figcaption caption summary legend tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("tbody", "thead", "tfoot")}
STOPS = {"li": frozenset(("ul", "ol", "menu", "dir")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "option": frozenset(("select",))}
SCOPE = frozenset("html table td th caption template object".split())
TABLE = frozenset("table tbody thead tfoot tr".split())
#: Inline elements whose text is left out where their names say so.
INLINE = frozenset("a b em font i ins small span strong sub sup u".split())

#: Tags whose content is never article text, whatever they hold.
NEVER = frozenset("nav aside footer head template svg object button select option label dialog menu search".split())
#: Tags and roles whose content is not article text unless the article stands inside.
UNLESS = frozenset(("header", "form", "fieldset"))
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar".split())
#: Words of a class or id that name boilerplate.
NAMES = frozenset("""ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus feedback
footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices overlay pagination pager paywall popup popups promo promotion promoted related recommended replies
respond responses share sharing sidebar sidebars sidenav signup skiplink social sponsor sponsored subscribe subscription toolbar topbar widget widgets alert""".split())
ARTICLE = ("article", "main")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Names that say what a container comes with rather than what it is.
WITH = re.compile(r"(?:has|no|with|without|is|hide|show)[-_]")
HEAD = frozenset("html head meta link base title script style noscript template".split())
LINE = re.compile(r"\d+")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


@lru_cache(1 << 14)
def boilerplate(names: str) -> bool:
    """Whether a class or id names something that is not the article."""
    return any(not NAMES.isdisjoint(x.lower() for x in NAME.findall(name)) for name in names.split() if not WITH.match(name.lower()))


class Page:
    """Containers in page order (parent, path, whether left out) and blocks (container, text, link characters)."""

    def __init__(self, source: str):
        self.parent, self.tags, self.paths, self.named, self.never = [-1], [""], [0], [False], [False]
        self.inside_article = [False]
        self.blocks: list[tuple[int, str, int, str]] = []
        self._read(source)
        self._judge()

    def _read(self, source: str) -> None:
        open_tags: list[tuple[str, int, bool]] = []  # tag, the container that was current before it, and whether it mutes its text
        count: Counter[str] = Counter()
        at, links, muted, pieces, link_size, leaf = 0, 0, 0, [], 0, ""
        paths: dict[tuple[int, str], int] = {}

        def flush() -> None:
            nonlocal pieces, link_size
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self.blocks.append((at, text, link_size, leaf))
                pieces, link_size = [], 0

        def pop_to(n: int) -> None:
            nonlocal at, links, muted, leaf
            while len(open_tags) > n:
                tag, before, mute = open_tags.pop()
                muted -= mute
                count[tag] -= 1
                links -= tag == "a"
                if tag in BLOCK:
                    flush()
                    leaf = ""
                at = before

        def close(names, stops=SCOPE) -> None:
            """Ends the nearest of these elements, if no stop stands before it."""
            if not any(count[n] for n in names):
                return
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] in names:
                    pop_to(i)
                    return
                if open_tags[i][0] in stops:
                    return

        place, end = 0, len(source)
        while place < end:
            m = TOKEN.search(source, place)
            text = source[place : m.start() if m else end]
            if not m:
                cut = OPEN_END.search(text)
                text = text[: cut.start()] if cut else text
            if text and not muted:
                pieces.append(entities.unescape(text) if "&" in text else text)
                if links:
                    link_size += len(text)
            if not m:
                break
            place = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if count["head"] and tag not in HEAD:
                close(("head",), frozenset())
            if m[1]:
                if tag in ("html", "body"):  # what follows still belongs to the body
                    flush()
                elif tag in BLOCK:
                    if tag in HEADINGS:
                        close(HEADINGS)
                    else:
                        close((tag,), frozenset(("table", "template")) - {tag} if tag in TABLE else SCOPE - {tag})
                    flush()
                elif tag == "br":
                    pieces.append(" ")
                else:
                    close((tag,), BLOCK)
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, place)
                place = stop.end() if stop else end
                continue
            if tag == "br":
                pieces.append(" ")
                continue
            if tag == "a":
                close(("a",), BLOCK)
            if tag in BLOCK:
                flush()
                if tag in CLOSES:
                    close(CLOSES[tag], STOPS.get(tag, frozenset(("table", "template"))))
                if tag not in ("html", "body", "button", "label", "option", "select"):
                    close(("p",), SCOPE | {"button"})
                if tag in HEADINGS and open_tags and open_tags[-1][0] in HEADINGS:
                    pop_to(len(open_tags) - 1)
            if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCK:
                continue
            given = m[3]
            if given.strip(" \t\n\r\f/"):
                attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(given)}
                names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
                role = attributes.get("role", "").strip().lower()
                hidden = "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower()
            else:
                names, role, hidden = "", "", False
            mute = tag in INLINE and (hidden or boilerplate(names))
            open_tags.append((tag, at, mute))
            count[tag] += 1
            links += tag == "a"
            muted += mute
            if tag in LEAF:
                leaf = tag
            if tag in BLOCK and (tag not in LEAF or hidden or names.strip()):
                step = f"{tag}.{' '.join(sorted(LINE.sub('', names.lower()).split()))}"
                key = (self.paths[at], step)
                if key not in paths:
                    paths[key] = int.from_bytes(hashlib.blake2b(f"{key[0]}/{step}".encode(), digest_size=8).digest(), "big", signed=True)
                self.parent.append(at)
                self.tags.append(tag)
                self.paths.append(paths[key])
                self.named.append(tag not in ("html", "body", "main") and (tag in UNLESS or role in ROLES or boilerplate(names)))
                self.never.append(tag in NEVER or hidden)
                self.inside_article.append(self.inside_article[at] or self.tags[at] in ARTICLE and not self.named[at])
                at = len(self.parent) - 1
        flush()

    def _judge(self) -> None:
        """Which containers are left out, and the scores of the others with all they hold."""
        n = len(self.parent)
        held = [False] * n  # whether an article, or a heading of the first level, stands inside
        for at, _, _, leaf in self.blocks:
            held[at] = held[at] or leaf == "h1"
        for i in range(n - 1, 0, -1):
            if not self.never[i] and (held[i] or self.tags[i] == "h1" or self.tags[i] in ARTICLE and not self.named[i]):
                held[self.parent[i]] = True
        self.out = [False] * n
        for i in range(1, n):
            kept = held[i] and (self.tags[i] != "header" or self.inside_article[i])
            self.out[i] = self.out[self.parent[i]] or self.never[i] or self.named[i] and not kept
        self.score = [0.0] * n
        self.titled = [False] * n
        for at, text, linked, leaf in self.blocks:
            if not self.out[at]:
                self.score[at] += max(len(text) - linked, 0)
                if leaf == "h1":
                    self.titled[self.parent[at] if self.tags[at] == "h1" else at] = True
        for i in range(n - 1, 0, -1):
            self.score[self.parent[i]] += self.score[i]

    def best(self) -> int:
        """The deepest container that holds most of the text: down to the article, or else while seven tenths are in one child."""
        children: dict[int, int] = {}
        for i in range(1, len(self.parent)):
            up = self.parent[i]
            if up not in children or self.score[i] > self.score[children[up]]:
                children[up] = i
        at = 0
        while self.tags[at] != "article" and at in children and self.score[children[at]] > 0 and (
                self.score[children[at]] >= 0.7 * self.score[at] or self.tags[children[at]] in ARTICLE and self.score[children[at]] >= 0.3 * self.score[at]):
            at = children[at]
        while self.tags[at] in LEAF and at:
            at = self.parent[at]
        up = self.parent[at]
        if self.tags[at] not in ARTICLE and up > 0 and (self.tags[up] in ARTICLE or self.titled[up] and self.tags[up] != "body"):
            at = up
        return at

    def text(self, roots: list[int], notices: frozenset[int] = frozenset()) -> str:
        inside = [False] * len(self.parent)
        for i in roots:
            inside[i] = True
        for i in range(1, len(self.parent)):
            inside[i] = (inside[i] or inside[self.parent[i]]) and self.paths[i] not in notices
        return "\n".join(text for at, text, _, _ in self.blocks if inside[at] and not self.out[at])


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


VOTES = pa.schema([("host", pa.string()), ("path", pa.int64()), ("vote", pa.bool_()), ("score", pa.float64()), ("digest", pa.int64())])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for the voted container of each page, and one for each path inside it, with hashes of their texts."""
    for batch in batches:
        rows: list[tuple] = []
        for host, source in zip(batch["host"], batch["html"], strict=True):
            page = Page(source.as_py() or "")
            best = page.best()
            if not page.score[best]:
                continue
            name = host.as_py()
            rows.append((name, page.paths[best], True, page.score[best], _digest(page.text([best]))))
            texts: dict[int, list[str]] = {}
            inside = {best}
            for i in range(best + 1, len(page.parent)):
                if page.parent[i] in inside and not page.out[i]:
                    inside.add(i)
                    texts[page.paths[i]] = []
            for at, text, _, _ in page.blocks:
                if at != best and at in inside:
                    texts[page.paths[at]].append(text)
            rows += [(name, path, False, 0.0, _digest("\n".join(t))) for path, t in texts.items() if t]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), VOTES.types, strict=True)], schema=VOTES) if rows \
            else pa.RecordBatch.from_pylist([], schema=VOTES)


TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for source, paths, notices in zip(batch["html"], batch["paths"], batch["notices"], strict=True):
            page = Page(source.as_py() or "")
            where: dict[int, list[int]] = {}
            for i, path in enumerate(page.paths):
                if page.score[i] > 0 and not page.out[i]:
                    where.setdefault(path, []).append(i)
            won = next((where[p] for p in paths.as_py() or [] if p in where), None)
            out.append(page.text(won or [page.best()], frozenset(notices.as_py() or [])))
        yield pa.RecordBatch.from_arrays([batch["page_id"].cast(pa.int64()), batch["url"], pa.array(out, pa.string())], schema=TEXTS)


def winners(pages: DataFrame, share: float = 0.1, same_on: int = 5) -> DataFrame:
    """What each host has voted for: host, paths (most votes first; 1 / ``share`` at most), notices."""
    votes = pages.filter("host is not null and html is not null").select("host", "html").mapInArrow(_votes, "host string, path long, vote boolean, score double, digest long")
    counts = common.materialize(votes.groupBy("host", "path", "vote").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"), F.min("digest").alias("low"), F.max("digest").alias("high")), "html-votes")
    hosts = counts.filter("vote").groupBy(F.col("host").alias("of")).agg(F.sum("n").alias("total"), F.min("low").alias("least"), F.max("high").alias("most"))
    hosts = common.materialize(hosts, "html-hosts")
    joined = counts.join(hosts, F.col("host") == F.col("of"))
    won = joined.filter(F.col("vote") & (F.col("n") >= F.col("total") * share))
    notice = joined.filter(~F.col("vote") & (F.col("low") == F.col("high")) & (F.col("n") >= same_on) & (F.col("n") * 2 >= F.col("total")) & (F.col("least") != F.col("most")))
    ranked = won.unionByName(notice).groupBy("host").agg(
        F.sort_array(F.collect_list(F.when(F.col("vote"), F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("s"), "path")))).alias("ranked"),
        F.collect_list(F.when(~F.col("vote"), F.col("path"))).alias("notices"))
    return ranked.select(F.col("host").alias("of"), F.col("ranked.path").alias("paths"), "notices")


def extract(pages: DataFrame, share: float = 0.1) -> DataFrame:
    """The main text of each page: page_id, url, text."""
    hosted = pages.select("page_id", "url", "html", F.lower(F.nullif(F.regexp_extract("url", HOST, 1), F.lit(""))).alias("host"))
    known = common.materialize(winners(hosted, share), "html-winners")
    joined = hosted.join(known, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "paths", "notices")
    return joined.mapInArrow(_texts, "page_id long, url string, text string")


def op13_html_extract(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
