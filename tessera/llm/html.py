"""Main text of web pages by consensus host paths.

Each page's containers are scored by the prose that stands directly in them; per host, Spark sums
the scores of generalised tag-class paths; the winning paths of a host then choose, in a second
reading of each page, the containers whose text is kept: all below the article that a path stands in.
"""

from __future__ import annotations

import hashlib
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, by_value, small_batches, table

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object canvas noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
LEFT_OUT = frozenset("nav header footer aside form menu button select option input label head dialog fieldset legend dir".split())
CONTAINER = frozenset("article main section div td body center blockquote".split())
#: Elements that a new one of the set on the right closes.
CLOSES = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: Words of a class, id or role that mark what is not the article.
ODD = re.compile(
    r"(?<![a-z])(?:ad|ads|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar|side|aside|widget\w*|footer|foot|header|masthead|topbar|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|"
    r"newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|more-?posts|comment\w*|disqus|respon[ds]\w*|repl(?:y|ies)|discussion|pagination|pager|tags?|toolbar|search\w*|complementary|contentinfo|navigation|legal|copyright|disclaimer|hidden)(?![a-z])"
)
#: Names that tell of what is around, not of what the element is.
ABOUT = re.compile(r"(?:has|no|with|without|is|js)[-_]")
#: Beside a name of this kind a name that is odd in part does not count.
ARTICLE = re.compile(r"(?<![a-z])(?:article|post|entry|story|content|main|body|text)(?:[-_]?(?:body|content|text))?(?![a-z])")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")
#: Of the marks above, names that an article's own container may have: there the vote decides, not the name.
WEAK = re.compile(r"(?<![a-z])(?:legal|disclaimer|copyright|notice\w*|tags?|social|share|sharing|discussion|related|promo\w*|alert|hidden|side|widget\w*|search\w*|header|masthead)(?![a-z])")
#: What a container of such a name must have of prose, against others, to be taken for the article.
DOUBT = 0.25
#: Containers nested deeper than this have the path of the one at this depth; longer classes are hashed.
MOST_DEEP, MOST_LABEL = 64, 80
#: Hosts' winning and side paths are broadcast up to so many bytes; beyond, they are joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: Shares of a host's pages that a winning path's votes, and the pages of a side path, reach at least.
WINNER_SHARE, SIDE_SHARE = 0.02, 0.01


def is_odd(tag: str, names: list[str]) -> bool:
    """Whether an element's classes, id and role say that it is no part of the article."""
    names = [x for x in names if not ABOUT.match(x)]
    if not names:
        return False
    if any(ODD.fullmatch(x) for x in names):
        return tag != "main"
    return tag not in ("article", "main") and any(ODD.search(x) for x in names) and not any(ARTICLE.fullmatch(x) for x in names)


def is_weak(names: list[str]) -> bool:
    """Whether all odd ones of an element's names are such as an article's container may have."""
    return all(WEAK.search(x) for x in names if not ABOUT.match(x) and ODD.search(x))


def blocks(html: str, strict: bool = True) -> list[tuple[str, str, float]]:
    """The page's text blocks in order, each with the path of its container and its share of link text.

    Left out are scripts, styles, comments in the markup, and all below an element that by its
    tag, class, id or role is not part of the article (a header within an article is). Where that
    leaves nothing of a page, only tags decide and forms count as text. A path is the container's
    tag and class, digits as #, below those of the containers around it; a container whose name is
    in doubt has a ! behind its tag, and what is below it is text only where that path is chosen.
    br and block elements end a block.
    """
    out: list[tuple[str, str, float]] = []
    words: list[str] = []
    linked = 0
    # tag, left out, path of the nearest container, within a link, within an article, containers around
    stack: list[tuple[str, bool, str, bool, bool, int]] = [("", False, "", False, False, 0)]
    paragraphs = 0
    unclosed: set[str] = set()
    at, n = 0, len(html)

    def cut(k: int) -> None:
        nonlocal paragraphs
        paragraphs -= sum(s[0] == "p" for s in stack[k:])
        del stack[k:]

    def flush() -> None:
        nonlocal linked
        if words:
            raw = "".join(words)
            text = SPACE.sub(" ", unescape(raw)).strip()
            words.clear()
            if text:
                out.append((text, stack[-1][2], min(1.0, linked / len(raw))))
        linked = 0

    def close(tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                if tag in BLOCK or any(s[0] in BLOCK for s in stack[k:]):
                    flush()
                cut(k)
                return
            if tag not in BLOCK and stack[k][0] in BLOCK:
                return

    while at < n:
        m = TOKEN.search(html, at)
        to = m.start() if m else n
        if to > at and not stack[-1][1]:
            words.append(html[at:to])
            linked += (to - at) * stack[-1][3]
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag == "p" and not paragraphs:
                flush()
            close(tag)
            continue
        if tag in RAW:
            attributes = m[3] or m[6] or ""
            if not attributes.rstrip().endswith("/"):
                # where one such element has no end, no later one has
                end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                if end is None:
                    unclosed.add(tag)
                at = end.end() if end else n if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag == "br":
            flush()
            continue
        if tag in BLOCK:
            flush()
        for inner, enders in CLOSES.items():
            if tag in enders:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == inner:
                        flush()
                        cut(k)
                        break
                    if stack[k][0] in CONTAINER or stack[k][0] in ("table", "ul", "ol", "dl") or stack[k][0] in LEFT_OUT:
                        break
        if tag in VOID:
            continue
        _, left_out, path, link, article, deep = stack[-1]
        doubt = False
        attributes = m[3] or m[6] or ""
        label = ""
        if attributes and ("=" in attributes or "hidden" in attributes):
            found = {a[1].lower(): (a[2] or a[3] or a[4] or "").lower() for a in ATTRIBUTE.finditer(attributes)}
            label = DIGITS.sub("#", ".".join(sorted(found.get("class", "").split())))
            if len(label) > MOST_LABEL:
                label = hashlib.md5(label.encode()).hexdigest()
            if not left_out and strict and tag not in ("html", "body"):
                names = [*found.get("class", "").split(), *found.get("id", "").split(), *found.get("role", "").split()]
                odd = is_odd(tag, names)
                doubt = odd and tag in CONTAINER and is_weak(names)
                left_out = odd and not doubt or "hidden" in found or found.get("aria-hidden") == "true" or bool(HIDDEN.search(found.get("style", "")))
        left_out = left_out or tag in LEFT_OUT and not (tag == "header" and article) and (strict or tag != "form")
        article = article or tag == "article"
        if tag in CONTAINER and deep < MOST_DEEP:
            path, deep = f"{path}>{tag}{'!' * doubt}{'.' * bool(label)}{label}", deep + 1
        else:
            left_out = left_out or doubt
        if attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        stack.append((tag, left_out, path, link or tag == "a", article, deep))
        paragraphs += tag == "p"
    flush()
    return blocks(html, strict=False) if strict and not out and "<" in html else out


def scores(found: list[tuple[str, str, float]]) -> dict[str, float]:
    """A score for each path of one page: words and sentence marks of its own blocks that are no link.

    An article or main element weighs more, as does a container with several blocks.
    """
    own: dict[str, list[float]] = {}
    for text, path, link in found:
        n = text.count(" ") + 1
        x = own.setdefault(path, [0, 0])
        x[0] += (n + 2 * (text.count(".") + text.count(","))) * (1 - 0.95 * link)
        x[1] += 1
    out: dict[str, float] = {}
    for path, (mass, n) in own.items():
        last = path.rsplit(">", 1)[-1].split(".")[0].rstrip("!")
        out[path] = mass * (2.0 if last in ("article", "main") else 1.0) * (1 + min(n, 10) / 10) * (DOUBT if "!" in path else 1.0)
    return out


def roots(path: str) -> list[str]:
    """Where the article of a path begins: its outermost article, else container that is named so, else main, else itself.

    Sections that stand side by side are one article; a quotation belongs to what is around it.
    """
    parts = path.split(">")
    last = [x.replace("!", "", 1).split(".") for x in parts]
    for test in (lambda x: x[0] == "article", lambda x: x[0] in ("div", "section") and any(ARTICLE.fullmatch(c) for c in x[1:]), lambda x: x[0] == "main"):
        k = next((k for k, x in enumerate(last) if test(x)), None)
        if k is not None:
            parts, last = parts[: k + 1], last[: k + 1]
            break
    else:
        while len(parts) > 2 and last[-1][0] == "blockquote":
            parts, last = parts[:-1], last[:-1]
    root = ">".join(parts)
    return [root, any_class(root)] if last[-1][0] == "section" else [root]


def any_class(path: str) -> str:
    """The path with its last container of any class."""
    around, _, last = path.rpartition(">")
    return f"{around}>{last.split('.')[0]}.*"


def best_of(s: dict[str, float]) -> str:
    """The path of the highest score."""
    return max(s, key=lambda p: (s[p], -len(p), p))


def text_of(found: list[tuple[str, str, float]], winners: list[str] | None, side: list[str] | None = None) -> str:
    """Blocks below the roots of winning paths, joined by newlines.

    Where these have less than half of the page's score, and the page's own best path is not one
    that other pages of the host score low (``side``), blocks below its root.
    """
    s = scores(found)
    if not s:
        return ""

    def below(paths: list[str]) -> set[str]:
        chosen = {r for p in paths for r in roots(p)}
        out = set()
        for p in s:
            ends = [k for k, c in enumerate(p) if c == ">"] + [len(p)]
            # the deepest root that the path is or lies below; what is below it in doubt stays out
            root = next((p[:k] for k in reversed(ends) if p[:k] in chosen or any_class(p[:k]) in chosen), None)
            if root is not None and "!" not in p[len(root) :]:
                out.add(p)
        return out

    kept, own = below(winners or []), best_of(s)
    if not kept or own not in kept and own not in (side or []) and sum(s[p] for p in kept) < 0.5 * sum(s.values()):
        kept = below([own])
    return "\n".join(t for t, p, _ in found if p in kept)


def host_of(url: Column) -> Column:
    """The lower-case host of a URL without www; empty where there is none."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))), r"^www\.", "")


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, votes, pages and best (pages on which it scores most): each page splits one vote between its containers by score."""

    def run(batches):
        for b in batches:
            rows: dict[tuple[str, str], list[float]] = {}
            for host, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = scores(blocks(html.as_py() or ""))
                own = best_of(s) if s else None
                # containers in doubt take no vote from the others, unless one of them is the page's best
                total = sum(x for p, x in s.items() if "!" not in p or "!" in own) or 1.0
                for path, x in s.items():
                    v = rows.setdefault((host, path), [0.0, 0, 0])
                    v[0] += min(1.0, x / total)
                    v[1] += 1
                    v[2] += path == own
            if rows:
                host, path = zip(*rows, strict=True)
                votes, n, best = zip(*rows.values(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(host), pa.array(path), pa.array(votes), pa.array(n, pa.int64()), pa.array(best, pa.int64())], names=["host", "path", "votes", "pages", "best"])

    voted = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(run, "host string, path string, votes double, pages long, best long")
    # rounding makes the sums the same in any order
    return voted.groupBy("host", "path").agg(F.sum(F.round("votes", 6).cast("decimal(28,6)")).alias("votes"), F.sum("pages").alias("pages"), F.sum("best").alias("best"))


def winners(paths: DataFrame, share: float = 0.5) -> DataFrame:
    """host, its winning paths (the best and all with ``share`` of its votes) and side paths (a page's best, but under half of the votes of the pages that have it).

    A path of a single page is in neither: there its own score decides. As a page casts one vote, the
    shares that are asked for bound the paths of a host.
    """
    hosts = paths.groupBy("host").agg(F.max("votes").alias("top"), F.sum("votes").alias("cast"))
    w = paths.where("pages > 1").join(hosts, "host")
    won = (F.col("votes") >= F.col("top") * share) & (F.col("votes") >= F.col("cast") * WINNER_SHARE)
    side = ~won & (F.col("best") > 0) & (F.col("votes") < 0.5 * F.col("pages")) & (F.col("pages") >= F.col("cast") * SIDE_SHARE)
    return w.where(won | side).groupBy("host").agg(F.sort_array(F.collect_list(F.when(won, F.col("path")))).alias("paths"), F.sort_array(F.collect_list(F.when(side, F.col("path")))).alias("side"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without its html, with text and n_chars (code points).

    Null or empty html gives an empty text; pages without a host vote together; repeated pages
    are rows of their own and vote each; of paths that score alike the shorter wins; an empty table
    gives an empty result. Input columns named text or n_chars are replaced. A page is parsed in one
    pass whatever its length and depth.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "html")
    small_batches(spark)
    won = scratch.save(winners(scratch.save(host_paths(pages, url_col, html_col))).select(F.col("host").alias("__host"), F.col("paths").alias("__paths"), F.col("side").alias("__side")))
    size = won.agg(F.sum(F.length(F.concat_ws(" ", "__host", F.concat_ws(" ", "__paths"), F.concat_ws(" ", "__side"))))).first()[0] or 0
    side = F.broadcast(won) if size <= BROADCAST_BYTES else won
    kept = [f for f in pages.schema.fields if f.name not in (html_col, "text", "n_chars")]
    rows = pages.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{html_col}`").alias("__html"), host_of(F.col(f"`{url_col}`")).alias("__host")).join(side, "__host", "left").drop("__host")

    def run(batches):
        for b in batches:
            names = b.schema.names
            texts = [text_of(blocks(h.as_py() or ""), p.as_py(), x.as_py()) for h, p, x in zip(*(b.column(names.index(c)) for c in ("__html", "__paths", "__side")), strict=True)]
            columns = [b.column(names.index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f.name for f in kept), "text", "n_chars"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string, n_chars long"]))


def op4_consensus_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


by_value(__name__)
