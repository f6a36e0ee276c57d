"""Main text of web pages by a site style tree."""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, cut

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
# HTML element groups.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img picture".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select", "datalist")}
# Elements and name parts whose branches have no importance wherever they stand.
_NOISE_TAGS = frozenset("nav footer aside form menu button select dialog head".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_NOISE_PARTS = frozenset("ad ads advert advertisement adverts advertising sponsor sponsored promo comment comments disqus reply replies cookie cookies consent gdpr notice notices banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead share sharing social related newsletter subscribe popup modal widget pagination pager toolbar".split())
# Parts of names that speak of a state of the page, not of what a branch is (ad-free, has-sidebar, menu-open).
_STATE_PARTS = frozenset("has with without no not non is free less open opened close closed show shown hide hidden visible enable enabled disable disabled active inactive on off loaded ready".split())
_MAIN_TAGS, _MAIN_ROLES = frozenset(("article", "main")), frozenset(("main", "article"))
#: Why a branch has no importance: its element or role; its name, outside of a marked article; its name, inside of one.
BY_KIND, BY_NAME, BY_NAME_INSIDE = 1, 2, 4
#: Unimportant paths (8 bytes each) of all sites together that may be broadcast; beyond that, sites are joined in so many parts.
BROADCAST_PATHS, SALTS = 1_000_000, 64
#: The importance of nodes inside article or main counts so many times.
RAISE = 2.0


def noise_name(names: str) -> bool:
    """Whether a class or id names a branch without importance: by the first or last part of a name none of whose parts is a state."""
    for name in names.split():
        parts = _PART.findall(name)
        if parts and (parts[0] in _NOISE_PARTS or parts[-1] in _NOISE_PARTS) and _STATE_PARTS.isdisjoint(parts):
            return True
    return False


class Page:
    """The branches of one page: text blocks with the style path of their node, and the style nodes at any depth."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, int, bool, int]] = []  # text, style path, inside the article, why it has no importance (0: it has)
        self.styles: dict[int, tuple[int, list[int], bool]] = {}  # path -> parent (which comes first), children in order, inside the article
        self.texts: list[tuple[int, int]] = []  # path, text hash
        self._stack: list[tuple[str, int, bool, int]] = []
        self._buffer: list[str] = []
        self._read(source)

    def _top(self) -> tuple[str, int, bool, int]:
        return self._stack[-1] if self._stack else ("", 0, False, 0)

    def _muted(self) -> bool:
        """Whether text here can be no article, even if that of the page lies in a branch with a telling name."""
        _, _, main, noise = self._top()
        return bool(noise & (BY_KIND | BY_NAME_INSIDE)) or bool(noise) and not main

    def _text(self, raw: str) -> None:
        if raw and not self._muted():
            self._buffer.append(entities.unescape(raw) if "&" in raw else raw)

    def _flush(self) -> None:
        text = " ".join("".join(self._buffer).split())
        self._buffer.clear()
        if text:
            i = len(self._stack)
            while i and self._stack[i - 1][0] in _INLINE:
                i -= 1
            _, path, main, noise = self._stack[i - 1] if i else ("", 0, False, 0)
            self.blocks.append((text, path, main, noise))
            self.texts.append((path, xxhash.xxh3_64_intdigest(text) >> 1))

    def _push(self, tag: str, attrs: str) -> None:
        _, parent, main, noise = self._top()
        style, named, role = tag, False, ""
        if attrs and "=" in attrs:
            for name, *value in _ATTR.findall(attrs):
                v = "".join(value).lower()
                if name.lower() == "role":
                    role = v
                else:
                    named = named or noise_name(v)
                style += f".{_DIGITS.sub('0', v)}"
        path = parent
        if tag not in _INLINE:
            path = xxhash.xxh3_64_intdigest(f"{parent}/{style}") >> 1
            inside = main or tag in _MAIN_TAGS or role in _MAIN_ROLES
            self.styles.setdefault(path, (parent, [], inside))
            if parent in self.styles:
                self.styles[parent][1].append(path)
        else:
            inside = main or role in _MAIN_ROLES
        if tag in _NOISE_TAGS or role in _NOISE_ROLES or (tag == "header" and not main):
            noise |= BY_KIND
        if named and tag not in ("html", "body") and (tag not in _MAIN_TAGS or main or noise):
            noise |= BY_NAME_INSIDE if inside else BY_NAME
        self._stack.append((tag, path, inside, noise))

    def _pop(self, names: tuple[str, ...], scope: tuple[str, ...] = ()) -> None:
        for i in range(len(self._stack) - 1, -1, -1):
            tag = self._stack[i][0]
            if tag in names:
                del self._stack[i:]
                return
            if tag in scope:
                return

    def _read(self, source: str) -> None:
        at, low = 0, None
        for m in _TOKEN.finditer(source):
            if m.start() < at:
                continue
            self._text(source[at : m.start()])
            at = m.end()
            tag = m.group(2) or m.group(5)
            if not tag:
                continue
            tag = tag.lower()
            close, attrs = bool(m.group(1) or m.group(4)), m.group(3) or m.group(6) or ""
            block = tag not in _INLINE
            if block and tag != "br":
                self._flush()
            if tag == "br":
                self._text(" ")
            elif close:
                if block and tag != "p" or any(x[0] == tag for x in self._stack):
                    self._pop((tag,), ("table",) if tag in _INLINE else ())
            elif tag in _RAW:
                low = source.lower() if low is None else low
                end = low.find(f"</{tag}", at)
                at = len(source) if end < 0 else end
            elif tag not in _VOID:
                if block:
                    self._pop(("p",), ("table", "td", "th", "button", "article", "body"))
                if tag in _CLOSES:
                    self._pop(_CLOSES[tag], _SCOPE[tag])
                if not attrs.endswith("/") or block:
                    muted = self._muted()
                    self._push(tag, attrs)
                    if not block and self._muted() and not muted:
                        self._buffer.append(" ")
        self._text(source[at:])
        self._flush()


def main_text(source: str | None, unimportant: frozenset[int] | set[int] = frozenset()) -> str:
    """The blocks of importance, one a line.

    Branches of the fixed kinds without importance go, and those whose style path the
    site's tree found unimportant, inside an article (article, main, or such a role) as
    outside of it. A name on a branch around the page's only article does not count for it.
    """
    if not source:
        return ""
    page = Page(source)
    gone: set[int] = set()
    if unimportant:
        for path, (parent, _, _) in page.styles.items():
            if path in unimportant or parent in gone:
                gone.add(path)
    free = any(main and not noise for _, _, main, noise in page.blocks)
    return "\n".join(text for text, path, main, noise in page.blocks if path not in gone and (not noise or main and not free))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Style nodes and texts, once a page: (host, path, parent, marked, kind, value, page)."""
    for b in batches:
        rows: list[tuple] = []
        for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            if not source:
                continue
            page, digest = Page(source), xxhash.xxh3_64_intdigest(source) >> 1
            found = {(path, parent, int(inside), 0, xxhash.xxh3_64_intdigest(repr(children)) >> 1) for path, (parent, children, inside) in page.styles.items()}
            for path, h in page.texts:
                parent, _, inside = page.styles.get(path, (0, [], False))
                found.add((path, parent, int(inside), 1, h))
            rows += [(host, *f, digest) for f in found]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["host", "path", "parent", "marked", "kind", "value", "page"])


def importance(paths: pd.DataFrame, gamma: float = 0.9, least_pages: int = 2) -> dict[int, tuple[float, float]]:
    """Of a site's style nodes: composite importance, and the greatest one in the node's branch.

    paths has (path, parent, pages, style_entropy, text_entropy) and may have marked and rare, the number of
    children of fewer than least_pages pages that are not in paths. A node of fewer than least_pages pages has the importance 1. A node without element children has the content importance 1 - text_entropy. An inner
    node weighs its presentation importance (the entropy of its children's styles) with
    the mean composite importance of its children and of its own text. Marked nodes count RAISE times, up to 1.
    """
    rows = {r.path: r for r in paths.itertuples()}
    children: dict[int, list[int]] = {}
    order = []
    for r in rows.values():
        if r.parent in rows and r.parent != r.path:
            children.setdefault(r.parent, []).append(r.path)
        else:
            order.append(r.path)
    for path in order:  # grows: every node comes after its parent
        order.extend(children.get(path, []))
    done: dict[int, tuple[float, float]] = {}
    for path in reversed(order):
        own, inner = rows[path], children.get(path, [])
        text = None if own.text_entropy is None or math.isnan(own.text_entropy) else 1 - own.text_entropy
        rare = int(getattr(own, "rare", 0))
        below = [done[c][0] for c in inner] + [1.0] * rare + ([text] if text is not None else [])
        if own.pages < least_pages:
            value = 1.0
        elif not inner and not rare:
            value = text if text is not None else 0.0
        else:
            part = gamma ** len(below)
            style = 0.0 if math.isnan(own.style_entropy) else own.style_entropy
            value = (1 - part) * style + part * (sum(below) / len(below))
        if getattr(own, "marked", 0):
            value = min(1.0, RAISE * value)
        done[path] = value, max([value, float(rare > 0), *(done[c][1] for c in inner)])
    return done


def style_tree(pages: DataFrame, least_pages: int = 2, threshold: float = 0.3) -> DataFrame:
    """(host, paths): the style paths of each site whose whole branch has an importance under the threshold.

    The tree of a site merges its distinct pages, so copies of a page count once, and
    holds the nodes inside marked articles too. Entropies are sums over counted rows, and
    pages are counted exactly. A node of fewer than least_pages distinct pages is
    important: one page gives no evidence. Such nodes (names made at random, one a page)
    only count at their parent, so what meets in one task a site are the nodes of its
    templates, whose number does not follow its pages.
    """
    seen = pages.mapInArrow(_stats, "host long, path long, parent long, marked int, kind int, value long, page long").groupBy("host", "path", "parent", "marked", "kind", "value").agg(F.count_distinct("page").alias("n"))
    nodes = seen.groupBy("host", "path", "parent").agg(
        F.max("marked").alias("marked"),
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"),
        F.sum(F.when(F.col("kind") == 0, F.col("n") * F.log("n"))).alias("style_nlogn"),
        F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("texts"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * F.log("n"))).alias("text_nlogn"),
    )
    m = F.log(F.greatest(F.col("pages"), F.lit(2)))
    seldom = nodes.where(F.col("pages") < least_pages).groupBy("host", F.col("parent").alias("path")).agg(F.count("*").alias("rare"))
    nodes = nodes.where(F.col("pages") >= least_pages).join(seldom, ["host", "path"], "left")
    nodes = nodes.select("host", "path", "parent", "marked", "pages", F.coalesce("rare", F.lit(0)).alias("rare"), (F.lit(1.0) - F.col("style_nlogn") / (F.col("pages") * m)).alias("style_entropy"), F.least(F.lit(1.0), F.col("text_nlogn") / (F.col("texts") * m)).alias("text_entropy"))

    def decide(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[pdf["pages"].notna()].drop_duplicates("path")
        low = [p for p, (_, most) in importance(known, least_pages=least_pages).items() if most < threshold]
        return pd.DataFrame({"host": [key[0]], "paths": [np.array(sorted(low), np.int64)]})

    return nodes.groupBy("host").applyInPandas(decide, "host long, paths array<long>")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **tree) -> DataFrame:
    """(id_col, url_col, text, n_chars): the main text of every whole page.

    Null or empty html, and pages without text of importance, give an empty text. A null
    url belongs to a site of its own kind. Ids may be null or repeat; each row gives a row.
    An empty table gives no rows. Columns other than the three are ignored.
    """
    arrow_batches(pages.sparkSession)
    host = F.xxhash64(F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[^:/?#]*:?//([^/?#]*)", 1)))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    low = cut(style_tree(rows.select("host", "html"), **tree).where(F.size("paths") > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h, frozenset(p or ())) for h, p in zip(b.column("html").to_pylist(), b.column("paths").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    if (low.agg(F.sum(F.size("paths") + 4)).first()[0] or 0) <= BROADCAST_PATHS:
        met = rows.join(F.broadcast(low), "host", "left")
    else:  # a site may hold a third of the pages, so each is spread over SALTS tasks
        dealt = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(dealt, ["host", "salt"], "left")
    done = met.select("page_id", "url", "html", "paths").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
    return done.withColumnsRenamed({"page_id": id_col, "url": url_col})
