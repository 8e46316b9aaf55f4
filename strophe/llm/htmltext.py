"""Main text of web pages by templates that pages of a host share."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_batch, redealt, slices, stored

#: Shares of each host's pages that are joined with its template apart from one another, so that a host with very many pages is no single task.
SALT = 32
#: Templates of all hosts together up to this many bytes are sent to every task; beyond, pages and templates meet by host.
SENT = 32 << 20
#: Least share of a host's pages that a template's tokens are on.
SUPPORT = 0.5

# Elements by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold is no markup.
RAW = ("script", "style", "textarea", "title", "noframes", "xmp", "iframe")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold main text.
CHROME = frozenset("nav header footer aside form script style noscript template svg iframe object button select textarea title head dialog menu canvas audio video map fieldset noframes xmp".split())
#: Words in a class or an id that say the same.
CHROME_NAMES = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs
footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations
comment comments disqus respond reply replies login search searchbox widget toolbar pagination pager copyright hidden skip""".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
MAIN = frozenset(["article", "main"])
#: A tag that opens ends an open element of these, up to the nearest of those after it.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body table ul ol dl div article main section nav aside header footer blockquote form select td th".split())
P_ENDS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$)""", re.I)
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}


def _chrome(name: str, given: dict[str, str]) -> bool:
    if name in CHROME:
        return True
    if "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", given.get("style", "")) or given.get("role") in CHROME_ROLES:
        return True
    if name in MAIN or name in ("html", "body"):
        return False
    for value in (given.get("class"), given.get("id")):
        for word in (value or "").split():
            parts = re.split(r"[-_]+", word)
            if parts[0] not in ("has", "no", "with", "without", "is") and (parts[0] in CHROME_NAMES or parts[-1] in CHROME_NAMES):
                return True
    return False


class Page:
    """A page's tokens in order. Every token has a path, the open elements with their first class: tags are tokens ("<" with their path), and so are texts. texts: (path, whether below main, whether below chrome, text, number of the container). A text ends where an element begins or ends that is not inline; white space is one space, character references are decoded."""

    def __init__(self, source: str):
        self.tags: list[str] = []
        self.texts: list[tuple[str, bool, bool, str]] = []
        stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # name, path, main, chrome
        pieces: list[str] = []

        def end_text() -> None:
            if pieces:
                if text := " ".join("".join(pieces).split()):
                    top = next(s for s in reversed(stack) if s[0] not in INLINE)
                    self.texts.append((top[1], stack[-1][2], stack[-1][3], text))
                pieces.clear()

        at, n = 0, len(source)
        search = _TAG.search
        while at < n:
            m = search(source, at)
            stop = m.start() if m else n
            if stop > at:
                piece = source[at:stop]
                pieces.append(entities.unescape(piece) if "&" in piece else piece)
            if not m:
                break
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                if m[0].startswith("<![CDATA["):
                    pieces.append(m[0][9:].removesuffix("]]>"))
                continue
            inline = name in INLINE
            if m[1] or m[4]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        if not inline or any(s[0] not in INLINE or s[3] != stack[k - 1][3] for s in stack[k:]):
                            end_text()
                        del stack[k:]
                        break
                continue
            given = {}
            if rest := m[3] or m[6]:
                given = {a.lower(): (x or y or z).lower() for a, x, y, z in _ATTRIBUTE.findall(rest)}
            chrome = _chrome(name, given)
            if not inline or chrome:
                end_text()
            ends = CLOSES.get(name, ()) if name != "p" else ()
            if name in P_ENDS:
                ends = ("p",)
            if ends:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        del stack[k:]
                        break
                    if stack[k][0] in SCOPE:
                        break
            kind = given.get("class", "").split()
            path = f"{stack[-1][1]}/{name}{'.' + kind[0] if kind else ''}" if not inline else stack[-1][1]
            if not inline:
                self.tags.append(path)
            if name in VOID:
                if name == "wbr":
                    continue
                pieces.append(" ")
                continue
            top = stack[-1]
            main = top[2] or name in MAIN or given.get("role") == "main" or given.get("itemprop") == "articlebody"
            if name in RAW:
                ended = _END[name].search(source, at)
                at = ended.end() if ended else n
                continue
            if len(stack) < 512:  # deeper elements count to the one at this depth
                stack.append((name, path, main, top[3] or chrome))
        end_text()

    def visible(self) -> Iterator[tuple[str, bool, str]]:
        """(path, below main, text) of the texts outside chrome."""
        return ((p, main, t) for p, main, chrome, t in self.texts if not chrome)


def host(url: Column) -> Column:
    """The host of an address in lower case, without the port; null for none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))


#: kind 0: a tag by its path; kind 1: a text by its path and hash; kind 2: the path of texts. others: as a set of 64 bits, what a text stands beside.
TOKENS = "host string, kind int, token string, low long, high long, n_pages long, weight long, others long"
#: Least pages of a host that a text must be on, and least tokens that a class must have, to be a template's.
PAGES, LARGE = 3, 2


def candidates(page: Page) -> list[tuple[str, str]]:
    """(path, text) of what may be main text: the texts below a main element, or, on a page without one, all outside chrome."""
    found = list(page.visible())
    return [(p, t) for p, main, t in found if main] or [(p, t) for p, _, t in found]


def page_tokens(page: Page) -> dict[tuple[int, str], tuple[int, int, int]]:
    """The tokens of a page: for each (kind, token) how often it is there, its characters, and, for texts, a bit for the hash of the longest other text."""
    out: dict[tuple[int, str], list[int]] = {}

    def add(kind: int, token: str, weight: int, bit: int) -> None:
        x = out.setdefault((kind, token), [0, 0, 0])
        x[0] += 1
        x[1] += weight
        x[2] |= bit

    for tag in page.tags:
        add(0, tag, 0, 0)
    texts = candidates(page)
    long = sorted({t for _, t in texts}, key=lambda t: (-len(t), t))[:2] + ["", ""]
    first, second = 1 << (_hash(long[0]) & 63), 1 << (_hash(long[1]) & 63)
    for path, text in texts:
        add(1, f"{path} {_hash(text):016x}", len(text), second if text == long[0] else first)
        add(2, path, len(text), 0)
    return {k: tuple(v) for k, v in out.items()}


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host and token of a task's pages: the occurrence vector as two sums, the pages, the characters and the others.

    An occurrence vector has a place for each page of the host, with how often the token is there. Two vectors are taken for equal if the sums over the pages of a 64-bit hash of page and count are, in halves of 32 bits so that sums of two milliards of pages fit.
    """
    sums: dict[tuple, list[int]] = {}

    def flush() -> pa.RecordBatch:
        rows = [(h, kind, token, *v) for (h, kind, token), v in sums.items()]
        types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in TOKENS.split(", ")])

    for b in (part for whole in batches for part in slices(whole)):
        for number, h, source in zip(b.column("content").to_pylist(), b.column("host").to_pylist(), b.column("html").to_pylist()):
            for (kind, token), (n, weight, bit) in page_tokens(Page(source or "")).items():
                x = xxhash.xxh64_intdigest(f"{number}:{n}")
                s = sums.setdefault((h, kind, token), [0, 0, 0, 0, 0])
                s[0] += x & 0xFFFFFFFF
                s[1] += x >> 32
                s[2] += 1
                s[3] += weight
                x = (s[4] & (1 << 64) - 1) | bit
                s[4] = x - (1 << 64) if x >> 63 else x
            if len(sums) > 100_000:
                yield flush()
    if sums:
        yield flush()


def contents(pages: DataFrame) -> DataFrame:
    """(host, content, html): each page of a host once, however many rows have the same html; content is its hash. Pages without a host are left out. Only pages that there are several of are shuffled, and these are summed up before."""
    p = pages.select(host(F.col("url")).alias("host"), F.xxhash64("html").alias("content"), "html").where("host is not null")
    several = redealt(p.groupBy("host", "content").agg(F.count("*").alias("n")).where("n > 1").select("host", "content"), "host", "content")
    once = p.join(several, ["host", "content"], "left_anti")
    return once.unionByName(p.join(several, ["host", "content"], "left_semi").groupBy("host", "content").agg(F.first("html").alias("html")))


def classes(pages: DataFrame) -> DataFrame:
    """The frequent equivalence classes of each host: tokens with one occurrence vector over its pages, on at least SUPPORT of them: (host, n_pages, pages, tokens), tokens an array of (kind, token, weight, others). Paths of texts, which are none of a template's tokens, are classes of their own with n_pages null.

    Tokens are summed up within tasks and by Spark before the shuffle; what is left for a host is bounded by a page's size, as no more tokens can be on half the pages than a page has twice.
    """
    p = contents(pages)
    t = p.mapInArrow(_token_rows, TOKENS).groupBy("host", "kind", "token").agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum("n_pages").alias("n_pages"), F.sum("weight").alias("weight"), F.bit_or("others").alias("others"))
    t = stored(t, "tokens")
    n = pages.select(host(F.col("url")).alias("host"), F.xxhash64("html").alias("content")).where("host is not null").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    t = t.join(redealt(n, "host"), "host").where(F.col("n_pages") >= SUPPORT * F.col("pages"))
    vector = F.when(F.col("kind") < 2, F.struct("low", "high"))
    frequent = t.groupBy("host", vector.alias("vector"), F.when(F.col("kind") < 2, F.col("n_pages")).alias("n_pages"), "pages").agg(F.array_sort(F.collect_list(F.struct("kind", "token", "weight", "others"))).alias("tokens"))
    return frequent.select("host", "n_pages", "pages", "tokens")


def varied(n_pages: int, others: int) -> bool:
    """Whether a text on so many pages stands beside ever other texts: at least two, and half as many as if each page had its own, as far as 64 bits tell. What stands beside the same text everywhere is part of copied pages."""
    return (others & (1 << 64) - 1).bit_count() >= max(2, 32 * (1 - (63 / 64) ** n_pages))


def template(found: list[tuple[int | None, int, list[tuple[int, str, int, int]]]]) -> tuple[set[str], set[str], str | None]:
    """From the classes (n_pages, pages, tokens) of a host its template: (tags, texts, container).

    Texts that are on fewer than PAGES pages, or that are part of copied pages (varied), are no template's and leave their classes. Classes nest: every tag of a class stands below a tag of a valid class or at the top, and every text in an element whose tag is one of a valid class (nested). Of classes that nest, those of LARGE tokens are valid for texts: a lone text with an occurrence vector of its own, as two articles of a host may share it, is a slot's value. container is the slot for pages without a main element: the path below which most characters stand that are not the template's.
    """
    kept = []
    weight: dict[str, int] = {}
    for n, _, tokens in found:
        if n is None:
            weight |= {t: w for _, t, w, _ in tokens}
        else:
            kept.append([(k, t, w) for k, t, w, others in tokens if k == 0 or n >= PAGES and varied(n, others)])
    tags = nested([[t for k, t, _ in c if k == 0] for c in kept]) | {""}
    texts = {t: w for c in kept if len(c) >= LARGE for k, t, w in c if k == 1 and t.rsplit(" ", 1)[0] in tags}
    for t, w in texts.items():
        weight[t.rsplit(" ", 1)[0]] -= w
    best = max(((w, t) for t, w in weight.items() if t in tags and w > 0), default=(0, None))
    return tags, set(texts), best[1]


def templates(pages: DataFrame) -> DataFrame:
    """For each host its template (template): (host, texts, container). A host's classes are one row of one task, as they are bounded by a page's size."""
    g = classes(pages).groupBy("host").agg(F.collect_list(F.struct("n_pages", "pages", "tokens")).alias("classes"))

    def f(b: pa.RecordBatch) -> dict:
        rows = [template([(c["n_pages"], c["pages"], [(x["kind"], x["token"], x["weight"], x["others"]) for x in c["tokens"]]) for c in cs]) for cs in b.column("classes").to_pylist()]
        return {"host": b.column("host"), "texts": [sorted(r[1]) for r in rows], "container": [r[2] for r in rows]}

    return per_batch(g, "host string, texts array<string>, container string", f)


def nested(classes: list[list[str]]) -> set[str]:
    """The tags of the valid classes: each of a class's tags stands, step by step upwards to the top, below tags of classes that are valid so far as that is known. Classes that fail are taken out until none fails."""
    left = [set(c) for c in classes if c]
    while True:
        there = set().union(*left) if left else set()
        fine = [c for c in left if all((parent := t.rsplit("/", 1)[0]) == "" or parent in there for t in c)]
        if len(fine) == len(left):
            return there
        left = fine


def main_text(source: str, texts: set[str], container: str | None) -> str:
    """The texts in a page's slots, joined by a space: its candidates without what is the template's (texts); if nothing is left, all candidates. On a page without a main element those below the container count (with its parent, so that headings beside paragraphs do), if there are any."""
    page = Page(source)
    found = candidates(page)
    slots = [(p, t) for p, t in found if f"{p} {_hash(t):016x}" not in texts] or found
    if container and not any(main for _, main, _ in page.visible()):
        top = container.rsplit("/", 1)[0] if re.search(r"/(p|li|h[1-6]|td|blockquote|pre|dd|dt)(\.[^/]*)?$", container) else container
        slots = [(p, t) for p, t in slots if p == top or p.startswith(top + "/")] or slots
    return " ".join(t for _, t in slots)


def extract(pages: DataFrame) -> DataFrame:
    """For each row: page_id, url, text (the main text, empty if there is none) and n_chars, its code points.

    A null html is empty; a page without a host in its url, or of a host with fewer than three different pages, has no template texts, so its elements decide. Whole pages are read, whatever their length; tags that are never closed or never opened do not matter. Repeated rows stay, and as pages with equal html count once for the template, they keep their text; an empty table gives none, other columns do not matter. Templates are sent to where the pages are, if all of them have no more than SENT bytes; else a host's template meets SALT shares of the host's pages. The rows are the same.
    """
    p = pages.select("page_id", "url", "html").withColumn("_host", host(F.col("url")))
    t = stored(templates(pages), "templates").withColumnRenamed("host", "_host")
    size = t.agg(F.sum(64 + F.octet_length(F.concat_ws("", "texts")) + 16 * F.size("texts"))).first()[0] or 0
    if size <= SENT:
        joined = p.join(F.broadcast(t), "_host", "left")
    else:
        p = p.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
        joined = p.join(t.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["_host", "_salt"], "left")

    def f(b: pa.RecordBatch) -> dict:
        out = [main_text(source or "", set(texts or ()), container) for source, texts, container in zip(*(b.column(c).to_pylist() for c in ("html", "texts", "container")))]
        return {"page_id": b.column("page_id"), "url": b.column("url"), "text": out, "n_chars": [len(x) for x in out]}

    return per_batch(joined, "page_id long, url string, text string, n_chars long", f)
