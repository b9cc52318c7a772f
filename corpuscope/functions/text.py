"""Column functions over urls and texts. All are built-in expressions unless said otherwise."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser
from pathlib import Path
from urllib.parse import urljoin

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of pages that hold no content.
BOILERPLATE = ("while your request is being verified", "scrapers break the web", "Javascript is required for this site", "domain name registration has expired", "doesn't work properly without JavaScript")
SITE_TYPES = (("BLOG", r"/blog/|blog\."), ("WIKI", r"/wiki|\.wiki|wiki\."), ("NEWS", r"/news/|/articles/|articles\.|news\."), ("NEWSAPI", None), ("SHOP", r"/shop/|shop\."))


def news_domains(path: str | Path | None = None) -> list[str]:
    """Domains of news sites, one per line; the packaged list, or a file's."""
    lines = Path(path or Path(__file__).with_name("news_domains.txt")).read_text().split("\n")
    return sorted({s.strip().rstrip("/") for s in lines if s.strip()})


def news_pattern(domains: list[str] | None = None) -> str:
    """A regex for any of the domains after a slash or a dot, so that no longer name is taken for one. It means the same in Spark and in SQL engines with RE2."""
    names = news_domains() if domains is None else domains
    return "[/.](?:" + "|".join(re.sub(r"([.?+*()\[\]{}|^$\\])", r"\\\1", d) for d in names) + ")"


def host(url: Column) -> Column:
    """The host of a url in lower case, without port or user; null where there's none or the url is malformed."""
    h = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(h != "", h)


def link_domain(url: Column) -> Column:
    """What follows the last // up to a slash or question mark, with its port; null without //."""
    d = F.regexp_extract(url, r".*//([^/?]*)", 1)
    return F.when(d != "", d)


def site_type(url: Column, domains: list[str] | None = None) -> Column:
    """The first rule that the url meets; UNKNOWN otherwise, also for a null url."""
    out = None
    for name, pattern in SITE_TYPES:
        test = url.rlike(pattern or news_pattern(domains))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("UNKNOWN")


def is_ai(score: Column, human_lt: float = 0.005, ai_gt: float = 0.9) -> Column:
    return F.when(score < human_lt, "HUMAN").when(score > ai_gt, "AI").otherwise("UNKNOWN")


def contains_any(text: Column, literals) -> Column:
    """Whether the text holds one of the literals, as they are written."""
    out = F.lit(False)
    for s in literals:
        out = out | F.contains(text, F.lit(s))
    return out


def ai_mentions(text: Column) -> Column:
    """How often "ai" stands alone between separators, in any case."""
    parts = F.split(F.lower(text), r"(?U)[.,\-—!()\s]")
    return F.coalesce(F.size(F.filter(parts, lambda x: x == "ai")), F.lit(0)).cast("long")


def tokens(text: Column) -> Column:
    """Words between white space, as they are written; an empty array for null."""
    return F.coalesce(F.filter(F.split(text, r"\s+"), lambda x: x != ""), F.array().cast("array<string>"))


#: Plurals and past forms that rules would get wrong.
IRREGULAR = {"children": "child", "men": "man", "women": "woman", "people": "person", "mice": "mouse", "feet": "foot", "was": "be", "were": "be", "is": "be", "are": "be", "been": "be", "has": "have", "had": "have", "did": "do", "done": "do", "went": "go", "gone": "go", "made": "make", "gemini": "geminus", "this": "this", "bus": "bus", "news": "news", "gas": "gas"}


def lemma(word: Column) -> Column:
    """A base form: a table of irregular words, then suffix rules. Punctuation stays as it is."""
    table = F.create_map(*(F.lit(x) for kv in IRREGULAR.items() for x in kv))
    w = F.lower(word)
    ruled = F.when(w.rlike("^[a-z]{3,}ies$"), F.regexp_replace(w, "ies$", "y")).when(w.rlike("(?:ss|x|ch|sh)es$"), F.regexp_replace(w, "es$", "")).when(w.rlike("^[a-z]{2,}[^su]s$"), F.regexp_replace(w, "s$", "")).otherwise(w)
    return F.coalesce(table[w], ruled)


def counted(items: Column) -> Column:
    """array<struct<stem, occurrences>> of a document's items, by name.

    The items are sorted and the starts of runs are found in one pass; arrays are bound as lambda variables, so that they aren't made anew for each entry.
    """

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        ends = lambda b, j: F.coalesce(F.get(b, j + 1), F.size(s))
        return F.transform(F.array(starts), lambda b: F.transform(b, lambda at, j: F.struct(F.get(s, at).alias("stem"), (ends(b, j) - at).cast("long").alias("occurrences"))))[0]

    return F.when(F.size(items) > 0, F.transform(F.array(F.sort_array(items)), runs)[0]).otherwise(F.array().cast("array<struct<stem:string,occurrences:bigint>>"))


def lemma_of(word: str) -> str:
    """lemma() of one word in Python."""
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if re.search("^[a-z]{3,}ies$", w):
        return w[:-3] + "y"
    if re.search("(?:ss|x|ch|sh)es$", w):
        return w[:-2]
    return w[:-1] if re.search("^[a-z]{2,}[^su]s$", w) else w


def stem_counts(texts: pa.Array, merge_ai: bool = False) -> pa.Array:
    """Lemma counts by name of each text. Entries go into Arrow arrays text by text, so a batch takes about its own bytes, not an object for each entry."""
    cached = lru_cache(1 << 16)(lemma_of)
    at, numbers, names, held = array("i", [0]), array("q"), [], []
    for t in texts:
        t = t.as_py()
        c = Counter(map(cached, re.findall(r"\w+|[^\w\s]", t.lower()))) if t else {}
        if merge_ai:
            c.pop("ai", None)
        for k in sorted(c):
            held.append(k)
            numbers.append(c[k])
        at.append(len(numbers))
        if len(held) > 1 << 16:
            names.append(pa.array(held, pa.string()))
            held = []
    names.append(pa.array(held, pa.string()))
    entries = pa.StructArray.from_arrays([pa.concat_arrays(names), pa.array(np.array(numbers, np.int64))], ["stem", "occurrences"])
    return pa.ListArray.from_arrays(pa.array(np.array(at, np.int32)), entries)


def stems(text: Column, merge_ai: bool = False) -> Column:
    """Lemma counts by name, and one more entry for standing-alone "ai" where there are any; equal keys aren't merged unless asked for.

    Lemmas are counted in Python over Arrow batches: a cache of words is much faster than rules for each word of each text.
    """

    @F.arrow_udf("array<struct<stem:string,occurrences:bigint>>")
    def count(x: pa.Array) -> pa.Array:
        return stem_counts(x, merge_ai)

    n = ai_mentions(text)
    return F.concat(count(text), F.when(n > 0, F.array(F.struct(F.lit("ai").alias("stem"), n.alias("occurrences")))).otherwise(F.array().cast("array<struct<stem:string,occurrences:bigint>>")))


#: An opening tag of a link up to its target, quoted in either way or not at all; tags and attributes in any case. It means the same in Spark and in SQL engines with RE2.
HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def hrefs(html: Column) -> Column:
    """Targets of links that aren't empty, in order, without their quotes."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), lambda x: F.regexp_replace(x, """^["']|["']$""", "")), lambda x: x != "")


def link_host(base: Column, href: Column) -> Column:
    """The host that a link leads to, seen from its page."""
    return F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), host(href)).when(href.rlike("^//"), host(F.concat(F.lit("http:"), href))).when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None).cast("string")).otherwise(host(base))


def tag_text(html: Column) -> Column:
    """The text of a page by expressions only: without scripts, styles, comments and tags."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))


class _MainText(HTMLParser):
    """Text of paragraphs, headings and list items, without what is around the content."""

    BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "div", "article", "main", "section"}
    SKIP = {"script", "style", "nav", "header", "footer", "aside", "form", "table", "noscript", "figure", "button", "select", "svg", "head"}

    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.now: list[str] = []
        self.depth = 0

    def flush(self) -> None:
        s = " ".join("".join(self.now).split())
        if s and s not in self.out:
            self.out.append(s)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.flush()
            self.depth += 1
        elif tag in self.BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.depth = max(0, self.depth - 1)
        elif tag in self.BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.depth:
            self.now.append(data)


def main_text_of(html: str | None) -> str | None:
    if not html:
        return None
    p = _MainText()
    p.feed(html)
    p.flush()
    return "\n".join(p.out) or None


def main_text(html: Column) -> Column:
    """Main text of a page, equal lines once; null without any. Runs in Python over Arrow batches."""

    @F.pandas_udf("string")
    def extract(x: pd.Series) -> pd.Series:
        return x.map(main_text_of, na_action="ignore")

    return extract(html)


def url_join(base: Column, href: Column) -> Column:
    """RFC 3986 resolution; null where it fails. Runs in Python over Arrow batches."""

    @F.pandas_udf("string")
    def join(b: pd.Series, h: pd.Series) -> pd.Series:
        def one(x, y):
            try:
                return urljoin(x, y)
            except ValueError:
                return None

        return pd.Series([one(x, y) if x is not None and y is not None else None for x, y in zip(b, h)], dtype=object)

    return join(base, href)


#: Public suffixes of two labels; any other suffix is the last label.
SUFFIXES = frozenset("co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp or.jp ac.jp com.br com.ar com.mx co.in co.za com.tr co.kr com.cn com.tw com.sg com.hk github.io blogspot.com".split())


def root_host(name: Column) -> Column:
    """The registrable domain of a host."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    two = F.concat_ws(".", F.slice(parts, F.greatest(n - 1, F.lit(1)), 2))
    three = F.concat_ws(".", F.slice(parts, F.greatest(n - 2, F.lit(1)), 3))
    return F.when(name.isNull() | (n < 2), name).when(two.isin(*sorted(SUFFIXES)), three).otherwise(two)


STOPWORDS = {"en": "the of and to in is that it was for on are with as this", "de": "der die und das den von mit ist des im nicht ein eine auf", "fr": "le la les de des et un une que qui dans pour est du", "es": "el los de que y en un una las por para es del"}


def languages(text: Column) -> Column:
    """The two best languages with scores: shares of a text's words that are a language's stop words."""

    def best(t: Column) -> Column:
        def share(ws: str) -> Column:
            return F.size(F.filter(t, lambda x: x.isin(*ws.split()))) / F.greatest(F.size(t), F.lit(1))

        scores = [F.struct(share(ws).alias("score"), F.lit(k).alias("lang")) for k, ws in sorted(STOPWORDS.items())]
        return F.transform(F.slice(F.sort_array(F.array(*scores), asc=False), 1, 2), lambda s: F.struct(s["lang"].alias("lang"), F.round(s["score"], 6).alias("score")))

    return F.transform(F.array(tokens(F.lower(text))), best)[0]  # the words are bound, so that the text is split once
