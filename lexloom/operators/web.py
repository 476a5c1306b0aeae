"""Links, URL classes, page features, the crawl and its journal (rows F6-F13, T23, C8, C9, J4-J6, L3, A12, S17, S26)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.dialect import Spark

EXTENSIONS = "avi|css|eot|exe|gif|gz|ico|jpe?g|js|json|mp3|mp4|pdf|png|rss|svg|tar|ttf|webp|woff2?|xml|zip"
INVALID = r"(?i)/(tags?|author|auteurs?|categor(y|ie)|account|cdn-cgi)/|/(feed|rss)/?$|/search[/?]|/(login|register|cart|panier)|[?&]s="
PAGING = r"(?i)/page/\d+/?$|[?&](page|paged|offset|start|from)=\d+|[?&]p=\d+$|/\d+/?$"
ANTIBOT = r"(?i)access denied|attention required|cf_chl_opt|cf-browser-verification|challenge-form|ddos protection by cloudflare|enable javascript and cookies|just a moment|please (complete the security check|verify you are a human)"


def resolved(d, base: str, href: str) -> str:
    """A link against its page: absolute, scheme-relative, rooted, query, or in the page's folder."""
    scheme, root = d.first(base, "^[a-zA-Z][a-zA-Z0-9+.-]*:"), d.first(base, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*")
    bare = d.sub(base, "[?#].*$", "")
    folder = d.sub(bare, "[^/]*$", "")
    return (
        f"case when {d.match(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:')} then {href} when {d.match(href, '^//')} then concat({scheme}, {href}) when {d.match(href, '^/')} then concat({root}, {href}) "
        f"when {d.match(href, '^[?]')} then concat({bare}, {href}) when {d.match(href, '^#')} or {href} = '' then concat({bare}, {href}) else concat({folder}, {href}) end"
    )


def valid_link(d, x: str) -> str:
    """F7."""
    path = d.sub(d.sub(f"lower({x})", "[?#].*$", ""), "^[a-z][a-z0-9+.-]*://[^/]*", "")
    return f"(not {d.match(path, rf'\.({EXTENSIONS})$')} and not {d.match(x, INVALID)})"


def link_class(d, url: str, base: str, article: str | None = None, paging: str | None = None) -> str:
    """F6, then F9 before F8."""
    same = f"replace({tx.domain(d, url)}, 'www.', '') = replace({tx.domain(d, base)}, 'www.', '')"
    good = d.match(url, f"(?i){article}") if article else valid_link(d, url)
    return f"case when not {same} then 'off_domain' when {d.match(url, f'(?i){paging}' if paging else PAGING)} then 'pagination' when {good} then 'article' else 'other' end"


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Each page's distinct http links in order, resolved, normal, with their class."""
    rows = pages.select(key, "url", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    rows = rows.withColumn("link", F.expr(tx.url_normal(Spark, "(" + resolved(Spark, "url", "href") + ")"))).where("link like 'http%'")
    rows = rows.groupBy(key, "url", "link").agg(F.min("pos").alias("pos"))
    return rows.select(key, "pos", "link", F.expr(link_class(Spark, "link", "url")).alias("class"))


def news_score(d, html: str) -> str:
    """F12 from attributes of the markup."""
    named = lambda what: d.match(html, rf'(?i)<[a-z0-9]+ [^>]*class="[^"]*({what})')
    parts = [
        (d.match(html, r'(?is)application/ld\+json[^<]*"@type"[^<]*(Article|BlogPosting)'), 4), (d.match(html, r'(?i)<meta [^>]*property="og:type"[^>]*article'), 3), (d.match(html, r"(?i)<article[ >]"), 2),
        (f"({d.match(html, '(?i)<time[ >]')} or {named('pubdate|published|timestamp|posted|date')})", 2), (f"({d.match(html, '(?i)rel=.author')} or {named('author|byline|auteur')})", 1),
        (d.match(html, r'(?i)<meta [^>]*name="author"'), 1), (named("(article|post|entry).?(body|content|text)"), 2),
    ]
    return " + ".join(f"case when {c} then {v} else 0 end" for c, v in parts)


def page_year(d, html: str, url: str, pattern: str | None = None, selector: str | None = None) -> str:
    """A site's own rule, then JSON-LD, meta, time, path, date in the text, URL.

    ``pattern`` has one group, a date; it is looked for in the text of the element that ``selector``
    (a tag, .class, #id or tag.class) names, or in the page's text.
    """
    year = lambda x: f"cast({x} as int)"
    own = []
    if pattern or selector:
        where = selected(d, html, selector) if selector else d.sub(html, "<[^>]*>", " ")
        own = [year(d.first(d.first(where, pattern or r"(\d{2}/\d{2}/20\d{2})", 1), r"(^|[^0-9])(20\d\d)($|[^0-9])", 2))]
    return "coalesce(" + ", ".join([
        *own,
        year(d.first(html, r'"date(?:Published|Created|Modified)"\s*:\s*"[^"]*?\b(20\d\d)\b', 1)),
        year(d.first(html, r'(?i)<meta [^>]*property="article:published_time"[^>]*content="[^"]*?\b(20\d\d)\b', 1)),
        year(d.first(html, r'(?i)<meta [^>]*name="(?:date|pubdate|publish_date|DC\.date|article\.published)"[^>]*content="[^"]*?\b(20\d\d)\b', 1)),
        year(d.first(html, r'(?i)<time [^>]*datetime="[^"]*?\b(20\d\d)\b', 1)), year(d.first(url, r"/(20\d\d)[/-]", 1)), year(d.first(html, r"\d\d/\d\d/(20\d\d)", 1)), year(d.first(url, r"\b(20\d\d)", 1)),
    ]) + ")"


def selected(d, html: str, selector: str) -> str:
    """The text of the first element that a simple CSS selector names."""
    tag, _, name = selector.partition("#") if "#" in selector else selector.partition(".")
    attribute = "" if not name else rf'[^>]*id="{name}"' if "#" in selector else rf'[^>]*class="([^"]* )?{name}( [^"]*)?"'
    inner = 1 + attribute.count("(") + 1
    return d.sub(f"coalesce({d.first(html, rf'(?is)<({tag or '[a-z0-9]+'})(?:\s{attribute})?[^>]*>(.*?)</', inner)}, '')" if attribute else f"coalesce({d.first(html, rf'(?is)<({tag})[^>]*>(.*?)</{tag}', 2)}, '')", "<[^>]*>", " ")


ERRORS = (403, 404, 410, 429, 503)


def fetched(urls: DataFrame, fetch: Callable[[str], tuple[int | None, str]], on: str = "url") -> DataFrame:
    """(url, code, html, error): ``fetch`` (a browser or an HTTP client) is called in the executors, an exception is the row's error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url in pdf["url"]:
                try:
                    rows.append((url, *fetch(url), None))
                except Exception as e:
                    rows.append((url, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "code", "html", "error"])

    return urls.select(F.col(on).alias("url")).mapInPandas(run, "url string, code int, html string, error string")


def visited(pages: DataFrame, article: str | None = None, current: int | None = None, undated: bool = True, pattern: str | None = None, selector: str | None = None) -> DataFrame:
    """Per page (url, html; code and error where there are) its journal row: status, year, file, detail.

    error: an HTTP code of ERRORS, an exception or an anti-bot page; not_article: no address of the
    site's pattern, or, without one, a news score below 3; skipped_year: not of the year ``current``
    (without a date only where ``undated`` is false); else saved, under P28's name.
    """
    code = F.col("code") if "code" in pages.columns else F.lit(None).cast("int")
    error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    rows = pages.withColumn("_code", code).withColumn("_error", error)
    news = F.col("url").rlike(f"(?i){article}") if article else F.expr(news_score(Spark, "html")) >= 3
    rows = rows.withColumn("year", F.expr(page_year(Spark, "html", "url", pattern, selector)))
    other = F.lit(False) if current is None else F.when(F.col("year").isNull(), F.lit(not undated)).otherwise(F.col("year") != current)
    status = (
        F.when(F.col("_error").isNotNull() | F.coalesce(F.col("_code").isin(*ERRORS), F.lit(False)), "error").when(F.coalesce(antibot("html"), F.lit(False)), "error")
        .when(~F.coalesce(news, F.lit(False)), "not_article").when(other, "skipped_year").otherwise("saved")
    )
    rows = rows.withColumn("status", status)
    detail = F.when(F.col("status") == "error", F.coalesce(F.col("_error"), F.when(F.col("_code").isin(*ERRORS), F.col("_code").cast("string")), F.lit("anti-bot page")))
    return rows.withColumn("file", F.when(F.col("status") == "saved", F.expr(tx.url_filename(Spark, "url")))).withColumn("detail", detail).drop("_code", "_error")


def at_most(articles: DataFrame, journal: DataFrame, order: list[str], most: int = 50, site: str = "site", url: str = "url") -> DataFrame:
    """The articles of each site to visit, in their order: what the journal saved counts, what it knows isn't visited again.

    A site has at most some thousand articles listed (L3's other bound), so the window is small.
    """
    known = journal.groupBy(F.col("url").alias("_u")).agg(F.max(F.when(F.col("status") == "saved", 1).otherwise(0)).alias("_saved"))
    rows = articles.join(known, F.col(url) == F.col("_u"), "left")
    counts = F.when(F.col("_u").isNull(), 1).otherwise(F.col("_saved"))  # each visit may save one
    before = F.sum(counts).over(W.partitionBy(site).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_u").isNull() & (F.col("_before") < most)).select(*articles.columns)


def listing(start: DataFrame, cache: DataFrame, read: Callable[[DataFrame], DataFrame], most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(articles, cache) from start pages (site, url), at most ``most`` listing pages each.

    ``cache`` (url, link, class) has the links of pages read before, and is used where it has some;
    ``read`` gives those of other pages (url) in the same columns. Pages are visited in the order of
    discovery, step by step; a step's pages are read together.
    """
    from .shared import cut

    seen = cut(start.select("site", F.col("url").alias("start"), "url", F.lit(0).alias("step"), F.lit(0).cast("long").alias("place")).dropDuplicates(["start", "url"]))
    cache = cut(cache.select("url", "link", "class").distinct())
    step = 0
    while True:
        last = seen.where(F.col("step") == step)
        new = last.select("url").distinct().join(cache.select("url").distinct(), "url", "left_anti")
        if not new.isEmpty():
            cache = cut(cache.unionByName(read(new).select("url", "link", "class")).distinct())
        more = last.join(cache.where("class = 'pagination'"), "url").select("site", "start", F.col("link").alias("url"), "place").distinct()
        more = more.groupBy("site", "start", "url").agg(F.min("place").alias("place")).join(seen.select("start", "url"), ["start", "url"], "left_anti")
        had = seen.groupBy("start").agg(F.count("*").alias("_had"))
        rank = F.row_number().over(W.partitionBy("start").orderBy("place", "url"))
        more = more.withColumn("_r", rank).join(had, "start").where(F.col("_r") + F.col("_had") <= most)
        grown = cut(seen.unionByName(more.select("site", "start", "url", F.lit(step + 1).alias("step"), (F.lit(step + 1) * F.lit(1_000_000_000).cast("long") + F.col("_r")).alias("place"))))
        if grown.where(F.col("step") == step + 1).isEmpty():
            break
        seen, step = grown, step + 1
    articles = seen.join(cache.where("class = 'article'"), "url").groupBy("site", "link").agg(F.min(F.struct("start", "place", "link")).alias("_o"))
    return articles.select("site", F.col("link").alias("url"), F.col("_o.start").alias("start"), F.col("_o.place").alias("place")), cache


def crawl_stats(journal: DataFrame) -> DataFrame:
    """Pages by status, with how many addresses they are."""
    return journal.groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("url").alias("n_urls"))


def antibot(html: Column | str) -> Column:
    """F10."""
    return tx.c(html).rlike(ANTIBOT)


def unseen(candidates: DataFrame, journal: DataFrame, on: str = "url") -> DataFrame:
    """What the journal has under no status; Spark broadcasts the journal where it measures small."""
    return candidates.join(journal.select(on).distinct(), on, "left_anti")


def frontier(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(url, depth): breadth-first from ``start`` (url) over ``edges`` (url, link), until nothing new is found.

    Each step is an anti-join with what was visited; the visited table is cut to the shared folder.
    """
    from .shared import cut

    visited = cut(start.select("url").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while True:
        last = visited.where(F.col("depth") == depth)
        new = edges.join(last.select("url"), "url", "left_semi").select(F.col("link").alias("url")).distinct().join(visited.select("url"), "url", "left_anti")
        grown = cut(visited.unionByName(new.withColumn("depth", F.lit(depth + 1))))
        if grown.where(F.col("depth") == depth + 1).isEmpty():
            return visited
        visited, depth = grown, depth + 1


def allowed(links: DataFrame, robots: DataFrame, link: str = "link") -> DataFrame:
    """Robots rules by host (host, prefix, allow): of the prefixes of a link's path the longest decides, allow before ban; without one it is allowed.

    Rules are gathered by host, so the join is on the host alone; Spark broadcasts them where they measure small.
    """
    rules = robots.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.length("prefix").alias("n"), "allow", "prefix")), asc=False).alias("_rules"))
    path = F.regexp_replace(F.col(link), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    rows = links.withColumn("_host", tx.column(tx.domain, link)).withColumn("_path", F.when(path == "", "/").otherwise(path))
    rows = rows.join(rules.withColumnRenamed("host", "_rh"), F.col("_host") == F.col("_rh"), "left")
    first = F.try_element_at(F.filter("_rules", lambda r: F.startswith(F.col("_path"), r["prefix"])), F.lit(1))
    return rows.where(F.coalesce(first["allow"], F.lit(True))).select(*links.columns)
