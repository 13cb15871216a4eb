"""Feeds, sitemaps and pages as DataFrames: raw documents (column content, one per row) to rows of items.

Fetching is not part of a query: contents land as a table first. Malformed documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RSS = "channel STRUCT<item: ARRAY<STRUCT<title: STRING, link: STRING, description: STRING, encoded: STRING, pubDate: STRING, guid: STRING, author: STRING, category: ARRAY<STRING>>>>"
ATOM = "entry ARRAY<STRUCT<title: STRING, link: ARRAY<STRUCT<_href: STRING>>, summary: STRING, content: STRING, published: STRING, updated: STRING, id: STRING>>"
JSON_FEED = "items ARRAY<STRUCT<title: STRING, url: STRING, external_url: STRING, summary: STRING, content_html: STRING, content_text: STRING, date_published: STRING, id: STRING, tags: ARRAY<STRING>, image: STRING>>"
SITEMAP = "url ARRAY<STRUCT<loc: STRING, news: STRUCT<title: STRING, publication_date: STRING, keywords: STRING>>>, sitemap ARRAY<STRUCT<loc: STRING, lastmod: STRING>>"
XML = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}


def text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def filled(items: DataFrame) -> DataFrame:
    """Without items that lack a link or a title; at most ten tags."""
    tags = F.slice(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.trim(t) != ""), 1, 10)
    return items.filter((F.col("url") != "") & (F.col("title") != "")).withColumn("tags", tags)


def rss(feeds: DataFrame) -> DataFrame:
    """feed_id, title, url, summary, body, published, guid, tags of RSS items. feeds: feed_id, content."""
    x = feeds.select("feed_id", F.explode(F.from_xml("content", F.lit(RSS), XML)["channel"]["item"]).alias("i"))
    tags = F.coalesce("i.category", F.array().cast("array<string>"))
    return filled(x.select("feed_id", text(F.col("i.title")).alias("title"), text(F.col("i.link")).alias("url"), text(F.col("i.description")).alias("summary"), text(F.col("i.encoded")).alias("body"), text(F.col("i.pubDate")).alias("published"), F.coalesce("i.guid", "i.link").alias("guid"), tags.alias("tags")))


def atom(feeds: DataFrame) -> DataFrame:
    """The same of Atom entries; published falls back to updated."""
    x = feeds.select("feed_id", F.explode(F.from_xml("content", F.lit(ATOM), XML)["entry"]).alias("i"))
    link = F.get(F.col("i.link"), 0)["_href"]
    return filled(x.select("feed_id", text(F.col("i.title")).alias("title"), text(link).alias("url"), text(F.col("i.summary")).alias("summary"), text(F.col("i.content")).alias("body"), text(F.coalesce("i.published", "i.updated")).alias("published"), F.coalesce(F.col("i.id"), link).alias("guid"), F.array().cast("array<string>").alias("tags")))


def json_feed(feeds: DataFrame) -> DataFrame:
    x = feeds.select("feed_id", F.explode(F.from_json("content", JSON_FEED)["items"]).alias("i"))
    url, body = F.coalesce(F.nullif(F.col("i.url"), F.lit("")), "i.external_url"), F.coalesce(F.nullif(F.col("i.content_html"), F.lit("")), "i.content_text")
    return filled(x.select("feed_id", text(F.col("i.title")).alias("title"), text(url).alias("url"), text(F.col("i.summary")).alias("summary"), text(body).alias("body"), text(F.col("i.date_published")).alias("published"), F.coalesce(F.col("i.id"), url).alias("guid"), F.col("i.tags").alias("tags")))


def news_sitemap(feeds: DataFrame) -> DataFrame:
    """Entries of a sitemap that carry news."""
    x = feeds.select("feed_id", F.explode(F.from_xml("content", F.lit(SITEMAP), XML)["url"]).alias("i")).filter("i.news IS NOT NULL")
    tags = F.transform(F.split(text(F.col("i.news.keywords")), ","), lambda t: F.trim(t))
    return filled(x.select("feed_id", text(F.col("i.news.title")).alias("title"), text(F.col("i.loc")).alias("url"), F.lit("").alias("summary"), F.lit("").alias("body"), text(F.col("i.news.publication_date")).alias("published"), F.col("i.loc").alias("guid"), tags.alias("tags")))


def child_sitemaps(feeds: DataFrame) -> DataFrame:
    """feed_id, position, loc, lastmod of a sitemap index, newest first."""
    kids = F.filter(F.from_xml("content", F.lit(SITEMAP), XML)["sitemap"], lambda s: text(s.loc) != "")
    ordered = F.reverse(F.array_sort(F.transform(kids, lambda s: F.struct(text(s.lastmod).alias("lastmod"), text(s.loc).alias("loc")))))
    return feeds.select("feed_id", F.posexplode(ordered).alias("position", "s")).select("feed_id", "position", "s.loc", "s.lastmod")


def items(feeds: DataFrame, kind: str) -> DataFrame:
    """Dispatch by kind: rss, atom, json_feed or sitemap."""
    return {"rss": rss, "atom": atom, "json_feed": json_feed, "sitemap": news_sitemap}[kind](feeds)


def published_at(raw: Column, now: Column) -> Column:
    """RFC 822 or ISO time; missing ones and those over ten minutes ahead count as now."""
    mail = F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3},\s*", "")
    mail = F.regexp_replace(mail, r"\b(GMT|UTC|UT|Z)$", "+0000")
    parsed = F.coalesce(F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(raw))
    return F.when(parsed.isNull() | (parsed > now + F.expr("INTERVAL 10 MINUTES")), now).otherwise(parsed)


ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def main_text(html: Column) -> Column:
    """Text of the article element, else of the whole page, one line per paragraph, entities resolved."""
    s = F.coalesce(html, F.lit(""))
    for tag in ("script", "style", "nav", "header", "footer", "aside", "form"):
        s = F.regexp_replace(s, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", " ")
    article = F.regexp_extract(s, r"(?is)<article\b[^>]*>(.*)</article>", 1)
    s = F.when(article != "", article).otherwise(s)
    s = F.regexp_replace(F.regexp_replace(s, r"[ \t\r\n]+", " "), r"(?i)</?(p|br|li|h[1-6]|div|blockquote)\b[^>]*>", "\n")
    s = F.regexp_replace(s, "<[^>]*>", "")
    for entity, sign in ENTITIES.items():
        s = F.replace(s, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(F.regexp_replace(s, " *\n[ \n]*", "\n"), " +", " "), F.lit(" \n"))


def import_rows(rows: DataFrame, numbers: list[str], keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imported rows (numbers cast, negative or malformed ones rejected, unknown pub_id rejected) and rejects with reasons.

    Rows are strings; an absent number stays null and is named in `unavailable`.
    """
    cast = {n: F.col(n).try_cast("bigint") for n in numbers}
    bad = [F.when(F.col(n).isNotNull() & (F.trim(n) != "") & (cast[n].isNull() | (cast[n] < 0)), f"{n}: not a number of zero or more") for n in numbers]
    missing = [F.when(cast[n].isNull(), n) for n in numbers]
    known = keys.select("pub_id", F.lit(True).alias("_known"))
    joined = rows.withColumn("pub_id", F.col("pub_id").try_cast("bigint")).join(known, "pub_id", "left")
    errors = F.filter(F.array(F.when(F.col("_known").isNull(), "unknown publication"), *bad), lambda e: e.isNotNull())
    checked = joined.withColumn("errors", errors).withColumn("unavailable", F.filter(F.array(*missing), lambda m: m.isNotNull())).drop("_known")
    good = checked.filter(F.size("errors") == 0).drop("errors")
    return good.withColumns({n: F.col(n).try_cast("bigint") for n in numbers}), checked.filter(F.size("errors") > 0).drop("unavailable")
