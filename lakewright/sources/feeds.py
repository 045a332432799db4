"""RSS documents to item rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEMS = "array<struct<title:string,link:string,pubDate:string>>"
CHANNEL = f"channel struct<title:string, item:{ITEMS}>, item {ITEMS}"  #: items stand in the channel or beside it


def feed_items(feeds: DataFrame, feed: str = "feed", xml: str = "xml") -> DataFrame:
    """(feed, outlet, title, link, date): one row per item. The outlet is the channel title, else the host."""
    parsed = feeds.select(feed, F.from_xml(F.col(xml), CHANNEL).alias("r__"))
    outlet = F.coalesce(F.nullif(F.trim("r__.channel.title"), F.lit("")), F.try_parse_url(F.col(feed), F.lit("HOST")))
    none = F.array().cast(ITEMS)
    items = F.concat(F.coalesce("r__.channel.item", none), F.coalesce("r__.item", none))
    rows = parsed.select(feed, outlet.alias("outlet"), F.explode(items).alias("i__"))
    return rows.select(
        feed, "outlet",
        *[F.trim(F.coalesce(F.col(f"i__.{c}"), F.lit(""))).alias(n) for c, n in (("title", "title"), ("link", "link"), ("pubDate", "date"))],
    )
