"""XML answers and HTML pages as columns."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def xpath_columns(df: DataFrame, xml: str, paths: Mapping[str, str]) -> DataFrame:
    """One array column per XPath (several hits per document); attribute predicates are allowed.

    Namespaced names are matched with ``*[local-name()='x']``.
    """
    return df.withColumns({name: F.xpath(F.col(xml), F.lit(path)) for name, path in paths.items()})


# A link's address in double quotes, single quotes or none, and a scheme before a colon.
LINK = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
SCHEME = "(?i)^[a-z][a-z0-9+.-]*:"


def hrefs(html: Column | str) -> Column:
    """All link targets of a page, in order; names in any case, values quoted or not."""
    groups = [F.regexp_extract_all(html, F.lit(LINK), F.lit(i)) for i in (1, 2, 3)]
    return F.transform(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "abc")]), lambda x: F.concat(x["a"], x["b"], x["c"]))


def section(html: Column | str, tag: str) -> Column:
    """Content of the first element with the given tag, empty if there is none."""
    return F.regexp_extract(html, rf"(?is)<{re.escape(tag)}\b[^>]*>(.*?)</{re.escape(tag)}\s*>", 1)


def after_heading(html: Column | str, heading: str, tag: str = "ul") -> Column:
    """Content of the first element ``tag`` that follows a text, empty if either is missing; lists of links stand like this."""
    return F.regexp_extract(html, rf"(?is){re.escape(heading)}.*?<{re.escape(tag)}\b[^>]*>(.*?)</{re.escape(tag)}\s*>", 1)


def text_of(html: Column | str) -> Column:
    """The text of a piece of a page, without tags, in single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "(?s)<[^>]*>", " "), r"\s+", " "))


def labelled_value(html: Column | str, label: str, tag: str = "p") -> Column:
    """The last word of the first element whose text starts with a label, empty if there is none."""
    starts = rf"(?is)<{re.escape(tag)}\b[^>]*>\s*({re.escape(label)}.*?)</{re.escape(tag)}\s*>"
    return F.regexp_extract(text_of(F.regexp_extract(html, starts, 1)), r"(\S+)$", 1)


def page_links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """One row per page and link, with the absolute address of the link.

    ``//host/x`` takes the page's scheme, ``/x`` its host, ``x`` its folder, ``#x`` and ``?x`` the page itself.
    """
    links = pages.select(F.col(url).alias("from_url"), F.posexplode(hrefs(html)).alias("place", "href"))
    scheme = F.regexp_extract("from_url", "^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    root = F.regexp_extract("from_url", "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract("from_url", "^([^?#]*)", 1)
    folder = F.when(page == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_extract(page, "^(.*/)", 1))
    href = F.col("href")
    absolute = (
        F.when(href.rlike(SCHEME), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, href))
        .when(href == "", F.col("from_url")).when(href.startswith("#") | href.startswith("?"), F.concat(page, href)).otherwise(F.concat(folder, href))
    )
    return links.withColumn("to_url", absolute)


def follow_links(links: DataFrame, targets: DataFrame, link: str, address: str) -> DataFrame:
    """Links joined with the content they lead to, as far as it is in the table of targets (one row per address)."""
    return links.join(targets.withColumnRenamed(address, link), link)
