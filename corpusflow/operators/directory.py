"""Web pages: links, profiles, captions and visual metadata, on HTML as text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow import sqltext as S
from corpusflow.functions import text as T
from corpusflow.tables import quoted as q
from corpusflow.tables import table

CAPTION = r"(?i)^(figure|fig\.?|table|image|photo|plate)\s*[0-9]+"
SPECIALISATIONS = (("brass", "metals"), ("tin", "metals"), ("steel", "metals"), ("copper", "metals"), ("nickel", "metals"))


class Page(HTMLParser):
    """Title, links and images of one page, and its text outside scripts."""

    def __init__(self) -> None:
        super().__init__()
        self.title, self.links, self.images, self.text, self._in = "", 0, 0, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._in.append(tag)
        self.links += tag == "a" and any(k == "href" and v for k, v in attrs)
        self.images += tag == "img"

    def handle_endtag(self, tag: str) -> None:
        while self._in and self._in.pop() != tag:
            pass

    def handle_data(self, data: str) -> None:
        if "script" in self._in or "style" in self._in:
            return
        if "title" in self._in:
            self.title += data
        self.text.append(data)


def profiles(pages):
    """page_id, title, n_links, n_images, text of each page, by the standard library's parser in Arrow batches."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for page_id, html in zip(f["page_id"], f["html"], strict=True):
                p = Page()
                p.feed(html or "")
                p.close()
                rows.append((page_id, p.title.strip(), p.links, p.images, " ".join(" ".join(p.text).split())))
            yield pd.DataFrame(rows, columns=["page_id", "title", "n_links", "n_images", "text"])

    return pages.select("page_id", "html").mapInPandas(parse, "page_id long, title string, n_links long, n_images long, text string")


def l1_profiles(spark, sf):
    return profiles(table(spark, sf, "pages"))


def l2_contacts(spark, sf):
    """First mail address and telephone link of a page, and how often numbers stand before 'year'."""
    p = table(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("html", "mailto:([^\"'?> ]+)", 1).alias("mail"), F.regexp_extract("html", "tel:([+0-9 ()-]+)", 1).alias("phone"), F.regexp_count("html", F.lit(r"[0-9]+\+? years?")).alias("years"))


def l3_page_count(spark, sf):
    """The largest number among paging links."""
    n = F.transform(F.regexp_extract_all("html", F.lit("[?&]page=([0-9]{1,6})"), 1), lambda x: x.cast("int"))
    return table(spark, sf, "pages").select("page_id", F.coalesce(F.array_max(n), F.lit(1)).alias("n_pages"))


def l5_schedule(spark, sf):
    """Weekdays and hours in which a user is active, as sorted summaries."""
    e = table(spark, sf, "events").select("user_id", F.weekday("ts").alias("day"), F.date_format("ts", "HH:00").alias("hour"))
    return e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("day")).cast("array<string>"), ",").alias("days"), F.array_join(F.array_sort(F.collect_set("hour")), ",").alias("hours"))


def l6_specialisation(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", T.first_match(F.lower("p_type"), SPECIALISATIONS, F.lit("general")).alias("kind"))


def captions(c):
    return F.filter(T.lines(c), lambda x: x.rlike(CAPTION) & (F.length(x) <= 320))


def h1_captions(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.size(captions(F.col("text"))).alias("n_captions"))


VISUALS = (("table", "table"), ("chart", "chart"), ("graph", "chart"), ("photo", "photo"), ("x-ray", "radiograph"), ("img", "image"))


def h2_visual_type(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.first_match(F.lower("html"), VISUALS, F.lit("figure")).alias("kind"))


def h4_visual_quality(spark, sf):
    """45 points, 30 for a heading, 15 for a paragraph, 10 for an image."""
    h = F.lower("html")
    points = 45 + 30 * F.contains(h, F.lit("<h1")).cast("int") + 15 * F.contains(h, F.lit("<p")).cast("int") + 10 * F.contains(h, F.lit("<img")).cast("int")
    return table(spark, sf, "pages").select("page_id", points.alias("points"))


def h5_visual_dedupe(spark, sf):
    """The first page of equal markup."""
    p = table(spark, sf, "pages").withColumn("hash", F.sha2(T.squeezed(F.col("html")), 256))
    return p.groupBy("hash").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


def h8_merge(spark, sf):
    """Pages of one host: the largest score, the union of their sections, the first title."""
    p = table(spark, sf, "pages").withColumn("host", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)).withColumn("path", F.regexp_extract("url", r"^[a-z]+://[^/]+/([^/?#]*)", 1))
    return p.groupBy("host").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"), F.min_by("url", "page_id").alias("first_url"))


def h12_new_only(spark, sf):
    """Pages without a label yet, newest first."""
    gone = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"))
    return table(spark, sf, "pages").join(gone, "page_id", "left_anti").select("page_id", "url")


QUERIES = {f.__name__: f for f in (l1_profiles, l2_contacts, l3_page_count, l5_schedule, l6_specialisation, h1_captions, h2_visual_type, h4_visual_quality, h5_visual_dedupe, h8_merge, h12_new_only)}

_POINTS = "45 + 30 * contains(lower(html), '<h1')::INT"
ORACLES = {
    "l2_contacts": "SELECT page_id, regexp_extract(html, 'mailto:([^\"''?> ]+)', 1) AS mail, regexp_extract(html, 'tel:([+0-9 ()-]+)', 1) AS phone, len(regexp_extract_all(html, '[0-9]+\\+? years?')) AS years FROM pages",
    "l3_page_count": "SELECT page_id, coalesce(list_max(list_transform(regexp_extract_all(html, '[?&]page=([0-9]{1,6})', 1), lambda x: x::INT)), 1) AS n_pages FROM pages",
    "l5_schedule": "SELECT user_id, array_to_string(list_sort(list(DISTINCT isodow(ts) - 1)), ',') AS days, array_to_string(list_sort(list(DISTINCT strftime(ts, '%H:00'))), ',') AS hours FROM events GROUP BY user_id",
    "l6_specialisation": f"SELECT p_partkey, {S.first_match('lower(p_type)', SPECIALISATIONS, q('general'))} AS kind FROM part",
    "h1_captions": f"SELECT doc_id, len(list_filter({S.lines('text')}, lambda x: {S.matches('x', CAPTION)} AND length(x) <= 320)) AS n_captions FROM documents",
    "h2_visual_type": f"SELECT page_id, {S.first_match('lower(html)', VISUALS, q('figure'))} AS kind FROM pages",
    "h4_visual_quality": f"SELECT page_id, {_POINTS} + 15 * contains(lower(html), '<p')::INT + 10 * contains(lower(html), '<img')::INT AS points FROM pages",
    "h5_visual_dedupe": f"SELECT sha256({S.squeezed('html')}) AS hash, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1",
    "h8_merge": "WITH p AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS path FROM pages) SELECT host, count(*) AS n, array_to_string(list_sort(list(DISTINCT path)), ',') AS paths, arg_min(url, page_id) AS first_url FROM p GROUP BY host",
    "h12_new_only": "SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)",
}
