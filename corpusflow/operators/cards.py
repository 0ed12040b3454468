"""Directory pages as element trees: listing cards, profile fields, and a profile export.

A page is parsed once, in an Arrow batch, by the standard library's parser into a tree whose elements know their text and what follows
them. Null and empty pages have no cards and empty fields; elements that aren't closed end with their parent; a page's cards come in
the order of the page.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlparse

import pandas as pd
from pyspark.sql import functions as F

from corpusflow import sqltext as S
from corpusflow.functions import text as T
from corpusflow.shared import folder, written
from corpusflow.tables import table

# What marks a card and its parts, labels of sections, and where a section ends.
CARD_CLASS, NAME_CLASS, FIELD_CLASS = "u-info", "g-color-black", "ProfileSpeciality"
LINK_ID, LINK_PAGE, ID_PARAMETER = "ahreftitle", "profiles.aspx", "ProfileID"
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
HEADINGS = ("h2", "h3", "h4", "strong", "b")
SECTION_ENDS = ("education", "research", "clinical", "publication", "certification", "award", "membership", "interest")
#: Field, labels that its text may follow, and the label of a section or list in place of that.
LABELLED = (
    ("qualifications", ("Qualification", "Qualifications"), "section", "Qualification"), ("degrees", ("Degree", "Degrees"), "", ""), ("biography", ("Biography", "About"), "section", "Biography"), ("clinical_interests", ("Clinical Interest",), "list", "Clinical Interest"),
    ("research_interests", ("Research Interest",), "list", "Research Interest"), ("areas_of_interest", ("Area",), "list", "Area of Interest"), ("education", ("Education",), "list", "Education"), ("certifications", ("Certification",), "list", "Certification"), ("awards", ("Award",), "list", "Award"),
    ("publications", ("Publication",), "list", "Publication"), ("memberships", ("Membership",), "list", "Membership"), ("consultation_timings", ("Timing", "Consultation"), "", ""), ("available_days", ("Available Day",), "", ""),
)
PROFILE = ("name", "image_url", "gender", "email", "phone", "clinic_address", *(f[0] for f in LABELLED))


class Element:
    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator["Element"]:
        """The elements below, in the order of the page."""
        waiting = [c for c in reversed(self.children) if isinstance(c, Element)]
        while waiting:
            e = waiting.pop()
            yield e
            waiting += [c for c in reversed(e.children) if isinstance(c, Element)]

    def text(self) -> str:
        parts, waiting = [], [self]
        while waiting:
            e = waiting.pop()
            if isinstance(e, str):
                parts.append(e)
            elif e.tag not in ("script", "style"):
                waiting += reversed(e.children)
        return " ".join("".join(parts).split())

    def first(self, fits) -> "Element | None":
        return next((e for e in self.walk() if fits(e)), None)

    def has_class(self, part: str) -> bool:
        return part in self.attrs.get("class", "")


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_endtag(self, tag: str) -> None:
        if any(e.tag == tag for e in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def tree(html: str | None) -> Element:
    t = Tree()
    t.feed(html or "")
    t.close()
    return t.root


def listing(root: Element, base: str, whole_class: str = CARD_CLASS, tag: str = "") -> Iterator[dict]:
    """The cards of a page: elements of a class, or of a tag, that have a name."""
    for card in [e for e in root.walk() if (e.tag == tag if tag else e.has_class(whole_class))]:
        named = card.first(lambda e: e.tag in ("h4", "h3") or e.has_class(NAME_CLASS)) or (card.first(lambda e: e.tag == "a") if tag else None)
        name = named.text() if named else ""
        if not name:
            continue
        field = card.first(lambda e: e.has_class(FIELD_CLASS)) or card.first(lambda e: e.tag == "em")
        image = card.first(lambda e: e.tag == "img")
        link = card.first(lambda e: e.tag == "a" and (bool(tag) or LINK_ID in e.attrs.get("id", "") or LINK_PAGE in e.attrs.get("href", "")))
        source = (image.attrs.get("src") or image.attrs.get("data-src") or "") if image else ""
        href = link.attrs.get("href", "") if link else ""
        own = parse_qs(urlparse(href).query).get(ID_PARAMETER, [""])[0]
        if not own and (m := re.search(ID_PARAMETER + r"[=:]([0-9]+)", card.attrs.get("id", ""))):
            own = m[1]
        code = next((m[1] for a in ("ng-click", "onclick", "data-doctor-id") if (m := re.search(r"['\"]([A-Z]{4})['\"]", card.attrs.get(a, "")))), "")
        yield {"name": name, "card_id": own or hashlib.md5(name.encode()).hexdigest()[:8], "field": field.text() if field else "", "image_url": urljoin(base, source) if source else "", "link": urljoin(base, href) if href else "", "code": code}


def _after_label(root: Element, label: str) -> str:
    for e in root.walk():
        if e.tag in ("span", "div", "p", "td", "li"):
            text = e.text()
            if text.lower().startswith(label.lower()) and (rest := text[len(label) :].strip(": -")):
                return rest
    return ""


def _headed(root: Element, label: str) -> tuple[list, int] | None:
    """The children of which the first heading with the label is one, and its place."""
    parents = {id(c): e for e in (root, *root.walk()) for c in e.children if isinstance(c, Element)}
    head = root.first(lambda e: e.tag in HEADINGS and label.lower() in e.text().lower())
    if head is None:
        return None
    siblings = parents[id(head)].children
    return siblings, next(i for i, c in enumerate(siblings) if c is head)


def _section(root: Element, label: str) -> str:
    """What follows a heading, up to the next heading of a known section."""
    found = _headed(root, label)
    parts = []
    for c in found[0][found[1] + 1 :] if found else ():
        if isinstance(c, Element) and c.tag in HEADINGS and any(k in c.text().lower() for k in SECTION_ENDS):
            break
        parts.append(" ".join(c.split()) if isinstance(c, str) else c.text())
    return "; ".join(filter(None, parts))


def _list_section(root: Element, label: str) -> str:
    """The items that follow a heading, up to the next one."""
    found = _headed(root, label)
    parts = []
    for c in found[0][found[1] + 1 :] if found else ():
        if isinstance(c, str):
            continue
        if c.tag in ("h2", "h3", "h4"):
            break
        parts += [e.text() for e in c.walk() if e.tag == "li"] if c.tag in ("ul", "ol") else [c.text()]
    return "; ".join(filter(None, parts))


def profile(root: Element, base: str) -> dict:
    """The fields of a profile page; a field that the page lacks is empty, experience null."""
    out = dict.fromkeys(PROFILE, "")
    for field, labels, kind, label in LABELLED:
        text = next((t for x in labels if (t := _after_label(root, x))), "")
        out[field] = text or (_section(root, label) if kind == "section" else _list_section(root, label) if kind == "list" else "")
    named = root.first(lambda e: e.tag == "h1" or (e.tag == "h2" and e.has_class("doctor-name")) or e.has_class("profile-name"))
    name = named.text() if named else ""
    out["name"] = name if len(name.split()) >= 2 and "contact" not in name.lower() else ""
    for e in root.walk():
        source = e.attrs.get("src") or e.attrs.get("data-src") or "" if e.tag == "img" else ""
        if source and "default_user" not in source and ("Faculty" in source or "Attachments" in source or e.has_class("profile-image") or e.has_class("doctor")):
            out["image_url"] = urljoin(base, source)
            break
    said = _after_label(root, "Gender").lower()
    out["gender"] = said or ("male" if out["name"].lower().startswith(("mr.", "dr.", "prof.")) else "")
    for field, scheme in (("email", "mailto:"), ("phone", "tel:")):
        e = root.first(lambda e: e.tag == "a" and e.attrs.get("href", "").startswith(scheme))
        out[field] = e.attrs["href"].replace(scheme, "").strip() if e else ""
    e = root.first(lambda e: e.has_class("address") or e.has_class("location"))
    out["clinic_address"] = e.text() if e else ""
    years = re.sub(r"[^0-9]", "", _after_label(root, "Experience") or _after_label(root, "Years of Experience"))
    spoken = [x.strip() for x in re.split("[,;]", _after_label(root, "Language")) if x.strip()]
    return out | {"experience_years": int(years[:9]) if years else None, "languages": spoken}


def cards(pages, whole_class=CARD_CLASS, tag=""):
    """page_id, place, name, card_id, field, image_url, link, code: a row a card of each page. An id comes from the link's parameter, the card's own id, or the name's hash."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{"page_id": p, "place": i} | c for p, url, html in zip(f["page_id"], f["url"], f["html"], strict=True) for i, c in enumerate(listing(tree(html), url or "", whole_class, tag))]
            yield pd.DataFrame(rows, columns=["page_id", "place", "name", "card_id", "field", "image_url", "link", "code"])

    return pages.select("page_id", "url", "html").mapInPandas(parse, "page_id long, place int, name string, card_id string, field string, image_url string, link string, code string")


def profile_fields(pages):
    """page_id, url, the PROFILE fields, experience_years and languages of each page."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{"page_id": p, "url": url} | profile(tree(html), url or "") for p, url, html in zip(f["page_id"], f["url"], f["html"], strict=True)]
            out = pd.DataFrame(rows, columns=["page_id", "url", *PROFILE, "experience_years", "languages"])
            yield out.astype({"experience_years": "Int64"})

    return pages.select("page_id", "url", "html").mapInPandas(parse, "page_id long, url string, " + ", ".join(f"{c} string" for c in PROFILE) + ", experience_years long, languages array<string>")


def export_rows(p):
    """The export's row of each profile (`profile_fields`): all its columns, in their fixed order."""
    stamp = F.date_format(F.timestamp_seconds(F.col("page_id") * 3600 + 1_700_000_000), "yyyy-MM-dd'T'HH:mm:ss")
    slug = F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    none = F.lit("")
    made = {
        "id": F.col("page_id").cast("string"), "name": F.col("name"), "slug": slug, "qualifications": F.col("qualifications"), "degrees": F.col("degrees"), "specialization": T.first_match(F.lower("qualifications"), (("orthodont", "orthodontics"), ("endodont", "endodontics"), ("surg", "surgery")), F.lit("general")), "department": none, "hospital": F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)),
        "experience_years": F.coalesce(F.col("experience_years").cast("string"), none), "gender": F.col("gender"), "clinic_name": none, "clinic_address": F.col("clinic_address"), "consultation_fee": none, "consultation_timings": F.col("consultation_timings"), "available_days": F.col("available_days"), "appointment_url": none, "languages": F.array_join("languages", ", "), "biography": F.col("biography"),
        "areas_of_interest": F.col("areas_of_interest"), "clinical_interests": F.col("clinical_interests"), "research_interests": F.col("research_interests"), "education": F.col("education"), "certifications": F.col("certifications"), "awards": F.col("awards"), "publications": F.col("publications"), "memberships": F.col("memberships"), "image_url": F.col("image_url"), "image_path": none, "profile_url": F.coalesce("url", none),
        "phone": F.col("phone"), "email": F.col("email"), "hospital_address": none, "content_hash": F.md5(F.concat_ws("|", "name", "qualifications", "email", "phone", "biography")), "data_version": F.lit("1"), "is_active": F.lit("true"), "created_at": stamp, "updated_at": stamp, "last_scraped_at": stamp,
    }
    return p.select(*(c.alias(n) for n, c in made.items()))


def l1_cards(spark, sf):
    """Cards of the pages, whose list items stand for cards: what SQL can tell of them."""
    return cards(table(spark, sf, "pages"), tag="li").select("page_id", "place", "name", "card_id", "link")


def l2_profile(spark, sf):
    return profile_fields(table(spark, sf, "pages"))


def a7_profile_fields(spark, sf):
    """The whole export, written as CSV and as JSON lines and read back."""
    rows, at = written(export_rows(profile_fields(table(spark, sf, "pages"))), "profiles"), folder(spark)
    rows.write.options(header=True, quoteAll=True, escape='"').csv(f"{at}/csv")
    rows.write.json(f"{at}/json")
    csv = spark.read.schema(rows.schema).options(header=True, escape='"', multiLine=True).csv(f"{at}/csv").na.fill("")
    return csv.select(F.lit("csv").alias("form"), "*").unionByName(spark.read.schema(rows.schema).json(f"{at}/json").select(F.lit("json").alias("form"), "*"))


QUERIES = {f.__name__: f for f in (l1_cards, l2_profile, a7_profile_fields)}

_LI = "regexp_extract_all(html, '(?s)<li[^>]*><a [^>]*>(.*?)</a></li>', 1)"
_HREF = "regexp_extract_all(html, '(?s)<li[^>]*><a [^>]*href=\"([^\"]*)\"[^>]*>.*?</a></li>', 1)"
_NAME = S.squeezed("replace(replace(replace(replace(regexp_replace(n, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')")
_HOST = "regexp_extract(url, '^[a-z]+://[^/?#]+')"
ORACLES = {
    "l1_cards": f"WITH c AS (SELECT page_id, url, unnest({_LI}) AS n, unnest({_HREF}) AS h FROM pages), k AS (SELECT page_id, url, {_NAME} AS name, replace(h, '&amp;', '&') AS h, row_number() OVER () AS o FROM c) SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY o) - 1)::INT AS place, name, CASE WHEN regexp_extract(h, '[?&]ProfileID=([^&#]+)', 1) <> '' THEN regexp_extract(h, '[?&]ProfileID=([^&#]+)', 1) ELSE md5(name)[:8] END AS card_id, CASE WHEN h LIKE '/%' THEN {_HOST} || h ELSE h END AS link FROM k WHERE name <> ''",
}
