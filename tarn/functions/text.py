"""Text normalisers as Columns. Null reads as the empty string wherever the result is a string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that don't tell headlines or companies apart, and paths that are front pages.
HEADLINE_STOPWORDS = ("the", "a", "an", "of", "in", "on", "at", "to", "for", "and", "or", "with", "by", "from", "as", "is", "are", "be", "was", "were", "this", "that", "these", "those", "its", "it", "into", "after", "before")
COMPANY_FORMS = ("inc", "incorporated", "llc", "lc", "corp", "corporation", "ltd", "limited", "co", "company", "lp", "llp", "plc", "ag", "gmbh", "sa")
INDUSTRY_GENERICS = ("septic", "service", "services", "environmental", "waste", "industrial", "solutions", "group", "groups", "holdings", "partners", "international", "enterprises", "enterprise")
PROPER_NOUN_JUNK = ("The", "A", "An", "And", "Or", "For", "On", "In", "At", "Q1", "Q2", "Q3", "Q4", "Inc", "LLC", "Corp", "Ltd", "Co", "Company", "Corporation", "Limited", "Incorporated", "Grease", "Trap", "Septic", "Environmental", "Wastewater", "Waste", "Industrial", "Solutions", "Services", "Service", "Acquires", "Announces", "Reports", "Acquisition", "Acquired", "Regulations", "Regulation", "Guide", "FOG", "UCO")
FRONT_PATHS = ("", "/home", "/index", "/index.html", "/index.htm", "/news", "/blog")
OPERATOR_FORMS = r"\b(llc|inc|corp|corporation|company|co|ltd|lp|llp)\b\.?"


def text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words(c: Column, drop: tuple[str, ...] = ()) -> Column:
    """The non-empty words between single blanks, without those to drop."""
    return F.filter(F.split(c, " +"), lambda w: (w != "") & ~w.isin(*drop) if drop else w != "")


def headline_tokens(c: str | Column) -> Column:
    timeless = F.regexp_replace(F.lower(text(c)), r"\b(20[0-9]{2}|q[1-4]|fy20[0-9]{2}|h[12])\b", "")
    return words(F.regexp_replace(timeless, "[^a-z0-9 ]", " "), HEADLINE_STOPWORDS + COMPANY_FORMS)


def normalized_headline(c: str | Column) -> Column:
    return F.array_join(headline_tokens(c), " ")


def normalized_company(c: str | Column) -> Column:
    return F.array_join(words(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]", " "), COMPANY_FORMS + ("the",) + INDUSTRY_GENERICS), " ")


def normalized_operator(c: str | Column) -> Column:
    plain = F.regexp_replace(F.lower(text(c)), OPERATOR_FORMS, " ")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def proper_nouns(c: str | Column) -> Column:
    """Distinct capitalised tokens of three characters or more, in order of appearance."""
    tokens = F.regexp_extract_all(text(c), F.lit(r"\b([A-Z][A-Za-z0-9&]+)\b"), F.lit(1))
    return F.array_distinct(F.filter(tokens, lambda t: ~t.isin(*PROPER_NOUN_JUNK) & (F.length(t) >= 3)))


def without_tags(c: str | Column) -> Column:
    """Tags off, white space squeezed; null stays null."""
    plain = F.regexp_replace(F.col(c) if isinstance(c, str) else c, "</?[A-Za-z][^>]*>", "")
    return F.trim(F.regexp_replace(plain, r"[ \t\n\r]+", " "))


def sanitized(c: str | Column) -> Column:
    """As without_tags, and an unfinished tag at the end goes too."""
    return F.trim(F.regexp_replace(F.regexp_replace(text(c), "</?[A-Za-z][^>]*(>|$)", ""), r"[ \t\n\r]+", " "))


def normalized_url(c: str | Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(text(c))), "^https?://", "")
    bare = F.regexp_replace(bare, r"^www\.", "")
    return F.regexp_replace(F.regexp_replace(bare, "[#?].*$", ""), "/+$", "")


def is_front_page(c: str | Column) -> Column:
    """Without a host, or with nothing but a listing page's path."""
    url = F.lower(F.trim(text(c)))
    host = F.regexp_extract(url, "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(url, "^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    return (host == "") | path.isin(*FRONT_PATHS)


def html_escaped(c: str | Column) -> Column:
    out = text(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def first_zip(c: str | Column) -> Column:
    return F.nullif(F.regexp_extract(text(c), r"\b([0-9]{5})\b", 1), F.lit(""))


def zero_filled(c: Column, width: int) -> Column:
    """Zeros on the left up to the width; a longer string stays whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def title_cased(c: str | Column) -> Column:
    """A capital after anything that isn't a letter."""
    parts = F.regexp_extract_all(F.lower(text(c)), F.lit(r"([^\p{L}]*\p{L}*)"), F.lit(1))
    cased = F.transform(parts, lambda p: F.concat(F.regexp_extract(p, r"^([^\p{L}]*)", 1), F.initcap(F.regexp_replace(p, r"^[^\p{L}]*", ""))))
    return F.array_join(cased, "")


def category_key(c: str | Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(text(c)), r"[ \t\n\r]+", ""), F.lit("&"), F.lit("and"))


def bullets(as_text: Column, as_list: Column) -> Column:
    """A list stays one, without blanks; a text is its only bullet."""
    listed = F.filter(F.transform(as_list, lambda x: without_tags(x)), lambda x: x != "")
    return F.when(as_list.isNotNull(), listed).otherwise(F.filter(F.array(without_tags(as_text)), lambda x: x.isNotNull() & (x != "")))


def recipients(c: str | Column) -> Column:
    """Comma-separated addresses, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text(c), ","), lambda x: F.trim(x)), lambda a: a != "")


def bad_text_reason(*columns: str) -> Column:
    """The first of: 'tag' (markup or a citation mark), 'control' (a control character); null for fine text."""
    joined = F.concat_ws("\n", *columns)
    return F.when(joined.rlike(r"(?i)</?[a-z][^>]*>|\[cite|antml:"), "tag").when(joined.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), "control")
