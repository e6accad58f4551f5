"""Facts, names and word counts as built-in expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a word (Latin only: other scripts count no words) and as an e-mail address.
WORD = r"[A-Za-z0-9'À-ɏ]+"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
# Telephone numbers, dates, the owner in a copyright line, words of an offer, and what a template left unfilled.
PHONE = r"(?<![0-9/])(?:\+[0-9]{1,3}[\s\-]?)?(?:\([0-9]{2,4}\)[\s\-]?)?[0-9](?:[0-9\s\-]{7,13})[0-9](?![0-9])"
DATE = r"\d{4}-\d{2}-\d{2}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2},?\s+\d{4}|\b(?:19[89]\d|20[0-4]\d)\b"
COPYRIGHT = r"(?i)(?:©|\(c\)|copyright)\s*(?:[0-9]{4}\s*[-–]\s*[0-9]{4}|[0-9]{4})?\s*,?\s*([A-Z0-9][A-Za-z0-9&.,'\- ]{1,60}?)(?:\s*[.|·]|\s+All\s+rights|$)"
OFFER = r"(?i)\b(?:we\s+(?:are|build|make|help|offer|provide|design|deliver|sell)|our\s+(?:products?|services?|platform|software|team|mission)|platform\s+for|software\s+for|solutions?\s+for|helps?\s+\w+\s+to|for\s+(?:teams|businesses|companies|developers))"
PLACEHOLDER = r"\{\{|\}\}|%%|<%|\bundefined\b|\bnull\b|\byour[ _-]?(?:company|brand|site)\b|lorem ipsum"
# Abbreviations of address words.
ADDRESS_WORDS = {"street": "st", "road": "rd", "avenue": "ave", "suite": "ste", "floor": "fl", "building": "bldg", "number": "no"}
# Titles that say nothing.
GENERIC_TITLES = ["home", "homepage", "welcome", "index", "untitled", "page", "home page", "main", "site", "welcome!", "document"]


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))


def normalize_phone(value: Column) -> Column:
    return F.substring(F.regexp_replace(value, r"[^0-9]", ""), -10, 10)


def normalize_email(value: Column) -> Column:
    return F.lower(F.trim(value))


def emails(text: Column, most: int = 10) -> Column:
    """The first ``most`` addresses, without those that are image names."""
    return F.filter(F.slice(F.regexp_extract_all(text, F.lit(EMAIL), 0), 1, most), lambda x: ~F.lower(x).rlike(r"\.(png|jpg|webp)$"))


def phones(text: Column, most: int = 10) -> Column:
    """The first ``most`` numbers, without those of fewer than ten digits."""
    found = F.transform(F.slice(F.regexp_extract_all(text, F.lit(PHONE), 0), 1, most), lambda x: F.trim(x))
    return F.filter(found, lambda x: F.length(normalize_phone(x)) >= 10)


def footer_brand(footer: Column) -> Column:
    """The owner that a copyright line names, in six words at most; null where there is none."""
    name = F.btrim(F.regexp_extract(footer, COPYRIGHT, 1), F.lit(" .,|"))
    said = ~F.lower(name).isin("all rights reserved", "reserved")
    return F.when((name != "") & (F.size(F.split(name, r"\s+")) <= 6) & said, name)


def normalize_address(value: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.lower(value), r"[^a-z0-9]+", " "), " "), lambda x: x != "")
    short = F.create_map(*[F.lit(x) for pair in ADDRESS_WORDS.items() for x in pair])
    return F.array_join(F.transform(words, lambda x: F.coalesce(short[x], x)), " ")


def generic_title(title: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return t.isin(GENERIC_TITLES) | (F.length(t) < 6)


def latest_year(dates: Column) -> Column:
    """The greatest of the first years 1980 to 2049 in each text."""
    years = F.transform(dates, lambda x: F.regexp_extract(x, r"(19[89][0-9]|20[0-4][0-9])", 1))
    return F.array_max(F.filter(years, lambda x: x != ""))
