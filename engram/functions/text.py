"""Normalising, sanitising and labelling text and names."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_CHARS = 10_000
ZERO_WIDTH = r"[\x{200b}-\x{200f}\x{2028}-\x{202f}\x{feff}]"
HTML_COMMENT = r"(?s)<!--.*?-->"

#: Phrases that only raise a flag on input text.
INJECTION = (
    r"(?i)ignore\s+(all\s+)?previous\s+instructions?",
    r"(?i)(forget|disregard)\s+(all\s+)?previous",
    r"(?i)you\s+are\s+now",
    r"(?i)system\s*prompt",
    r"(?i)<\s*/?\s*instructions?\s*>",
)
#: Phrases that are cut from evidence.
REDACTED = (
    r"(?s)<system>.*?</system>",
    r"(?s)<assistant>.*?</assistant>",
    r"(?i)ignore\s+(all\s+)?(previous|above|all)\s+instructions?",
    r"(?i)you\s+are\s+(?:now\s+)?(?:a|an|the)\s+[\w\s]{0,40}?\b(assistant|AI|bot|model|chatbot|language\s+model|jailb(?:roken|reak))\b",
)
#: Secrets that stop a corpus from being published.
SECRETS = (
    ("anthropic_key", r"sk-ant-[A-Za-z0-9_-]{40,}"),
    ("openai_key", r"sk-[A-Za-z0-9_-]{20,}"),
    ("github_pat", r"ghp_[A-Za-z0-9]{20,}"),
    ("aws_access_key", r"AKIA[A-Z0-9]{16}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{20,}\."),
    ("aws_secret_config", r"aws_secret_access_key\s*="),
)
#: Legal forms of organisations.
LEGAL_FORMS = ("ООО", "ОАО", "ЗАО", "ИП", "ПАО", "АО", "LLC", "Inc", "Ltd", "GmbH")
#: Entity types that a domain asks for, domains in order.
DOMAIN_TYPES = {
    "project": ["project", "task"],
    "decision": ["decision", "meeting"],
    "strategic": ["project", "goal", "north_star"],
    "risk": ["topic", "decision"],
    "people": ["person", "team"],
    "engineering": ["document", "project", "task"],
    "knowledge": ["document", "process"],
    "customer": ["person", "team"],
    "smalltalk": [],
}
#: Addresses and links.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
URL = r"""https?://[^\s<>"']+"""
#: White space at either end, of any alphabet.
BLANK = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
#: Russian letters that one Latin letter stands for, and those that take several.
CYRILLIC = ("абвгдеёзийклмнопрстуфхыэъь", "abvgdeezijklmnoprstufhye''")
CYRILLIC_PAIRS = (("ж", "zh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "sch"), ("ю", "ju"), ("я", "ja"))
TRIMMED = " _-.,;:()[]{}'\""


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def strip(text: Column) -> Column:
    """Without white space, of any alphabet, at both ends."""
    return F.regexp_replace(text, BLANK, "")


def normalize_name(name: Column, unicode: bool = True) -> Column:
    """Compatibility form, stripped of white space, lower-cased, without format characters; `unicode=False` skips the first step."""
    return F.regexp_replace(F.lower(strip(nfkc(name) if unicode else name)), r"\p{Cf}", "")


def transliterate(name: Column) -> Column:
    """A name, normalised, with Russian letters in Latin ones."""
    latin = F.translate(normalize_name(name), *CYRILLIC)
    for letter, letters in CYRILLIC_PAIRS:
        latin = F.replace(latin, F.lit(letter), F.lit(letters))
    return latin


def sanitize(text: Column, max_chars: int = MAX_CHARS, unicode: bool = True) -> Column:
    clean = F.regexp_replace(F.regexp_replace(nfkc(text) if unicode else text, ZERO_WIDTH, ""), HTML_COMMENT, "")
    return F.substring(clean, 1, max_chars)


def any_match(text: Column, patterns) -> Column:
    """Whether any pattern occurs; white space, letters and case are those of Unicode."""
    return reduce(lambda a, b: a | b, [F.coalesce(text.rlike(f"(?U){p}"), F.lit(False)) for p in patterns])


def injected(text: Column) -> Column:
    return any_match(text, INJECTION)


def sanitize_context(text: Column, unicode: bool = True) -> Column:
    """Cut instruction-like phrases from the normalised text; a text without any stays as it is."""
    view = F.regexp_replace(nfkc(text) if unicode else text, r"\p{Cf}", "")
    cut = reduce(lambda t, p: F.regexp_replace(t, f"(?U){p}", "[REDACTED]"), REDACTED, view)
    return F.when(any_match(view, REDACTED), cut).otherwise(text)


def secret_kinds(text: Column) -> Column:
    """Names of the secret patterns that occur in a text."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in SECRETS]))


def strip_legal_forms(name: Column) -> Column:
    forms = F.array(*[F.lit(x) for x in LEGAL_FORMS])
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: ~F.array_contains(forms, F.btrim(w, F.lit("«»\"'."))))
    return F.array_join(words, " ")


def latin(name: Column) -> Column:
    """A name in compatibility form with Russian letters in Latin ones, its case kept: a capital that takes several letters begins with one."""
    capitals = [c.upper() for c in CYRILLIC[0]], [c.upper() for c in CYRILLIC[1]]
    out = F.translate(nfkc(name), CYRILLIC[0] + "".join(capitals[0]), CYRILLIC[1] + "".join(capitals[1]))
    for letter, letters in CYRILLIC_PAIRS:
        out = F.replace(F.replace(out, F.lit(letter), F.lit(letters)), F.lit(letter.upper()), F.lit(letters.capitalize()))
    return out


def name_variants(name: Column) -> Column:
    """(transliterated, stripped, stripped_transliterated): forms under which a name may be known elsewhere; letters of other alphabets stay."""
    stripped = strip_legal_forms(nfkc(name))
    return F.struct(latin(name).alias("transliterated"), stripped.alias("stripped"), latin(stripped).alias("stripped_transliterated"))


def clean_name(name: Column) -> Column:
    """A name without XML tags, control characters and white space at its ends; null if it holds a script tag."""
    plain = F.regexp_replace(name, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.when(~plain.rlike(r"(?iU)<\s*script"), strip(F.regexp_replace(plain, r"<[^>]+>", "")))


def strip_name(name: Column) -> Column:
    return F.btrim(F.lower(name), F.lit(TRIMMED))


def slug_path(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit("/"), F.replace(F.lower(name), F.lit(" "), F.lit("-")))


def confidence_tier(x: Column, high: float = 0.8, low: float = 0.6) -> Column:
    return F.when(x >= high, "high").when(x >= low, "medium").otherwise("low")


def relevant_types(scores: Column, least: float = 0.2) -> Column:
    """Types that the domains of a map<domain, score> at `least` or more ask for; null (all) when none does."""
    lists = [F.when(F.coalesce(F.element_at(scores, F.lit(d)), F.lit(0.0)) >= least, F.array(*[F.lit(t) for t in types]).cast("array<string>")) for d, types in DOMAIN_TYPES.items()]
    out = F.array_distinct(F.flatten(F.array_compact(F.array(*lists))))
    return F.when(F.size(out) > 0, out)


def primary_domain(scores: Column) -> Column:
    """The domain with the highest score; of equals, the first in order."""
    ranked = [F.struct(F.coalesce(F.element_at(scores, F.lit(d)), F.lit(0.0)).alias("s"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DOMAIN_TYPES)]
    return F.array_max(F.array(*ranked))["d"]


def is_crystal(best_other: Column, smalltalk: Column, least: float = 0.1) -> Column:
    return ~((smalltalk >= 0.8) & (best_other < 0.4)) & (best_other >= least)


def is_garbage_name(name: Column) -> Column:
    """More than twelve words, or a question."""
    return (F.size(F.split(F.trim(name), r"\s+")) > 12) | F.endswith(F.trim(name), F.lit("?"))


def is_artifact_name(name: Column) -> Column:
    return name.rlike(r"^[0-9a-f]{16,}$") | name.rlike(r"^U[A-Z0-9]{8,}$")


def valid_path(path: Column) -> Column:
    """At most 512 characters and ten levels, without '..', '//' or control characters."""
    return (F.char_length(path) <= 512) & (F.size(F.split(path, "/")) <= 10) & ~path.rlike(r"\.\.|//|[\x00-\x1f]")


def fake_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic vector from SHA-256 bytes, repeated to `dim`, each byte / 255."""
    once = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  # a lambda computes what it names for each element, so values are bound first
    numbers = lambda h: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int") / 255.0)
    return once(once(F.sha2(text.cast("binary"), 256), numbers), lambda v: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: v[i % 32]))


def content_key(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


#: Words for days from the anchor, and the months of both languages by number.
DAYS = {"today": 0, "tomorrow": 1, "yesterday": -1, "day after tomorrow": 2, "сегодня": 0, "завтра": 1, "вчера": -1, "послезавтра": 2, "позавчера": -2}
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "января": 1, "февраля": 2, "марта": 3, "апреля": 4, "мая": 5, "июня": 6, "июля": 7, "августа": 8, "сентября": 9, "октября": 10, "ноября": 11, "декабря": 12,
}
_SPANS = (("day", r"days?|день|дня|дней"), ("week", r"weeks?|недел[юиь]|недель"), ("month", r"months?|месяц(?:а|ев)?"), ("year", r"years?|год(?:а)?|лет"))


def iso_date(text: Column, anchor: Column, past: int = 10, future: int = 2) -> Column:
    """struct(iso, reason) of dates in English and Russian, at midnight, within a window of years around `anchor`.

    ISO dates; "31.12.2026" and "31/12/2026"; a day and a month by name, with or
    without a year; words such as "tomorrow"; "in 3 days", "через 2 недели", "a
    week ago". A date without a year is the next one from the anchor on.
    """
    t, day = F.lower(strip(text)), anchor.cast("date")
    known = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    parts = lambda pattern, i: F.nullif(F.regexp_extract(t, pattern, i), F.lit(""))
    iso = F.try_to_date(F.regexp_extract(t, r"\A(\d{4}-\d{2}-\d{2})(?:[t ].*)?\z", 1), "yyyy-MM-dd")
    dotted = r"\A(\d{1,2})[./](\d{1,2})[./](\d{4})\z"
    made = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int")), "yyyy-MM-dd")
    numeric = F.when(t.rlike(dotted), made(parts(dotted, 3), parts(dotted, 2), parts(dotted, 1)))
    named = r"(?U)\A(?:(\d{1,2})(?:st|nd|rd|th)? (\p{L}+)|(\p{L}+) (\d{1,2})(?:st|nd|rd|th)?),?(?: (\d{4}))?(?: года?)?\z"
    d, month, year = F.coalesce(parts(named, 1), parts(named, 4)), F.try_element_at(known(MONTHS), F.coalesce(parts(named, 2), parts(named, 3), F.lit(""))), parts(named, 5)
    this = made(F.coalesce(year, F.year(day).cast("string")), month, d)
    later = F.coalesce(*[made((F.year(day) + i).cast("string"), month, d) for i in (1, 2, 3, 4)])
    by_name = F.when(year.isNotNull(), this).when(this >= day, this).otherwise(later)
    relative = None
    for unit, words in _SPANS:
        pattern = rf"(?U)\A(?:(in|через) )?(?:(\d{{1,3}}|an?|один|одну) )?(?:{words})( ago| назад)?\z"
        count = F.coalesce(parts(pattern, 2).try_cast("int"), F.lit(1)) * F.when(parts(pattern, 3).isNotNull(), -1).otherwise(1)
        ok = t.rlike(pattern) & (parts(pattern, 1).isNotNull() != parts(pattern, 3).isNotNull())
        moved = {"day": F.date_add(day, count), "week": F.date_add(day, 7 * count), "month": F.add_months(day, count), "year": F.add_months(day, 12 * count)}[unit]
        relative = F.when(ok, moved) if relative is None else relative.when(ok, moved)
    parsed = F.coalesce(F.date_add(day, F.try_element_at(known(DAYS), t)), iso, numeric, by_name, relative)
    inside = (parsed >= F.add_months(day, -12 * past)) & (parsed <= F.add_months(day, 12 * future))
    reason = F.when(F.coalesce(t, F.lit("")) == "", "empty_input").when(parsed.isNull(), "unparseable_relative_date").when(~inside, "out_of_sanity_window")
    return F.struct(F.when(reason.isNull(), F.concat(parsed.cast("string"), F.lit("T00:00:00+00:00"))).alias("iso"), reason.alias("reason"))
