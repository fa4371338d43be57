"""String and token expressions. All are Catalyst expressions over Columns; none calls Python per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import EMPLOYMENT_TYPES, JUNIOR_WORDS, PHRASES, ROLE_WORD, ROLE_WORDS, TITLE_NOISE, YEARS_LEAST, YEARS_PLUS, YEARS_RANGE


def strings(values) -> Column:
    values = list(values)
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _split(c: Column | str, pattern: str) -> Column:
    return F.filter(F.split(F.lower(col(c)), pattern), lambda x: x != "")


def normalise_key(c: Column | str) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


def normalise_country(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z]", "")


def title_tokens(c: Column | str) -> Column:
    return F.array_distinct(_split(c, "[^a-z0-9+#]+"))


def significant_tokens(c: Column | str) -> Column:
    return F.array_except(title_tokens(c), strings(TITLE_NOISE))


def signal_tokens(c: Column | str) -> Column:
    return F.array_distinct(_split(c, "[^a-z0-9]+"))


def title_variants(c: Column | str) -> Column:
    """The title with its first role word replaced by each interchangeable one; itself if it has none; [] if empty."""
    c = col(c)
    at = F.regexp_instr(c, F.lit(ROLE_WORD))
    n = F.length(F.regexp_extract(c, ROLE_WORD, 0))
    swapped = F.array_distinct(F.transform(strings(ROLE_WORDS), lambda w: F.concat(F.substr(c, F.lit(1), at - 1), w, F.substr(c, at + n))))
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).when(at == 0, F.array(c)).otherwise(swapped)


def title_matches(headline: Column | str, titles: Column) -> Column:
    """Whether the headline holds all significant tokens of a variant of one of the titles."""
    held = title_tokens(headline)
    variants = F.flatten(F.transform(titles, title_variants))
    hit = F.exists(F.transform(variants, significant_tokens), lambda v: (F.size(v) > 0) & (F.size(F.array_except(v, held)) == 0))
    return F.coalesce(hit, F.lit(False))


def acceptable_titles(titles: Column, must_have: Column) -> Column:
    return F.concat(titles, F.transform(must_have, lambda s: F.concat(s, F.lit(" Engineer"))))


def mentions_country(c: Column | str, country: str = "india") -> Column:
    return F.regexp_like(col(c), F.lit(rf"(?i)\b{country}\b"))


def first_excluded(haystack: list[Column], excluded: Column) -> Column:
    """The first excluded string that occurs in the joined parts, without regard to case; null if none."""
    text = F.lower(F.concat_ws(" ", *haystack))
    return F.get(F.filter(excluded, lambda e: F.contains(text, F.lower(e))), F.lit(0))


def banned_signal(key: Column | str, value: Column | str, banned: list[str]) -> Column:
    """The first banned signal that the key names, else the value: all its words occur in that one text. Null if none.

    Only texts that hold the first word of a signal anywhere are split into words.
    """
    begins = "|".join(sorted({re.escape(b.split("_")[0]) for b in banned}))

    def named(c: Column | str) -> Column:
        found = bound(signal_tokens(c), lambda words: F.get(F.filter(strings(banned), lambda b: F.size(F.array_except(F.split(b, "_"), words)) == 0), F.lit(0)))
        return F.when(F.regexp_like(F.lower(col(c)), F.lit(begins)), found)

    return F.coalesce(named(key), named(value))


def bound(c: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it (a lambda's free expressions aren't)."""
    return F.transform(F.array(c), lambda x: f(x))[0]


def words(c: Column | str) -> Column:
    """Runs of letters, digits, plus, hash and full stop, in order."""
    return F.filter(F.split(col(c), "[^A-Za-z0-9+#.]+"), lambda x: x != "")


def folded(word: Column) -> Column:
    """A word in lower case, its letters and digits only."""
    return F.translate(F.lower(word), "+#.", "")


def window_keys(c: Column | str, longest: int = 3) -> Column:
    """{stage, place, key} of the windows of ``longest`` (stage 0) to 1 words that have a letter or digit."""

    def windows(w: Column) -> Column:
        key = lambda i, k: F.when(i + k <= F.size(w), F.concat(*[F.get(w, i + j) for j in range(k)]))
        of = lambda k: F.transform(w, lambda _, i: F.struct(F.lit(longest - k).alias("stage"), i.alias("place"), key(i, k).alias("key")))
        return F.filter(F.concat(*[of(k) for k in range(longest, 0, -1)]), lambda x: F.coalesce(x["key"] != "", F.lit(False)))

    return bound(F.transform(words(c), folded), windows)


def squeezed(c: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(col(c), r"\s+", " ")))


def quotable(snippet: Column | str, source: Column | str) -> Column:
    """Whether the source holds the snippet, white space and case aside; true where there is no source."""
    return F.col(source).isNull() | F.contains(squeezed(source), squeezed(snippet)) if isinstance(source, str) else source.isNull() | F.contains(squeezed(source), squeezed(snippet))


def present_in(value: Column | str, page: Column | str) -> Column:
    v = F.trim(col(value))
    return (v != "") & F.contains(F.lower(col(page)), F.lower(v))


def looks_like_title(c: Column | str, cues: list[str]) -> Column:
    return F.arrays_overlap(signal_tokens(c), strings(cues))


def employer_keys(c: Column | str, stop: list[str], cues: list[str]) -> Column:
    """Words of an employer that identify it: two letters or more, no stop words; none if it reads like a title."""
    own = F.filter(F.array_except(signal_tokens(c), strings(stop)), lambda w: F.length(w) >= 2)
    return F.when(looks_like_title(c, cues), F.array().cast("array<string>")).otherwise(own)


def quoted(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(" ")), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)


def or_clause(items: Column) -> Column:
    """Distinct items that aren't empty, quoted where they hold a space, joined by OR; in parentheses if several."""
    some = F.transform(F.array_distinct(F.filter(items, lambda x: F.coalesce(x, F.lit("")) != "")), quoted)
    joined = F.array_join(some, " OR ")
    return F.when(F.size(some) > 1, F.concat(F.lit("("), joined, F.lit(")"))).otherwise(joined)


def years_from_text(c: Column | str) -> Column:
    """Struct of min_years and max_years that a text states: a range (swapped if inverted), a minimum, "n+"; else nulls."""
    t = col(c)
    a, b = (F.regexp_extract(t, YEARS_RANGE, i).try_cast("int") for i in (1, 2))
    least = F.coalesce(F.regexp_extract(t, YEARS_LEAST, 1).try_cast("int"), F.regexp_extract(t, YEARS_PLUS, 1).try_cast("int"))
    return F.struct(F.coalesce(F.least(a, b), least).alias("min_years"), F.greatest(a, b).alias("max_years"))


def plain_reason(c: Column | str) -> Column:
    """A reason for readers: what follows the first colon, phrases in plain words, a capital first letter."""
    out = F.trim(F.when(F.contains(col(c), F.lit(":")), F.regexp_replace(col(c), r"(?s)^[^:]*:", "")).otherwise(col(c)))
    for phrase, plain in PHRASES.items():
        out = F.replace(out, F.lit(phrase), F.lit(plain))
    return F.when(F.coalesce(out, F.lit("")) == "", "No reason recorded").otherwise(F.concat(F.upper(F.substring(out, 1, 1)), F.substr(out, F.lit(2))))


def display_headline(title: Column, employer: Column, headline: Column) -> Column:
    """Title at employer where both are known, else the title, else the headline."""
    some = lambda x: F.nullif(x, F.lit(""))
    return F.coalesce(F.when(some(title).isNotNull() & some(employer).isNotNull(), F.concat(title, F.lit(" at "), employer)), some(title), headline)


def is_junior(c: Column | str) -> Column:
    """Whether a position holds one of the words of beginners."""
    padded = F.concat(F.lit(" "), F.lower(col(c)), F.lit(" "))
    return F.exists(strings(JUNIOR_WORDS), lambda w: F.contains(padded, w))


def comma_list(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def human_bytes(c: Column | str) -> Column:
    """Bytes in the largest unit of which there is one."""
    c, out = col(c).cast("double"), None
    for i, unit in enumerate(["B", "KB", "MB", "GB", "TB"]):
        shown = F.format_string("%.1f " + unit if i else "%.0f " + unit, c / float(1024**i))
        cond = c < float(1024 ** (i + 1))
        out = F.when(cond, shown) if out is None else (out.when(cond, shown) if unit != "TB" else out.otherwise(shown))
    return out


def first_integer(c: Column | str) -> Column:
    """First integer of a count such as "1,234 posts"."""
    return F.regexp_extract(F.regexp_replace(col(c), ",", ""), r"(\d+)", 1).try_cast("long")


def relative_age(c: Column | str) -> Column:
    """An age such as "5d" or "3 weeks ago"; null if there is none."""
    found = F.regexp_extract(F.lower(col(c)), r"(\d+\s*(?:minutes?|hours?|days?|weeks?|months?|years?)\s+ago|\d+\s*(?:mo|yr|[mhdwy])\b)", 1)
    return F.nullif(found, F.lit(""))


def activity_ids(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(r"urn:li:activity:(\d+)"), F.lit(1)))


def time_split(c: Column | str) -> Column:
    """ "from - to · duration" in three fields; a single part is both from and to."""
    parts = F.split(col(c), r"\s*·\s*")
    span = F.split(F.get(parts, F.lit(0)), r"\s+[-–—]\s+|\s*[–—]\s*")
    first = F.nullif(F.trim(F.get(span, F.lit(0))), F.lit(""))
    return F.struct(first.alias("from"), F.coalesce(F.nullif(F.trim(F.get(span, F.lit(1))), F.lit("")), first).alias("to"), F.get(parts, F.lit(1)).alias("duration"))


def is_employment_type(c: Column | str) -> Column:
    return F.replace(F.lower(F.trim(col(c))), F.lit(" "), F.lit("-")).isin(EMPLOYMENT_TYPES)


def keyword_routes(c: Column | str, routes: dict[str, list[str]]) -> Column:
    """Names of all routes one of whose keywords occurs in the text as words."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(col(c)), "[^a-z0-9+#]+", " "), F.lit(" "))
    hits = [F.when(F.exists(strings(words), lambda w: F.contains(padded, F.concat(F.lit(" "), F.lower(w), F.lit(" ")))), F.lit(name)) for name, words in routes.items()]
    return F.array_compact(F.array(*hits))


def header_version(c: Column | str) -> Column:
    """Version in a first line such as "version: 3", and the rest."""
    v = F.nullif(F.regexp_extract(col(c), r"^\s*#?\s*version:\s*(\S+)", 1), F.lit(""))
    return F.struct(v.alias("version"), F.when(v.isNull(), col(c)).otherwise(F.regexp_replace(col(c), r"^[^\n]*\n?", "")).alias("body"))


def classify(c: Column | str, rules: list[tuple[str, str]]) -> Column:
    """The category of the first rule whose text occurs, without regard to case."""
    t, out = F.lower(col(c)), None
    for needle, name in rules:
        out = F.when(F.contains(t, F.lit(needle)), F.lit(name)) if out is None else out.when(F.contains(t, F.lit(needle)), F.lit(name))
    return out
