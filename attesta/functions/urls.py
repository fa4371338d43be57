"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import LOGIN_KEYS, NO_PERSON_SEGMENTS, PERSON_MARKERS, SECRET_PARAMS
from .text import col, strings


def host(c: Column | str) -> Column:
    """Lower-case host; null where there is none."""
    return F.lower(F.try_parse_url(col(c), F.lit("HOST")))


def registered_host(c: Column | str) -> Column:
    return F.regexp_replace(host(c), r"^www\.", "")


def redact_url(c: Column | str, params: list[str] | None = None) -> Column:
    """The values of secret query parameters replaced by REDACTED, the others decoded and encoded anew.

    Addresses without a query stay as they are. Parameters without a value get an empty one, empty ones go.
    """
    whole = col(c)
    fragment = F.regexp_extract(whole, r"(#.*)$", 1)
    plain = F.regexp_replace(whole, r"#.*$", "")
    at = F.instr(plain, "?")
    query = F.when(at > 0, F.substr(plain, at + 1)).otherwise("")
    decoded = lambda x: F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))
    # form encoding, but for the two characters that it treats otherwise than a URL does
    encoded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    def pair(p: Column) -> Column:
        name, value = decoded(F.regexp_extract(p, r"^([^=]*)", 1)), decoded(F.regexp_extract(p, r"^[^=]*=?(.*)$", 1))
        return F.concat(encoded(name), F.lit("="), F.when(F.lower(name).isin(params or SECRET_PARAMS), "REDACTED").otherwise(encoded(value)))

    rebuilt = F.array_join(F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair), "&")
    head = F.substr(plain, F.lit(1), at - 1)
    return F.when(query == "", whole).otherwise(F.concat(head, F.when(rebuilt != "", F.concat(F.lit("?"), rebuilt)).otherwise(""), fragment))


def url_hash(c: Column | str) -> Column:
    return F.sha2(F.encode(redact_url(c), "UTF-8"), 256)


def body_path(body: Column | str) -> Column:
    """Content-addressed path: two characters of the digest, then the digest."""
    digest = F.sha2(col(body), 256)
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), digest)


def host_suffixes(c: Column | str) -> Column:
    """A host and all its dot-suffixes."""
    parts = F.split(col(c), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def blocked(c: Column | str, blocklist: list[str]) -> Column:
    """Whether a host equals, or lies under, a blocked one."""
    return F.coalesce(F.arrays_overlap(host_suffixes(c), strings(blocklist)), F.lit(False))


def slug(c: Column | str) -> Column:
    """Last path segment, lower case."""
    return F.lower(F.element_at(F.split(F.regexp_replace(F.regexp_replace(col(c), r"[?#].*$", ""), "/+$", ""), "/"), -1))


def profile_url(c: Column | str, domain: str = "linkedin.com") -> Column:
    """Canonical address ``domain/in/<slug>`` of a person; null for other hosts and for pages that aren't a person's."""
    c = F.trim(col(c))
    full = F.when(F.contains(c, F.lit("//")), c).otherwise(F.concat(F.lit("https://"), c))
    h = F.lower(F.regexp_extract(full, r"//([^/?#:]*)", 1))
    path = F.filter(F.split(F.regexp_extract(full, r"//[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    low = F.transform(path, F.lower)
    at = F.array_position(F.transform(low, lambda x: x.isin(PERSON_MARKERS)), F.lit(True)).cast("int")
    who = F.when(at > 0, F.get(low, at))
    own = ((h == domain) | F.endswith(h, F.lit(f".{domain}"))) & ~F.get(low, F.lit(0)).isin(NO_PERSON_SEGMENTS)
    return F.when(own & who.isNotNull() & ~who.isin(NO_PERSON_SEGMENTS), F.concat(F.lit(f"{domain}/in/"), who))


def login_from_url(c: Column | str, domain: str = "github.com", reserved: tuple[str, ...] = ("orgs", "topics", "features", "about", "login", "search", "settings", "marketplace")) -> Column:
    """Segment behind the host, if it is a possible login."""
    login = F.lower(F.regexp_extract(col(c), rf"(?i){domain.replace('.', r'\.')}/([A-Za-z0-9](?:[A-Za-z0-9-]{{0,38}}))(?:[/?#]|$)", 1))
    return F.when((login != "") & ~login.isin(list(reserved)) & ~F.endswith(login, F.lit("-")), login)


def login_from_keys(keys: Column) -> Column:
    """Login among a person's keys (a map): a held one as it is, else the first that an address gives."""
    return F.coalesce(F.nullif(F.element_at(keys, "github_login"), F.lit("")), *[login_from_url(F.element_at(keys, k)) for k in LOGIN_KEYS])


_URL = r"https?://[^\s\"'<>)\]]+"
_MAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"


def strong_keys(c: Column | str) -> Column:
    """The login of the first address of a text that gives one, and the digest of its first e-mail address, by kind."""
    logins = F.filter(F.transform(F.regexp_extract_all(col(c), F.lit(_URL), F.lit(0)), lambda u: login_from_url(u)), lambda x: x.isNotNull())
    mails = F.regexp_extract_all(col(c), F.lit(_MAIL), F.lit(0))
    entries = F.array(
        F.struct(F.lit("github_login").alias("k"), F.get(logins, F.lit(0)).alias("v")),
        F.struct(F.lit("email_sha256").alias("k"), F.sha2(F.encode(F.lower(F.get(mails, F.lit(0))), "UTF-8"), 256).alias("v")),
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def without_query(c: Column | str) -> Column:
    return F.split_part(F.split_part(col(c), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))


def with_slash(c: Column | str) -> Column:
    return F.when(F.endswith(col(c), F.lit("/")), col(c)).otherwise(F.concat(col(c), F.lit("/")))


def absolute(c: Column | str, base: str) -> Column:
    """An address without its query and fragment, put under ``base`` where it has no host."""
    u = without_query(F.trim(col(c)))
    return F.when(F.regexp_like(u, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), u).when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).when(u != "", F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(u, "^/+", "")))


def distinct_addresses(items: Column, base: str, limit: int) -> Column:
    """The first ``limit`` distinct addresses of an array, cleaned, in order."""
    return F.slice(F.array_distinct(F.filter(F.transform(items, lambda x: absolute(x, base)), lambda x: x.isNotNull())), 1, limit)
