"""Composite operators: query plans, discovery, collection, scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.constants import COUNTRY, MUST_HAVES, PLAN_CAP, REMOTE, RESULTS_CAP, ROLE_WORDS
from ..functions.text import normalise_key, or_clause, quoted, strings, title_variants, years_from_text
from ..operators import claims as C
from ..operators import dictionary as D
from ..operators.gate import regate, rescue, snippet_gate
from ..operators.relational import first_wins, insert_ignore, top_k, upsert
from ..operators.scoring import active_weights, evaluate


def regions_with_places(requirements: DataFrame, cities: DataFrame) -> DataFrame:
    """(req_id, places): the places of each of a requirement's regions in the dictionary's order, the code where it has none."""
    dim = cities.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "place"))), lambda x: x["place"]).alias("members"))
    named = requirements.select("req_id", F.posexplode("regions").alias("at", "code")).join(dim, "code", "left").select("req_id", "at", F.coalesce("members", F.array("code")).alias("members"))
    return named.groupBy("req_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "members"))), lambda x: x["members"])).alias("places"))


def query_plan(requirements: DataFrame, cities: DataFrame, cap: int = PLAN_CAP) -> DataFrame:
    """(req_id, queries, dropped): title queries (all variants of a role word), then skill queries, distinct and capped.

    ``requirements`` has req_id, titles, must_have, regions, ``expects`` (whether artifacts can be expected: then skills are
    asked for with role words) and ``extras`` (words that all queries take); ``cities`` has code, place and ord.
    """
    r = requirements.join(regions_with_places(requirements, cities), "req_id", "left")
    none = F.array().cast("array<string>")
    place = F.when(F.size(F.coalesce("places", none)) > 0, or_clause(F.concat("places", F.array(F.lit(COUNTRY))))).otherwise("")
    r = r.withColumn("_place", place).withColumn("_extra", F.array_join(F.transform(F.coalesce("extras", none), quoted), " ")).withColumn("_role", F.when(F.col("expects"), or_clause(strings(ROLE_WORDS))).otherwise(""))
    some = lambda *x: F.array_join(F.filter(F.array(*x), lambda p: p != ""), " ")
    ask = lambda core: some(F.lit("site:linkedin.com/in/"), core, F.col("_place"), F.col("_extra"))
    titles = F.transform(F.filter("titles", lambda t: F.coalesce(t, F.lit("")) != ""), lambda t: ask(or_clause(title_variants(t))))
    skills = F.transform("must_have", lambda t: ask(some(quoted(t), F.col("_role"))))
    every = F.array_distinct(F.concat(titles, skills))
    return r.select("req_id", F.slice(every, 1, cap).alias("queries"), F.greatest(F.size(every) - cap, F.lit(0)).alias("dropped"))


def supplementary_plan(requirements: DataFrame, cities: DataFrame) -> DataFrame:
    """(req_id, queries): a code-host search for each known must-have with each place; either may be missing."""
    r = requirements.join(regions_with_places(requirements, cities), "req_id", "left")
    blank = lambda a: F.when(F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0, a).otherwise(strings([""]))
    word = lambda s: F.when(s != "", F.concat(F.lit(" language:"), s)).otherwise("")
    town = lambda c: F.when(c != "", F.concat(F.lit(' location:"'), c, F.lit('"'))).otherwise("")
    ask = F.flatten(F.transform(blank(F.col("must_have")), lambda s: F.transform(blank(F.col("places")), lambda c: F.concat(F.lit("type:user"), word(s), town(c)))))
    return r.select("req_id", ask.alias("queries"))


def corroboration_plan(people: DataFrame) -> DataFrame:
    """(subject_id, cost, query): searches for people (subject_id, name, employer), the cheapest first; none without a name."""
    name, firm = F.trim("name"), F.trim("employer")
    who = F.concat(F.lit('"'), name, F.lit('"'))
    both = F.concat(who, F.lit(' "'), firm, F.lit('"'))
    known = F.coalesce(F.col("employer"), F.lit("")) != ""
    asked = F.array_compact(F.array(F.when(known, both), F.when(known, F.concat(both, F.lit(' (team OR leadership OR "about us")'))), F.concat(who, F.lit(" (speaker OR panelist OR keynote OR conference)"))))
    return people.where(F.coalesce(name, F.lit("")) != "").select("subject_id", F.posexplode(asked).alias("cost", "query"))


def search_links(results: DataFrame, search: str, position: str, link: str, blocklist: list[str], cap: int = RESULTS_CAP) -> DataFrame:
    """(search, urls, notes) of search results: addresses to fetch in order, and what was dropped: blocked hosts by count, then those past the cap."""
    rows = results.select(F.col(search), F.col(position).alias("_at"), F.trim(link).alias("_url")).where("_url <> ''").withColumn("_host", urls.registered_host("_url"))
    rows = rows.withColumn("_why", F.when(F.col("_host").isNull(), "no host").otherwise(F.get(F.filter(urls.host_suffixes("_host"), lambda x: x.isin(blocklist)), F.lit(0))))
    first = rows.where("_why IS NULL").groupBy(search, "_url").agg(F.min("_at").alias("_at"))
    kept = first.groupBy(search).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_url"))), lambda x: x["_url"]).alias("_all"))
    lost = rows.where("_why IS NOT NULL").groupBy(search, "_why").agg(F.count("*").alias("_n"))
    told = lost.groupBy(search).agg(F.transform(F.array_sort(F.collect_list(F.struct("_why", "_n"))), lambda x: F.concat(x["_n"].cast("string"), F.lit(" from "), x["_why"])).alias("_notes"))
    out = results.select(search).distinct().join(kept, search, "left").join(told, search, "left")
    none = F.array().cast("array<string>")
    n = F.size(F.coalesce("_all", none)) - cap
    over = F.when(n > 0, F.array(F.concat(n.cast("string"), F.lit(" past the per-query cap")))).otherwise(none)
    return out.select(search, F.slice(F.coalesce("_all", none), 1, cap).alias("urls"), F.concat(F.coalesce("_notes", none), over).alias("notes"))


def draft(jds: DataFrame, terms: DataFrame, regions: DataFrame) -> DataFrame:
    """(jd_id, skills, regions, min_years, max_years) of job descriptions, from dictionaries and patterns."""
    out = jds.select("jd_id", years_from_text("text").alias("y"))
    out = out.join(D.terms_in_text(jds, "jd_id", "text", terms), "jd_id", "left").join(D.regions_in_text(jds, "jd_id", "text", regions), "jd_id", "left")
    return out.select("jd_id", F.col("names").alias("skills"), F.col("codes").alias("regions"), "y.min_years", "y.max_years")


def _mapped(df: DataFrame, key: str, names: str, dim: DataFrame) -> DataFrame:
    """(key, known, unknown): the names of an array by a dictionary (key, name), each distinct and in order."""
    rows = df.select(key, F.posexplode(names).alias("at", "raw")).withColumn("key", normalise_key("raw")).join(dim.select("key", F.col("name").alias("known")), "key", "left")
    one = rows.groupBy(key, "known", F.when(F.col("known").isNull(), F.col("raw")).alias("unknown")).agg(F.min("at").alias("at"))
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("at", F.col(c).alias("v"))))), lambda x: x["v"])
    return one.groupBy(key).agg(pick("known").alias("known"), pick("unknown").alias("unknown"))


def mapped_draft(extracted: DataFrame, terms: DataFrame, regions: DataFrame) -> DataFrame:
    """Specs from what a reader extracted of job descriptions: jd_id, text, titles, must_have, nice_to_have, places, remote, min_years, max_years.

    Names are mapped to the dictionaries and what none knows is listed; years that the text states win over extracted ones;
    a must-have isn't nice to have; unknown modes of work are on site.
    """
    skill, place = D.alias_lookup(terms), D.region_lookup(regions).withColumnRenamed("code", "name")
    out = extracted
    for names, dim, a, b in (("must_have", skill, "_must", "_no_must"), ("nice_to_have", skill, "_nice", "_no_nice"), ("places", place, "_codes", "_no_place")):
        out = out.join(_mapped(extracted, "jd_id", names, dim).select("jd_id", F.col("known").alias(a), F.col("unknown").alias(b)), "jd_id", "left")
    none = F.array().cast("array<string>")
    some = lambda c: F.coalesce(c, none)
    y = years_from_text("text")
    stated = y["min_years"].isNotNull() | y["max_years"].isNotNull()
    return out.select(
        "jd_id", some("titles").alias("titles"), some("_must").alias("must_have"), F.array_except(some("_nice"), some("_must")).alias("nice_to_have"), some("_codes").alias("regions"),
        F.when(F.col("remote").isin(REMOTE), F.col("remote")).otherwise("onsite").alias("remote"),
        F.when(stated, y["min_years"]).otherwise(F.col("min_years")).alias("min_years"), F.when(stated, y["max_years"]).otherwise(F.col("max_years")).alias("max_years"),
        F.concat(some("_no_must"), some("_no_nice")).alias("unmapped_skills"), some("_no_place").alias("unmapped_places"),
    )


def review(spec: DataFrame) -> DataFrame:
    """Specs with warnings and blocking items; unmapped names warn where the spec has them."""
    names = lambda c, text: F.when(F.size(c) > 0, F.concat(F.lit(text), F.array_join(c, ", ")))
    w = [
        F.when(F.size("must_have") > MUST_HAVES, F.concat(F.size("must_have").cast("string"), F.lit(" must-have skills is a lot and usually returns nobody. Consider moving some to nice-to-have."))),
        *[names(c, text) for c, text in (("unmapped_skills", "These skills aren't in our list yet, so they won't be searched: "), ("unmapped_places", "These locations aren't recognised: ")) if c in spec.columns],
    ]
    b = [
        F.when((F.size("titles") == 0) & (F.size("must_have") == 0), "Add at least one job title or one must-have skill to search for."),
        F.when((F.size("regions") == 0) & (F.col("remote") == "onsite"), "This role is in-office but has no location. Add a location, or change it to fully remote."),
        F.when(F.col("min_years") > F.col("max_years"), F.concat(F.lit("Minimum experience ("), F.col("min_years").cast("string"), F.lit(") is above the maximum ("), F.col("max_years").cast("string"), F.lit(")."))),
    ]
    return spec.withColumn("warnings", F.array_compact(F.array(*w))).withColumn("blocking", F.array_compact(F.array(*b)))


def confirm(spec: DataFrame) -> tuple[DataFrame, DataFrame]:
    r = review(spec)
    return r.where(F.size("blocking") == 0), r.where(F.size("blocking") > 0)


SPEC = (
    "titles array<string>, must_have_skills array<string>, nice_to_have_skills array<string>, seniority struct<min_years:int,max_years:int>, locations array<string>, remote string, "
    "domains array<string>, max_staleness_days int, excluded_employers array<string>, extra_keywords array<string>"
)


def spec_of(roles: DataFrame, spec: str = "spec_json") -> DataFrame:
    """Roles with their stored spec as typed columns, defaults filled in; all null where a role has none."""
    none = F.array().cast("array<string>")
    s = F.from_json(spec, SPEC)
    has = F.col(spec).isNotNull() & s.isNotNull()
    some = lambda f: F.when(has, F.coalesce(s[f], none))
    return roles.select(
        "*", some("titles").alias("titles"), some("must_have_skills").alias("must_have"), some("nice_to_have_skills").alias("nice_to_have"), s["seniority"]["min_years"].alias("min_years"), s["seniority"]["max_years"].alias("max_years"),
        some("locations").alias("regions"), F.when(has, F.coalesce(s["remote"], F.lit("onsite"))).alias("remote"), some("domains").alias("domains"), F.when(has, F.coalesce(s["max_staleness_days"], F.lit(540))).alias("max_staleness_days"),
        some("excluded_employers").alias("excluded_employers"), some("extra_keywords").alias("extras"),
    )


REF_SPEC = {"titles": "titles", "must_have": "must_have", "excluded": "excluded_employers", "regions": "regions", "remote": "remote"}


Resolver = Callable[[DataFrame], DataFrame]


def gated(refs: DataFrame, requirements: DataFrame, regions: DataFrame | Resolver, strict: bool = True) -> DataFrame:
    """Refs (ref_id, req_id, title, headline, employer, raw, location) with ``verdict``; a loose gate asks for no titles or must-haves.

    ``regions`` is a dictionary (code, place), or a function from refs with a location to (ref_id, region).
    """
    placed = refs.where("location IS NOT NULL")
    resolved = regions(placed) if callable(regions) else D.region_of(placed, "ref_id", "location", regions)
    r = refs.join(requirements, "req_id").join(resolved, "ref_id", "left")
    spec = {k: F.col(v) for k, v in REF_SPEC.items()}
    if not strict:
        spec |= {"titles": F.array().cast("array<string>"), "must_have": F.array().cast("array<string>")}
    return r.withColumn("verdict", snippet_gate(F.col("title"), F.col("headline"), F.col("employer"), F.col("raw"), F.col("location"), F.col("region"), spec))


def judged(refs: DataFrame, requirements: DataFrame, regions: DataFrame | Resolver) -> DataFrame:
    """Refs with the verdict of the gate and, where few of a requirement pass, of the rescue; refs that a person filed keep theirs."""
    own = refs.where("adapter <> 'manual'") if "adapter" in refs.columns else refs
    strict = gated(own, requirements, regions).withColumnRenamed("verdict", "strict")
    loose = gated(own, requirements, regions, strict=False).select("ref_id", F.col("verdict").alias("loose"))
    return rescue(strict.join(loose, "ref_id"), "req_id", "strict", "loose")


def discover(existing: DataFrame, found: DataFrame, requirements: DataFrame, regions: DataFrame | Resolver, local: DataFrame | None = None) -> DataFrame:
    """New refs deduplicated over queries, upserted (a known subject stays), gated and, where few pass, rescued.

    ``local`` refs (people that are known already) come after those that the search found: an equal ref isn't taken twice.
    All refs are judged anew, so that a fresh search and a later one arrive at the same verdicts.
    """
    key = ["req_id", "ref_kind", "ref_value"]
    new = first_wins(found, key, [F.asc("discovered_at"), F.asc("ref_id")])
    if local is not None:
        new = insert_ignore(new, local.select(new.columns), key, [F.asc("ref_id")])
    refs = upsert(existing, new, key, ["discovered_at", "ref_id"], ["title", "headline", "employer", "raw", "location"], ["subject_id"])
    return judged(refs, requirements, regions)


def known_elsewhere(refs: DataFrame, requirements: DataFrame, regions: DataFrame | Resolver, req_id: str, limit: int = 100) -> DataFrame:
    """Refs that passed for other requirements, aren't on this one and pass its gate too: a bounded report, newest first."""
    key = ["ref_kind", "ref_value"]
    here = refs.where(F.col("req_id") == req_id).select(*key).distinct()
    other = refs.where((F.col("req_id") != req_id) & (F.col("state") == "passed")).join(here, key, "left_anti")
    best = first_wins(other, key, [F.desc("discovered_at"), F.desc("ref_id")]).withColumn("req_id", F.lit(req_id))
    return gated(best, requirements, regions).where("verdict.passed").orderBy(F.desc("discovered_at"), "ref_id").limit(limit)


def local_candidates(requirements: DataFrame, subjects: DataFrame, claims: DataFrame, identities: DataFrame, limit: int = 100) -> DataFrame:
    """(req_id, subject_id, ref_kind, ref_value, name, headline, location): known active people with a must-have (where some
    are asked for) and a region of the requirement (likewise), who have a profile; at most ``limit`` a requirement, by subject."""
    asks = requirements.select("req_id", "must_have", "regions").where((F.size("must_have") > 0) | (F.size("regions") > 0))
    skilled = asks.select("req_id", F.explode("must_have").alias("claim_value")).join(claims.where("claim_type = 'skill'").select("claim_value", "subject_id").distinct(), "claim_value").select("req_id", "subject_id").distinct()
    placed = asks.select("req_id", F.explode("regions").alias("region")).join(subjects.where("status = 'active'").select("subject_id", "region"), "region").select("req_id", "subject_id").distinct()
    both = asks.where((F.size("must_have") > 0) & (F.size("regions") > 0)).select("req_id")
    one = lambda rows, other: rows.join(asks.where(F.size(other) == 0).select("req_id"), "req_id", "left_semi")
    hits = one(skilled, "regions").unionByName(one(placed, "must_have")).unionByName(skilled.join(placed, ["req_id", "subject_id"], "left_semi").join(both, "req_id", "left_semi"))
    slug = identities.where("kind = 'linkedin_slug'").groupBy("subject_id").agg(F.min("value").alias("slug"))
    title = claims.where("claim_type = 'title'").groupBy("subject_id").agg(F.max_by("claim_value", F.struct("observed_at", "claim_value")).alias("headline"))
    rows = hits.join(subjects.where("status = 'active'").select("subject_id", "name", F.coalesce("place", "region").alias("location")), "subject_id")
    rows = top_k(rows.join(slug, "subject_id"), ["req_id"], [F.asc("subject_id")], limit).join(title, "subject_id", "left")
    return rows.select("req_id", "subject_id", F.lit("linkedin_url").alias("ref_kind"), F.concat(F.lit("linkedin.com/in/"), "slug").alias("ref_value"), "name", "headline", "location")


def promising(refs: DataFrame, requirements: DataFrame, seen: DataFrame, budget: Column, limit: int, resolvable: DataFrame | None = None) -> DataFrame:
    """Refs to read next: most must-haves in the raw snippet first, then the oldest; not those seen; within the budget.

    ``resolvable`` subjects, whom a held key already leads to their work, are left out.
    """
    hits = F.size(F.filter("must_have", lambda s: F.contains(F.lower(F.coalesce("raw", F.lit(""))), F.lower(s))))
    if resolvable is not None:
        refs = refs.join(resolvable.select("subject_id").distinct(), "subject_id", "left_anti")
    todo = refs.where("state = 'passed'").join(seen.select("ref_value").distinct(), "ref_value", "left_anti").join(requirements.select("req_id", "must_have"), "req_id").withColumn("hits", hits)
    return top_k(todo, ["req_id"], [F.desc("hits"), F.asc("discovered_at"), F.asc("ref_value")], limit).where(F.col("rank") <= budget)


def collect_person(existing: DataFrame, profiles: DataFrame, as_of: Column, source_text: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(claims after the write, refusals) of parsed profiles."""
    rows = C.person_claims(profiles, as_of).withColumn("snippet", F.coalesce("claim_value", F.lit("stated"))).withColumn("extractor", F.lit("profile")).withColumn("extractor_version", F.lit("1"))
    good, bad = C.validate(rows, source_text)
    return C.write_claims(existing, good, as_of), bad


def score(requirements: DataFrame, claims: DataFrame, weights: DataFrame, as_of: Column, pairs: DataFrame) -> DataFrame:
    """Scores under the active weights of each requirement's profile."""
    return evaluate(requirements, claims, as_of, pairs, active_weights(weights))


def attached(refs: DataFrame, subjects: DataFrame) -> DataFrame:
    """(req_id, subject_id): the active people that refs attach to requirements, once each."""
    return refs.where("subject_id IS NOT NULL").select("req_id", "subject_id").distinct().join(subjects.where("status = 'active'").select("subject_id"), "subject_id", "left_semi").select("req_id", "subject_id")


def changed(old: DataFrame, refs: DataFrame, requirements: DataFrame, regions: DataFrame | Resolver) -> DataFrame:
    """Refs whose state a new gate (with its rescue) changes."""
    return regate(old, judged(refs, requirements, regions), "ref_id")
