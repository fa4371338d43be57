"""Dictionary lookups of terms and hierarchical regions. Dictionaries are dimensions that the caller passes.

A term dimension has (name, alias, kind, implies array); a region dimension has (code, place). Windows of a text are looked
up by an equi-join, for which Spark broadcasts a dimension under its threshold and shuffles otherwise; filters of a fixed
size keep nearly all windows that no dictionary has from being made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ROLE_WORD
from ..functions.text import folded, normalise_key, strings, words


LONGEST = 3  #: words of a window
BEGIN = 6  #: letters of a key that its beginnings are told by
SLOTS = 1 << 21  #: of a filter; 2 MB, whatever the dictionary
BITS = 1 << 24  #: of a filter of bits; 2 MB as well


def alias_lookup(terms: DataFrame) -> DataFrame:
    """(key, name): the later entry (by ``ord``) wins where normalised aliases collide."""
    return terms.select(normalise_key("alias").alias("key"), "name", "ord").groupBy("key").agg(F.max_by("name", "ord").alias("name"))


def fixed_filter(texts: DataFrame, c: str) -> Column:
    """A filter of the column's texts as an array of flags, made by an aggregate and handed on as a scalar.

    Flags are gathered as words of 64 bits and spread in the one row: a lookup is then one access, and takes its text once.
    """
    spot = F.pmod(F.xxhash64(c), F.lit(SLOTS))
    held = texts.select(F.shiftright(spot, 6).cast("int").alias("i"), (spot % 64).cast("int").alias("b")).groupBy("i").agg(F.expr("bit_or(shiftleft(1L, b))").alias("w"))
    every = texts.sparkSession.range(SLOTS // 64).select(F.col("id").cast("int").alias("i")).join(held, "i", "left")
    flags = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.coalesce(F.getbit("w", b), F.lit(0).cast("byte")))
    return every.select("i", flags.alias("f")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "f"))), lambda x: x["f"])).alias("flags")).scalar()


def may_hold(flags: Column, c: Column) -> Column:
    """False only for texts that the filter wasn't made of."""
    return F.get(flags, F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")) == 1


def _spots(h: Column) -> list[Column]:
    return [x.bitwiseAND(F.lit(BITS - 1)) for x in (h, F.shiftrightunsigned(h, 32))]


def bit_filter(hashes: DataFrame, c: str) -> Column:
    """A filter of 64-bit hashes, two bits for each, as an array of words; made and handed on like ``fixed_filter``'s. It
    lets far fewer through."""
    held = hashes.select(F.explode(F.array(*_spots(F.col(c)))).alias("s")).groupBy(F.shiftright("s", 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, CAST(s % 64 AS INT)))").alias("w"))
    every = hashes.sparkSession.range(BITS // 64).select(F.col("id").alias("i")).join(held, "i", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("w", F.lit(0)).alias("w")))), lambda x: x["w"]).alias("flags")).scalar()


def bits_hold(flags: Column, *hashes: Column) -> Column:
    """False only where the filter was made of none of the hashes. All are looked up, so that a projection computes each once."""
    bit = lambda s: F.getbit(F.get(flags, F.shiftright(s, 6).cast("int")), s.bitwiseAND(F.lit(63)).cast("int"))
    return reduce(Column.bitwiseOR, [low.bitwiseAND(high) for low, high in ([bit(s) for s in _spots(h)] for h in hashes)]) == 1


def _windows(docs: DataFrame, id_col: str, text_col: str, dim: DataFrame) -> DataFrame:
    """(id, stage, place, key) of the windows of 3 (stage 0) to 1 words whose key the dictionary may have, and few others.

    A row for each word with the two after it; words that begin no key go, by a filter of the keys' first letters, before
    any key is made, and windows by a filter of whole keys. Both filters have one size; what they let through is joined.
    """
    begins = fixed_filter(dim.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(BEGIN)), lambda n: F.substr("key", F.lit(1), n))).alias("b")), "b")
    held = fixed_filter(dim.select("key"), "key")
    every = docs.select(id_col, words(text_col).alias("_w")).select(id_col, F.posexplode(F.arrays_zip(*[F.slice("_w", F.lit(i + 1), F.size("_w")).alias(f"w{i}") for i in range(LONGEST)])).alias("place", "_z"))
    first = every.where(may_hold(begins, F.substring(folded(F.col("_z.w0")), 1, BEGIN)))
    said = [folded(F.col(f"_z.w{i}")) for i in range(LONGEST)]
    made = first.select(id_col, "place", F.posexplode(F.array(*[F.concat(*said[:k]) for k in range(LONGEST, 0, -1)])).alias("stage", "key"))
    return made.where((F.col("key") != "") & may_hold(held, F.col("key")))


def terms_in_text(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """(id, names): canonical names in the order in which windows of 3 to 1 words first name them."""
    dim = alias_lookup(terms)
    hits = _windows(docs, id_col, text_col, dim).join(dim, "key").groupBy(id_col, "name").agg(F.min(F.struct("stage", "place")).alias("pos"))
    return hits.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]).alias("names"))


def canonical(df: DataFrame, raw: str, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``canonical``; and the proposals: raw terms that no alias knows, repeats kept."""
    known = df.withColumn("key", normalise_key(raw)).join(alias_lookup(terms).withColumnRenamed("name", "canonical"), "key", "left").drop("key")
    return known, known.where("canonical IS NULL").select(F.col(raw).alias("raw"))


def with_implied(held: DataFrame, subject: str, term: str, terms: DataFrame) -> DataFrame:
    """Held terms and those they imply, one hop."""
    dim = terms.select(F.col("name").alias(term), F.explode("implies").alias("_implied")).distinct()
    return held.select(subject, term).unionByName(held.join(dim, term).select(subject, F.col("_implied").alias(term))).distinct()


def region_lookup(regions: DataFrame) -> DataFrame:
    """(key, code): of the codes of a place, the longer one, then the greater."""
    return regions.groupBy(normalise_key("place").alias("key")).agg(F.max_by("code", F.struct(F.length("code"), F.col("code"))).alias("code"))


def drop_covered(codes: Column) -> Column:
    """Codes, longest first, without those that prefix another."""
    kept = F.filter(codes, lambda c: ~F.exists(codes, lambda d: (d != c) & F.startswith(d, c)))
    return F.transform(F.sort_array(F.transform(F.array_distinct(kept), lambda c: F.struct((-F.length(c)).alias("n"), c.alias("c")))), lambda s: s["c"])


def regions_in_text(docs: DataFrame, id_col: str, text_col: str, regions: DataFrame) -> DataFrame:
    dim = region_lookup(regions)
    hits = _windows(docs, id_col, text_col, dim).join(dim, "key")
    return hits.groupBy(id_col).agg(drop_covered(F.collect_set("code")).alias("codes"))


def region_of(df: DataFrame, id_col: str, text_col: str, regions: DataFrame) -> DataFrame:
    """(id, region): whole text, else its comma parts, else windows of 3, 2, 1 words; the first stage with a hit decides,
    the longest code wins, the earliest on ties."""
    dim = region_lookup(regions)
    base = df.select(id_col, F.col(text_col).alias("t"))
    whole = base.select(id_col, F.lit(0).alias("stage"), F.lit(0).alias("pos"), normalise_key("t").alias("key"))
    parts = base.select(id_col, F.lit(1).alias("stage"), F.posexplode(F.split("t", ",")).alias("pos", "w")).select(id_col, "stage", "pos", normalise_key("w").alias("key"))
    found = _windows(base, id_col, "t", dim).select(id_col, (F.lit(2) + F.col("stage")).alias("stage"), F.col("place").alias("pos"), "key")
    tried = whole.unionByName(parts).unionByName(found).where("key <> ''").join(dim, "key")
    best = tried.groupBy(id_col).agg(F.min_by("code", F.struct("stage", (-F.length("code")).alias("n"), "pos")).alias("region"))
    return df.select(id_col).distinct().join(best, id_col, "left")


def cities(code_col: Column, places: Column) -> Column:
    """Places of a region code in a map of code to places; none for unknown codes."""
    return F.coalesce(F.element_at(places, code_col), F.array().cast("array<string>"))


def kind_of(df: DataFrame, name: str, terms: DataFrame) -> DataFrame:
    """Rows with the ``kind`` of their canonical term; null for unknown ones."""
    return df.join(terms.groupBy(F.col("name").alias(name)).agg(F.max_by("kind", "ord").alias("kind")), name, "left")


def compatible(region: Column, wanted: Column) -> Column:
    """Prefix relation in either direction; IN-REMOTE in the wanted list means IN."""
    return F.exists(wanted, lambda w: F.startswith(region, F.when(w == "IN-REMOTE", "IN").otherwise(w)) | F.startswith(F.when(w == "IN-REMOTE", "IN").otherwise(w), region))


def _prefixes(code: Column, least: int = 1, but: int = 0) -> Column:
    """The beginnings of a code from ``least`` characters on, up to all but ``but``; none of an empty or null one."""
    last = F.coalesce(F.char_length(code), F.lit(0)) - but
    return F.when(last >= least, F.transform(F.sequence(F.lit(least), last), lambda n: F.substr(code, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def prefix_pairs(left: DataFrame, left_code: str, right: DataFrame, right_code: str) -> DataFrame:
    """All pairs of rows of which one's code begins the other's; columns of both, whose names differ.

    Codes are spread to their beginnings, so both directions are equi-joins. Empty and null codes have no partner.
    """
    shorter = left.select("*", F.explode(_prefixes(F.col(left_code))).alias("_c")).join(right, F.col("_c") == F.col(right_code)).drop("_c")
    longer = right.select("*", F.explode(_prefixes(F.col(right_code), but=1)).alias("_c")).join(left, F.col("_c") == F.col(left_code))
    return shorter.unionByName(longer.select(shorter.columns))


def longest_prefix(left: DataFrame, left_key: str, left_code: str, right: DataFrame, right_code: str) -> DataFrame:
    """(left_key, right_code): for each left row the right code that begins its code, the longest; null if none does."""
    codes = right.select(F.col(right_code).alias("_c")).where("_c <> ''").distinct()
    hit = left.select(left_key, F.explode(_prefixes(F.col(left_code))).alias("_c")).join(codes, "_c")
    best = hit.groupBy(left_key).agg(F.max_by("_c", F.char_length("_c")).alias(right_code))
    return left.select(left_key).distinct().join(best, left_key, "left")


def expects_artifacts(terms_held: Column, titles: Column, code_terms: list[str], analyst_terms: list[str]) -> Column:
    """Whether code can be expected: a code term outside the analyst set, or an analyst one under a title with a role word."""
    code = F.array_intersect(terms_held, strings(code_terms))
    role = F.exists(titles, lambda t: F.regexp_like(t, F.lit(ROLE_WORD)))
    return F.coalesce((F.size(F.array_except(code, strings(analyst_terms))) > 0) | ((F.size(code) > 0) & F.coalesce(role, F.lit(False))), F.lit(False))
