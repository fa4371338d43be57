"""Sources and sinks: JSON payloads, CSV exports, pages, line lists, dictionaries, content store, audit log, backup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import human_bytes, strings
from ..functions.urls import body_path, profile_url, registered_host, url_hash

SEARCH = "organic_results array<struct<position:int,title:string,link:string,snippet:string,rich_snippet:struct<top:struct<extensions:array<string>>>>>"
USER = (
    "user struct<login:string,type:string,name:string,location:string,hireable:boolean,html_url:string,blog:string>,"
    "repos array<struct<repo:struct<full_name:string,html_url:string,fork:boolean,private:boolean,archived:boolean,size:long,"
    "pushed_at:string,stargazers_count:long,owner:struct<login:string>>,languages:map<string,long>>>"
)


class Tables(dict):
    """The driver's tables by name, each opened when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        df = self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The driver's tables; a scan reads the columns that a plan needs."""
    return Tables(spark, sf_dir)


def split_title(title: Column) -> Column:
    """Name and headline of a result title: parts at spaced dashes; the site's own suffix goes."""
    clean = F.regexp_replace(title, r"\s*\|\s*LinkedIn\s*$", "")
    parts = F.split(clean, r"\s+[-–—]\s+")
    return F.struct(F.trim(parts[0]).alias("name"), F.nullif(F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), " - "), F.lit("")).alias("headline"))


def extensions(items: Column, is_place: Column) -> Column:
    """Location, title and employer of a result's extensions. ``is_place``: for each item, whether it resolves to a region.

    The first item that resolves is the location; else the first, if there are several and it has a comma or at most
    three words. Title and employer are the next two others.
    """
    none = F.lit(None).cast("string")
    at = F.coalesce(F.array_position(is_place, F.lit(True)), F.lit(0)).cast("int")
    first = F.get(items, F.lit(0))
    guess = (at == 0) & (F.size(items) > 1) & (F.contains(first, F.lit(",")) | (F.size(F.split(first, r"\s+")) <= 3))
    at = F.when(guess, 1).otherwise(at)
    rest = F.filter(items, lambda _, i: i != at - 1)
    return F.struct(F.when(at > 0, F.get(items, at - 1)).otherwise(none).alias("location"), F.get(rest, F.lit(0)).alias("title"), F.get(rest, F.lit(1)).alias("employer"))


def search_refs(payloads: DataFrame, payload: str, blocklist: list[str] = ()) -> DataFrame:
    """(ref_value, name, headline, snippet, link, position, raw): refs to people of search payloads, first of each kept."""
    p = payloads.select(F.from_json(payload, SEARCH).alias("p")).select(F.inline(F.coalesce("p.organic_results", F.array().cast(SEARCH.split(" ", 1)[1]))))
    refs = p.withColumn("ref_value", profile_url("link")).where("ref_value IS NOT NULL").where(~F.coalesce(registered_host("link").isin(list(blocklist)), F.lit(False)))
    refs = refs.withColumn("raw", F.to_json(F.struct(*p.columns)))
    best = refs.groupBy("ref_value").agg(F.min_by(F.struct("title", "snippet", "link", "position", "raw", "rich_snippet"), F.struct("position", "raw")).alias("r"))
    t = split_title(F.col("r.title"))
    return best.select("ref_value", t["name"].alias("name"), t["headline"].alias("headline"), "r.snippet", "r.link", "r.position", F.col("r.rich_snippet.top.extensions").alias("extensions"), "r.raw")


def repos_of(p: DataFrame) -> DataFrame:
    """A row for each repo of parsed code-host payloads (subject_id, user, repos), with its map of languages."""
    r = p.select("subject_id", "user", F.explode("repos").alias("x"))
    return r.select(
        "subject_id", F.col("user.login").alias("login"), F.col("user.type").alias("account_type"), F.col("x.repo.full_name").alias("repo"), F.col("x.repo.html_url").alias("url"),
        F.col("x.repo.fork").alias("fork"), F.col("x.repo.private").alias("private"), F.col("x.repo.archived").alias("archived"), F.col("x.repo.size").alias("size"),
        F.try_to_timestamp(F.col("x.repo.pushed_at")).alias("pushed_at"), F.col("x.repo.stargazers_count").alias("stars"), F.col("x.repo.owner.login").alias("owner"), F.col("x.languages").alias("languages"),
    )


def code_host_repos(payloads: DataFrame, payload: str) -> DataFrame:
    """The same of payloads (subject_id, text)."""
    return repos_of(payloads.select("subject_id", F.from_json(payload, USER).alias("p")).select("subject_id", "p.*"))


def code_host_accounts(payloads: DataFrame, payload: str) -> DataFrame:
    """(subject_id, login, account_type, location, hireable, url) of code-host payloads."""
    p = payloads.select("subject_id", F.from_json(payload, USER).alias("p")).select("subject_id", "p.user")
    return p.select("subject_id", "user.login", F.col("user.type").alias("account_type"), "user.location", "user.hireable", F.col("user.html_url").alias("url"))


def contacts(spark: SparkSession, path: str) -> DataFrame:
    """CSV export with a header (UTF-8, byte-order mark allowed), all strings."""
    df = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿").strip().lower().replace(" ", "_") for c in df.columns])


def contact_refs(rows: DataFrame) -> DataFrame:
    """Refs of contacts, with a search-shaped payload as their raw form."""
    headline = F.concat_ws(" at ", F.nullif("position", F.lit("")), F.nullif("company", F.lit("")))
    name = F.concat_ws(" ", "first_name", "last_name")
    raw = F.to_json(F.struct(F.concat_ws(" - ", name, headline).alias("title"), F.col("url").alias("link"), headline.alias("snippet")))
    return rows.select(profile_url("url").alias("ref_value"), name.alias("name"), headline.alias("headline"), raw.alias("raw")).where("ref_value IS NOT NULL")


def line_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines without the white space around them; blank ones go."""
    return spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("value")).where("value <> ''")


def term_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(name, alias, kind, implies, ord) from JSON lines of {name, kind, aliases, implies}; the order of lines counts."""
    raw = spark.read.schema("ord int, name string, kind string, aliases array<string>, implies array<string>").json(path)
    alias = F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return raw.select("name", alias.alias("alias"), "kind", F.coalesce("implies", F.array().cast("array<string>")).alias("implies"), "ord")


def region_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(code, place) from JSON lines of {code, places}."""
    return spark.read.schema("code string, places array<string>").json(path).select("code", F.explode("places").alias("place"))


def _yaml(spark: SparkSession, path: str) -> dict:
    """A YAML file of a dictionary, in its order; it is read by Spark and is as small as a dictionary is."""
    import yaml

    return yaml.safe_load(spark.read.text(path, wholetext=True).first().value)


def yaml_terms(spark: SparkSession, path: str) -> DataFrame:
    """(name, alias, kind, implies, ord) from YAML entries ``name: {kind, aliases, implies}``; their order counts."""
    return terms_frame(spark, [(name, e.get("kind"), e.get("aliases") or [], e.get("implies") or []) for name, e in _yaml(spark, path).items()])


def yaml_regions(spark: SparkSession, path: str) -> DataFrame:
    """(code, place, ord) from YAML entries ``code: [places]``."""
    rows = [(code, place) for code, members in _yaml(spark, path).items() for place in members]
    return spark.createDataFrame([(c, p, i) for i, (c, p) in enumerate(rows)], "code string, place string, ord int")


def terms_frame(spark: SparkSession, entries: list[tuple[str, str, list[str], list[str]]]) -> DataFrame:
    """The same from literal (name, kind, aliases, implies) rows."""
    rows = [(n, a, k, i, at) for at, (n, k, al, i) in enumerate(entries) for a in [n, *al]]
    return spark.createDataFrame(rows, "name string, alias string, kind string, implies array<string>, ord int")


def with_bodies(fetches: DataFrame) -> DataFrame:
    """Fetches with the content-addressed path of their body and the digest of their redacted address."""
    return fetches.withColumn("body_path", body_path("body")).withColumn("url_hash", url_hash("url"))


def append(df: DataFrame, path: str) -> None:
    """Audit rows added to a Parquet log."""
    df.write.mode("append").parquet(path)


def backup(df: DataFrame, path: str) -> None:
    """A full copy; the commit protocol publishes it only when all tasks have ended."""
    df.write.mode("overwrite").parquet(path)


def field_presence(refs: DataFrame, fields: list[str]) -> DataFrame:
    """How many rows hold each field."""
    one = refs.agg(F.count("*").alias("n"), *[F.count_if(F.col(f).isNotNull()).alias(f) for f in fields])
    return one.select("n", F.explode(F.map_from_arrays(strings(fields), F.array(*fields))).alias("field", "present"))


def folder_usage(spark: SparkSession, path: str, budget: int, amber: float = 0.8) -> DataFrame:
    """(bytes, share, light, human) of all files under a folder, whose sizes alone are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"))
    share = F.col("bytes") / budget if budget else F.lit(0.0)
    return total.select("bytes", share.alias("share"), F.when(share >= amber, "amber").otherwise("green").alias("light"), human_bytes("bytes").alias("human"))
