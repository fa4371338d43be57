"""Adapters by name: how each kind of payload is read, as a batch or a stream, and what rows it gives.

An adapter states the fields of its payload and an expression-only function from parsed payloads to rows. Files of
payloads (one JSON object a line) are read by Spark with the adapter's fields as schema, so that a plan parses only the
fields that it uses and filters on them reach the reader.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import readers


@dataclass(frozen=True)
class Adapter:
    name: str
    schema: str  #: fields of a payload
    rows: Callable[[DataFrame], DataFrame]  #: frames of these fields (and of others, which it may keep) to rows


REGISTRY: dict[str, Adapter] = {}


def register(adapter: Adapter) -> Adapter:
    """Adds an adapter; a name is given once."""
    if adapter.name in REGISTRY:
        raise ValueError(f"there is an adapter {adapter.name}")
    REGISTRY[adapter.name] = adapter
    return adapter


def adapter(name: str) -> Adapter:
    if name not in REGISTRY:
        raise KeyError(f"no adapter {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def read(spark: SparkSession, name: str, path: str, where: Column | None = None) -> DataFrame:
    """Rows of the payloads in a folder; ``where`` is a condition on fields of the payload."""
    a = adapter(name)
    raw = spark.read.schema(a.schema).json(path)
    return a.rows(raw if where is None else raw.where(where))


def stream(spark: SparkSession, name: str, path: str, files_at_once: int = 1000) -> DataFrame:
    """Rows of the payloads that come into a folder."""
    a = adapter(name)
    return a.rows(spark.readStream.schema(a.schema).option("maxFilesPerTrigger", files_at_once).json(path))


def handled(jobs: DataFrame, kind: str = "kind", payload: str = "payload") -> tuple[dict[str, DataFrame], DataFrame]:
    """The rows of each adapter's jobs, and the jobs of a kind that no adapter has."""
    of = lambda a: a.rows(jobs.where(F.col(kind) == a.name).select("*", F.from_json(payload, a.schema).alias("_p")).select("*", "_p.*").drop("_p"))
    return {name: of(a) for name, a in REGISTRY.items()}, jobs.where(~F.coalesce(F.col(kind).isin(list(REGISTRY)), F.lit(False)))


def _results(p: DataFrame) -> DataFrame:
    """Results that lead to a person, as they come."""
    r = p.select(F.inline("organic_results"))
    title = readers.split_title(F.col("title"))
    return r.select(readers.profile_url("link").alias("ref_value"), title["name"].alias("name"), title["headline"].alias("headline"), "snippet", "link", "position").where("ref_value IS NOT NULL")


register(Adapter("search", readers.SEARCH, _results))
register(Adapter("code_host", "subject_id long, " + readers.USER, readers.repos_of))
