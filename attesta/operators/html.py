"""Pages to blocks of visible text, and where pages name people beside their employers.

HTML has no grammar that expressions can follow, so a page's text nodes come from ``htmltree`` in Arrow-batched maps; all
else is expressions on blocks, and joins by what names begin with and by page and block.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.constants import EMPLOYER_STOP, TITLE_AFTER, TITLE_CUES
from ..functions.text import bound, col, employer_keys, signal_tokens, strings
from .dictionary import bit_filter, bits_hold
from .htmltree import blocks_of
from .scan import materialised

AROUND = 160  #: characters kept on either side of a name in a long window
BATCH_ROWS = 256  #: pages in one Arrow batch; pages can be long, so batches stay short to bound a worker's memory
SEEN = 4  #: words of a name that a filter tells it by
NAME = 6  #: words of a name that are looked up at once


@pandas_udf(StringType())
def page_text(html: pd.Series) -> pd.Series:
    """Visible text, a block a line; a null page has none."""
    return html.map(blocks_of)


def with_text(pages: DataFrame, page: str, html: Column | str) -> DataFrame:
    """(page, text): the pages' visible text, read in short batches (a setting that stays, as rows are read later)."""
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return pages.select(page, page_text(html).alias("text"))


def keys_of(employer: Column | str) -> Column:
    """The words by which an employer is known; none for what reads like a title."""
    return employer_keys(employer, EMPLOYER_STOP, TITLE_CUES)


def trimmed(window: Column, name: Column, around: int = AROUND) -> Column:
    """A window of over twice ``around`` characters, cut at spaces about ``around`` before and after the name."""

    def cut(w: Column) -> Column:
        whole = w["w"]
        at = F.instr(F.lower(whole), F.lower(w["n"])) - 1
        after = at + F.char_length(w["n"])
        lo, hi = F.greatest(at - around, F.lit(0)), F.least(after + around, F.char_length(whole))
        space = F.instr(F.substr(whole, lo + 1, at - lo + 1), F.lit(" "))  # of a space within the part before the name
        start = F.when(lo == 0, 0).when(space == 0, at).otherwise(lo + space)
        tail = F.substr(whole, after + 1, hi - after)
        last = F.instr(F.reverse(tail), F.lit(" "))
        stop = F.when((hi == F.char_length(whole)) | (last == 0), hi).otherwise(hi - last)
        kept = F.substr(whole, start + 1, stop - start)
        return F.when(F.char_length(whole) <= 2 * around, whole).when(at < 0, F.substr(whole, F.lit(1), F.lit(2 * around))).otherwise(F.btrim(kept, F.lit(" \n")))

    return bound(F.struct(window.alias("w"), name.alias("n")), cut)


def windows(pages: DataFrame, page: str, text: str, targets: DataFrame) -> DataFrame:
    """(page, subject_id, pos, window, name, employer): where a page names a target by name and employer.

    ``targets`` has (page, subject_id, name, employer). A window is a block that holds the name, if it holds one of the
    employer's words as a word; else that block with the next one, if that does. Of equal windows the first stays.
    Targets without a name or without identifying words have none.
    """
    known = targets.select(page, "subject_id", "name", "employer", keys_of("employer").alias("_keys")).where((F.coalesce("name", F.lit("")) != "") & (F.size("_keys") > 0))

    def found(b: Column) -> Column:
        named = F.filter(F.transform(b["blocks"], lambda x, i: F.struct(i.alias("pos"), x.alias("block"))), lambda s: F.contains(F.lower(s["block"]), F.lower(b["name"])))
        holds = lambda x: F.coalesce(F.arrays_overlap(signal_tokens(x), b["keys"]), F.lit(False))
        after = lambda s: F.get(b["blocks"], s["pos"] + 1)
        seen = F.transform(named, lambda s: F.struct(s["pos"].alias("pos"), F.when(holds(s["block"]), s["block"]).when(holds(after(s)), F.concat(s["block"], F.lit("\n"), after(s))).alias("window")))
        return F.transform(F.filter(seen, lambda s: s["window"].isNotNull()), lambda s: F.struct(s["pos"].alias("pos"), trimmed(s["window"], b["name"]).alias("window")))

    pairs = pages.select(page, F.col(text).alias("_text")).join(known, page)
    hits = pairs.select(page, "subject_id", "name", "employer", F.inline(bound(F.struct(F.split("_text", "\n").alias("blocks"), F.col("name").alias("name"), F.col("_keys").alias("keys")), found)))
    return hits.where("window <> ''").groupBy(page, "subject_id", "name", "employer", "window").agg(F.min("pos").alias("pos"))


def title_near(window: Column, name: Column, cues: list[str] = TITLE_CUES, longest: int = 6) -> Column:
    """The first of what follows the name anywhere in the window, up to a line end, pipe, semicolon or full stop, that
    has at most ``longest`` words, one of them a title's."""
    quoted = F.regexp_replace(name, r"([^\p{L}\p{N}\s])", r"\\$1")
    after = F.regexp_extract_all(window, F.concat(F.lit("(?i)"), quoted, F.lit(TITLE_AFTER)), F.lit(1))
    phrase = F.transform(after, lambda x: F.btrim(F.element_at(F.split(F.trim(x), r"[\n|;.]"), 1), F.lit(" .,-")))
    words = lambda x: F.size(F.filter(F.split(x, "[^A-Za-z0-9]+"), lambda w: w != ""))
    return F.get(F.filter(phrase, lambda x: (words(x) <= longest) & F.arrays_overlap(signal_tokens(x), strings(cues))), F.lit(0))


def corroborations(pages: DataFrame, page: str, text: str, targets: DataFrame) -> DataFrame:
    """(page, subject_id, employer, pos, window, title): each page's first window of each target."""
    first = windows(pages, page, text, targets).groupBy(page, "subject_id", "name", "employer").agg(F.min(F.struct("pos", "window")).alias("_w"))
    return first.select(page, "subject_id", "employer", "_w.pos", "_w.window", title_near(F.col("_w.window"), F.col("name")).alias("title"))


def postings(pages: DataFrame, page: str, text: str) -> DataFrame:
    """(page, block, own, after): each block and the next in lower case."""
    lines = pages.select(page, F.split(F.lower(text), "\n").alias("_l"))
    zipped = F.arrays_zip(F.col("_l").alias("own"), F.slice("_l", F.lit(2), F.size("_l")).alias("after"))
    return lines.select(page, F.posexplode(zipped).alias("block", "_z")).select(page, "block", "_z.own", "_z.after")


def mentions(index: DataFrame, page: str, people: DataFrame) -> DataFrame:
    """(page, subject_id, block, distance): blocks that hold a person's name, word by word, and a word of the employer in
    the same block (distance 0) or the next (1).

    ``index`` is what ``postings`` gives (it is read twice: written down, if pages are many), ``people`` has (subject_id,
    name, employer) and is read twice too. A filter of a fixed size, of the names' first ``SEEN`` words, keeps nearly all
    places of the pages from leaving their task; what it lets through is joined by the first ``NAME`` words. The blocks and
    people that this brings together are written down, and compared once each, name by whole name; a second filter keeps
    other blocks from being shuffled.
    """
    words = lambda c: F.split(c, "[^a-z0-9]+")  # noqa: E731  # the first and last can be empty, which no name's word is
    who = people.select("subject_id", F.filter(words(F.lower("name")), lambda w: w != "").alias("_n"), keys_of("employer").alias("_keys")).where((F.size("_n") > 0) & (F.size("_keys") > 0))
    held = bit_filter(who.select(F.xxhash64(*[F.get("_n", F.lit(i)) for i in range(SEEN)]).alias("h")), "h")  # a hash passes over nulls
    head = who.select("subject_id", "_keys", F.array_join("_n", " ").alias("_name"), F.array_join(F.slice("_n", 1, NAME), " ").alias("_head"))
    places = index.select(page, "block", words("own").alias("_w")).select(page, "block", F.explode(F.arrays_zip(*[F.slice("_w", F.lit(i + 1), F.size("_w")).alias(f"w{i}") for i in range(NAME)])).alias("_z"))
    w = [F.col(f"_z.w{i}") for i in range(NAME)]
    begins = F.array(*[F.when(w[k - 1].isNotNull(), F.concat_ws(" ", *w[:k])) for k in range(1, NAME + 1)])
    seen = places.select(page, "block", F.when(bits_hold(held, *[F.xxhash64(*w[:k]) for k in range(1, SEEN + 1)]), begins).alias("_b"))
    begun = seen.select(page, "block", F.explode_outer("_b").alias("_head")).where("_head IS NOT NULL")  # a plain explode would look twice
    near = materialised(begun.join(head, "_head").select(page, "block", "subject_id", "_name", "_keys").distinct())
    at = F.xxhash64(page, "block")
    beside = index.where(bits_hold(bit_filter(near.select(at.alias("h")), "h"), at))
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    holds = lambda c: F.arrays_overlap(words(c), F.col("_keys"))
    found = near.join(beside, [page, "block"]).where(F.contains(spaced(F.array_join(words("own"), " ")), spaced(F.col("_name"))))
    return found.select(page, "subject_id", "block", F.when(holds("own"), 0).when(holds("after"), 1).alias("distance")).where("distance IS NOT NULL")
