"""The pipeline's decisions take effect, stage by stage."""

import collections

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    from attesta.llm import packing, secrets

    clean = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(60)]
    toxic = [f"{t} grobble snarkest grobble" for t in clean[:20]]
    near = [c + " tail" for c in clean[:5]]
    texts = clean + toxic + near + ["token=abcdefghij " + clean[0][::-1]] + [None, ""]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(60 <= i < 80)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.collect()}
        want = set(range(88)) - set(range(60, 80))
        if name != "toxicity":
            want -= set(range(80, 85))
        assert ids == want
    text = {r.doc_id: r.text for r in kept.collect()}
    assert text[85].startswith("[SECRET] ") and not secrets.spans(text[85]) and text[86] is None
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(text)
    held = collections.defaultdict(bytes)
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        held[r.doc_id] += bytes(r.content)
    assert {i: b.decode() for i, b in held.items()} == {i: t or "" for i, t in text.items()}  # redacted, whole
    bins = collections.Counter()
    for r in out:
        bins[r.bin_id] += r.n_bytes + 1
    assert max(bins.values()) <= packing.CAPACITY
    assert pipeline.near_duplicates(spark, docs.where(F.lit(False)), str(tmp_path)).count() == 0


def test_stages_on_awkward_tables(spark, tmp_path):
    """Columns of clashing names, repeated rows and null ids go through all stages; empty tables give empty results."""
    words = lambda c: " ".join(f"{c}{j}" for j in range(80))
    rows = [(0, words("a"), "s"), (0, words("a"), "s"), (1, words("a") + " end", "t"), (None, words("b"), "s"), (None, None, None), (2, words("c") + " token=abcdefgh", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit(i).alias(c) for i, c in enumerate(("first", "component_id", "key", "score", "n", "bin_id"))])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in out) == ["0", "2", "None", "None"]
    assert [bytes(r.content) for r in out if r.doc_id == 2] == [words("c").encode() + b" [SECRET]"]
    kept = docs
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_repeated_ids_of_different_texts(spark, tmp_path):
    a, b, c = (" ".join(f"{w}{j}" for j in range(60)) for w in "abc")
    rows = [(0, a, "s"), (1, a + " tail", "s"), (1, b, "s"), (2, "", "s"), (2, c, "t"), (2, c, "s"), (None, a, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [rows[0], rows[2], rows[3], rows[5], rows[6]]))
