"""The pipeline stage by stage on the smallest tables: what each keeps, drops and returns."""

from conftest import DATA

from pyspark.sql import functions as F
from test_operators import brute_near, brute_repeats

import corpus_pipeline
from chronoplate.llm.minhash import words_lower


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.dtypes
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = {r.doc_id: r.text for r in docs.collect()}
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.dtypes == columns
        if name != "suffix_dedup":
            assert all(after[k] == before[k] for k in after)
        ids = sorted(before)
        if name == "near_duplicates":
            roots, _ = brute_near([before[k] for k in ids], 5, 80)
            assert set(after) == {k for i, k in enumerate(ids) if roots[i] == i}
        if name == "suffix_dedup":
            left = {k: kept.decode("utf-8", "ignore") if removed else before[k] for k, (_, removed, _, kept) in zip(ids, brute_repeats([before[k] for k in ids], 200), strict=True)}
            assert after == {k: t for k, t in left.items() if t or t == before[k]}
        if name == "near_duplicates":
            sets = {k: frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for k, t in after.items() if (w := words_lower(t))}
            assert len(set(sets.values())) == len(sets)
        if name == "decontamination":
            assert not [k for k, t in after.items() if any(x in t for x in items)]
        assert after and len(after) <= len(before)
        before = after
    want = {r.doc_id: r.ids_sha256 for r in docs.collect()}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, DATA).collect()} == want


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_null_and_repeated_ids_are_told_apart(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first().text
    one, two, three, four = (" ".join(f"{w}{i}" for i in range(60)) for w in ("ab", "cd", "ef", "gh"))
    near = f"{two} tail"
    rows = [(1, one), (1, two), (2, one), (None, near), (None, three), (None, three), (3, four), (3, four), (4, three.upper() + " x" * 9)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").to(schema)
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()), key=str)
    assert kept == sorted([(1, one), (1, two), (4, three.upper() + " x" * 9), (3, four)], key=str)
    held = [(None, f"Intro. {item} End."), (None, one), (7, f"Intro. {item} End."), (7, two)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in held], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").to(schema)
    assert {(r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, docs, DATA).collect()} == {(None, one), (7, two)}


def test_rows_of_one_id_and_text_leave_the_least(spark):
    text = "one two three four five six seven eight nine ten " * 3
    rows = [(1, text, "fr", "b", 5), (1, text, "en", "c", 9), (1, text, "en", "a", None), (1, text, None, "z", 2), (None, text + "and more of it", "en", "q", 1), (2, "something else " * 9, "de", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    for parts in (1, 5):
        kept = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(parts, "source"), DATA).collect()
        assert (1, text, None, "z", 2) in map(tuple, kept) and len([r for r in kept if r.doc_id == 1]) == 1
