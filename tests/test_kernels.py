"""Kernels without a SQL form, against the cases that define them."""

import numpy as np
import pytest

from corpusflow.operators import cleaning, directory, retrieval
from corpusflow.streaming import events


def test_windows_cover_and_overlap(spark):
    texts = {1: "One sentence here. " * 80, 2: "short", 3: "x" * 1000, 4: None}
    df = spark.createDataFrame(list(texts.items()), "i int, t string").select("i", cleaning.cut_windows(400, 50)("t").alias("w"))
    got = {r["i"]: r["w"] for r in df.collect()}
    assert all(len(p) <= 400 for p in got[1]) and len(got[1]) > 3
    assert got[2] == ["short"] and got[3][0] == "x" * 400 and got[4] is None


def test_packed_paragraphs_carry_a_tail(spark):
    ps = [("alpha beta gamma delta. " * 8).strip()] * 5
    df = spark.createDataFrame([(1, ps), (2, []), (3, ["too few words"])], "i int, blocks array<string>")
    out = [r["chunk"] for r in cleaning.chunks(df, 400, 60).orderBy("i", "chunk_no").collect()]
    assert len(out) >= 3 and all(len(c.split()) >= 5 for c in out)
    assert all(b.startswith(a[-60:].partition(". ")[2]) for a, b in zip(out, out[1:], strict=False))


def test_nfkc_and_page_cleanup(spark):
    rows = [(1, "ﬁne car- ies\n12\nPage 3\nput a tick here\nWord word word word word word end"), (2, None), (3, "")]
    got = {r["i"]: r["t"] for r in spark.createDataFrame(rows, "i int, t string").select("i", cleaning.cleaned_page(cleaning.F.col("t")).alias("t")).collect()}
    assert got == {1: "fine caries\nWord word end", 2: "", 3: ""}


def test_pages_are_parsed(spark):
    rows = [(1, "<html><title> A b </title><body><a href='x'>l</a><img src='y'><script>no()</script>text</body></html>"), (2, None)]
    got = {r["page_id"]: r for r in directory.profiles(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert (got[1]["title"], got[1]["n_links"], got[1]["n_images"]) == ("A b", 1, 1)
    assert "no()" not in got[1]["text"] and got[2]["text"] == ""


def test_rate_limit_starts_at_the_first_event(spark):
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(i, 1, at(s)) for i, s in enumerate((0, 10, 20, 30, 86_399, 86_400, 86_500))]
    got = {r["event_id"]: r["limited"] for r in events.limited(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")).collect()}
    assert got == {0: False, 1: False, 2: False, 3: True, 4: True, 5: False, 6: False}


def test_stream_equals_batch(spark):
    sf = "/root/testdata/sf0.001"
    found = sorted(map(tuple, events.s4_rate_limit_stream(spark, sf).collect()))
    assert found == sorted(map(tuple, events.s4_rate_limit(spark, sf).collect())) and {limited for _, limited in found} == {True, False}


def test_replay_within_a_day_only(spark):
    import datetime

    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    rows = [(i, u, k, at(h)) for i, (u, k, h) in enumerate([(1, "a", 0), (1, "a", 23), (1, "b", 23), (1, "a", 24), (1, "a", 47), (1, "a", 49), (2, "a", 50), (1, "a", 200), (None, "a", 201), (None, "a", 202)])]
    table = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp")
    found, reports = events.fed(spark, events.by_time(table, 5), events.replayed_stream)
    got = {r["event_id"]: (r["answered_by"], r["replayed"]) for r in found.collect()}
    assert {k: v[0] for k, v in got.items()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8}
    assert all(replayed == (k != first) for k, (first, replayed) in got.items()) and len([r for r in reports if r["numInputRows"]]) >= 3


def test_continuous_ingest_equals_a_fresh_one(spark, tmp_path):
    from corpusflow.operators import ingest

    text = "Enamel is the hard outer layer of a tooth and keeps it whole for many years of life. Cavities are treated by dentists who clean them and then fill them. "
    docs = spark.createDataFrame([(i, f"s{i % 2}", f"Document {i}. " + text * 4) for i in range(12)], "doc_id long, source string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda df: sorted((r["doc_id"], r["chunk_index"], r["hash"], r["points"]) for r in df.collect())
    got = key(events.s8_continuous_ingest(spark, str(tmp_path)))
    assert {r[0] for r in got} == set(range(12))
    parts = [docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 OR doc_id % 10 = 0")]
    again = [r for p in parts for r in key(ingest.ingested(p))]
    assert got == sorted(set(again))


def test_versions_replace_by_key_and_survive_a_failed_write(spark, tmp_path):
    from pyspark.sql import functions as F

    from corpusflow.sources import versions

    path, schema = f"{tmp_path}/t", "k long, v string"
    assert versions.current(spark, path) is None
    make = lambda rows: spark.createDataFrame(rows, schema)
    held = lambda: sorted(map(tuple, versions.current(spark, path).collect()), key=str)
    assert versions.replace(path, make([]), make([]), "k") is None
    versions.replace(path, make([(i, "a") for i in range(100)] + [(None, "n")]), spark.range(100).select(F.col("id").alias("k")).union(spark.sql("SELECT CAST(NULL AS BIGINT)")), "k")
    assert len(held()) == 101
    versions.replace(path, make([(1, "b"), (1, "c")]), make([(1, ""), (2, "")]), "k")
    assert [r for r in held() if r[0] in (1, 2)] == [(1, "b"), (1, "c")] and len(held()) == 101
    before = held()
    broken = make([(3, "x")]).withColumn("v", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        versions.replace(path, broken, make([(3, "")]), "k")
    assert held() == before
    versions.replace(path, make([(None, "m")]), make([(None, "")]), "k")
    assert [r for r in held() if r[0] is None] == [(None, "m")]


@pytest.mark.parametrize("block", [1024, 7])
def test_cosine_top_collects_no_queries(spark, monkeypatch, block):
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(retrieval, "BLOCK_ROWS", block, raising=False)
    monkeypatch.setattr(retrieval, "HELD_BLOCKS", 2, raising=False)
    x = np.random.default_rng(3).normal(size=(90, 8))
    x[50:60] = x[40:50]  # ties
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    asked = v.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "query_id")
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "collect", lambda self: pytest.fail("collected"))
        found = retrieval.cosine_top(asked, v, 4)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 9)
    wanted = {(i, j, r + 1) for i in range(0, 90, 2) for r, j in enumerate(sorted(range(90), key=lambda j: (-score[i, j], j))[:4])}
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in found.collect()} == wanted


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_cells_find_the_same(spark, monkeypatch, spread):
    """Clustered vectors, whose cells prune, and vectors without clusters, for which every cell is probed in the end."""
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 16)
    monkeypatch.setattr(retrieval, "PROBES", 2)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 10))[rng.integers(0, 12, 400)] + spread * rng.normal(size=(400, 10))
    x[:40] = x[0]  # a third of a cell is one vector
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    asked = v.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 9)
    wanted = {(i, j, r + 1) for i in range(0, 400, 5) for r, j in enumerate(sorted(range(400), key=lambda j: (-score[i, j], j))[:7])}
    index = retrieval.VectorIndex(v, 9)
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in index.search(asked, 7).collect()} == wanted
    probed = sum(len(r["q_ids"]) // 8 for r in index._asked(asked.withColumn("least", retrieval.F.lit(0.99)), False).collect())
    assert (probed < 20) == (spread < 0.1)
    none = v.limit(0)
    assert retrieval.cosine_top(asked, none, 7, 9).count() == 0 and retrieval.cosine_top(none.withColumnRenamed("vec_id", "query_id"), v, 7, 9).count() == 0


def test_point_ids_are_name_based_uuids(spark):
    import uuid

    names = ["page:0", "page:17", "", "é漢"] + [f"n{i}" for i in range(20)]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", retrieval.name_uuid(retrieval.F.col("n")).alias("u"))
    assert {r["n"]: r["u"] for r in df.collect()} == {n: str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names}
