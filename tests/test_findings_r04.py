"""Findings of round 4: what replaced a step gives what it gave, and holds what it is said to hold."""

import pyarrow.parquet as pq


def test_row_groups_of_blocks_are_bounded(spark, monkeypatch):
    """A reader holds the rows of a row group, and a block is megabytes: a hundred of them were one group and one page."""
    from corpusflow.operators import retrieval as R

    at, real = [], R.written

    def written(df, name="table", **options):
        out = real(df, name, **options)
        at.append((name, out.inputFiles()))
        return out

    monkeypatch.setattr(R, "written", written)
    monkeypatch.setattr(R, "BLOCK_ROWS", 64)
    monkeypatch.setattr(R, "GROUP_BYTES", 64 << 10, raising=False)
    rows = spark.range(2000).selectExpr("id AS vec_id", "transform(sequence(1, 64), i -> sin(id * i + i)) AS embedding").coalesce(1)
    index = R.VectorIndex(rows, 4)
    files = [f for name, fs in at if name == "cells" for f in fs]
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in files]
    sizes = [m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)]
    assert sum(sizes) > 900_000 and max(sizes) < 200_000
    asked = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    key = lambda d: sorted((r.query_id, r.vec_id, r["rank"]) for r in d.collect())
    assert key(index.search(asked, 3)) == key(R.VectorIndex(rows, 1).search(asked, 3))


def test_sets_of_copies_and_of_pairs_of_blocks_are_not_written_or_shuffled(spark, monkeypatch):
    """Of copies only the class's set is written; pairs of blocks hold places, not sets; what is read no more is removed."""
    import os

    from corpusflow.llm import ngram_join, storage

    real, tables, folders = storage.written, [], []
    shared = storage.shared_dir
    monkeypatch.setattr(storage, "shared_dir", lambda s: folders.append(shared(s)) or folders[-1])
    monkeypatch.setattr(storage, "written", lambda df, name="table", **o: tables.append((name, df.columns)) or real(df, name, **o))
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[: 200 + i % 40] + [f"own{i % 40}"]) for i in range(200)] + [None, "", "one two", "one two", "alone in its words as no other text is"]
    docs = spark.createDataFrame([(i - 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_join.near_duplicates(docs).collect()}
    assert {got[i - 3].component_id for i in range(200)} == {-3} and all(got[i - 3].class_id == i % 40 - 3 for i in range(200))
    assert (got[197].component_id, got[199].component_id, got[200].component_id, got[201].component_id) == (197, 199, 199, 201)
    columns = dict(tables)
    assert "shingles" not in columns["candidates"] and [n for n, _ in tables].count("blocks") == 2
    assert all({"file", "at"} <= set(c) and not {"hashes", "shingles"} & set(c) for n, c in tables if n in ("blocks", "pairs"))
    left = {x for f in folders if os.path.isdir(f.removeprefix("file://")) for x in os.listdir(f.removeprefix("file://"))}
    assert "sets" in left and not left & {"members", "bodies", "sketch"}
    assert ngram_join.near_duplicates(docs.where("doc_id = 201")).count() == 1


def test_keys_of_many_documents_lose_no_near_pair(spark, monkeypatch):
    """More documents than LARGEST share title, first words and lines: each near pair of them is found, once, also with a small key that two of them share."""
    import random

    from corpusflow.operators import ingest
    from tests.test_micro import _near_documents, _near_score

    rng, stems = random.Random(4), ["the", "and", "tion", "er", "ou", "quz", "xav", "jop", "wyb", "kex", "vim", "gaf"]
    prose = lambda n: " ".join("".join(rng.choices(stems, k=rng.randint(1, 3))) for _ in range(n))
    base, rows = [prose(22) for _ in range(6)], []
    for i in range(60):
        words = base[i % 6].split() if i % 3 else prose(rng.randint(16, 26)).split()
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(stems)
        at = sorted(rng.sample(range(1, len(words)), rng.randint(4, 6)))
        lines = [" ".join(words[x:y]) for x, y in zip([0, *at], [*at, len(words)], strict=True)]
        rows.append((i, "\n".join(["The running head of it" + (" all" if i % 7 == 0 else ""), *lines]), f"s{i % 2}", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    d = _near_documents(docs)
    first = {x: min(y for y in d if d[y]["print"] == d[x]["print"]) for x in d}  # stands for documents of equal content
    want = {(a, b): s for a in d for b in d if a < b and first[a] == a and first[b] == b and (s := _near_score(d[a], d[b])) >= 0.86} | {(first[x], x): 1.0 for x in d if first[x] != x}
    monkeypatch.setattr(ingest, "TILE", 8, raising=False)
    got = [(r.left_id, r.right_id, r.score) for r in ingest.near_pairs(docs).collect()]
    assert 20 < len(want) < 900 and sorted((a, b) for a, b, _ in got) == sorted(want)
    assert all(abs(s - want[a, b]) < 1e-6 for a, b, s in got)
    group = {r.doc_id: r.group for r in ingest.near_groups(docs).collect()}
    assert set(group) == {x for pair in want for x in pair} and all(group[a] == group[b] for a, b in want)


def test_matching_ends_early_only_below_the_least():
    import random
    from difflib import SequenceMatcher

    from corpusflow.operators import ingest

    rng, words = random.Random(6), ["the", "of", "Ähre", "x1", "and,", "Zoo.", "in", "ouverture", "B"]
    for n in [0, 1, 3, 20, 60, 200, 600] * 8:
        x = " ".join(rng.choice(words) for _ in range(n))
        y = " ".join(w if rng.random() < 0.8 else rng.choice(words) for w in x.split(" "))
        ratio = SequenceMatcher(None, x, y).ratio()
        for least in (0.2, 0.6, ratio, 0.95, 1.5):
            got = ingest.matching(x, y, least, ingest.places_of(y))
            assert got == ratio or ratio <= got < least


def test_state_of_a_key_is_touched_as_little_as_it_changes():
    """Calls of a stateful stream's handle are round trips: timers aren't listed, and stay where a key's first event stays."""
    import pandas as pd

    from corpusflow.streaming import events

    class Handle:
        def __init__(self):
            self.calls, self.value = [], None

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def get(self):
            return self.value

        def exists(self):
            self.calls.append("exists")
            return self.value is not None

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def listTimers(self):  # noqa: N802
            self.calls.append("list")
            return iter(())

        def deleteTimer(self, at):  # noqa: N802
            self.calls.append(("delete", at))

        def registerTimer(self, at):  # noqa: N802
            self.calls.append(("register", at))

    handle, day = Handle(), events.LIFETIME
    replayer = events.Replayer()
    replayer.init(handle)
    feed = lambda *rows: pd.concat(replayer.handleInputRows(("u",), iter([pd.DataFrame(rows, columns=["event_id", "at"])]), None))["answered_by"].tolist()
    assert feed((7, 5.0), (3, 1.0), (4, 1.0)) == [3, 3, 3] and handle.calls == ["update", ("register", (day + 1) * 1000)]
    handle.calls.clear()
    assert feed((9, 6.0)) == [3] and handle.calls == []
    assert feed((10, day + 1.0)) == [10] and handle.calls == ["update", ("delete", (day + 1) * 1000), ("register", (2 * day + 1) * 1000)]
