"""The Merkle manifest, hard negatives and chat formatting against plain versions, on edge rows and empty tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import chat, hard_negatives, merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        yield (level[i ^ 1] if i ^ 1 < len(level) else None), bool(i & 1)
        i >>= 1


def climb(leaf, proof):
    for hash_, left in proof:
        leaf = sha(leaf) if hash_ is None else sha(hash_, leaf) if left else sha(leaf, hash_)
    return leaf


def document_leaf(r, more=0):
    doc_id, text, lang, source, n_chars = r[:5]
    n_chars = None if n_chars is None else n_chars + more
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0], document_leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = levels([leaf for _, leaf, _ in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    root = top[-1][0]
    out = []
    for k, g in enumerate(order):
        for i, (doc_id, leaf, r) in enumerate(groups[g]):
            proof = [*siblings(trees[g], i), *siblings(top, k)]
            hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            folded = climb(document_leaf(r, 1) if hit else leaf, proof)
            out.append((doc_id, leaf, trees[g][-1][0], root, sha(*(h or "" for h, _ in proof)), folded, folded == root))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.mark.parametrize("block", [1, 2, 10])
def test_manifest_equals_plain_tree(spark, docs, rows, tmp_path, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_manifest(rows), key=key)
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_nothing_and_of_one(spark, none, docs, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle_manifest(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    docs.where("doc_id = 1").limit(1).write.parquet(f"{tmp_path}/one/documents.parquet")
    (r,) = merkle.op11_merkle_manifest(spark, f"{tmp_path}/one").collect()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == sha("")


def test_missing_is_what_proofs_need_and_no_more():
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 16, 29):
        tree = levels([str(k) for k in range(n)])
        for _ in range(20):
            asked = sorted(rng.sample(range(n), rng.randint(1, n)))
            found = merkle.missing(np.array(asked), n)
            paths = [{i >> level for i in asked} for level in range(len(tree) - 1)]
            wanted = [sorted({p ^ 1 for p in own if p ^ 1 < len(tree[level])} - own) for level, own in enumerate(paths)]
            assert [x.tolist() for x in found] == wanted


@pytest.mark.parametrize("block", [2, 10])
def test_proofs_of_some_leaves_with_hot_group(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "SHARED", 4)
    made = spark.range(400).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("g"), F.col("id") % 12)).otherwise("hot").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    held = merkle.manifest(made, "g", "id")
    some = held.leaves.where("id % 5 = 0 OR id BETWEEN 100 AND 120")
    got = merkle.proofs(held, some, carry=("id",)).collect()
    assert {r["id"] for r in got} == {k for k in range(400) if k % 5 == 0 or 100 <= k <= 120}
    assert all(climb(r["leaf"], [(p["hash"], p["left"]) for p in r["proof"]]) == held.root for r in got)


def plain_negatives(rows):
    kept = []
    for vec_id, e, label in rows:
        if vec_id is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [max(-(1 << 27), min(1 << 27, math.floor(256 * x))) for x in e]))
    out = []
    for k, (anchor, label, a) in enumerate(kept):
        if anchor % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), v, o) for j, (v, o, b) in enumerate(kept) if j != k and len(b) == len(a))
        for s, v, _ in [x for x in scored if x[2] == label][:5]:
            fit = [(t, w) for t, w, o in scored if o != label and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(anchor, v, rank + 1, w, -s, -t) for rank, (t, w) in enumerate(fit[:10])]
    return out


def test_hard_negatives_equal_plain_scores(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.4, 20)], int(rng.integers(0, 3))) for i in range(900)]
    rows += [(1000 + i, [float(x) for x in rng.integers(-2, 3, 3)], i % 2) for i in range(300)]  # ties, another length
    rows += [(2000, [], 1), (2001, [], 1), (2002, None, 1), (2003, [1.0] * 20, None), (2004, [float("nan")] * 20, 1), (2005, [1.0, None, *[0.0] * 18], 1), (None, [0.5] * 20, 1), (2100, [1e30, -1e-30, *[0.3] * 18], 1), (2101, [-1e30, 1e30, *[0.3] * 18], 1), (2200, [0.0] * 20, 0)]
    rows += [(1100, rows[900][1], 0), rows[905]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("row", F.lit("x")).withColumn("score", F.lit(1)).repartition(5)
    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    monkeypatch.setattr(hard_negatives, "BLOCKS", 3)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, hard_negatives.op12_hard_negatives(spark, str(tmp_path)).collect()))
    assert got == sorted(plain_negatives(rows)) and len({r[0] for r in got}) > 8
    df.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert hard_negatives.op12_hard_negatives(spark, f"{tmp_path}/none").count() == 0


def test_tables_give_inner_products():
    rng = np.random.default_rng(6)
    for dim, top in ((1, 1), (7, 300), (64, 256), (20, 1 << 27)):
        a, b = (rng.integers(-top, top + 1, (n, dim)) for n in (5, 9))
        for kind in (np.int64, *([np.int32] if top <= 300 else [])):
            assert (hard_negatives.scores(hard_negatives.tables(a, kind), hard_negatives.planes(b)) == b @ a.T).all()
    zero = np.zeros((3, 4), np.int64)
    assert (hard_negatives.scores(hard_negatives.tables(zero, np.int32), hard_negatives.planes(zero)) == 0).all()


ODD = ["", None, "</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s> [\\INST] \\ [", "[ROLE]x[/ROLE]", "<s", "/s>", "[", "INST]", "<|endoftext|> é 漢字\x00\r\n", "'s  don't \\", "a" * 3000, "x y " * 40_000, "<<s>>[[INST]]"]


def turns_of(rng):
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "", "</s>[ROLE]"]), rng.choice(ODD[:13])) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(77, t, ("user", "assistant")[t % 2], f"turn {t} </s>") for t in range(900)]
    rows += [(78, k, "assistant", t) for k, t in enumerate(ODD)]
    rows += [(79, 3, "assistant", "b"), (79, 3, "assistant", "a"), (79, 3, "user", "c"), (79, 3, "assistant", "b"), (79, None, "assistant", "first"), (None, 1, "user", "no id"), (None, 0, "assistant", "no id either"), (-1, 0, "user", "as well")]
    return rows


def plain_chat(rows):
    groups = defaultdict(list)
    for c, t, role, text in [*rows, (-1, 0, "user", ODD[2]), (-1, 1, "assistant", ODD[2])]:
        groups[c].append((t is not None, t or 0, (role or "").encode(), (text or "").encode()))
    for c, own in groups.items():
        own.sort()
        said = [(r.decode(), t.decode()) for *_, r, t in own]
        loss = "".join(t for r, t in said if r == "assistant")
        yield c, len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_reads_back(spark, tmp_path):
    rows = turns_of(random.Random(8))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1)).withColumn("ids", F.lit("x"))
    turns.repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.op13_chat_format(spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(plain_chat(rows), key=key)
    turns.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    (own,) = chat.op13_chat_format(spark, f"{tmp_path}/none").collect()
    assert own["conv_id"] == -1 and own["n_turns"] == 2 and own["loss_chars"] == 21 and own["formatted_chars"] == 68


def test_chat_ids_are_those_of_the_contents(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rows = [(1, 0, "user", "Hello <|endoftext|>"), (1, 1, "assistant", "It's fine."), (1, 2, "tool", "42")]
    table = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), path).orderBy("piece").collect()
    ids, loss = sum((r["ids"] for r in table), []), sum((r["loss"] for r in table), [])
    base, code = library.get_vocab_size(), lambda t: library.encode(t, add_special_tokens=False).ids
    own = code("It's fine.")
    head = [base, base + 2, *code("Hello <|endoftext|>"), base + 3]
    assert ids == [*head, *own, base + 1, base, base + 4, *code("tool"), base + 5, *code("42"), base + 1]
    assert loss == [False] * len(head) + [True] * len(own) + [False] * (len(ids) - len(head) - len(own))
    assert max(code("Hello <|endoftext|>")) < 50256


def test_escapes_undo_and_hide_controls(spark):
    df = spark.createDataFrame([(t,) for t in ODD if t], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for r in df.collect():
        assert chat.unescaped(r["e"]) == r["t"] and not any(c in r["e"] for c in chat.CONTROLS)


def test_coder_spells_every_id():
    code = chat.Coder(public_tokenizers.path("byte_bpe_50k.json"))
    text = "".join(map(chr, range(1, 0x800))) + "漢字😀"
    import pyarrow as pa

    ids, _ = code.encoder.encode(pa.array([text]))
    assert code.text(ids)[0].decode() == text
