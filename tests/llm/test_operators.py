import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracegauge.llm import bpe, exact_dedup, near_dedup, packing, quality_classifier, quality_rules, sharding, token_counts, toxicity, warc
from tracegauge.llm.components import components

from . import cases

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


def labels(spark, docs):
    """Long plain texts are good; texts with zz are toxic."""
    return docs.where("doc_id is not null").select(
        "doc_id", (F.length("text") > 100).cast("int").alias("quality"), F.coalesce(F.col("text").contains("zz"), F.lit(False)).cast("int").alias("toxic")
    ).union(spark.createDataFrame([(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int"))


def test_base_counts(spark, docs):
    got = quality_rules.quality_rules(docs, labels(spark, docs))
    rows = cases.plain(got.select("doc_id", *[c.name for c in quality_rules.COUNTS], "base_failed"))
    want = []
    for doc_id, text, *_ in cases.rows():
        c = cases.base_counts(text)
        want.append((doc_id, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert rows == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert got.where("kept and base_failed").count() == 0


def test_quality_without_labels_keeps_base(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_rules(docs, none)
    assert got.where("kept = base_failed").count() == 0


def test_toxicity_learns_and_scores(spark, docs):
    got = toxicity.toxicity(docs, labels(spark, docs)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {(r["doc_id"]): r for r in got}
    assert by[0]["held_out"] == (zlib.crc32(b"0") % 4 == 2)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["score"] == 0 or r["score"] < 1e-6 for r in toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect())


def test_factorization_machine_learns_a_pair():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(600):
        a, b = rng.random(2) < 0.5
        rows.append((np.array([0] * int(a) + [1] * int(b) + [2 + int(rng.integers(5))], int), None))
        y.append(float(a and b))
    x = toxicity.Sparse([(i, np.ones(len(i))) for i, _ in rows], 7)
    model = toxicity.fit(x, np.array(y), steps=600)
    p = toxicity.sigmoid(toxicity.logits(x, model))
    assert ((p > 0.5) == (np.array(y) == 1)).mean() > 0.97


def test_classifier(spark, docs):
    got = quality_classifier.quality_classifier(docs, labels(spark, docs)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    text = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    known = [r for r in got if r["doc_id"] is not None]
    right = sum(r["predicted"] == int(len(text[r["doc_id"]] or "") > 100) for r in known)
    assert right / len(known) > 0.8


def test_rules_compile_to_what_they_mean(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, len(quality_classifier.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.6)).astype(float)
    model = quality_classifier.fit(x, y)
    z = model["shift"] + sum(w * quality_classifier.holds(x, r) for r, w in zip(model["rules"], model["weights"], strict=True))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], quality_classifier.STATISTICS)
    got = np.array([r[0] for r in df.select(quality_classifier.compiled(model)).collect()])
    assert np.allclose(np.sort(got), np.sort(1 / (1 + np.exp(-z))))
    assert ((1 / (1 + np.exp(-z)) > 0.5) == y).mean() > 0.95


def test_byte_bpe(docs):
    ranks = token_counts.read_ranks(RANKS)
    codec = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = cases.plain(bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN))
    want = []
    for doc_id, text, *_ in cases.rows():
        ids = codec.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_long_pieces_merge_as_the_library_does():
    ranks = token_counts.read_ranks(RANKS)
    codec = bpe.Codec(ranks, bpe.merge_table(ranks), public_tokenizers.PATTERN)
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(5)
    texts = ["a" * 997, "the" * 400, "=" * 501, "".join(rng.choice(list("etaoin"), 1500)), "é" * 333, "ab" * 700]
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode_ordinary(t)
    codec.close()


def test_packing(docs):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for limits in ({}, {"tokens": 64, "segments": 5, "loss": 50, "mask": None}):
        got = packing.pack_documents(docs, TOKENIZER, **limits).collect()
        texts = {}
        for doc_id, text, *_ in cases.rows():
            ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
            texts.setdefault(doc_id, []).append(ids)
        total = sum(len(x) for ids in texts.values() for x in ids)
        assert sum(r["length"] for r in got) == total
        for r in got:
            assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in texts[r["doc_id"]])
        sequences = {}
        for r in got:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= limits.get("tokens", 2048) and len(pieces) <= limits.get("segments", 256) and at <= limits.get("loss", 2048)


def test_packer_counts_loss_tokens_by_mask():
    p = packing.Packer(tokens=10, segments=3, loss=4)
    rng = np.random.default_rng(2)
    masks = {}
    for k in range(40):
        n = int(rng.integers(1, 25))
        masks[k] = rng.random(n) < 0.4
        p.add(k, np.arange(n, dtype="<u2"), masks[k])
    p.pack()
    used, seen = {}, {k: np.zeros(len(m), int) for k, m in masks.items()}
    for key, start, length, _, _, loss, sequence, _ in p.out:
        u = used.setdefault(sequence, [0, 0, 0])
        u[0] += length
        u[1] += 1
        u[2] += masks[key][start : start + length].sum()
        assert loss == masks[key][start : start + length].sum()
        seen[key][start : start + length] += 1
    assert all((s == 1).all() for s in seen.values())
    assert all(a <= 10 and b <= 3 and c <= 4 for a, b, c in used.values())


def test_packing_keeps_the_limits_of_its_mask(spark):
    """The query's own limits and mask, on enough documents that the loss limit is what closes some sequences."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack_documents(docs, TOKENIZER).toPandas()
    quarter = got["doc_tokens"] // 4
    lead = (quarter - got["start"]).clip(0, got["length"])
    assert (got["loss_tokens"] == got["length"] - lead).all()
    per = got.groupby("sequence_id").agg(tokens=("length", "sum"), loss=("loss_tokens", "sum"), pieces=("length", "size"))
    assert (per["tokens"] <= packing.MAX_TOKENS).all() and (per["loss"] <= packing.MAX_LOSS).all() and (per["pieces"] <= packing.MAX_SEGMENTS).all()
    assert (per["loss"] == packing.MAX_LOSS).sum() > 0.02 * len(per)
    padded = per[(per["tokens"] & (per["tokens"] - 1)) != 0]
    assert (packing.MAX_TOKENS - padded["tokens"]).sum() <= 0.01 * per["tokens"].sum()
    assert per.loc[per["tokens"] == packing.MAX_TOKENS, "tokens"].sum() > 0.95 * per["tokens"].sum()
    for start, total in zip(got["start"], got["doc_tokens"], strict=True):
        assert 0 <= start < total
    assert got.groupby("doc_id")["length"].sum().eq(got.groupby("doc_id")["doc_tokens"].max()).all()


def test_tokenizer_that_looks_across_words_is_used_whole():
    """A definition without lower-casing isn't read word by word."""
    import json

    with open(TOKENIZER, encoding="utf-8") as f:
        d = json.load(f)
    d["normalizer"] = None
    encoder = packing.WordEncoder(json.dumps(d))
    whole = Tokenizer.from_str(json.dumps(d))
    text = "Some Words THAT keep their Case"
    assert not encoder.by_word
    assert encoder.encode([text.encode()])[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_near_dedup(spark, docs):
    data = [tuple(r) for r in docs.collect()]
    want = sorted(cases.near_components(data).values(), key=lambda r: tuple((x is None, str(x)) for x in r))
    # rows without words: a class of their own, named by their doc_id
    want = [(d, n, d if n == 0 else c) for d, n, c in want]
    got = cases.plain(near_dedup.near_dedup(docs).select("doc_id", "n_shingles", "component_id"))
    assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_near_dedup_families(spark):
    """Chains and near misses around one text: links that the pivot doesn't show must come from the blocks."""
    import random

    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    data = []
    for k in range(150):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = f"v{rng.randrange(40)}"
        data.append((k, " ".join(t), "en", "s", 1))
    want = sorted(cases.near_components(data).values())
    got = cases.plain(near_dedup.near_dedup(cases.documents(spark, data=data)).select("doc_id", "n_shingles", "component_id"))
    assert sorted(got) == want
    small = near_dedup.BLOCK
    near_dedup.BLOCK = 16
    try:
        again = cases.plain(near_dedup.near_dedup(cases.documents(spark, data=data)).select("doc_id", "n_shingles", "component_id"))
    finally:
        near_dedup.BLOCK = small
    assert sorted(again) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 150), (150, 180)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[200] == got[180] == 150


def test_sharding(docs):
    got = sharding.shard_documents(docs, 5).collect()
    assert len(got) == len(cases.rows())
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in cases.rows())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert {r["shard"] for r in got} <= set(range(5)) and {r["grown_shard"] for r in got} == {None}


def test_sharding_balances_ties(spark):
    data = [(1, "same text", "en", "s", 1)] * 4000
    got = sharding.shard_documents(cases.documents(spark, data=data), 24).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r["b"] for r in got]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 3 * 17


def test_warc(spark):
    magic = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 40\r\n\r\n"
    rows = [(i, f"http://x/{i}", ("a" * (i * 37 % 2500) + magic + "ü" * i) if i % 3 else None) for i in range(120)]
    rows += [(1000 + i, None, "x" * 1200) for i in range(30)] + [(2000 + i, "a b\r\nc", "y" * 900) for i in range(5)] + [(5, "u", ""), (5, "u", "")] + [(None, None, "z" * 1500)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit(1)).repartition(3)
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", -1), i)
    want = []
    for i, _, h in rows:
        h = h or ""
        revisit = len(h.encode()) >= 1000 and last.get(h) is not None and i != last[h]
        want.append((i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    for packed in (False, True):
        files = warc.write_archives(pages, packed)
        for block in (512, 4096, 1 << 20):
            assert cases.plain(warc.read_archives(files, packed, block)) == sorted(want, key=key)


def test_token_counts(spark, docs):
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_counts.read_ranks(RANKS), special_tokens={})
    got = cases.plain(token_counts.token_counts(docs, RANKS, public_tokenizers.PATTERN).select("doc_id", "n_tokens"))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert got == sorted(((i, len(whole.encode_ordinary(t or ""))) for i, t, *_ in cases.rows()), key=key)


def test_separator_scan_across_blocks(spark, tmp_path):
    files, want = [], []
    for k, ids in enumerate(([5, 9, 7, 9, 9, 1, 2], [9], [], [1] * 50 + [9], [3, 4])):
        path = tmp_path / f"{k}.u16"
        path.write_bytes(np.array(ids, "<u2").tobytes())
        files.append((k, f"file://{path}", 2 * len(ids)))
        at = 0
        for i, e in enumerate([*np.flatnonzero(np.array(ids) == 9), *([len(ids)] if ids and ids[-1] != 9 else [])]):
            want.append((k, i, at, int(e) - at, bool(e < len(ids))))
            at = int(e) + 1
    df = spark.createDataFrame(files, "file long, uri string, length long")
    for block in (2, 6, 1000):
        assert sorted(tuple(r) for r in token_counts.scan(df, 9, block).collect()) == want


def test_exact_dedup(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, *_ in cases.rows():
        groups.setdefault(norm(t), []).append(i)
    for block in (16, 16384):
        got = exact_dedup.exact_dedup(docs, block).collect()
        assert len(got) == len(cases.rows())
        by_sha = {hashlib.sha256(t.encode()).hexdigest(): (ids, t) for t, ids in groups.items()}
        kept = {}
        for r in got:
            ids, _ = by_sha[r["text_sha256"]]
            assert r["group_size"] == len(ids) and r["keep_id"] == min((i for i in ids if i is not None), default=None)
            if r["kept"]:
                kept.setdefault(r["text_sha256"], []).append(r["doc_id"])
        assert {k: len(v) for k, v in kept.items()} == dict.fromkeys(by_sha, 1)


def test_hot_keys_take_the_other_way(spark):
    data = [(i, "one text for all " * 5, "en", "s", 1) for i in range(700)] + [(1000 + i, f"own {i}", "en", "s", 1) for i in range(50)]
    got = exact_dedup.exact_dedup(cases.documents(spark, data=data)).collect()
    assert sum(r["kept"] for r in got) == 51 and {r["group_size"] for r in got if r["doc_id"] < 1000} == {700}


OPERATORS = {
    "quality_rules": lambda d, l: quality_rules.quality_rules(d, l),
    "toxicity": lambda d, l: toxicity.toxicity(d, l),
    "quality_classifier": lambda d, l: quality_classifier.quality_classifier(d, l),
    "bpe": lambda d, l: bpe.round_trip(d, RANKS, public_tokenizers.PATTERN),
    "packing": lambda d, l: packing.pack_documents(d, TOKENIZER),
    "near_dedup": lambda d, l: near_dedup.near_dedup(d),
    "sharding": lambda d, l: sharding.shard_documents(d),
    "token_counts": lambda d, l: token_counts.token_counts(d, RANKS, public_tokenizers.PATTERN),
    "exact_dedup": lambda d, l: exact_dedup.exact_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    empty = spark.createDataFrame([], cases.SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert OPERATORS[name](empty, none).collect() == []


def test_empty_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, docs, name):
    wide = cases.documents(spark, extra=True)
    l = labels(spark, docs)
    # how many pieces packing cuts depends on the partitions; the tokens in them don't
    total = (lambda d: d.agg(F.sum("length")).first()[0]) if name == "packing" else (lambda d: d.count())
    assert total(OPERATORS[name](wide, l)) == total(OPERATORS[name](docs, l))


def test_vocabulary_reads():
    ranks = token_counts.read_ranks(RANKS)
    with open(RANKS, "rb") as f:
        first = f.readline().split()
    assert ranks[base64.b64decode(first[0])] == int(first[1])


def auc(rows, y):
    """The share of (1, 0) pairs that scores put in order; ties count half."""
    one, zero = ([r["score"] for r in rows if y[r["doc_id"]] == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in one for b in zero) / (len(one) * len(zero))


@pytest.mark.parametrize(("name", "f"), [("toxic", toxicity.toxicity), ("quality", quality_classifier.quality_classifier)])
def test_held_out_labels_are_ranked(spark, name, f):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    y = {r["doc_id"]: r[name] for r in marks.where(f"{name} is not null").collect()}
    rows = [r for r in f(docs, marks).where("held_out").collect() if r["doc_id"] in y]
    assert auc(rows, y) > 0.8


def test_toxicity_of_one_class(spark, docs):
    ones = docs.where("doc_id is not null").select("doc_id", F.lit(1).alias("toxic"))
    assert all(r["score"] > 0.9 and r["predicted"] == 1 for r in toxicity.toxicity(docs, ones).collect())


def test_near_dedup_finds_all_links_of_a_table(spark):
    """Whole documents of sf0.01 against a comparison of all pairs."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    data = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    want = sorted((d, n, d if n == 0 else c) for d, n, c in cases.near_components(data).values())
    got = sorted(tuple(r) for r in near_dedup.near_dedup(table).select("doc_id", "n_shingles", "component_id").collect())
    assert got == want


def test_exact_stage_returns_clashing_columns_as_they_are(spark):
    data = [(i, f"text {i % 7}", "en", "s", 1) for i in range(20)]
    docs = cases.documents(spark, data=data)
    for c in ("_sha", "_id", "__c0", "uid", "first"):
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id")))
    rows = exact_dedup.keep_first(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(7))
    assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in ("_sha", "_id", "__c0", "uid", "first"))
