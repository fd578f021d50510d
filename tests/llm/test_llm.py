"""Text operators: invariants, brute force on small inputs, edge cases."""

from __future__ import annotations

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, tokens, truncated

has_tokenizer = os.path.exists(tokens.RANKS)


@pytest.mark.skipif(not has_tokenizer, reason="no vocabulary file")
def test_sizes(spark):
    long = "word und Wörter 12,5 mm. " * 30
    assert list("".join(tokens.parts(long, 50))) == list(long)
    enc = tokens.encoder(tokens.RANKS, tokens.PATTERN)
    for size in (7, 50, 333):
        assert sum(len(enc.encode_ordinary(p)) for p in tokens.parts(long, size)) == len(enc.encode_ordinary(long))
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, long, "b"), (3, long, "b"), (None, "x y", None)], "n_tokens long, text string, source string")
    got = sorted(((r["doc"], r["n_tokens"]) for r in tokens.with_sizes(df.withColumnRenamed("n_tokens", "doc"), "doc", "text", "source").collect()), key=str)
    n = len(enc.encode_ordinary(long))
    assert got == sorted([(1, 0), (2, 0), (3, n), (3, n), (None, 2)], key=str)
    assert tokens.with_sizes(df.limit(0), "n_tokens", "text").count() == 0


def test_best_two_fit():
    # greedy takes 6 and 3; the 3 is replaced by 2 + 2 for a full bin
    sizes = np.array([6, 3, 2, 2])
    assert [sorted(sizes[b].tolist()) for b in packing.best_two_fit(sizes, 10)] == [[2, 2, 6], [3]]
    rng = np.random.default_rng(0)
    for cap in (16, 100, 512):
        sizes = rng.integers(0, cap + 1, 500)
        bins = packing.best_two_fit(sizes, cap)
        assert sorted(i for b in bins for i in b) == list(range(500))
        used = [sizes[b].sum() for b in bins]
        assert max(used) <= cap
        assert len(bins) <= 1.1 * np.ceil(sizes.sum() / cap) + 1
    assert packing.best_two_fit(np.array([], np.int64), 5) == []


def test_two_is_the_tightest_pair():
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes = rng.integers(1, 30, rng.integers(1, 12))
        room, least = int(rng.integers(1, 60)), int(rng.integers(0, 30))
        stock = packing._Stock(sizes)
        pairs = [int(a + b) for i, a in enumerate(sizes) for b in sizes[i + 1 :] if least < a + b <= room]
        got = stock.two(room, least)
        assert (sum(got) if got else None) == (max(pairs) if pairs else None)


def test_pack(spark):
    rng = np.random.default_rng(2)
    data = [(int(i), int(s)) for i, s in enumerate(rng.lognormal(3, 1, 400))] + [(7, None), (None, 12), (500, 1000), (501, 0), (502, 200)]
    items = spark.createDataFrame(data, "capacity long, size long")
    kinds = spark.createDataFrame([("s", 50), ("l", 200), ("none", None), ("zero", 0)], "container string, capacity long")
    out = packing.pack(items.withColumnRenamed("capacity", "bin_of"), "bin_of", "size", kinds, shard_items=100).toPandas()
    assert set(out.container) == {"s", "l"}
    for kind, cap in (("s", 50), ("l", 200)):
        o = out[out.container == kind]
        assert o.groupby("bin")["size"].sum().max() <= cap
        assert o["size"].sum() == sum(s or 0 for _, s in data)
        assert (o.piece == 0).sum() == len(data)
        for doc, g in o[o.bin_of.notna()].groupby("bin_of"):
            assert sorted(g.piece) == sorted(p for n in g[g.piece == 0].n_pieces for p in range(n))
            if g["size"].sum() <= cap and doc != 7:
                assert len(g) == 1
    rep = {r.container: r for r in packing.packing_report(spark.createDataFrame(out.astype({"bin_of": "float"}))).collect()}
    assert rep["l"].fill > 0.8 and rep["s"].fullest <= 50
    assert packing.pack(items.limit(0), "capacity", "size", kinds).count() == 0
    assert packing.pack(items, "capacity", "size", kinds.limit(0)).count() == 0


def test_mix(spark):
    rng = np.random.default_rng(3)
    src = ["a"] * 600 + ["b"] * 200 + ["c"] * 30
    data = [(i, s, int(n)) for i, (s, n) in enumerate(zip(src, rng.integers(1, 100, len(src)), strict=True))]
    data += [(900, None, 5), (901, "other", 5), (None, "a", 5), (902, "a", None)]
    items = spark.createDataFrame(data, "id long, source string, size long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("gone", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    rows, info, budget = mixing.mix(items, targets)
    got = rows.toPandas()
    share = got.groupby("source")["size"].sum() / budget
    want = {x["source"]: x["share"] for x in info}
    for s in "abc":
        assert share[s] <= want[s] + 1e-9 and share[s] > want[s] - 100 / budget
    assert (got.groupby(["source", "id"]).size() <= got.source.map({"a": 1, "b": 2, "c": 3}).groupby([got.source, got.id]).max()).all()
    assert not got.duplicated(["id", "copy"]).any() and got.finish.is_monotonic_increasing and got.finish.max() <= budget
    few = mixing.BUCKET_ROWS
    try:
        mixing.BUCKET_ROWS = 20  # the same rows when the running totals are made in buckets
        again = mixing.mix(items, targets)[0].toPandas()
    finally:
        mixing.BUCKET_ROWS = few
    assert sorted(zip(again["id"], again["copy"], again["finish"].round(6), strict=True)) == sorted(zip(got["id"], got["copy"], got["finish"].round(6), strict=True))
    rep = {r.source: r for r in mixing.mixing_report(rows, info, budget).collect()}
    assert rep["gone"].tokens == 0 and sum(r.actual_share for r in rep.values()) == pytest.approx(1)
    assert mixing.mix(items.limit(0), targets)[0].count() == 0
    assert mixing.mix(items, targets.limit(0))[0].count() == 0
    small = mixing.mix(items, targets, budget=1000.0)[0].toPandas()
    assert 700 < small["size"].sum() <= 1000 and (small["copy"] == 1).all()


def _texts():
    random.seed(4)
    parts, verbs, ends = ["valve plate", "return spring", "heat sink", "light guide"], ["bears on", "cools down", "moves along"], ["the main axis", "the outer housing", "the sealing ring"]
    sentence = lambda: f"The {random.choice(parts)} ({random.randint(10, 30)}) {random.choice(verbs)} {random.choice(ends)} after {random.randint(2, 9)} cycles."
    docs = {}
    for i in range(400):
        docs[i] = "\n".join(sentence() for _ in range(random.randint(4, 9)))
    cases = {
        1000: docs[0] + "\nThe valve plate (12) bears on the main", 1001: docs[1] + "\nThe return spr", 1002: docs[2] + "\nThe heat sink (14) cools down the outer hous…",
        1003: docs[3] + "\nThe light guide (15) moves along the sealing\n- 3 -", 1004: docs[4] + "\nThe valve plate (12) bears on the main", 1005: docs[5] + "\nThe heat sink (14) cools down the [...]",
    }
    whole = {2000: docs[6][:-1], 2001: docs[7] + "\n- 12 -", 2002: docs[8][:-1] + "...", 2003: docs[9] + "  \n\n", 2004: "", 2005: None, 2006: "One", 2007: docs[10] + "\n* * * * *"}
    # what is added behind texts is learned from texts that share it
    added = ["\n- {} -", " [...]", "\n* * * * *"]
    whole |= {3000 + 10 * k + i: docs[20 + 10 * k + i] + a.format(i) for k, a in enumerate(added) for i in range(6)}
    return docs, cases, whole


def test_cut_texts_behind_many_trailers_and_in_long_words(spark):
    """However many lines follow a cut, and however long the word is that it is in."""
    docs, cases, whole = _texts()
    name = "poly" + "methylethyl" * 11
    docs = {**docs, **{5000 + i: f"The layer is made of {name} after {i} cycles.\nThe main axis cools." for i in range(20)}}
    cut_word = "\nThe layer is made of " + name[:90]
    cases = {
        6000: docs[0] + "\nThe valve plate (12) bears on the main" + "".join(f"\n- {i} -" for i in range(200)), 6001: docs[1] + cut_word,
        6002: docs[2] + "\nThe heat sink (14) cools down the outer hous" + "\n* * * * *" * 20_000, 6003: docs[3] + cut_word + " [...]" * 40 + "\n- 2 -",
    }
    df = spark.createDataFrame([(k, v) for k, v in {**docs, **cases, **whole}.items()], "id long, text string")
    j = truncated.cut_texts(df, "id", "text")
    assert sorted(r.id for r in j.where("cut").collect()) == sorted(cases)


def test_learned_trailers(spark):
    docs, cases, whole = _texts()
    df = spark.createDataFrame([(v,) for v in [*docs.values(), *cases.values(), *whole.values()]], "text string")
    counted = truncated.sentence_counts(df, "text")
    lines, marks = truncated.learn_trailers(df, "text", counted, truncated.trigram_counts(counted))
    assert sorted(lines) == ["* * * * *", "- # -"] and marks == ["[...]"]
    # a cut that many texts share goes on in others: it is no trailer
    same = df.unionByName(spark.createDataFrame([(docs[i] + "\nThe",) for i in range(9)] + [(docs[i] + "\nThe valve pl",) for i in range(9)], "text string"))
    counted = truncated.sentence_counts(same, "text")
    assert truncated.learn_trailers(same, "text", counted, truncated.trigram_counts(counted)) == (lines, marks)
    known = truncated.cut_texts(df, "text", "text", trailers=(lines, marks)).where("cut").count()
    assert known == len(cases)


def test_cut_texts(spark):
    docs, cases, whole = _texts()
    rows = [(k, v, f"s{k % 2}", True) for k, v in {**docs, **cases, **whole}.items()] + [(1000, cases[1000], "s0", True), (None, docs[0], None, None)]
    df = spark.createDataFrame(rows, "id long, text string, source string, final boolean").drop("final")
    j = truncated.cut_texts(df, "id", "text", "source")
    assert j.count() == len(rows)
    assert sorted(r.id for r in j.where("cut").collect()) == sorted([*cases, 1000])
    rep = {r.source: r for r in truncated.cut_report(j, "source").collect()}
    assert rep["s0"].n_cut == 4 and rep["s1"].n_cut == 3 and rep[None].n_cut == 0
    assert truncated.cut_texts(df.limit(0), "id", "text").count() == 0


def test_trigram_counts_match_brute_force(spark):
    docs, _, _ = _texts()
    texts = list(docs.values())[:60]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {(r.w1, r.w2, r.w3): (r.inside, r.ends) for r in truncated.trigram_counts(truncated.sentence_counts(df, "text")).collect()}
    want: dict = {}
    for t in texts:
        for s in t.split("\n"):
            w = ["¶", "¶", *re.sub(r"[.]$", "", re.sub(r"\d+", "#", s.lower())).split()]
            for i in range(2, len(w)):
                a, b = want.get(tuple(w[i - 2 : i + 1]), (0, 0))
                want[tuple(w[i - 2 : i + 1])] = (a, b + 1) if i == len(w) - 1 else (a + 1, b)
    assert got == want


def test_final_trigram_of_odd_texts(spark):
    far = "lead " * 300 + "alpha beta " + "x" * 5000
    df = spark.createDataFrame([("a b c",), ("word",), ("",), (None,), (far,), ("Ends well. Then cut of\n- 4 -\n",)], "text string")
    j = truncated.cut_texts(df.withColumn("line", F.lit(1)), "text", "text", "line", trailers=(["- # -"], []))
    got = {r.text: r.final for r in j.collect()}
    assert got == {"a b c": "a b c", "word": "¶ ¶ word", "": "¶ ¶ ", None: "¶ ¶ ", far: "alpha beta " + "x" * 5000, "Ends well. Then cut of\n- 4 -\n": "then cut of"}


def test_pack_many_kinds(spark):
    kinds = spark.range(1_050).selectExpr("cast(id as string) as container", "id + 10 as capacity")
    items = spark.createDataFrame([(1, 5), (2, 7)], "doc long, size long")
    out = packing.pack(items, "doc", "size", kinds)
    assert out.select("container").distinct().count() == 1_050 and out.count() == 2 * 1_050


def test_pack_in_shards_holds_few_rows_and_fills_well(spark, monkeypatch):
    """A task hands on some shards at a time, however many are in its partition."""
    sizes = np.random.default_rng(1).lognormal(4, 1, 6_000).astype(int) + 1
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "doc long, size long")
    kinds = spark.createDataFrame([("a", 500), ("a", 2000)], "container string, capacity long")
    one = {(r.container, r.capacity): r for r in packing.packing_report(packing.pack(items, "doc", "size", kinds)).collect()}
    out = packing.pack(items, "doc", "size", kinds, shard_items=1_000)
    many = {(r.container, r.capacity): r for r in packing.packing_report(out).collect()}
    assert out.selectExpr("bin >> 32 as shard").distinct().count() == 6 and one.keys() == many.keys() == {("a", 500), ("a", 2000)}
    for k in one:
        assert many[k].tokens == one[k].tokens == sizes.sum() and many[k].n_items == 6_000
        assert one[k].fill > 0.99 and many[k].n_bins <= one[k].n_bins + 6 + 0.01 * one[k].n_bins


def test_tokenizer_is_handed_to_executors(spark, tmp_path):
    if not os.path.exists(tokens.RANKS):
        pytest.skip("no vocabulary")
    other = tmp_path / "other.tiktoken"
    other.write_bytes(b"".join(open(tokens.RANKS, "rb").readlines()[:256]))
    df = spark.createDataFrame([(1, "abc abc")], "id long, text string")
    assert tokens.with_sizes(df, "id", "text", ranks=str(other)).first().n_tokens == 7
    spark.conf.set("spark.tidemark.ranks", str(other))
    try:
        assert tokens.with_sizes(df, "id", "text").first().n_tokens == 7
    finally:
        spark.conf.unset("spark.tidemark.ranks")
    assert tokens.with_sizes(df, "id", "text").first().n_tokens < 7
