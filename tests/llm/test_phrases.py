"""Phrases against a plain count of all of them, skewed and odd tables included."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemill.llm import phrases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, max_n=3, least=10, top=2000, inside=50):
    f: dict = {}
    for text, lang in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, max_n + 1):
                own.update(tuple(words[k : k + m]) for k in range(len(words) - m + 1))
    out = []
    for lang, own in f.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        found = {p: c for p, c in own.items() if len(p) > 1 and c >= least}
        dropped = {q for p, c in found.items() for m in range(2, len(p)) for k in range(len(p) - m + 1) for q in [p[k : k + m]] if 100 * c >= inside * own[q]}
        rows = []
        for p, a in found.items():
            if p not in dropped:
                score, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def texts(rng, docs, words, odd=()):
    vocabulary = [f"w{k}" for k in range(40)] + list(odd)
    weight = [1 / (k + 1) for k in range(len(vocabulary))]
    for _ in range(docs):
        yield "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", "]) for w in rng.choices(vocabulary, weight, k=words))


@pytest.mark.parametrize(("max_n", "shares"), [(3, 4096), (3, 8), (2, 4), (4, 16)])
def test_by_brute_force(spark, monkeypatch, max_n, shares):
    """Few shares: most words are dealt out by what follows."""
    monkeypatch.setattr(phrases, "SHARES", shares)
    monkeypatch.setattr(phrases, "PARTS", 2 * shares)
    rng = random.Random(max_n * 100 + shares)
    odd = ["É", "ABC", "x\x01", "x", "x\x0e", '"q"', "\\", "日本", "𝄞", "a b"]
    rows = [(t, rng.choice(["en", "en", "en", "de", None, "t\tab", "t\\tab", "", "b c"])) for t in texts(rng, 60, 120, odd)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(df, max_n=max_n, least=4, top=50).collect())
    assert got == brute(rows, max_n, 4, 50)


def test_stack_over_small_batches(spark):
    """Groups that go on from one Arrow batch to the next."""
    rng = random.Random(4)
    rows = [(t, "en") for t in texts(rng, 30, 60)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), least=3).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute(rows, least=3)


def test_odd(spark):
    rows = [(None, None), ("", "en"), (" \t\n", "en"), ("one", "en"), ("a b " * 30, "en"), ("a b " * 30, "en"), ("w" * 50_000 + " x", "en"), ("Ä B. " * 12, None), ("ä b. " * 12, "und")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "text string, lang string, f int, phrase string")
    assert sorted(tuple(r) for r in phrases.collocations(df).collect()) == brute(rows)
    assert phrases.collocations(df.where("false")).count() == 0
    assert phrases.collocations(df.where(F.length("text") < 4)).count() == 0


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000
    df = spark.createDataFrame([(big, big, big + 1)], "a long, l long, r long")
    got = df.withColumn("over", phrases._exact(F.lit(1_000_000), F.col("a"), F.col("a"))).withColumn("under", phrases._exact(F.col("l"), F.col("r"))).select(F.expr("over div under")).first()[0]
    assert got == 10**6 * big * big // (big * (big + 1))
