"""The sieve before the similarity join, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridex.operators import lineage as LN
from veridex.operators import sieve as SV


def corpus(n, seed=5):
    """Texts of which most have no partner, with near copies, copies, copies but for case, and texts of too few words."""
    rng = random.Random(seed)
    words, texts = [f"w{i}" for i in range(400)], ["", "too short", "a b c", "A, b c!", None]
    while len(texts) < n:
        base = rng.choice(texts[5:]).split() if len(texts) > 9 and rng.random() < 0.2 else rng.choices(words, k=rng.randrange(3, 40))
        texts.append(" ".join(w if rng.random() > 0.05 else rng.choice(words) for w in base))
    return texts + texts[-20:]


def shingled(text, k=3):
    w = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


@pytest.mark.parametrize("k", [1, 3])
def test_shingle_sets(spark, k):
    texts = corpus(120)
    got = {r.id: r.s for r in SV.shingle_sets(spark.createDataFrame(list(enumerate(texts)), "id long, content string"), k).collect()}
    want = {i: shingled(t, k) for i, t in enumerate(texts) if shingled(t, k)}
    assert {i: len(s) for i, s in got.items()} == {i: len(s) for i, s in want.items()}
    assert all(s == sorted(set(s)) for s in got.values())
    some = sorted(want)[::7]
    assert all(len(set(got[i]) & set(got[j])) == len(want[i] & want[j]) for i in some for j in want)


@pytest.mark.parametrize("per_slice", [10_000, 1_500])
def test_possible_sets(spark, monkeypatch, per_slice):
    """As by counting all shingles, over one slice and bucket or many, with numbers of sets in several blocks."""
    monkeypatch.setattr(SV, "PER_BUCKET", per_slice // 3)
    monkeypatch.setattr(SV, "PACKED", 200)
    texts = corpus(200)
    sets = SV.shingle_sets(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, content string"), 3)
    numbered = sets.select((F.col("id") * 30_001).alias("no"), F.size("s").alias("n"), "s")
    own = {i: shingled(t) for i, t in enumerate(texts) if shingled(t)}
    often = {}
    for s in own.values():
        for x in s:
            often[x] = often.get(x, 0) + 1
    want = {i * 30_001 for i, s in own.items() if sum(often[x] > 1 for x in s) >= np.ceil(0.5 * len(s))}
    got = SV.possible(numbered, sum(map(len, own.values())), 0.5, per_slice, 16)
    assert {r.no for r in got.collect()} == want and 20 < len(want) < len(own) - 20


def test_similar_sets_compare_few(spark, monkeypatch):
    """Equal texts are shingled once, and what has no partner goes no further than the sieve."""
    seen, written = [], {}
    real, store = LN.shingle_sets, LN.stored
    monkeypatch.setattr(LN, "shingle_sets", lambda df, k: seen.append(df.count()) or real(df, k))

    def stored(parts, name="part"):
        written[name] = store(parts, name)
        if name == "own":
            seen.append(written[name].count())
        return written[name]

    monkeypatch.setattr(LN, "stored", stored)
    texts = corpus(200)
    members, pairs = LN.similar_sets(spark.createDataFrame(list(enumerate(texts)), "id long, content string"))
    own = {i: shingled(t) for i, t in enumerate(texts) if shingled(t)}
    least = {}
    for i in sorted(own):
        least.setdefault(own[i], i)
    assert {r.id: r.rep for r in members.collect()} == {i: least[s] for i, s in own.items()}
    reps = sorted(least.values())
    want = {(a, b): len(own[a] & own[b]) / len(own[a] | own[b]) for x, a in enumerate(reps) for b in reps[x + 1 :] if 2 * len(own[a] & own[b]) >= len(own[a] | own[b])}
    assert {(r.a, r.b): r.jaccard for r in pairs.collect()} == want and want
    assert seen[0] == len({t for t in texts if t is not None}) + 1  # and the one without a text
    assert seen[1] < len(reps) / 2


def test_sets_go_to_few_units(spark, monkeypatch):
    """Of 60 sets that all meet, each goes to as many units as there are blocks, not to one for each of its 59 pairs; and all pairs are compared."""
    monkeypatch.setattr(LN, "BLOCK", 20)
    monkeypatch.setattr(LN, "PER_CELL", 10)
    rng = random.Random(2)
    sets = {f"s{i:02}": sorted(rng.sample(range(60), 40)) for i in range(60)}
    met = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a string, b string")
    placed, carried = LN.in_cells(met)
    assert {(r.a, r.b) for r in placed.collect()} == {(a, b) for a in sets for b in sets if a < b} and placed.count() == 60 * 59 / 2
    assert carried.count() <= 60 * 4
    own = spark.createDataFrame(list(sets.items()), "id string, s array<bigint>")
    cell = F.pmod("unit", F.lit(3)).alias("cell")
    got = SV.overlaps(carried.join(own, "id").select(cell, "id", "s").distinct(), placed.select(cell, "a", "b"), 0.5)
    want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in sets.items() for b, y in sets.items() if a < b}
    assert {(r.a, r.b): r.jaccard for r in got.collect()} == {p: j for p, j in want.items() if j >= 0.5}
