"""The llm operators against brute force, exact round trips and held-out labels, on small tables."""

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veridex.llm import _kernel as K
from veridex.llm import chroma, fingerprint, langid, license_scan, mixing, near_dup, pieces, preferences, queries, substring_dedup, suffix_array, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, label string"  # the last two clash with results


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), "x", "y") for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, wordless and long texts, ties and repeated rows."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    base = say(200)
    rows = [(None, None, None, None), (None, "no id here", "en", None), (1, "", "en", "a"), (2, None, None, "a"), (3, "!!! ???", None, None), (4, "été Ça va où", "fr", "b"), (5, base, "en", "a"), (5, base, "en", "a"), (6, base, None, "b")]
    rows += [(7, say(3000), "en", "a"), (8, base.replace(base.split()[50], "zzz", 1), "en", "b"), (9, "x " * 700, "en", "c"), (10, say(150) + " " + base + " " + say(100), "en", "c"), (5, "same id, other text", "en", "a"), (11, "🙂" * 5, None, "🙂")]
    return docs(spark, rows)


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


# ---- 1


def nearest(word, terms, fuzzy_from=5):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    found = [(e, t) for t in terms if (e := edits(word, t)) <= (1 if len(t) >= fuzzy_from else 0)]
    return min(found)[0] if found else -1


def test_automaton_is_edit_distance():
    rng = random.Random(2)
    terms = ["moron", "clown", "clowns", "bad", "abcab", "caaab", "bbbbbb"]
    a = toxicity.Automaton(terms, [1.0] * len(terms))
    words = ["".join(rng.choices("abc", k=rng.randint(1, 8))) for _ in range(3000)] + ["morron", "mron", "m0ron", "clownz", "bda", "bad", "clow"]
    cp = np.array([ord(c) for w in words for c in w], np.uint32)
    end = np.cumsum([len(w) for w in words])
    term, edits = a.run(cp, end - [len(w) for w in words], end)
    assert [int(e) if t >= 0 else -1 for t, e in zip(term, edits, strict=True)] == [nearest(w, terms) for w in words]


def test_toxicity_learns_and_reads_context(spark, nothing, odd):
    rng = random.Random(3)
    clean = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(200)]
    rows, labels = [], []
    for i in range(1200):
        t = rng.choices(clean, k=30)
        bad = i % 4 == 0
        if bad:
            t[5], t[15] = "grumbolt", "snorvax"
        rows.append((i, " ".join(t), "en", "s"))
        labels.append((i, int(bad)))
    train = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5]
    m = toxicity.fit(docs(spark, rows), spark.createDataFrame(train, "doc_id long, toxic int"))
    assert {"grumbolt", "snorvax"} == set(m.terms)
    probe = docs(spark, [(1, "they are grumbolt and snorvax", None, None), (2, "a grumbolf of snorwax", None, None), (3, "clean words", None, None), (4, 'he said "grumbolt" and wrote "snorvax" as a word', None, None), (5, "", None, None), (6, None, None, None)])
    s = {r.doc_id: r.score for r in toxicity.score(probe, m).collect()}
    assert s[1] > 0.5 and s[2] > s[3] and s[4] < s[1] and s[3] == s[5] == s[6] < 0.5
    held = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    got = {r.doc_id: r.predicted for r in toxicity.score(docs(spark, rows), m).collect()}
    assert all(got[i] == y for i, y in held)
    assert toxicity.score(odd, m).count() == odd.count() and toxicity.score(nothing, m).count() == 0
    none = toxicity.fit(docs(spark, rows), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(probe, none).collect()} == {toxicity.score(probe, none).first().score}


# ---- 2


def test_mix_properties(odd, nothing):
    rows = mixing.mix(odd, ("doc_id", "source")).collect()
    assert len(rows) == odd.count()
    total = sum(r._size for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for own in by.values():
        assert own[0]._target <= 2 * own[0]._source_size and sum(r._taken for r in own) == int(own[0]._target)
        assert all(r._taken <= 2 * r._size for r in own)
    assert abs(sum(own[0]._target for own in by.values()) - 1.5 * total) < 1e-6 * total
    assert mixing.mix(nothing).count() == 0 and mixing.curriculum(nothing).count() == 0
    order = mixing.curriculum(odd)
    assert order.columns == odd.columns and order.count() == sum(r._passes for r in rows)


def test_mix_query_is_sorted_by_position(spark):
    rows = mixing.op2_curriculum_mix(spark, SF, rows_per_task=50).collect()
    at = [(-1 if r.position is None else r.position, r.doc_id) for r in rows]
    assert at == sorted(at) and len(rows) == 200


def test_positions_invert_schedules(spark):
    for tilt in (-0.5, 0.0, 0.5):
        for u in (0.0, 0.1, 0.5, 0.9, 1.0):
            t = spark.range(1).select(mixing.position(F.lit(u), F.lit(tilt)).alias("t")).first().t
            assert abs(t + tilt * (t * t - t) - u) < 1e-12


# ---- 3


def test_chroma_aligns_a_shifted_noisy_copy(spark):
    rng = np.random.default_rng(4)
    song = chroma.melody(rng.uniform(-1, 1, 90))
    other = chroma.melody(rng.uniform(-1, 1, 90))
    shifted = song[10 * chroma.HOP_4 :] + rng.normal(0, 0.02, len(song) - 10 * chroma.HOP_4)
    rows = [(0, song.tolist()), (1, shifted.tolist()), (2, other.tolist()), (3, song.tolist()), (4, None), (5, []), (6, [float("nan")] * 3000)]
    p = chroma.fingerprint(spark.createDataFrame(rows, "id long, pcm array<double>"), "id", "pcm", chroma.RATE_4, chroma.FRAME_4, chroma.HOP_4)
    got = {r.id: r for r in chroma.align(p, "id").collect()}
    assert got[0].asked and got[0].class_id == got[3].class_id == 0
    assert got[0].best_class == 1 and got[0].best_shift == -10 and got[0].best_error < 0.2 and got[0].n_links == 2
    assert got[4].n_ints == 0 and len(got) == 7


def test_chroma_aligns_copies_whose_seeds_are_all_common(spark):
    """A hundred copies that differ in every sixth integer have pairs in common, but no run of six."""
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**31), 2**31, 60)
    rows = []
    for v in range(100):
        x = base.copy()
        x[::6] = rng.integers(-(2**31), 2**31, 10)
        rows.append((v, x.tolist()))
    got = {r.id: r for r in chroma.align(spark.createDataFrame(rows, "id long, fingerprint array<int>"), "id").collect()}
    assert got[0].n_links == got[50].n_links == 99 and got[0].best_shift == 0


def test_integers_by_direct_sums():
    rng = np.random.default_rng(5)
    image = rng.random((20, 12))
    got = chroma.integers(image).view(np.uint32)
    at = 2
    twice = np.hstack([image, image])
    bits = 0
    for t, n, c, k, kind in chroma.FILTERS:
        area = lambda a, b, x, y: twice[at + a : at + b, x:y].sum()  # noqa: B023, E731
        if kind == 0:
            a, b = area(t, t + n // 2, c, c + k), area(t + n // 2, t + n, c, c + k)
        elif kind == 1:
            a, b = area(t, t + n, c, c + k), area(t, t + n, c + k, c + 2 * k)
        else:
            a, b = area(t, t + n, c, c + k) / k, area(t, t + n, 0, 12) / 12
        bits = bits * 4 + int(chroma.GRAY[np.digitize(np.log1p(a) - np.log1p(b), chroma.CUTS)])
    assert got[at] == bits


# ---- 4


def test_preferences(spark):
    turn = "array<struct<role: string, text: string>>"
    u, a, b = ("user", "hi"), ("assistant", "good"), ("assistant", "bad")
    rows = [(1, [u, a], [u, b]), (2, [u, a], [u, a]), (3, [], []), (4, [u], [u, a]), (5, [("user", None), a], [("user", None), b]), (6, [u, ("assistant", "x<|end|>y")], [u, ("user", "z")])]
    got = {r.k: r for r in preferences.format_pairs(spark.createDataFrame(rows, f"k long, chosen {turn}, rejected {turn}")).collect()}
    assert got[1].n_common == 1 and got[1].prompt == "<|user|>\nhi<|end|>\n<|assistant|>\n"
    assert got[1].chosen_completion.text == "good<|end|>\n" and got[1].chosen_completion.mask[0].asDict() == {"start": 0, "end": 12}
    assert got[2].n_common == 2 and got[2].chosen_completion.text == "" and not got[2].chosen_completion.mask
    assert got[3].n_common == 0 and got[3].prompt == ""
    assert got[4].n_common == 1 and got[4].chosen_completion.text == ""
    assert got[5].n_common == 1
    c = got[6].chosen_completion
    assert c.text.count("<|end|>") == 1 and [c.text[m.start : m.end] for m in c.mask][0].startswith("x<")
    assert got[6].rejected_completion.mask == []


# ---- 5


def test_pieces(odd, nothing):
    with open(pieces.MODEL_PATH, "rb") as f:
        c = pieces.Codec(f.read(), memo_words=50)
    rng = random.Random(6)
    samples = [t for _, t in texts(odd)] + ["", " ", "  a  b ", "▁x", "<s> <unk> <0x0A>", "漢字🙂\x00", "\n\tx", "".join(rng.choices(" ab▁é🙂\n", k=300))]
    assert all(c.verify(samples))
    ids, off = c.encode(samples)
    back, end = c.decode(ids, off)
    for k, t in enumerate(samples):
        if "▁" not in t:
            assert back[end[k] : end[k + 1]].tobytes().decode() == t
    rows = pieces.encode(odd)
    assert all(r.round_trip and r.parity is not False for r in rows.collect())
    assert sorted(r.text for r in pieces.decode(rows).collect()) == sorted(t for _, t in texts(odd))
    assert pieces.encode(nothing).count() == 0


def test_parity_of_every_row(odd):
    assert {r.parity for r in pieces.encode(odd).collect()} == {True}


def test_parity_by_word_is_parity_of_texts():
    with open(pieces.MODEL_PATH, "rb") as f:
        c = pieces.Codec(f.read(), memo_words=300)
    assert c.verified_by_word
    rng = random.Random(16)
    texts_ = ["".join(rng.choices(" ab▁é🙂\n漢\x00<>/s", k=rng.randint(0, 60))) for _ in range(400)]
    for i in range(0, 400, 50):
        ids, off, parity = c.encode_verified(texts_[i : i + 50])
        assert parity.tolist() == c.verify(texts_[i : i + 50]) == [True] * 50
    c.ids = [c.ids[0] + 1]  # a codec that is wrong, and says so
    c.agrees = np.zeros(0, bool)
    wrong = c.encode_verified(texts_[350:])[2].tolist()
    assert wrong == [t == "" for t in texts_[350:]]


def test_unigram_model_is_rebuilt():
    piece = lambda p, s, k=1: (lambda body: b"\x0a" + bytes([len(body)]) + body)(b"\x0a" + bytes([len(p.encode())]) + p.encode() + b"\x15" + np.float32(s).tobytes() + b"\x18" + bytes([k]))
    data = piece("<unk>", 0, 2) + piece("▁", -3) + piece("a", -2) + piece("b", -2.5) + piece("▁ab", -1) + piece("ab", -1.5) + b"\x12\x02\x18\x01" + b"\x1a\x04\x18\x01\x20\x00"
    c = pieces.Codec(data)
    assert c.spec.model_type == pieces.UNIGRAM and all(c.verify(["ab ab", "ba", "aab abb", ""]))


# ---- 6


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(7)
    for trial in range(150):
        t = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(1, 60)).astype(np.uint8)
        b = t.tobytes()
        sa = suffix_array.of_bytes(t)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        plcp, phi = suffix_array.permuted_lcp(t, sa)
        for i in range(len(b)):
            if phi[i] >= 0:
                assert plcp[i] == len(os.path.commonprefix([b[i:], b[phi[i] :]]))


@pytest.mark.parametrize("most_runs", [2000, 1])
def test_substrings(odd, nothing, most_runs):
    length, gram = 60, 20
    got = substring_dedup.dedup(odd, length, gram, most_runs).collect()
    raw = [(r.text or "").encode() for r in odd.collect()]
    count = collections.Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    want = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        want.append((t, bytes(c for c, g in zip(t, gone, strict=True) if not g), sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))))
    assert sorted(((r.text or "").encode(), bytes(r._kept), len(r._spans)) for r in got) == sorted(want)
    assert got[0].score == "x" and substring_dedup.dedup(nothing, length, gram).count() == 0


# ---- 7


def test_license_scan(spark, odd, nothing):
    rows = [(1, "Released under the MIT License.", None, None), (2, "Licenced under the Apache\n Licence, Version 2.0", None, None), (3, "mit\tLICENSE; general PUBLIC -- license x mit license", None, None), (4, "mitlicense summit license", None, None), (5, "mit", None, None), (6, "license", None, None)]
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, rows)).collect()}
    assert (got[1].base_labels, got[1].labels, got[1].n_base, got[1].first_word, got[1].score) == ("mit", "mit", 1, 3, 1.0)
    assert got[2].base_labels == "" and got[2].labels == "apache" and got[2].notices[0].edits > 0 and (got[2].notices[0].first_word, got[2].notices[0].last_word) == (0, 7)
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].base_labels, got[3].n_words) == (3, 0, 6, "gpl,mit", 8)
    assert [got[k].n_base for k in (4, 5, 6)] == [0, 0, 0]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = {i: i + 32 for i in range(65, 91)}
    assert sorted(r.n_words for r in license_scan.scan(odd).collect()) == sorted(len(word.findall(t.translate(low))) for _, t in texts(odd))
    assert license_scan.scan(nothing).count() == 0


# ---- 8


def test_near_duplicates(spark, odd, nothing):
    members, links = near_dup.classify(odd)
    cls = collections.defaultdict(set)
    for r in members.collect():
        cls[r.root].add(r.doc_id)
    groups = sorted((sorted(x for x in g if x is not None) for g in cls.values()), key=str)
    assert [5, 6, 8] in groups and members.count() == odd.count()
    assert near_dup.classify(nothing)[0].count() == 0
    kept = near_dup.one_of_each_stage(spark, odd, SF)
    assert kept.columns == odd.columns and kept.count() == len(cls)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(8)
    words = ["w%d" % i for i in range(400)]
    rows = []
    for g in range(25):
        base = rng.choices(words, k=rng.randint(40, 160))
        for v in range(rng.randint(1, 7)):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((g * 10 + v, " ".join(t), "en", "s"))
    members, _ = near_dup.classify(docs(spark, rows))
    mine = {r.doc_id: r["class"] for r in members.collect()}
    sh = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t, _, _ in rows}
    root = {i: i for i in sh}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sh):
        for j in sorted(sh):
            if i < j and len(sh[i] & sh[j]) >= 0.8 * len(sh[i] | sh[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert mine == {i: find(i) for i in sh}


def test_family_around_one_base(spark):
    """Variants of one base resemble it, but hardly each other; so none may go unmet in a hot bucket."""
    rng = random.Random(10)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(0, " ".join(base), "en", "s")]
    for v in range(1, 301):
        t = list(base)
        for at in rng.sample(range(300), 4):
            t[at] = f"x{v}y{at}"
        rows.append((v, " ".join(t), "en", "s"))
    members, _ = near_dup.classify(docs(spark, rows))
    assert collections.Counter(r["class"] for r in members.collect()) == {0: 301}


@pytest.mark.parametrize("block", [16, 512])
def test_family_without_its_base(spark, block):
    """Some variants resemble each other, most don't: classes are those of brute force, however buckets are dealt."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for v in range(150):
        t = list(base)
        for at in rng.sample(range(120), 2 + v % 2):
            t[at] = f"x{v}y{at}"
        rows.append((v, " ".join(t), "en", "s"))
    sh = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t, _, _ in rows}
    root = list(range(150))
    for i in range(150):
        for j in range(i):
            if len(sh[i] & sh[j]) >= 0.8 * len(sh[i] | sh[j]) and root[i] != root[j]:
                a, b = min(root[i], root[j]), max(root[i], root[j])
                root = [a if x == b else x for x in root]
    members, _ = near_dup.classify(docs(spark, rows), block=block)
    assert {r.doc_id: r["class"] for r in members.collect()} == dict(enumerate(root))
    assert 1 < len(set(root)) < 150


def test_overlaps_in_parts():
    rng = np.random.default_rng(13)
    seqs = [rng.choice(300, rng.integers(0, 80), replace=False).astype(np.uint64) for _ in range(30)]
    lead = [3, 0, 29]
    for room in (1 << 22, 100):
        got = near_dup.overlaps(seqs, np.array(lead), room)
        assert all(got[k, j] == len(np.intersect1d(seqs[i], seqs[j])) for k, i in enumerate(lead) for j in range(30) if i != j)


def test_very_long_documents_have_the_same_signatures(monkeypatch):
    grams = K.Grams(np.frombuffer(b"a b c d e f g a b c d h i j", np.uint8), np.array([0, 5, 5, 27]), 3, K.word_table())
    want = K.order_minhash(grams, 6, 4)
    monkeypatch.setattr(K, "POS_MASK", 2)
    assert K.order_minhash(grams, 6, 4).tolist() == want.tolist()


def test_alignment_keeps_order():
    a = np.arange(1, 101, dtype=np.uint64)
    assert near_dup.similarity(a, a) == 1.0
    b = np.concatenate([a[50:], a[:50]])
    assert near_dup.similarity(a, b) == 0.0
    c = np.delete(a, [10, 20])
    assert near_dup.similarity(a, c) == 0.98


# ---- 9


def test_fingerprints(odd, nothing, spark):
    rows = texts(odd)
    rows.sort(key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    got = fingerprint.with_edit(odd, rows_per_task=4).collect()
    want = []
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    prints = {r.fingerprint for r in got if r.doc_id in (6,)} | {r.fingerprint for r in got if r.doc_id == 5 and r.n_chars > 100}
    assert len(prints) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint.with_edit(nothing).count() == 0
    single = fingerprint.with_edit(docs(spark, [(1, "abcd", None, None)])).first()
    assert single.near_next == 1.0 and single.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert {r.fingerprint for r in fingerprint.fingerprints(odd.where("doc_id = 6")).collect()} == prints


def test_grams_do_not_depend_on_neighbours():
    table = K.word_table()
    rng = random.Random(9)
    ts = [" ".join(rng.choices("aa bb cc DD éé".split(), k=rng.randint(0, 40))).encode() for _ in range(60)]
    buf = np.frombuffer(b"".join(ts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in ts])])
    whole = K.Grams(buf, off, 5, table)
    for k, t in enumerate(ts):
        own = K.Grams(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 5, table)
        assert own.hash.tolist() == whole.hash[whole.first[k] : whole.first[k + 1]].tolist()
        assert len(set(own.hash.tolist())) == len(own.hash)


# ---- 10


def test_language(spark, odd, nothing):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op10_language_id(spark, SF).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    m = langid.fit(odd)
    out = {(r.doc_id, r.text): r for r in langid.identify(odd, m).collect()}
    assert out[(1, "")].lang_pred == out[(2, None)].lang_pred == out[(3, "!!! ???")].lang_pred == "und" and out[(3, "!!! ???")].score == 0
    assert langid.identify(nothing, m).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.fit(nothing)).collect()} == {"und"}


# ---- queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = c.execute(queries.ORACLE_SQL[name])
    order = [d[0] for d in want.description]
    assert sorted(map(str, df.select(*order).toPandas().to_numpy().tolist())) == sorted(map(str, want.df().to_numpy().tolist()))


@pytest.mark.parametrize("short", [True, False])
def test_substring_stage_cuts_passages_of_51_words(spark, odd, nothing, short):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghé", k=rng.randint(1, 2 if short else 9))) for _ in range(3000)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    there, longer, line = say(51), say(70), say(50)
    texts_ = [f"{say(40)}\n{there} {say(30)}", f"{there} {say(80)}", f"{say(20)} {longer}", f"{longer}\n\n{say(20)} {line}", f"{line} {say(90)}", say(100), there, f"{say(60)} {longer[:200]}"]
    texts_ += [whole := f"{say(30)} {say(51)}", f"{whole} {say(9)}", whole]  # the last of them has nothing of its own
    rows = [(i, t, "en", "s") for i, t in enumerate(texts_)]
    place = {r.doc_id: r.r for r in docs(spark, rows).select("doc_id", F.xxhash64("doc_id", F.col("doc_id").isNull()).alias("r")).collect()}
    least = {}
    for i, t in enumerate(texts_):
        for k in range(len(t.split()) - 50):
            w = tuple(t.split()[k : k + 51])
            least[w] = min(least.get(w, (1 << 64, 0)), (place[i], k))

    def kept(i, t):  # brute force over all windows of 51 words; windows of 400 bytes lie in them here
        spots = [m.span() for m in re.finditer(r"[^\t-\r ]+", t)]
        gone = bytearray(len(t))
        for k in range(len(spots) - 50):
            w = tuple(t[x:y] for x, y in spots[k : k + 51])
            if count[w] > 1 and least[w] != (place[i], k):
                gone[spots[k][0] : spots[k + 50][1]] = b"\1" * (spots[k + 50][1] - spots[k][0])
        return "".join(c for c, g in zip(t, gone, strict=True) if not g)

    count = collections.Counter(tuple(t.split()[i : i + 51]) for t in texts_ for i in range(len(t.split()) - 50))
    want = {i: kept(i, t) for i, t in enumerate(texts_)}
    assert all(sum(x in t for t in want.values()) == 1 for x in (there, longer, whole)) and line in want[3] and line in want[4]
    got = {r.doc_id: r for r in substring_dedup.substring_stage(spark, docs(spark, rows), SF).collect()}
    assert {i: r.text for i, r in got.items()} == {i: t for i, t in want.items() if t.strip()}
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert substring_dedup.substring_stage(spark, nothing, SF).count() == 0


def test_texts_that_are_wholly_repeated_stay_once(spark):
    rng = random.Random(14)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    a, b = say(120), say(130)
    rows = [(1, a, "en", "s"), (2, b, "en", "s"), (3, f"{a}\n{b}", "en", "s"), (4, f"{b} {a}", "en", "s"), (5, say(60), "en", "s")]
    got = [r.text for r in substring_dedup.substring_stage(spark, docs(spark, rows), SF).collect()]
    assert sum(t.count(a[200:500]) for t in got) == 1 and sum(t.count(b[200:500]) for t in got) == 1 and rows[4][1] in got


def test_passages_are_counted(spark):
    rng = random.Random(15)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))
    there = say(55)
    rows = [(1, f"{say(20)} {there} {say(20)}", None, None), (2, f"{there} {say(40)}", None, None), (3, say(90), None, None), (4, None, None, None)]
    got = {r.doc_id: (len(r._passages), sum(x.end - x.start for x in r._passages), len(r._spans)) for r in substring_dedup.dedup(docs(spark, rows)).collect()}
    assert got == {1: (1, len(there), 0), 2: (1, len(there), 0), 3: (0, 0, 0), 4: (0, 0, 0)}


def test_pipeline_stages(spark, odd):
    import corpus_pipeline

    d = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == odd.columns, name
        d = spark.createDataFrame(out.collect(), odd.schema)
    assert d.count() > 0
    last = corpus_pipeline.STAGES[-1][1](spark, d, SF)
    assert last.count() == d.count() and all(r.round_trip for r in last.collect())
    assert corpus_pipeline.STAGES[0][1](spark, odd.limit(0), SF).count() == 0
