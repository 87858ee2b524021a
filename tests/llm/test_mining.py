"""Fill-in-middle, collocations and embedding near-duplicates against brute force, on small tables."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from veridex.llm import collocations, fill_middle, vector_dups

SCHEMA = "doc_id long, text string, lang string, n long, form string, key string, rank string"  # the last four clash with results


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, 0, "x", "y", "z") for i, t, g in rows], SCHEMA)


def by_sql(df, sql):
    documents = df.toArrow()  # noqa: F841  duckdb reads it by name
    con = duckdb.connect()
    con.register("documents", documents)
    return con.sql(sql)


# ---- 11


def arranged(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    form = "spm" if h4 % 100 < 50 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


ODD = ["", None, "\n", "\n\n\n", "one line", "a\nb", "a\nb\n", "a\r\nb\rc\n", "\x01\x02m\x01e\n\x02\x02\x01\nend\x01", "<P>\nno", "x<S>", "<M>", "<P\n>\n<S\nS>\n", "$1\\1\n${0}\n\\n", "été\n🙂🙂\n x \n\x00\n", "tie\n" * 5]


def test_fill_middle(spark):
    rng = random.Random(3)
    rows = [(i, t, "en") for i, t in enumerate(ODD * 6)] + [(None, "no\nid\n", None), (None, None, None), (5, "a\nb", "x"), (5, "a\nb", "x")]
    rows += [(1000 + k, "".join(rng.choices("ab\n<>PSM\x01\x02é🙂", k=rng.randint(0, 60))), "en") for k in range(300)]
    rows.append((9999, "long line " * 300_000 + "\n" + "\n" * 200_000 + "x" * 1_000_000, "en"))
    out = fill_middle.fill_in_middle(docs(spark, rows))
    got = sorted([repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in out.collect()])
    assert got == sorted(repr((i, *arranged(i, t))) for i, t, _ in rows)
    assert out.columns == ["doc_id", "text", "lang", "key", "rank", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = out.select("text", fill_middle.restored(out.output, out.form).alias("back")).collect()
    assert all((r.text or "") == r.back for r in back)


def test_fill_middle_rates_and_markers(spark):
    df = docs(spark, [(i, f"{i}\n" * 9, "en") for i in range(2000)])
    form = fill_middle.Form("[pre]", "[suf]", "[mid]", of_100=60, spm_of_100=0, seed=11)
    out = fill_middle.fill_in_middle(df, form)
    rows = out.select("text", "form", "output", fill_middle.restored(out.output, out.form, form).alias("back")).collect()
    count = collections.Counter(r.form for r in rows)
    assert 1100 < count["psm"] < 1300 and count["spm"] == 0
    assert all(r.text == r.back and (r.form == "plain" or r.output.startswith("[pre]")) for r in rows)


def test_fill_middle_plan(spark):
    df = fill_middle.fill_in_middle(docs(spark, [(1, "a\n", "en")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Arrow" not in plan and "Python" not in plan
    assert fill_middle.fill_in_middle(docs(spark, [])).count() == 0


# ---- 12


def lang_pieces(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(low)):
            yield lang or "und", re.findall("[^ \t]+", piece)


def counted(rows):
    f, n = collections.Counter(), collections.Counter()
    for lang, w in lang_pieces(rows):
        n[lang] += len(w)
        for size in range(1, 5):
            for i in range(len(w) - size + 1):
                f[lang, tuple(w[i : i + size])] += 1
    return f, n


def best(rows, least, covered=80, top=2000):
    f, n = counted(rows)
    f = {k: v for k, v in f.items() if v >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or any(g == lang and len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in f.items()):
            continue
        score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, xs in out.items() for k, (s, a, p, left, right) in enumerate(sorted(xs)[:top])}


@pytest.fixture(scope="module")
def wordy():
    rng = random.Random(5)
    words = ["a", "B", "c", "Ä", "ä", "\x1cq\x1c", "\x00", " ", " x", "🙂", "the", "of", "x" * 40]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ".", "\n", "\r\n", ", "]) for _ in range(n))
    rows = [(i, say(rng.randint(0, 40)), rng.choice(["en", "de", None, "und", "é"])) for i in range(400)]
    rows += [(None, None, None), (1, "", "fr"), (2, " \t ", "fr"), (3, "a a a a a a a a", "en"), (3, "a a a a a a a a", "en"), (4, "hot line of words here. " * 500, "en")]
    return rows + [(5, "the same copy of the text", "de")] * 200


def test_collocations(spark, wordy):
    df = docs(spark, wordy)
    for least, covered, top in ((3, 80, 2000), (30, 50, 7)):
        out = collocations.collocations(df, least=least, covered=covered, top=top, width=1 << 6 if least == 3 else 1 << 12)
        got = [tuple(r) for r in out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
        assert len(got) == len(set(got)) and set(got) == best(wordy, least, covered, top)


def test_collocations_sql(spark, wordy):
    out = collocations.collocations(docs(spark, wordy))
    want = by_sql(docs(spark, wordy), collocations.SQL).select("lang, rank, phrase, a, l, r, n, score").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want) and want


@pytest.mark.parametrize("rows", [1, 40, 200_000])
def test_frequent_in_blocks(spark, wordy, rows):
    """Groups that are counted in parts give the same counts."""
    counters = np.full(1 << 4, 10**9)  # everything is dealt over many keys, and nothing is known to be rare
    f, _ = counted(wordy)
    got = {(r.lang, r.phrase): r.a for r in collocations.frequent(docs(spark, wordy), counters, 5, rows=rows).collect()}
    assert got == {(lang, " ".join(p)): a for (lang, p), a in f.items() if a >= 5}


def test_places_of_long_streams():
    rng = np.random.default_rng(1)
    ids, rank = rng.integers(0, 9, 500).astype(np.int32), np.array([-1, 3, 0, 1, 7, 2, 5, 4, 6], np.int32)
    at, whole = collocations.places(ids, rank, 0, len(ids))
    parts = [collocations.places(ids, rank, lo, min(lo + 7, 500)) for lo in range(0, 500, 7)]
    assert (np.concatenate([p[0] for p in parts]) == at).all()
    assert all((np.concatenate([p[1][k] for p in parts]) == whole[k]).all() for k in range(7))


def test_words_of_cut_texts(monkeypatch):
    texts = [b"One two,three\tfour " * 50, b"", b"x" * 300, "é.É ".encode() * 40]
    whole = [w for ws in collocations.words_of(texts) for w in ws]
    monkeypatch.setattr(collocations, "SPLIT", 16)
    assert [w for ws in collocations.words_of(texts) for w in ws] == whole


def test_distinct_sums():
    rng = np.random.default_rng(2)
    columns, n = [rng.integers(-1, 3, 1000) for _ in range(4)], rng.integers(1, 9, 1000)
    first, total = collocations.distinct(columns, n)
    want = collections.Counter()
    for row, k in zip(zip(*columns, strict=True), n, strict=True):
        want[row] += k
    assert {tuple(c[i] for c in columns): t for i, t in zip(first, total, strict=True)} == want


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs(spark, [])).count() == 0
    assert collocations.collocations(docs(spark, [(1, "too rare", "en"), (None, None, None)])).count() == 0


# ---- 13

VECTORS = "vec_id long, embedding array<double>, label int, n long, home string, component_id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "h", "c") for i, v in rows], VECTORS)


def all_links(rows, threshold=0.9):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = np.zeros(len(rows), int)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, v) in enumerate(rows):
        for j, (_, w) in enumerate(rows):
            if i < j and good[i] and good[j] and len(v) == len(w):
                a, b = np.array(v, float) / np.abs(v).max(), np.array(w, float) / np.abs(w).max()
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    n[i] += 1
                    n[j] += 1
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    least = {}
    for i, (vec_id, _) in enumerate(rows):
        old = least.get(find(i))
        least[find(i)] = vec_id if old is None else old if vec_id is None else min(old, vec_id)
    return sorted(repr((vec_id, int(n[i]), least[find(i)], vec_id == least[find(i)])) for i, (vec_id, _) in enumerate(rows))


@pytest.fixture(scope="module")
def family():
    rng = np.random.default_rng(7)
    rows = []
    for k in range(30):
        base = rng.normal(size=16)
        rows += [(len(rows) + j, (base + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.3])).tolist()) for j in range(rng.integers(1, 12))]
    base = rng.normal(size=16)
    rows += [(1000 + j, (base + rng.normal(size=16) * 0.15).tolist()) for j in range(120)]
    rows += [(2000 + j, base.tolist()) for j in range(40)] + [(2100, (base * 1e200).tolist()), (2101, (base * 1e-200).tolist()), (2102, (-base).tolist())]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15, base[:5].tolist(), base[:5].tolist(), base.tolist() + [0.0], [1.0], [2.0], [-1.0]]
    rows += [(3000 + j, v) for j, v in enumerate(odd)]
    return rows + [(None, base.tolist()), (None, None), (3, rows[3][1]), (3, rng.normal(size=16).tolist()), (None, [9.0, 1.0]), (None, [9.0, 1.0])]


@pytest.mark.parametrize(("lists", "block"), [(4, 8), (32, 2048), (None, 16)])
def test_vector_links(spark, family, lists, block):
    out = vector_dups.near_vectors(vectors(spark, family), lists=lists, block=block, slack=vector_dups.Index.fit(np.eye(16), 2).radius / 2)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(repr((r.vec_id, r.n_links, r.component_id, r.kept if r.vec_id is not None else False if r.component_id is not None else r.kept)) for r in out.collect()) == [
        x for x in all_links(family)
    ]


def test_vector_recall(spark):
    """Pairs at cosines just over the threshold, the hardest, by the default slack."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(2000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(axis=1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = rng.uniform(0.901, 0.92, size=(2000, 1))
    near = cosine * base + np.sqrt(1 - cosine**2) * aside
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    got = {r.vec_id: r for r in vector_dups.near_vectors(vectors(spark, rows)).collect()}
    found = sum(got[i].component_id == got[i + 2000].component_id for i in range(2000))
    assert found >= 0.99 * 2000
    assert sum(r.n_links for r in got.values()) == 2 * found and all(r.n_links <= 1 for r in got.values())


def test_vectors_of_nothing(spark):
    assert vector_dups.near_vectors(vectors(spark, [])).count() == 0
    got = vector_dups.near_vectors(vectors(spark, [(1, None), (1, [0.0]), (None, [])])).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, [(1, 0, 1, True), (1, 0, 1, True), (None, 0, None, True)]))


def test_codes_bound_distances():
    """What stands for a vector is as far from it as its error says, and no neighbour is passed over."""
    rng = np.random.default_rng(9)
    x = vector_dups.unit(rng.normal(size=(500, 30)))
    y = vector_dups.unit(x + rng.normal(size=x.shape) * 0.06)
    index = vector_dups.Index.fit(x, 16)
    home, probed, codes, error, norm = index.encode(y)
    assert probed[np.arange(500), home].all() and len(index.books) == 8
    near = index.near(x, index.tables(x.astype(np.float32)), home, codes, error, norm)
    linked = y @ x.T >= 0.9
    assert near[linked].all() and linked.any() and near.mean() < 0.2
