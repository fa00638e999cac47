"""Fill-in-the-middle, license scans, whitening and the fit of the factorization machine against plain Python and at their edges."""

import random
import re
from hashlib import sha256

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from segno.llm import fill_middle, licenses, registry, toxicity, whitening

SF = "/root/testdata/sf0.001"


def sha(text):
    return sha256(text.encode()).hexdigest()


# op11

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc_id, text):
    text = text or ""
    h = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_op11_equals_cuts_by_hand_at_edges(spark):
    r = random.Random(3)
    texts = [None, "", " ", "a", " \t\n", "a <P> b", "x<S>y", "<<S", "<P", "S>", "über 😀 naïve wort  end ", "w " * 60_000, "z" * 300_000]
    texts += ["".join(r.choice(["wort", " ", "\n", "\t", "<", "P>", "<M", "é", "😀"]) for _ in range(r.randrange(40))) for _ in range(120)]
    rows = [(i, t, "x", i, "own") for i, t in enumerate(texts)] + [(None, "no id here at all", "x", 0, "own"), (7, "a again and again", "y", 1, "own"), (7, "a again and again", "y", 1, "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int, kept string")
    out = fill_middle.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "kept", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted([(g.doc_id, g.n, g.form, g.prefix_chars, g.middle_chars, g.output) for g in got], key=key) == sorted([by_hand(i, t) for i, t, *_ in rows], key=key)
    assert all(g.back == (g.text or "") and g.kept == "own" for g in got)
    assert {g.form for g in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_license_positions"])
def test_query_equals_its_sql(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duck.sql(registry.oracle_sql()[name]).df()
    order = ["doc_id"]
    got, want = (x[sorted(x.columns)].sort_values(order).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


# op12


def license_docs():
    r = random.Random(5)
    text = dict((label, t) for label, t, _ in licenses.TEMPLATES)
    filler = lambda n: " ".join(r.choice("mit der und license public general the of software".split()) for _ in range(n))
    moved = text["gpl-notice"].split()
    cut = text["isc"].split()
    docs = [
        None, "", "!!! ---", "MIT License", "mit-license, MIT\nLICENSE; the mit  license.", "submit license mitlicense", "GNU General Public License, version 3.",
        "general public general public license license", text["mit-text"].title(), "x " * 500 + text["bsd"] + " y" * 500, "émit license MIT licensé mit license",
        " ".join([*moved[:8], "kindly", *moved[8:]]), " ".join(cut[: len(cut) // 3]), text["apache-2.0-notice"].replace("kind", "sort"), "Licensed under CC BY-NC 4.0.", "mit license " * 3000,
    ]
    return docs + [filler(r.randrange(1, 80)) for _ in range(80)]


def test_op12_base_places_and_planted_texts(spark):
    texts = license_docs()
    rows = [(i if i != 3 else None, t, "en", "s", 1.0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[4]], "doc_id long, text string, lang string, words string, score double")
    got = licenses.license_scan(docs).collect()
    assert len(got) == len(rows) + 1
    assert sum(g.doc_id == 4 for g in got) == 2
    by = {g.doc_id: g for g in got}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        g = by[i]
        want = (len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places})))
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == want
        assert set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) and 0 <= g.score <= 1
    assert [by[k].labels for k in (6, 8, 9, 11, 14)] == ["gpl,gpl-3.0", "mit-text", "bsd", "gpl,gpl-notice", "cc-by-nc"]
    assert by[12].labels == by[13].labels == "" and by[12].score <= 0.5 and 0 < by[13].score <= 0.5
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_op12_looks_up_the_rarest_words_of_the_corpus():
    counts = {"license": 3, "mit": 90, "apache": 1, "general": 50, "public": 70}
    _, postings = licenses.index(100, counts)
    own = {p["template"]: p["word"] for p in postings if p["template"] < 3}
    assert own == {0: "license", 1: "apache", 2: "license"}


# op13


def by_dense_solver(vectors, most=16):
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    return n, [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x], ((n * x - s) / n) @ q / np.sqrt(e), e / np.trace(v)


def test_op13_equals_a_dense_solver(spark):
    r = np.random.default_rng(4)
    vectors = r.standard_normal((300, 24)) * np.linspace(3, 0.2, 24)
    vectors[100:200] = vectors[0]  # one vector in a third of all rows
    rows = [(i, list(map(float, v)), i, "x") for i, v in enumerate(vectors)]
    odd = [(900, None), (901, [1.0, None] + [0.0] * 22), (902, [float("nan")] + [0.0] * 23), (903, [float("-inf")] + [0.0] * 23), (904, [])]
    frame = spark.createDataFrame([*rows, *((i, v, 0, "y") for i, v in odd)], "vec_id long, embedding array<double>, n int, whitened string").repartition(7)
    got = whitening.whitened_components(frame).toPandas()
    assert got.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n, deviation, want, explained = by_dense_solver(vectors)
    assert n == 200 and len(got) == 300 * 16 and (got.n == n).all()
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[range(300)].to_numpy()
    sign = np.sign((table * want).sum(0))
    assert np.abs(table * sign - want).max() < 1e-8
    assert got[got.component == 1].set_index("vec_id").loc[range(300)].deviation.tolist() == deviation
    assert np.allclose(got[got.vec_id == 5].sort_values("component").explained, explained, rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    again = whitening.whitened_components(frame.repartition(3)).toPandas()
    key = ["vec_id", "component"]
    one, other = (x.sort_values(key).reset_index(drop=True) for x in (got, again))
    pd.testing.assert_frame_equal(one[[*key, "n", "deviation", "explained"]], other[[*key, "n", "deviation", "explained"]], check_exact=True)
    assert np.abs(one.whitened - other.whitened).max() < 1e-12


def test_op13_lengths_copies_and_rows_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [0.5, 1.0]), (None, [0.5, 2.0]), (1, [0.5, 1.0]), (4, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.0]), (6, [3e38, 0.0, 0.0, 0.0]), (7, [0.0, 0.0, 0.0, 0.0])]
    got = whitening.whitened_components(spark.createDataFrame(rows, schema)).collect()
    two = [g for g in got if g.n == 2 and abs(g.deviation) < 1 << 40]
    assert sorted(round(g.whitened, 9) for g in two) in ([-1, -1, 1], [-1, 1, 1]) and {g.component for g in got} == {1}
    assert [g.deviation for g in got if g.vec_id in (6, 7)] == [(1 << 63) - 1] * 2  # and three numbers alike have no variance
    assert {g.vec_id for g in got} == {1, None, 6, 7}
    assert whitening.whitened_components(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("values", [[5, 5, 5, 4, 4, 1] + [0.1] * 24, [1e6, 1e-3] + [1e-9] * 18, list(np.linspace(1, 2, 40)), [1] * 8, [3, 3 - 1e-9, 3 - 2e-9] + [1] * 22, [2, 1] + [0] * 18, [7]])
def test_slicing_numbers_equal_and_close_eigenvalues(values):
    q, _ = np.linalg.qr(np.random.default_rng(len(values)).standard_normal((len(values), len(values))))
    v = (q * np.array(values, float)) @ q.T
    v = (v + v.T) / 2
    e, y = whitening.leading(v, 16)
    want = [x for x in sorted(values, reverse=True)[:16] if x > 1e-9]
    many = len(e)
    assert many >= len(want) and np.allclose(e[: len(want)], want, rtol=1e-6, atol=1e-9 * max(values))
    assert np.abs(y @ y.T - np.eye(many)).max() < 1e-12 and np.abs(y @ v - e[:, None] * y).max() < 1e-12 * max(values) * len(values)


def test_inertia_counts_equal_sorted_eigenvalues():
    r = np.random.default_rng(8)
    for d in (1, 2, 7, 30):
        a = r.standard_normal((d, d))
        a = a + a.T - np.diag(np.diag(a)) * (d % 2)
        e = np.linalg.eigvalsh(a)
        for shift in [*r.uniform(e[0] - 1, e[-1] + 1, 20), 0.0]:
            assert whitening.under(a, shift) == int((e < shift).sum())


# op3: learning


def test_op3_learns_what_two_terms_mean_together(spark):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(1500):
        has = r.choice([(True, True), (True, False), (False, True), (False, False)])
        w = [r.choice("river house green walks slowly bread paper winter".split()) for _ in range(12)] + ["insultus"] * has[0] + ["groupa"] * has[1]
        r.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 0, int(has == (True, True))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity_scores(docs, known).collect()}
    held = [(got[i].predicted, y) for i, _, y in labels if got[i].held_out]
    assert len(held) > 200 and sum(p == y for p, y in held) >= 0.98 * len(held)
    # no rule that adds up one weight a word can tell these apart as well as they are
    assert got[0].score == [x.score for x in toxicity.toxicity_scores(docs.repartition(3), known).where("doc_id = 0").collect()][0]


def test_op3_slopes_equal_differences_of_the_loss():
    r = np.random.default_rng(1)
    d, f = np.repeat(np.arange(6), 3), np.concatenate([r.choice(5, 3, replace=False) for _ in range(6)])
    y = r.integers(0, 2, 6).astype(float)
    # one plain step of the machine equals one step along numeric slopes, in sign, for every parameter that has a slope
    b, w, v = toxicity.machine(d, f, y, 5, rounds=1, step=1e-6, decay=0.0)
    start = np.random.default_rng(5).normal(0, 0.02, (toxicity.FACTORS, 5))

    def loss(b, w, v):
        z = np.array([b + w[f[d == i]].sum() + sum((v[k, f[d == i]].sum() ** 2 - (v[k, f[d == i]] ** 2).sum()) / 2 for k in range(len(v))) for i in range(6)])
        return np.mean(np.log1p(np.exp(z)) - y * z)

    e = 1e-6
    for j in range(5):
        up = np.zeros(5)
        up[j] = e
        assert np.sign(w[j]) == -np.sign(loss(0, up, start) - loss(0, -up, start))
        for k in range(toxicity.FACTORS):
            more = start.copy()
            more[k, j] += e
            less = start.copy()
            less[k, j] -= e
            slope = (loss(0, np.zeros(5), more) - loss(0, np.zeros(5), less)) / (2 * e)
            if abs(slope) > 1e-7:
                assert np.sign(v[j, k] - start[k, j]) == -np.sign(slope)
