"""Token alignment, URL templates and embedding whitening against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.llm import alignment, exact_dedup, queries, substrings, url_templates, whitening
from weftwork.llm.common import table


# --- token alignment


@pytest.fixture(scope="module")
def own():
    return alignment.Aligner()


def plain_alignment(own, text):
    """A's ids, B's ids, and groups as (ids of A, ids of B, end), by walking token ends of the whole text."""
    if not text:
        return [], [], []
    a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text, num_threads=1)
    ends, raw = [], (" " + text).encode()
    for ids, names in ((a, own.bytes_a), (b, own.bytes_b)):
        if b"".join(names[i] for i in ids) != raw:
            return [], [], []
        ends.append(np.cumsum([len(names[i]) for i in ids]).tolist())
    groups, i, j = [], 0, 0
    for c in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(c, i) + 1, ends[1].index(c, j) + 1
        groups.append((a[i:k], b[j:m], c))
        i, j = k, m
    return a, b, groups


def plain_scores(own, rows):
    found = [(i, *plain_alignment(own, t)) for i, t in rows]
    counts = Counter()
    for _, _, _, groups in found:
        counts.update({(x, y) for ga, gb, _ in groups for x in ga for y in gb})
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    for i, a, b, groups in found:
        links = [(x, y) for ga, gb, _ in groups for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb, _ in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if a else ""
        yield i, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), sha


ODD = [None, "", " ", "  ", "a ", " a", "a  b", "\n a ", "a\n b", "\t \t", "x" * 3000, "ab" * 900, "▁a", "a\x00b c", "<s> <|endoftext|> <0x41>", "한국어 ﬁ ½ é\xa0 z", "a\x1c b\x85 c", "don't  we'll\u3000 x", "\ufeffa b", "ñandú œuvre straße", "12 345,6 7"]
COLUMNS = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def test_op11(spark, sf, own):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in queries.op11_token_alignment(spark, sf).collect()}
    assert got == set(plain_scores(own, rows))


def test_alignment_of_odd_texts(spark, own):
    rows = [(k if k % 5 else None, t) for k, t in enumerate([*ODD, *ODD[4:9], "word " * 9000])]
    docs = spark.createDataFrame([(i, t, "e", 1) for i, t in rows], "doc_id long, text string, `a.b` string, keys int").repartition(3)
    got = alignment.scores(docs).collect()
    want = list(plain_scores(own, rows))
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert not any(x[1] for x in want[:2]) and sum(x[1] > 0 for x in want) > 20


def test_alignment_groups_and_links(spark, own):
    texts = [t for t in ODD if t] + ["The straightforward cat sat antidisestablishmentarianly."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in alignment.align(docs).collect():
        a, b, groups = plain_alignment(own, texts[r.doc_id])
        assert (r.a_ids, r.b_ids) == (a, b)
        assert [tuple(g) for g in r.groups] == [(end, len(ga), len(gb)) for ga, gb, end in groups]
    links = alignment.links(docs).collect()
    want = Counter(p for t in texts for p in {(x, y) for ga, gb, _ in plain_alignment(own, t)[2] for x in ga for y in gb})
    assert {(r.a_id, r.b_id): r.docs for r in links} == want


def test_alignment_by_blocks(spark, own, monkeypatch):
    """Many small blocks, steps and stores give what one gives; so do vocabularies that take whole texts."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["the", "cat", "prüfung", "xyzzy", "of", "\n"]) for _ in range(rng.randrange(40)))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    batches = docs.select("doc_id", "text").toArrow().to_batches()
    whole = alignment.Aligner()
    whole.whole, whole.rank = True, None
    monkeypatch.setattr(alignment, "STEP", 50)
    for texts in ([t for _, t in rows], ODD[1:]):
        for x in texts:
            n, of, _ = alignment.sound_runs(own, [x])
            m, _, _ = alignment.sound_runs(whole, [x])
            assert b";".join(own.texts[i] for i in n) == b";".join(whole.texts[i] for i in m)
    assert sum(len(t) for _, t, _ in alignment.steps(batches)) == 60 and len(list(alignment.steps(batches))) > 5
    monkeypatch.setattr(alignment, "SMALL", 1)
    again = alignment.Aligner()
    for x in ODD[1:]:
        n, _, _ = alignment.sound_runs(again, [x])
        m, _, _ = alignment.sound_runs(own, [x])
        for p, q in ((n, m),):
            k, w = alignment.counted(again.pairs.values[0][again.pairs.places(p)], again.pairs.values[1][again.pairs.places(p)])
            k2, w2 = alignment.counted(own.pairs.values[0][own.pairs.places(q)], own.pairs.values[1][own.pairs.places(q)])
            assert k.tolist() == k2.tolist() and w.tolist() == w2.tolist()


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.scores(docs).count() == 0 == alignment.links(docs).count() == alignment.align(docs).count()
    nulls = spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")
    assert [tuple(r) for r in alignment.scores(nulls).collect()] == [(None, 0, 0, 0, 0, 0, 0, "")] * 3


# --- URL templates


def hold(spark, rows, rules=url_templates.RULES):
    """The operator's rows over (page_id, url), and those of its SQL."""
    pages = spark.createDataFrame(rows, "page_id long, url string")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    if rows:
        con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    show = lambda rs: Counter(map(tuple, rs))
    got = url_templates.judge(pages, rules=rules).drop("blocked_share").collect()
    assert show(got) == show(con.execute(url_templates.sql(rules)).fetchall())
    return got


def test_url_rules_and_odd_rows(spark):
    urls = [None, "", "no scheme", "://", "http://", "http://A.Example.ORG", "http://example.org/es/1", "http://xexample.org/es/1", "https://a.example.org/en/12", "https://a.example.org/en/2", "http://ÀB.com/fr/?q=/de/", "ftp://x.com/de/a#b", "http://x.com?u=http://y.org/", "http://x.org//a///b//", "http://u@x.com:80/de/" + "a" * 5000, "http://h.net/" + "/".join("ab" * 3 for _ in range(500)), "http://h.net/%41/b", "http://h.net/new\nline/x", "a://b://c/d"]
    got = {r.page_id: r for r in hold(spark, [(k, u) for k, u in enumerate(urls)] + [(7, urls[7]), (None, urls[8])])}
    assert [(got[k].host, got[k].path) for k in range(5)] == [("", "")] * 5
    assert (got[5].host, got[5].path, got[5].rule) == ("a.example.org", "", None)
    assert [(got[k].rule, got[k].verdict) for k in range(6, 12)] == [("example.org/es/", "block"), ("org/", "allow"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block")]
    assert got[10].host == "Àb.com" and got[13].path == "//a///b//" and got[18].host == "b:"
    assert hold(spark, []) == []


def test_url_templates_learn(spark):
    """A branch that rules block on its own becomes a template of its own, and takes what rules leave with it."""
    rules = (("shop.net", "/deals/old", "block"), ("shop.net", "/news/", "allow"), ("shop.net", "/blog/", "allow"))
    rows = [f"http://shop.net/deals/old{k}" for k in range(40)] + [f"http://shop.net/news/{k}" for k in range(60)] + [f"http://shop.net/blog/{k}" for k in range(60)]
    rows += [f"http://shop.net/deals/2{k}" for k in range(20)] + ["http://other.net/deals/3"] + [f"http://shop.net/u/name{chr(97 + k % 26)}x{'abc'[k % 3]}" for k in range(50)]
    got = {u: r for u, r in zip(rows, sorted(hold(spark, list(enumerate(rows)), rules), key=lambda r: r.page_id), strict=True)}
    assert got["http://shop.net/deals/23"].verdict == "block" and got["http://shop.net/deals/23"].template == "/deals/*/"
    assert got["http://other.net/deals/3"].verdict == "allow"
    # the branches of one kind are one
    assert got["http://shop.net/news/1"].template == got["http://shop.net/blog/1"].template


def test_url_templates_equal_sql_on_random_trees(spark):
    rng = random.Random(8)
    words = ["en", "de", "fr", "tag", "a-very-long-slug-of-an-article", "p7", "x", "y"]
    rows = [(k, f"http{'s' * (k % 2)}://{rng.choice(['a.example.org', 'b.com', 'c.net', 'd.b.com'])}/" + "/".join(rng.choice(words) + rng.choice(["", "", str(k)]) for _ in range(rng.randrange(7)))) for k in range(3000)]
    got = hold(spark, rows)
    assert len({r.template for r in got}) > 5


# --- whitening


def plain_whitening(vectors):
    x = np.floor(np.array(vectors, float) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), c @ u / np.sqrt(e), e / np.trace(v)


def test_op13(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, white, explained = plain_whitening([r.embedding for r in rows])
    got = queries.op13_embedding_whitening(spark, sf).toPandas()
    assert len(got) == 32 * n and (got.n == n).all() and got.identity_error.max() < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened")
    assert wide.index.tolist() == [r.vec_id for r in rows] and wide.columns.tolist() == list(range(1, 33))
    assert got.drop_duplicates("vec_id").set_index("vec_id").deviation.loc[wide.index].tolist() == deviation.tolist()
    for k in range(32):
        one = wide[k + 1].to_numpy()
        assert np.abs(one * np.sign(one @ white[:, k]) - white[:, k]).max() < 1e-6
        assert got[got.component == k + 1].explained.iloc[0] == pytest.approx(explained[k], rel=1e-9)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = (rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3))).tolist()
    bad = [None, [1.0, None, 2.0], [math.nan, 0.0, 0.0], [math.inf, 0.0, 0.0], [], [1.0], [1.0, 2.0]]
    rows = [(k if k % 7 else None, v, 0) for k, v in enumerate(good + bad)]
    table_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened int").repartition(40)
    out = whitening.components_of(table_)
    n, deviation, _, explained = plain_whitening(good)
    got = out.toPandas()
    assert len(got) == 3 * n and (got.n == n).all() and got.identity_error.max() < 1e-9
    assert Counter(got[got.component == 1].deviation) == Counter(deviation.tolist())
    assert sorted(set(got.explained)) == pytest.approx(sorted(explained), rel=1e-9)


def test_whitening_without_variance(spark):
    for vs in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, [math.nan]]):
        assert whitening.components_of(spark.createDataFrame([(1, v) for v in vs], "vec_id long, embedding array<float>")).count() == 0
    # one direction only: one component
    got = whitening.components_of(spark.createDataFrame([(k, [float(k), float(2 * k)]) for k in range(9)], "vec_id int, embedding array<double>")).toPandas()
    assert got.component.tolist() == [1] * 9 and got.explained.iloc[0] == pytest.approx(1)


def test_whitening_of_large_numbers(spark):
    rows = [(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [3e6, 5.0]), (3, [-3e6, 7.0])]
    model_rows = whitening.components_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()
    xs = np.array([[(1 << 52) + 1_000_000, 1_000_000], [-(1 << 52) + 1_000_000, 1_000_064], [192_000_000 + 1_000_000, 1_000_320], [-192_000_000 + 1_000_000, 1_000_448]], object)
    n, s = 4, xs.sum(axis=0)
    want = [sum((n * v - t) ** 2 for v, t in zip(x, s, strict=True)) for x in xs]
    assert {r.vec_id: r.deviation for r in model_rows} == {k: w if w < 1 << 63 else None for k, w in enumerate(want)}


def test_symmetric_qr():
    rng = np.random.default_rng(4)
    for d in (1, 2, 7, 90):
        for a in (rng.normal(size=(d, d)), np.ones((d, d)), np.diag(rng.integers(0, 3, d).astype(float))):
            v = a + a.T
            e, u = whitening.symmetric_qr(v)
            size = max(1.0, np.abs(v).max() * d)
            assert np.abs(e - np.linalg.eigvalsh(v)[::-1]).max() < 1e-13 * size
            assert np.abs(v @ u - u * e).max() < 1e-13 * size and np.abs(u.T @ u - np.eye(d)).max() < 1e-12


def test_moments_merge_like_one_stream():
    x = np.random.default_rng(5).normal(size=(500, 6)) + 1e3
    whole_, out = whitening.Moments(6), whitening.Moments(6)
    for r in x:
        whole_.add(r)
    for part in np.split(x, [3, 3, 200]):
        m = whitening.Moments(6)
        for r in part:
            m.add(r)
        out.merge(m.n, m.mean, m.m2)
    assert out.n == 500 and np.allclose(out.m2, whole_.m2, rtol=1e-12) and np.allclose(out.mean, x.mean(axis=0))


def test_new_queries_read_whole_tables(spark, sf):
    assert queries.op12_url_templates(spark, sf).count() == table(spark, sf, "pages").count()
    assert queries.op13_embedding_whitening(spark, sf).select(F.countDistinct("vec_id")).first()[0] == table(spark, sf, "embeddings").count()


# --- repeated rows of earlier operators


def test_exact_dedup_settles_ties_alike(spark):
    rows = [(1, "a b", "x", {"k": 1}), (1, "a  b", "y", None), (1, "a\tb", "z", {"k": 2}), (1, "a\tb", None, {"k": 3}), (2, "a b", "w", None), (3, None, "n", None), (3, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `lang.x` string, m map<string,int>")
    got = {tuple(map(str, sorted(map(str, exact_dedup.deduplicate(docs.orderBy(*order).repartition(n)).collect())))) for n, order in ((1, ["text"]), (3, ["`lang.x`"]), (7, ["doc_id"]), (1, [F.desc("text"), F.desc("`lang.x`")]))}
    assert len(got) == 1 and len(next(iter(got))) == 2


def test_repeated_rows_keep_their_spans_once(spark):
    """Thousands of equal rows: each is removed whole, in time that grows with their number."""
    text = " ".join(f"w{k}" for k in range(400))
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(4)
    began = time.time()
    got = substrings.remove_repeats(docs).groupBy("n_removed", "n_spans").count().collect()
    assert [tuple(r) for r in got] == [(len(text), 1, 4000)] and time.time() - began < 60
