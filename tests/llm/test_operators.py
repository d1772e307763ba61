"""Each corpus operator against a plain version of itself, and on rows that are easy to trip over."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftwork.llm import bpe, decontaminate, exact_dedup, features, lines, minhash, ppm, quality, substrings, token_files, toxicity
from weftwork.llm.components import components, led

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
UP = {a: a + 32 for a in range(65, 91)}
SPACE = r"[\x20\x09-\x0D]+"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))


def prose(rng, n, vocab=None):
    vocab = vocab or [f"w{i}" for i in range(3000)]
    return " ".join(rng.choice(vocab) for _ in range(n))


def corpus():
    rng = random.Random(5)
    base = prose(rng, 200)
    near = base.split()
    near[50] = "changed"
    rows = [
        (1, base),
        (2, base.replace(" ", "\n\t ", 3)),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "x" * 70_000),
        (8, "one"),
        (8, "one"),
        (9, "One two three"),
        (None, base),
        (11, prose(rng, 3000)),
        (12, "Ünïcode ΣΑΣ 한국어 <|endoftext|> é \x1c \x85"),
        (13, base + " " + prose(rng, 40)),
    ]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 4 ------------------------------------------------------------------------------------


def test_exact_groups(docs, empty):
    norm = {}
    for i, t, *_ in corpus():
        norm.setdefault(re.sub(SPACE, " ", t or ""), []).append(i)
    names = ["keep_id", "GROUP_size", "kept", "ties", "text_sha256", "_sha", "_keep", "_size", "_ties", "_kept", "_text_sha256", "__sha", "sha", "body", "n", "a.b"]
    clash = docs.select("*", *[F.concat(F.lit("u"), F.col("doc_id")).alias(c) for c in names])
    left = exact_dedup.deduplicate(clash)
    assert left.columns == clash.columns and left.count() == len(norm)
    assert all(r[c] == (None if r.doc_id is None else f"u{r.doc_id}") for r in left.collect() for c in names)
    got = exact_dedup.groups(clash).collect()
    assert len(got) == len(corpus()) and all(r["_sha"] == (None if r.doc_id is None else f"u{r.doc_id}") for r in got)
    for r in got:
        t = re.sub(SPACE, " ", r.text or "")
        ids = [i for i in norm[t] if i is not None]
        assert r.keep_id == min(ids) and r.group_size == len(norm[t]) and r.kept == (r.doc_id == min(ids))
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(norm)
    assert exact_dedup.groups(empty).count() == 0 == exact_dedup.deduplicate(empty).count()


@pytest.mark.parametrize("budget", [1, 2000, 1 << 20])
def test_trie_spills_by_subtree(budget):
    rng = random.Random(budget)
    keys = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) * rng.randint(1, 40) for _ in range(600)]
    trie, want = exact_dedup.PatriciaTrie(budget), {}
    for n, k in enumerate(keys):
        trie.add(k, n)
        want.setdefault(k, []).append(n)
    got = {k: (best, rows) for k, best, rows, _ in trie.items()}
    assert got == {k: (min(v), len(v)) for k, v in want.items()}


# ---- 5 ------------------------------------------------------------------------------------


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        runs = len(re.findall(rb"\x01+", bytes(mark)))
        out.append((len(t), sum(mark), runs, hashlib.sha256(bytes(b for b, m in zip(t, mark, strict=True) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("shard,hot", [(1 << 20, 20_000), (3000, 20_000), (3000, 2)])
def test_substrings(spark, shard, hot):
    rng = random.Random(1)
    base = "".join(rng.choices("abcdefgh ", k=900))
    texts = [base[(a := rng.randint(0, 400)) : a + rng.randint(100, 500)] + "".join(rng.choices("abcdefgh ", k=100)) for _ in range(40)]
    texts += ["a" * 700, "", "xyz" * 150, "é" * 300, base, base]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(df, shard=shard, hot=hot).collect()}
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts], 200)))


def truncated(rng, letters):
    """Passages that end a text, or its copy, or go on differently."""
    texts = []
    for _ in range(12):
        base = "".join(rng.choices(letters, k=rng.randint(500, 900)))
        texts += [base, base[: rng.randint(210, 480)], base[: rng.randint(210, 480)] + "".join(rng.choices(letters, k=150)), base[rng.randint(10, 200) : 490]]
    return texts


@pytest.mark.parametrize("shard", [1 << 20, 3000])
def test_substrings_of_truncated_copies(spark, shard):
    texts = truncated(random.Random(21), "ab")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(df, shard=shard).collect()}
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts], 200)))


@pytest.mark.parametrize("letters,length", [("ab", 200), ("abcdefghijklmno", 200), ("ab", 40), ("a", 200)])
def test_windows_shared_in_a_shard(letters, length):
    for seed in range(6):
        bodies = [t.encode() for t in truncated(random.Random(seed), letters)]
        shard = substrings.Shard([(0, i, 0, 0, len(b) - length + 1, b) for i, b in enumerate(bodies)], length)
        seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
        for begin, b in zip(shard.begin.tolist(), bodies, strict=True):
            places = range(len(b) - length + 1)
            assert shard.shared[begin : begin + len(places)].tolist() == [seen[b[i : i + length]] > 1 for i in places]


def test_substrings_odd_rows(docs, empty):
    got = substrings.remove_repeats(docs.withColumn("k1", F.lit(1)), keep_text=True).collect()
    assert len(got) == len(corpus()) and substrings.remove_repeats(empty).count() == 0
    assert {r.n_bytes for r in got if r.doc_id in (4, 5)} == {0}
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in (1, 9, 300):
        t = rng.integers(97, 99, n).astype(np.uint8)
        raw = t.tobytes()
        order, _ = substrings.suffix_array(t, 20)
        assert sorted(order.tolist()) == list(range(n))
        assert all(raw[a : a + 20] <= raw[b : b + 20] for a, b in zip(order, order[1:], strict=False))


# ---- 8 ------------------------------------------------------------------------------------


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(12):
        base = prose(rng, rng.choice([3, 6, 30, 120, 400])).split()
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(["alpha", "beta"])
            rows.append((n, " ".join(w)))
            n += 1
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    rng = random.Random(4)
    base = prose(rng, 150).split()
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(i % 9):
            w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    for name, value in (("BLOCK", 7), ("STAR", 3), ("BLOCK_BYTES", 9000)):
        monkeypatch.setattr(minhash, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows)


@pytest.mark.parametrize("small,large", [(3, 4), (12, 16), (48, 64), (63, 84), (66, 88), (150, 200)])
def test_bands_meet_at_the_threshold(small, large):
    """Pairs whose similarity is 0.75 exactly share a band, for sets of few shingles as well."""
    rng = np.random.default_rng(small)
    for _ in range(1500):
        y = np.unique(rng.integers(0, 1 << 64, large, dtype=np.uint64))
        x = np.sort(rng.choice(y, small, replace=False))
        assert len(np.intersect1d(minhash.band_keys(x), minhash.band_keys(y)))
        assert minhash._linked(x, y, 75)


def test_bands_of_unrelated_small_sets():
    """Sets of one to three shingles share no band unless a shingle is shared."""
    rng = np.random.default_rng(3)
    keys = np.concatenate([minhash.band_keys(np.unique(rng.integers(0, 1 << 64, 1 + k % 3, dtype=np.uint64))) for k in range(3000)])
    assert np.unique(keys, return_counts=True)[1].max() <= 2


def test_near_duplicates_repeated_ids_and_clashing_columns(spark):
    rng = random.Random(14)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (1, b), (2, a), (3, b + " end"), (3, b + " end"), (4, None), (None, a), (5, prose(rng, 60)), (5, "short one")]
    names = ["_gone", "_twice", "_n", "_row", "_key", "_hash", "_place", "id", "hash", "n", "label", "a", "b", "g", "component_id", "KEPT"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.concat(F.lit("u"), F.col("doc_id")).alias(c) for c in names])
    out = minhash.deduplicate(docs)
    assert out.columns == docs.columns
    kept = sorted((str(r.doc_id), r.text or "") for r in out.collect())
    assert kept == sorted([("1", a), ("1", b), ("4", ""), ("None", a), ("5", rows[7][1]), ("5", "short one")])
    assert all(r[c] == (f"u{r.doc_id}" if r.doc_id is not None else None) for r in out.collect() for c in names)


def test_near_duplicates_odd_rows(docs, empty):
    got = minhash.near_duplicates(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == len(corpus())
    assert by[3][0].component_id == 1 and by[4][0].component_id == 4 and by[4][0].n_shingles == 0
    assert by[None][0].component_id is None and by[None][0].kept
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()).count("8") == 1
    assert minhash.near_duplicates(empty).count() == 0 == minhash.deduplicate(empty).count()


def test_estimate_corrects_collisions():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2))
    b = np.concatenate([a[:2000], np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))])
    assert abs(float(minhash.estimate(minhash.registers(a), minhash.registers(np.unique(b)))) - 1 / 3) < 0.1


@pytest.mark.parametrize("leaders", [False, True])
def test_leaders_of_buckets(leaders):
    rng = random.Random(6)
    for _ in range(200):
        rows = sorted((rng.randrange(6), rng.randrange(5)) for _ in range(rng.randrange(30)))
        cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(3))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        got = [r for b in led((pa.record_batch([pa.array([x[k] for x in p], pa.int64()) for k in (0, 1)], names=["k", "id"]) for p in parts), leaders) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        ids = {k: sorted({i for b, i in rows if b == k}) for k, _ in rows}
        assert sorted(got) == sorted((k, v[0], i) for k, v in ids.items() if len(v) > 1 for i in v[0 if leaders else 1 :])


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 300), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in (100, 200, 300)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 3 ------------------------------------------------------------------------------------


def levenshtein(a, b):
    """Myers' bit vectors."""
    if not a or not b:
        return len(a) + len(b)
    places = defaultdict(int)
    for i, x in enumerate(a):
        places[x] |= 1 << i
    full, top, up, down, score = (1 << len(a)) - 1, 1 << len(a) - 1, (1 << len(a)) - 1, 0, len(a)
    for x in b:
        same = places.get(x, 0)
        across = (((same & up) + up) ^ up) | same | down
        rise, fall = (down | ~(across | up)) & full, up & across
        score += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = (fall | ~(same | down | rise)) & full, rise & (same | down)
    return score


def test_levenshtein():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        return row[-1]

    rng = random.Random(0)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(2))
        d = plain(a, b)
        assert levenshtein(a, b) == d
        assert all(lines.within(a, b, room) == (d <= room) for room in range(14))
    for _ in range(200):
        a = "".join(rng.choices("abcdef ", k=rng.randint(60, 200)))
        b = edited(rng, a, rng.randint(0, 25))
        d = plain(a, b)
        assert all(lines.within(a, b, room) == (d <= room) for room in (0, 3, 9, d - 1, d, d + 1, 30) if room >= 0)


def plain_norm(line):
    return re.sub(r"[^a-z0]+", " ", re.sub("[1-9]", "0", line.lower())).strip()


def brute_lines(rows):
    """Groups of lines by edit similarity alone: no hashes, no buckets, no gate."""
    norm = {(i, j): plain_norm(x) for i, t in rows if t is not None for j, x in enumerate(t.split("\n"))}
    first = {}
    for k in sorted(norm):
        if norm[k]:
            first.setdefault(norm[k], k)
    parent = {k: k for k in first.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    heads, links = list(first.items()), []
    for m, (s, a) in enumerate(heads):
        for t, b in heads[:m]:
            room = int(max(len(s), len(t)) * (1 - lines.SIMILARITY) + 1e-9)
            if abs(len(s) - len(t)) <= room and levenshtein(s, t) <= room:
                links.append((a, b))
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return norm, links, {k: find(first[n]) if n else k for k, n in norm.items()}


def test_lines(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(200)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 60))) for _ in range(30)]
    rows = [(i, "\n".join(rng.choice([str.upper, str.lower, lambda s: s + "!", lambda s: s[:-1] + "q"])(rng.choice(base)) for _ in range(4))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "\n\n--\n")]
    got = {(r.doc_id, r.line_no): r for r in lines.occurrences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    norm, _, want = brute_lines(rows)
    assert set(got) == set(norm)
    for k, r in got.items():
        assert (r.group_doc_id, r.group_line_no) == want[k] and r.kept == (k == want[k])


def edit_words(rng, ws, kind, share):
    ws = list(ws)
    for p in rng.sample(range(len(ws)), max(1, round(len(ws) / share))):
        w = ws[p]
        if kind == "typo":
            i = rng.randrange(len(w))
            ws[p] = rng.choice([w[:i] + rng.choice("abcdefghijklm") + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdefghijklm") + w[i:]])
        elif kind == "drop":
            ws[p] = ""
        elif kind == "replace":
            ws[p] = "".join(rng.choices("abcdefghijklm", k=len(w)))
        elif p + 1 < len(ws):
            ws[p], ws[p + 1] = ws[p + 1], ws[p]
    return " ".join(filter(None, ws))


def test_lines_recall_against_all_pairs(spark):
    """Lines with one word in fifteen edited, held against every pair by edit distance alone."""
    rng, rows = random.Random(17), []
    syllables = ["the", "ing", "er", "on", "an", "re", "nd", "th", "st", "ea", "ou", "ti", "sh", "wh", "ly", "ble", "at", "in", "es"]
    vocab = ["the", "of", "and", "a", "is"] * 8 + ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(400)]
    for n in range(160):
        ws = rng.choices(vocab, k=rng.choice([5, 8, 12, 20, 35, 60]))
        rows += [(2 * n, " ".join(ws)), (2 * n + 1, edit_words(rng, ws, ["typo", "drop", "replace", "swap"][n % 4], 15))]
    _, links, want = brute_lines(rows)
    assert len(links) > 120
    got = {r.doc_id: (r.group_doc_id, r.group_line_no) for r in lines.occurrences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[a[0]] == got[b[0]] for a, b in links) / len(links)
    print("recall", found)
    assert found >= 0.93
    # no group holds lines that all pairs would leave apart
    assert all(want[(i, 0)] == want[g] for i, g in got.items())


def test_lines_in_small_blocks(spark, monkeypatch):
    """Lines of one bucket that are not like its leader meet block against block, and no bucket is paired up."""
    rng = random.Random(23)
    shared = " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(6))
    tails = [" ".join("".join(rng.choices("ijklmnopq", k=6)) for _ in range(5)) for _ in range(12)]
    rows = [(3 * k + e, shared + " " + (t if e == 0 else edited(rng, t, e))) for k, t in enumerate(tails) for e in range(3)]
    monkeypatch.setattr(lines, "ROWS", 4)
    monkeypatch.setattr(lines, "SLAB", 100)
    got = {(r.doc_id, r.line_no): (r.group_doc_id, r.group_line_no) for r in lines.occurrences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    _, _, want = brute_lines(rows)
    assert sum(got[k] == want[k] for k in want) >= len(want) - 2


def edited(rng, s, n):
    for _ in range(n):
        i = rng.randrange(len(s))
        s = rng.choice([s[:i] + rng.choice("abcdefghij") + s[i + 1 :], s[:i] + s[i + 1 :], s[:i] + rng.choice("abcdefghij") + s[i:]])
    return " ".join(s.split())


def test_lines_with_edits_are_linked(spark):
    """Recall of lines with an edit or two, all of which are similar enough by brute force."""
    rng, rows, pairs = random.Random(31), [], defaultdict(list)
    # words of a line, letters of a word, edits: least recall
    cases = {(10, 7, 1): 0.95, (10, 7, 2): 0.78, (30, 7, 1): 0.97, (30, 7, 2): 0.95, (100, 7, 2): 0.97, (5, 6, 1): 0.95, (30, 3, 1): 0.85, (3, 4, 1): 0.95}
    for case in cases:
        for _ in range(100):
            s = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvw", k=case[1])) for _ in range(case[0]))
            t, a = edited(rng, s, case[2]), len(rows)
            assert levenshtein(s[:250], t[:250]) <= 0.15 * max(len(s), len(t))
            rows += [(a, s), (a + 1, t)]
            pairs[case].append(a)
    base = ["".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(150)) for _ in range(20)]  # no blanks
    for t in base:
        pairs["letters"].append(len(rows))
        rows += [(len(rows), t), (len(rows) + 1, t[:70] + "字" + t[71:])]
    got = {r.doc_id: r.group_doc_id for r in lines.occurrences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {case: sum(got[a] == got[a + 1] == a for a in some) / len(some) for case, some in pairs.items()}
    print(found)
    assert all(found[case] >= least for case, least in (cases | {"letters": 0.9}).items())
    assert all(g == i - i % 2 or g == i for i, g in got.items() if i < 1600 - 200)


def test_lines_odd_rows(spark, docs, empty):
    assert lines.occurrences(docs).count() == sum(len(t.split("\n")) for _, t, *_ in corpus() if t is not None)
    assert lines.occurrences(empty).count() == 0 == lines.rewrite(empty).count()
    names = ["_gone", "_doc", "_row", "_lines", "key", "first", "lines", "a", "b", "doc_ID2"]
    out = lines.rewrite(docs.select("*", *[F.lit("u").alias(c) for c in names]))
    assert out.columns == docs.columns + names and out.count() == len(corpus())
    assert all(r[c] == "u" for r in out.collect() for c in names)
    rows = [(1, "one line of words here\nand another line of words"), (1, "something else altogether\none line of words here"), (None, "Something else altogether!"), (3, "one line of words here")]
    got = lines.rewrite(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.text) for r in got).count("") == 2
    assert sum("one line" in r.text for r in got) == 1 and sum("altogether" in r.text for r in got) == 1


def test_pairs_across_components():
    """Rows cut into batches anywhere, groups small and large, one block or two: each pair once, by hashes and lengths."""
    rng = np.random.default_rng(4)
    for large in (3, 70):
        rows, want = [], set()
        for bucket in range(12):
            two, n = bucket % 2, int(rng.integers(2, large + 5))
            base = rng.integers(-(1 << 62), 1 << 62, 4)
            mine = []
            for _ in range(n):
                sig = [int(x) ^ (1 << int(rng.integers(0, 60))) for x in base] if rng.random() < 0.6 else rng.integers(-(1 << 62), 1 << 62, 4).tolist()
                mine.append((bucket, 0, two, int(rng.integers(0, 1 + two)), len(rows) + len(mine), bytes([int(rng.integers(0, 3))]), int(rng.integers(80, 120)), *sig))
            for x, a in enumerate(mine):
                for b in mine[:x]:
                    bits = sum(bin((p ^ q) & (2**64 - 1)).count("1") for p, q in zip(a[7:], b[7:], strict=True))
                    if a[5] != b[5] and (not two or a[3] != b[3]) and abs(a[6] - b[6]) <= int(max(a[6], b[6]) * 0.15 + 1e-9) and bits <= lines.BITS:
                        want.add((b[4], a[4]))
            rows += mine
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), *[pa.int64()] * 4]
        whole = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f"c{k}" for k in range(11)])
        cuts = [0, *sorted(rng.integers(0, len(rows), 5).tolist()), len(rows)]
        got = [p for b in lines._apart((whole.slice(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False)), 0.85) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_near_lines_make_no_pairs(spark):
    """Lines that are near by hash and not linked: no table between the steps grows with their pairs, and links among them are found."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common, size = " ".join(word(11) for _ in range(24)), 80
    texts = [common + " " + " ".join(word(3) for _ in range(30)) for _ in range(size)]
    texts += [t[:-1] + "0" for t in texts[10:20]]
    rows: dict[str, int] = {}

    class Counted(lines.LineGroups):
        def kept_table(self, df, name):
            out = super().kept_table(df, name)
            rows[name] = max(rows.get(name, 0), out.count())
            return out

    got = {r.doc_id: r.group_doc_id for r in Counted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", 0.85).run().collect()}
    assert not any(lines.within(a, b, int(max(len(a), len(b)) * 0.15)) for k, a in enumerate(texts[:size]) for b in texts[:k])
    assert got == {k: k if k < size else k - size + 10 for k in range(len(texts))}
    assert rows["line-rest"] > size and max(rows.values()) <= 20 * len(texts) < size * (size - 1) / 2


def test_lines_of_any_length(spark):
    """A line of five megabytes, and its copy with one word changed, among short ones."""
    rng = random.Random(3)
    ws = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(k) for k in range(400_000)]
    long = " ".join(ws)
    ws[1000] = "omega"
    rows = [(0, long), (1, " ".join(ws)), (2, "alpha beta"), (3, "x" * 300_000)]
    assert len(long) > 4_000_000
    got = {r.doc_id: r.group_doc_id for r in lines.LineGroups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 1 - 1e-6).run().collect()}
    assert got[2] == 2 and got[3] == 3 and got[0] == 0


# ---- 7 and 10 -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(bpe.TOKENIZER)


def test_bpe_equals_library(docs, encoder):
    lib = encoder.library
    got = bpe.digests(docs.withColumn("n_tokens", F.lit("clash"))).collect()
    want = Counter()
    for i, t, *_ in corpus():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_bpe_round_trip(docs, empty, encoder):
    both = bpe.decode(bpe.encode(docs.where("doc_id in (1, 9)")))
    for r in both.collect():
        assert r.decoded.replace(" ", "") == "".join(r.text.lower().split())
    assert bpe.digests(empty).count() == 0


def test_bpe_streams_within_its_lookahead(encoder):
    table, rng = encoder.table, random.Random(1)
    pieces = [n.encode() for n in encoder.names if n.isascii() and n.isalpha()]
    for _ in range(40):
        w = b"".join(rng.choices(pieces, k=rng.randint(300, 500)))
        whole = table.settle([*map(table.start.__getitem__, w[:-1]), table.last[w[-1]]])
        assert [t for part in table.stream([w[:100], w[100:]]) for t in part] == whole


def test_library_encoder_equals_library(encoder):
    """Plain and odd chunks, stops, capitals and marks, with caches that overflow."""
    rng = random.Random(11)
    own = token_files.LibraryEncoder(bpe.TOKENIZER, 50)
    syllables = ["the", "ING", "\xe9r", "on'", "a.", "re,", "nd;", "42", "\xdf", "\u0130", "\xd7", "\xb2", "<|endoftext|>", "st!", "\u0301", "\u6f22", "-", "_", "x" * 50, "'s", "\xaa", "\u01c5", "A.", "\xc9!", "?!", ".."]
    for _ in range(60):
        texts = [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(0, 60))) for _ in range(4)]
        got = defaultdict(list)
        for i, raw in own.stream(texts):
            got[i] += own.unpack(raw)
        for i, t in enumerate(texts):
            want = encoder.library.encode(t, add_special_tokens=False).ids
            assert got[i] == want and encoder.encode(t) == want


def test_token_files_have_a_task_each(spark, tmp_path):
    folder = tmp_path.as_uri() + "/many"
    token_files.write(spark.createDataFrame([(i, "some words " * 50) for i in range(60)], "doc_id long, text string").repartition(4), folder, length=64, batch=2, file_ids=500)
    assert token_files.manifest(spark, folder).count() > 8
    assert token_files.files_of(spark, folder).rdd.getNumPartitions() == token_files.manifest(spark, folder).count()


def test_token_files(spark, docs, empty, tmp_path, encoder):
    folder = tmp_path.as_uri() + "/tokens"
    some = docs.where("doc_id is not null and doc_id <> 8")
    manifest = token_files.write(some.withColumn("start", F.lit(1)), folder, length=64, batch=2, file_ids=5000)
    assert manifest.count() > 1
    at, got = 0, {r.doc_id: r for r in token_files.read_digests(spark, folder).collect()}
    for i, t in sorted((i, t) for i, t, *_ in corpus() if i not in (None, 8)):
        ids = encoder.library.encode(t or "", add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    sequences = token_files.read_sequences(spark, folder).collect()
    assert all(len(r.ids) == 64 == len(r["mask"]) for r in sequences) and sum(sum(r["mask"]) for r in sequences) == at
    reader = token_files.Reader(folder, manifest.first()["name"])
    ids, mask = reader.sequence(0)
    assert not ids.flags.owndata and len(mask) == 64
    assert token_files.read_digests(spark, folder + "2").count() == 0 if token_files.write(empty, folder + "2") is not None else False


# ---- 1 ------------------------------------------------------------------------------------


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(12, 50)))) for i in range(20)] + [(90, None), (91, ""), (92, "alone")]
    rows = []
    for k in range(20):
        w = items[k][1].split()
        edited = [rng.choice(vocab) if j % 5 == 2 else x for j, x in enumerate(w)]
        rows += [(k, prose(rng, 80, vocab) + " " + items[k][1].upper() + "! " + prose(rng, 80, vocab)), (100 + k, " ".join(edited)), (200 + k, prose(rng, 120, vocab))]
    df = spark.createDataFrame(rows + [(300, None), (301, "")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (2_000_000, 100):
        got = {(r.doc_id, r.item_id): r.score for r in decontaminate.pairs(df, bench, block=block).collect()}
        assert {p for p in got if p[1] < 90} == {(k, k) for k in range(20)} | {(100 + k, k) for k in range(20)}
        assert all(got[(k, k)] == 1.0 for k in range(20))
    clean = decontaminate.decontaminate(df.withColumn("score", F.lit(1)), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [*range(200, 220), 300, 301]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.pairs(docs, none).count() == 0 == decontaminate.pairs(empty, bench).count()
    assert decontaminate.decontaminate(docs, none).count() == len(corpus())


def test_decontamination_recall():
    """Items with every third, fourth and fifth word changed, in words of unlike frequency; no Spark."""
    rng = random.Random(4)
    vocab = [f"{k:x}z" for k in range(20_000)]
    weights = [1 / (k + 5) for k in range(len(vocab))]
    items = [(i, rng.choices(vocab, weights, k=rng.randint(15, 50))) for i in range(100)]
    counts = Counter({w: int(1e7 * p / sum(weights)) for w, p in zip(vocab, weights, strict=True)})
    seeds = decontaminate.Seeds(items, decontaminate.choose_seeds(items, counts, 10_000_000, 20_000, decontaminate.CHANCE))
    recall = {}
    for step in (3, 4, 5):
        found = 0
        for i, ws in items:
            edited = [rng.choice(vocab) if j % step == step - 1 else w for j, w in enumerate(ws)]
            text = " ".join(rng.choices(vocab, weights, k=200) + edited + rng.choices(vocab, weights, k=200))
            found += i in {p[0] for p in seeds.pairs(text, decontaminate.SCORE)}
        recall[step] = found / len(items)
    clean = sum(1 for _ in range(200) for _ in seeds.pairs(" ".join(rng.choices(vocab, weights, k=500)), decontaminate.SCORE))
    print(recall, clean)
    assert recall[3] >= 0.75 and recall[4] >= 0.97 and recall[5] >= 0.97 and clean == 0


def test_decontamination_odd_rows(spark, docs, empty):
    """Null, empty and repeated rows, a very long text and clashing names against a real test set, in one block and in several."""
    rng = random.Random(13)
    items = [(1, prose(rng, 30)), (1, prose(rng, 30)), (None, prose(rng, 30)), (2, None), (3, ""), (4, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    long = prose(rng, 800_000) + " " + items[0][1]
    assert len(long) > 4_000_000
    rows = [(1, items[0][1]), (1, items[0][1]), (None, items[2][1]), (5, None), (6, ""), (7, long), (8, prose(rng, 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("u").alias(c) for c in ("score", "seeds", "t", "item_id")])
    for block in (2_000_000, 40):
        got = sorted(((r.doc_id, r.item_id) for r in decontaminate.pairs(df, bench, block=block).collect()), key=str)
        assert got == sorted([(1, 1), (1, 1), (None, None), (7, 1)], key=str)
        left = decontaminate.decontaminate(df, bench, block=block)
        assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [5, 6, 8]


def test_smith_waterman():
    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
        return max(map(max, h))

    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 20))
        assert decontaminate.smith_waterman(a, b)[0] == plain(a.tolist(), b.tolist())


# ---- 2 and 6 ------------------------------------------------------------------------------


def labelled(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        t = prose(rng, 60, [f"w{k}" for k in range(300)])
        bad, rude = i % 4 == 0, i % 5 == 0
        if bad:
            t = " ".join(w.upper() + "!!" for w in t.split())
        if rude:
            t += " " + " ".join(rng.choices(["awful", "vile", "nasty"], k=rng.randint(2, 6)))
        rows.append((i, t))
        labels.append((i, int(not bad), int(rude)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 1), (3000, None, None)], "doc_id long, quality int, toxic int")


def test_quality(spark, docs, empty):
    df, labels = labelled(spark)
    model = quality.train(df, labels, allowed=F.pmod(F.col("_key"), F.lit(4)) != 3)
    got = quality.classify(df.withColumn("predicted", F.lit("clash")), model).collect()
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in got]) > 0.95
    odd = quality.classify(docs, model).collect()
    assert len(odd) == len(corpus()) and all(0 <= r.score <= 1 for r in odd)
    assert quality.keep_good(df, model).columns == df.columns and quality.classify(empty, model).count() == 0
    blank = quality.train(df, labels.where("false"))
    assert {r.score for r in quality.classify(docs, blank).collect()} == {0.5}


def test_quality_with_metadata(spark):
    """Labels that only a column tells: the classifier learns them when the column is named, and cannot when it is not."""
    rng = random.Random(2)
    rows = [(i, prose(rng, 20, [f"w{k}" for k in range(50)]), rng.choice(["good site", "bad site", None])) for i in range(2400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.site` string")
    labels = spark.createDataFrame([(i, int(s == "good site")) for i, _, s in rows], "doc_id long, quality int")
    right = {}
    for meta in ((), ("a.site",)):
        model = quality.train(df, labels, allowed=F.col("_key") % 3 != 0, metadata=meta)
        got = quality.classify(df, model, good=0.5, metadata=meta).where("doc_id % 3 = 0").collect()
        right[meta] = np.mean([r.predicted == (r["a.site"] == "good site") for r in got])
    assert right[("a.site",)] > 0.95 > 0.75 > right[()]


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    m = quality.fit([], np.zeros(0))
    m.table = rng.normal(0, 1, m.table.shape).astype(np.float32)
    rows = [(rng.choice(1000, 12, replace=False), rng.normal(0, 1, 12)) for _ in range(5)]
    for (i, x), z in zip(rows, m.raw(quality.Rows(rows))[0], strict=True):
        w, v = m.table[i, 0], m.table[i, 1:]
        pairs = sum(float(v[a] @ v[b]) * x[a] * x[b] for a in range(12) for b in range(a))
        assert abs(m.bias + float(w @ x) + pairs - z) < 1e-3


def test_toxicity(spark, docs, empty):
    df, labels = labelled(spark)
    model = toxicity.train(df, labels)
    got = toxicity.score(df.withColumn("grade", F.lit("clash")), model).collect()
    assert np.mean([r.toxic == (r.doc_id % 5 == 0) for r in got]) > 0.95
    assert all(-1e-9 <= r.expected_severity <= 3 for r in got)
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == len(corpus()) and toxicity.score(empty, model).count() == 0
    assert not any(r.toxic for r in toxicity.score(docs, toxicity.train(df, labels.where("false"))).collect())


def test_ordinal_keeps_thresholds_in_order():
    rng = np.random.default_rng(2)
    rows = [(rng.choice(100, 5, replace=False), np.ones(5)) for _ in range(300)]
    m = toxicity.fit(rows, np.array([min(3, int((i < 20).sum())) for i, _ in rows]))
    assert (np.diff(m.thresholds) > 0).all()


def test_statistics_of_nothing():
    h, c = features.hashed([])
    assert not features.statistics(b"", h, c).any() and np.isfinite(features.statistics(b" \n", h, c)).all()


# ---- 9 ------------------------------------------------------------------------------------


@pytest.mark.parametrize("order,block", [(3, 300), (5, 500), (4, 1 << 20)])
def test_ppm(spark, order, block):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(0, 25), ["the", "of", "and", "theory", "ofter", "Zed\xe9"])) for i in range(40)] + [(50, None), (51, ""), (None, "the of"), (None, "of the"), (7, "the of and"), (7, "the of and")]
    made = ppm.score(spark.createDataFrame(rows, "doc_id long, text string"), order=order, block_bytes=block).collect()
    got = defaultdict(list)
    for r in made:
        got[r.doc_id].append(r)
    assert len(made) == len(rows)
    out = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter(w for i, t in rows if not out[i] for w in [*words(t), None])
    total, kinds, trie = sum(counts.values()), len(counts), ppm.Trie(order)
    for i, t in rows:
        if not out[i]:
            past = []
            for s in trie.symbols((t or "").encode()):
                trie.learn(past, s)
                past.append(s)
    for i, t in rows:
        w, score = [*words(t), None], trie.text((t or "").encode())
        r = min(got[i], key=lambda r: abs(r.score - score))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(w), sum(counts[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(np.log10((counts[x] + 1) / (total + kinds + 1)) for x in w))
        assert r.score == pytest.approx(score, rel=1e-5)


def test_counts_beyond_32_bits():
    big = np.array([0, 1, 1 << 32, 1 << 50], np.int64)
    assert (ppm.unnumbers(ppm.numbers(big)) == big).all()
    rows = [("word", b, ppm.squeeze(np.array([5, 9], np.uint64)), ppm.numbers(np.array([3_000_000_000, 1], np.int64))) for b in (0, 1)]
    replies = ppm._answer_words(pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=["kind", "block", "keys", "counts"]))
    assert [ppm.unnumbers(v.as_py()).tolist() for v in replies.column("value")] == [[6_000_000_000, 2]] * 2


def test_ppm_odd_rows(docs, empty):
    assert ppm.score(docs.withColumn("score", F.lit(0))).count() == len(corpus()) and ppm.score(empty).count() == 0
    got = ppm.adaptive(docs.where("doc_id in (4, 8, 9)")).collect()
    assert all(r.adaptive_log10 < 0 for r in got)


def test_lookup_table():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 60, 5000))
    table = ppm.Lookup(keys, np.arange(len(keys)))
    ask = rng.integers(0, len(keys), 20_000)
    assert (table[keys[ask]] == ask).all()


def test_line_signatures_by_hand():
    """The SimHash of a line, word by word, by a loop."""
    rng = random.Random(12)
    for text in [prose(rng, 40, [f"word{k}" for k in "abcdefghijklmnop"]), "Ünï, of 42 of", "漢字 かな mixed", "", "a" * 200]:
        norm, words, sig, mass = lines.signatures(text)
        assert norm == [" ".join("".join(c.lower() if c.isalpha() else "0" if c in "0123456789" else " " for c in text).split())]
        x = lines._codes(text)
        s, e, _ = lines._words(x)
        assert int(words[0]) == len(s)
        votes, total, heavy = np.zeros((8, 32)), np.zeros(8), np.zeros(8)
        with np.errstate(over="ignore"):
            for a, b in zip(s, e, strict=True):
                h = np.uint64(0)
                for k, c in enumerate(x[a:b].tolist()):
                    h += np.uint64(c + 0x9E37) * lines._power(lines._BASE, 300)[k]
                h = int(lines._mix(np.array([h]))[0])
                last = np.uint64(int(x[b - 1]) + (int(x[b - 2]) if b - a > 1 else 0) * 0x10001)
                block = int(lines._mix(np.array([last * lines._BASE]))[0]) >> 61
                w = min(int(b - a), 12) ** 2
                votes[block] += [w * (h >> (20 + k) & 1) for k in range(32)]
                total[block] += w
                # a Han or kana letter is a word of its own and says more than its length
                heavy[block] += 2 if lines._alone(x[a : a + 1])[0] else max(0, b - a - 2)
        want = [sum(1 << k for k in range(32) if 2 * votes[b][k] > total[b]) for b in range(8)]
        assert sig[0].tolist() == want and mass[0].tolist() == np.minimum(heavy, 255).tolist()
