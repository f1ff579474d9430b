"""Set joins, repeated strings and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from landwatch.llm import parsing, queries, repeats, shingle_join

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_components(rows, k, a, b):
    sets = {}
    for n, (_, t) in enumerate(rows):
        w = words_of(t)
        sets[n] = frozenset(zip(*(w[j:] for j in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])
    top = {n: n for n in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for x in sets:
        for y in range(x):
            if sets[x] and b * len(sets[x] & sets[y]) >= a * len(sets[x] | sets[y]):
                top[find(x)] = find(y)
    least = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        least[find(n)].append(i)
    return Counter((rows[n][0], len(sets[n]), min(least[find(n)])) for n in sets)


def near_copies(seed, groups=4, copies=30):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 150))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(["Zed", "w1", f"n{rng.random()}"])
            rows.append(" ".join(t))
    rows += [None, "", "  ", "one", "ONE", "one two", "one two three", "one two three", "x y z w"]
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,words,threshold", [(1, 3, (9, 10)), (2, 5, (4, 5)), (3, 2, (1, 2))])
def test_components_equal_brute_force(spark, monkeypatch, seed, words, threshold):
    rows = near_copies(seed)
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, n int, node string")
    got = Counter(tuple(r) for r in shingle_join.components(df, words=words, threshold=threshold).collect())
    assert got == brute_components(rows, words, *threshold)


def test_list_steps_miss_no_pair():
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(4)
    n = 400
    size = rng.integers(20, 40, n)
    rows = {"key": rng.integers(0, 6, n), "node": np.arange(n), "label": rng.integers(0, 30, n), "pos": rng.integers(0, 3, n), "size": size}
    rows["blk"] = np.floor(np.log(size) / np.log(10 / 9) + 1e-9).astype(np.int64)
    order = np.lexsort((rows["blk"], rows["key"]))
    rows = {k: v[order] for k, v in rows.items()}
    want = set()
    for i in range(n):
        for j in range(i):
            if rows["key"][i] == rows["key"][j] and rows["label"][i] != rows["label"][j]:
                left = min(rows["size"][i] - rows["pos"][i], rows["size"][j] - rows["pos"][j])
                if 19 * left >= 9 * (rows["size"][i] + rows["size"][j]):
                    want.add((min(rows["node"][i], rows["node"][j]), max(rows["node"][i], rows["node"][j])))
    for step in (1 << 17, 37):
        batches = [pa.RecordBatch.from_pydict({**{k: v[i:i + 10] for k, v in rows.items()}, "weight": pa.nulls(len(size[i:i + 10]), pa.int32()), "base": pa.nulls(len(size[i:i + 10]), pa.int32())}) for i in range(0, n, 10)]
        old, shingle_join.ROWS = shingle_join.ROWS, step
        try:
            got = {(x, y) for b in shingle_join._lists(iter(batches), 9, 10) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())}
        finally:
            shingle_join.ROWS = old
        assert got == want


def test_components_of_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shingle_join.components(df).collect() == []


def test_component_query(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    got = Counter(tuple(r) for r in queries.op1_shingle_join(spark, SF).collect())
    assert got == brute_components(rows, 3, 9, 10)


def brute_strip(rows, length):
    count = Counter(b[k:k + length] for _, b in rows for k in range(len(b) - length + 1))
    out = []
    for i, b in rows:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if count[b[k:k + length]] > 1:
                gone[k:k + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), kept))
    return Counter(out)


@pytest.mark.parametrize("crowd", [2000, 3])
def test_repeats_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rng = random.Random(7)
    piece = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [piece(n) for n in (90, 150, 400)]
    texts = [None, "", "short", "ab" * 100, "x" * 300, piece(79), piece(80)]
    for _ in range(40):
        texts.append(piece(rng.randint(0, 120)) + rng.choice(shared)[rng.randint(0, 9):] + piece(rng.randint(0, 120)))
    texts += [texts[-1], texts[-1], texts[8] + texts[9]]
    rows = [(i, t, "k") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.strip(df, length=80).collect())
    assert got == brute_strip([(i, (t or "").encode()) for i, t, _ in rows], 80)
    assert repeats.strip(df.limit(0), length=80).collect() == []


def test_repeat_query(spark):
    rows = [(r.doc_id, r.text.encode()) for r in queries.table(spark, SF, "documents").collect()]
    want = {(i, n, m, s, hashlib.sha256(k).hexdigest()) for i, n, m, s, k in brute_strip(rows, 200)}
    assert {tuple(r) for r in queries.op7_repeats(spark, SF).collect()} == want


def test_fingerprints(spark):
    rows = [(5, "abc " * 50), (1, None), (9, "Ünïcödé tèxt " * 30), (7, "abc " * 50), (7, "b"), (2, ""), (8, "z" * 5000)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = [r for r in parsing.compare_with_next(df).collect()]
    ordered = sorted((i, t or "") for i, t in rows)
    want = Counter()
    for k, (i, t) in enumerate(ordered):
        made = parsing.edited(t, ordered[(k + 1) % len(ordered)][1])
        assert len(made) <= len(t)
        want[(i, len(t), hashlib.sha256(made.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    of = {r.doc_id: r.fingerprint for r in got if r.n_chars > 1}
    assert of[5] == of[7] != of[9]
    assert parsing.compare_with_next(df.limit(0)).collect() == []
    one = parsing.compare_with_next(df.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_fingerprints_share_interiors():
    rng = random.Random(3)
    body = "".join(rng.choice("etaoin shrdlu") for _ in range(6000))
    other = "".join(rng.choice("etaoin shrdlu") for _ in range(6000))
    f = parsing.fingerprints([body, "xy" + body, body[:3000] + other[:3000], other, body])
    near = lambda a, b: float(parsing.likeness(f[a:a + 1], f[b:b + 1])[0])
    assert near(0, 4) == 1 and near(0, 1) > 0.9 and 0.15 < near(0, 2) < 0.6 and near(0, 3) < 0.1
    assert (parsing.fingerprints([body])[0] == f[0]).all()
