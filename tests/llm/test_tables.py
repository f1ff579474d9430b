"""Personal data, mixtures and nearest neighbours against brute force; the pipeline."""

import random
import re

import numpy as np
import pyspark.sql.functions as F
import pytest

import corpus_pipeline
from landwatch.llm import disclosure, mixture, neighbours, queries

SF = "/root/testdata/sf0.001"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), k, kind, m.end()))
    return [(s, kind, e) for s, _, kind, e in sorted(out)]


def test_base_spans_equal_patterns():
    rng = random.Random(2)
    parts = ["a@b.co", "@", "x@y", ".", "..", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+1 (416) 555-9937", "+", "é", " ", "12", "-", "0001.2.3.4.5.6.7.8", "a.b+c@d-e.f.g.", "9" * 25]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert disclosure.base_spans(text) == brute_base(text), text


def test_long_runs_stay_quick():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "a@" * 100_000, "+1" + " " * 200_000):
        disclosure.base_spans(text)


def test_revealing_terms(spark):
    rng = random.Random(5)
    filler = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(300):
        w = [rng.choice(filler) for _ in range(30)]
        if i % 30 == 0:
            w[10:13] = ["Zorro", "z@x.example", "again" if i % 60 else "twice"]
        rows.append((i, " ".join(w), "k"))
    rows += [(900, None, "k"), (901, "", "k"), (902, rows[0][1], "k"), (902, rows[0][1], "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, terms string")
    got = disclosure.spans(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        assert [(s.start, s.kind, s.end) for s in r.base] == brute_base(text)
        told = {text[s.start:s.end] for s in r.terms}
        assert ("Zorro" in told) == ("Zorro" in text) and not any(t.startswith("word") for t in told)
    clean = {r.doc_id: r.text for r in disclosure.sanitise(df).collect()}
    assert clean[900] is None and clean[901] == "" and "z@x.example" not in clean[0] and "Zorro" not in clean[902] and "[email]" in clean[30]
    assert clean[1] == rows[1][1] and disclosure.spans(df.limit(0)).collect() == []


def brute_told(texts, support=3, generalise=0.75, remove=0.9):
    """Spans of revealing terms of each text: every pair of an entity and a word counted over whole distinct texts."""
    held, words = {}, {}
    for text in set(texts):
        spans = brute_base(text)
        names = [(k, text[s:e] if k in ("email", "ip") else re.sub(r"[ ().-]", "", text[s:e])) for s, k, e in spans]
        held[text] = {x: names.count(x) for x in names}
        blank = list(text)
        for s, _, e in spans:
            blank[s:e] = " " * (e - s)
        words[text] = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", "".join(blank)) if any(map(str.isalnum, m.group()))]
    where = {}
    for text, found in words.items():
        for s, e in found:
            where.setdefault(text[s:e].lower(), set()).add(text)
    out = {text: set() for text in held}
    for entity in {x for h in held.values() for x in h}:
        mine = {t for t in held if entity in held[t]}
        for term, others in where.items():
            both = mine & others
            if both and sum(held[t][entity] for t in both) >= support:
                share = np.log2(len(held) * len(both) / (len(mine) * len(others))) / np.log2(max(len(held), len(mine) + 1) / len(mine))
                if share >= generalise:
                    for t in both:
                        out[t] |= {(s, "removed" if share >= remove else "generalised", e) for s, e in words[t] if t[s:e].lower() == term}
    return {t: sorted({s: (s, max(k for a, k, _ in found if a == s), e) for s, _, e in found}.values()) for t, found in out.items()}


def test_revealing_terms_of_whole_texts(spark):
    rng = random.Random(11)
    filler = [f"word{i}" for i in range(150)]
    base = ["z@x.example", "10.1.2.3", "+1 (416) 555-9937", "q@y.example"]
    texts = []
    for i in range(240):
        w = [rng.choice(filler) for _ in range(40)]
        if i % 24 == 0:  # far from the entity, and twice
            w[2], w[20], w[38] = "Zorro", base[0], "zorro"
        if i % 24 == 5:
            w[0], w[30] = "Half" if i % 48 == 5 else "Other", base[1 + i % 3]
        if i % 40 == 7:
            w[1] = "Half"
        if i == 9:
            w[0], w[9], w[19], w[29] = "single", *["lone@z.example"] * 3
        texts.append(" ".join(w))
    texts += ["Glued:q@y.example and 10.1.2.3,glued again", "", None, texts[0], texts[0], texts[24]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_told([t or "" for t in texts])
    got = {r.doc_id: [tuple(x) for x in r.terms] for r in disclosure.spans(df).collect()}
    assert len(got) == len(texts) and all(got[i] == want[t or ""] for i, t in enumerate(texts))
    assert {texts[0][s:e] for s, _, e in got[0]} == {"Zorro", "zorro"} and "single" in {texts[9][s:e] for s, _, e in got[9]}
    clean = {r.doc_id: r.text for r in disclosure.sanitise(df).collect()}
    assert "zorro" not in clean[0].lower() and "zorro" not in clean[len(texts) - 1].lower()


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in names if s not in full)
        rest = total - sum(most * sizes[s] for s in full)
        more = {s for s in names if s not in full and rest * weight[s] / free > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else rest * weight[s] / free for s in names}
        full |= more


def test_mixture(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["b", "a", "ç", None, "hot", "hot", "hot"]), 1) for i in range(900)]
    rows += [(5, None, "a", 1), (5, "", "void", 1), (7, "one two", "a", 1), (7, "one two", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixture.mix(df).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    by = {}
    for i, t, s, _ in rows:
        by.setdefault((i, len((t or "").split())), set()).add(s)
    taken = {}
    for r in got:
        source = next(s for s in by[(r.doc_id, r["size"])] if sizes[s] == r.source_size)
        assert abs(r.target - want[source]) < 1e-6 and r.taken in (0, r["size"], 2 * r["size"])
        taken[source] = taken.get(source, 0) + r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixture.mix(df.repartition(7)).collect()))
    assert mixture.mix(df.limit(0)).collect() == []


def test_fit_reaches_every_reachable_sum():
    sizes, counts = np.array([3, 7, 20]), np.array([2, 3, 1])
    sums = {3 * a + 7 * b + 20 * d for a in range(3) for b in range(4) for d in range(2)}
    for budget in range(50):
        got = mixture.fit(sizes, counts, budget)
        assert (got <= counts).all() and (got >= 0).all()
        assert int((got * sizes).sum()) <= budget
    near = [int((mixture.fit(sizes, counts, b) * sizes).sum()) in sums for b in range(50)]
    assert all(near)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[300:700] = x[300]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, None] * 8), (2080, [1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    hits, y = 0, x.astype(np.float64)
    for q, found in got.items():
        found.sort()
        score = y @ y[q]
        score[q] = -np.inf
        order = np.lexsort((np.arange(1500), -score))[:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        assert all(abs(s - score[v]) < 1e-9 for _, v, s in found)
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(found, found[1:]))
        hits += len({v for _, v, _ in found} & set(order.tolist()))
        if 300 <= q < 700:
            assert [v for _, v, _ in found][:5] == order[:5].tolist()
    assert hits / (20 * len(got)) > 0.9
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    few = {(r.query_id, r.vec_id) for r in neighbours.search(df.where("vec_id < 4"), F.lit(True)).collect()}
    assert few == {(a, b) for a in range(4) for b in range(4) if a != b}


def test_pipeline_stages(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    extra = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "123 456", "en", "s", 7), (10_003, "write to me@x.example now", "en", None, 25)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.limit(1))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        seen[name] = {}
        for r in docs.collect():
            seen[name].setdefault(r.doc_id, []).append(r.text)
    assert not {10_001, 10_002} & set(seen["known_language"]) and 10_003 in seen["known_language"]
    groups = {r.doc_id: r.component_id for r in corpus_pipeline.shingle_join.components(spark.read.parquet(f"{tmp_path}/known_language"), words=5, threshold=(4, 5)).collect()}
    assert set(seen["one_of_a_kind"]) == set(groups.values()) and all(len(v) == 1 for v in seen["one_of_a_kind"].values())
    assert seen["without_personal_data"][10_003] == ["write to [email] now"]
    assert all(not brute_base(t[0]) for t in seen["without_personal_data"].values())
    assert {len(v) for v in seen["mixed_sources"].values()} <= {1, 2}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()


def test_pipeline_decides_by_row(spark):
    long = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdefg"}
    near = {k: v + " more" for k, v in long.items()}
    rows = [(None, long["a"], "en", "s"), (None, long["b"], "en", "s"), (5, long["c"], "en", "s"), (6, near["c"], "en", "s"), (6, long["d"], "en", "s"), (None, near["d"], "en", "s"),
            (8, long["e"], "en", "s"), (8, near["e"], "en", "s"), (9, long["f"], "en", None), (9, long["f"], None, "en"), (None, long["g"], "en", "s"), (None, long["g"], "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = [tuple(r) for r in corpus_pipeline.one_of_a_kind(spark, df, SF).collect()]
    assert len(got) == 7 and set(got) <= set(rows)
    assert {t[0] for _, t, _, _ in got} == set(long) and {(i, t) for i, t, _, _ in got} >= {(None, long["a"]), (None, long["b"]), (5, long["c"]), (6, long["d"]), (None, long["g"])}
    two = spark.createDataFrame([(9, long["f"], "en", "s1"), (9, long["f"], "fr", "s2"), (None, long["g"], "en", "s2")], df.schema)
    words = {}
    for r in corpus_pipeline.mixed_sources(spark, two, SF).collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    want = brute_targets({"s1": 60, "s2": 120})
    assert words == {s: n // 60 * 60 for s, n in want.items()}


@pytest.mark.parametrize("name", ["op2_disclosure", "op5_mixture"])
def test_queries_cover_all_rows(spark, name):
    assert queries.queries()[name](spark, SF).count() == queries.table(spark, SF, "documents").count()
