"""Source divergence, SimHash links and tokenizer alignment against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from landwatch.llm import alignment, divergence, linking, queries, simhash
from tests.llm.test_sets import near_copies, words_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def documents(seed=3, n=160):
    rng = random.Random(seed)
    words = ["alpha", "Alpha", "éta", "ÉTA", "x1y", "zeta-ray", "naïve", "日本", "b", "be", "bet", "bets", "sets", "set", "z" * 90, "Zz"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "B", "é", None])) for i in range(n)]
    rows += [(None, None, "en", "a"), (1, "", "fr", "a"), (1, "", "fr", "a"), (2, "once", "fr", "b"), (7, "123 -- 4", "fr", None), (8, "bet " * 9000, "en", "a")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2, "k") for r in rows], "doc_id long, text string, lang string, source string, term string, n int, ordinal int, _text string")


@pytest.mark.parametrize("head,cells", [(divergence.HEAD, divergence.CELLS), (6, 4)])
def test_audit_equals_sql(spark, monkeypatch, head, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "BLOCK", 4)
    rows = documents()
    got = [tuple(r) for r in divergence.audit(frame(spark, rows), head=head).collect()]
    con = duckdb.connect()
    documents_ = frame(spark, rows).select("doc_id", "text", "lang", "source").toPandas()
    con.register("documents", documents_.astype(object).where(documents_.notna(), None))
    want = con.sql(queries.oracle_sql()["op11_divergence"]).fetchall()
    assert sorted(got) == sorted(want)
    assert {r[0] for r in got if r[2] == "term"} == {"en", "de", ""} and all(r[4] == 0 for r in got if r[0] == "fr")


def test_transducer_numbers_words_in_order_and_is_minimal():
    rng = random.Random(5)
    words = {root: sorted({bytes(rng.choices(b"ab\xc3\xff", k=rng.randint(1, 7))) for _ in range(300)}) for root in ("x", "y")}
    made = divergence.Transducer((root, w) for root in words for w in words[root])
    tails = {root: {w[i:] for w in words[root] for i in range(len(w) + 1)} for root in words}
    languages = {frozenset(w[len(head):] for w in words[root] if w.startswith(head)) for root in words for head in {w[:i] for w in words[root] for i in range(len(w) + 1)}}
    assert len(made.final) == len(languages)
    asked = [(root, w) for root in words for w in sorted(tails[root] | set(words["x"]) | {b"q", b"a" * 30}) if w]
    raw = np.frombuffer(b"".join(w for _, w in asked), np.uint8)
    ends = np.cumsum([len(w) for _, w in asked])
    got = made.ordinals(raw, ends - [len(w) for _, w in asked], ends, np.array([made.roots[r] for r, _ in asked]))
    assert got.tolist() == [words[r].index(w) if w in words[r] else -1 for r, w in asked]


def brute_print(text):
    w = words_of(text)
    line = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in line]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_links(prints, near=3):
    top = {p: p for p in prints}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for x in prints:
        for y in prints:
            if x < y and (x ^ y).bit_count() <= near:
                top[find(x)] = find(y)
    return {p: find(p) for p in prints}


def brute_simhash(rows, prints):
    root = brute_links(set(prints))
    least = defaultdict(list)
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]].append(i)
    return Counter((i, f"{p:016x}", min(least[root[p]], default=None)) for (i, _), p in zip(rows, prints))


def test_simhash_equals_brute_force(spark):
    rows = near_copies(8, copies=40) + [(None, "w1 w2 w3 w4"), (None, "w1 w2 w3 w4"), (500, "w1 w2 w3 w4"), (500, "ÀB  ab\tcd\x0b\x1cef   g"), (None, "é " * 30000 + "end")]
    df = spark.createDataFrame([(i, t, 0, "k", 1) for i, t in rows], "doc_id long, text string, print int, id string, least_id int")
    got = Counter(tuple(r) for r in simhash.components(df).collect())
    assert got == brute_simhash(rows, [brute_print(t) for _, t in rows])
    empty = simhash.components(df.where("false"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "fingerprint", "component_id"]


@pytest.mark.parametrize("few,flip", [(256, 14), (2, 30)])
def test_crowded_variants_lose_no_link(spark, monkeypatch, few, flip):
    """Fingerprints that crowd in few variants, listed at all three levels."""
    rng = random.Random(few + flip)
    spots = rng.sample(range(64), flip)
    bases = [rng.getrandbits(64) for _ in range(3)]
    prints = [rng.choice(bases) ^ sum(1 << b for b in rng.sample(spots, rng.randint(0, min(6, flip)))) for _ in range(260)]
    rows = [(i, "") for i in range(len(prints))]
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "signatures", lambda docs, *_: docs)
    got = Counter(tuple(r) for r in simhash.components(spark.createDataFrame(signed, "id long, print long"), ident="doc_id").collect())
    assert got == brute_simhash(rows, prints)


def test_roots_of_long_chains_and_stars(spark):
    rng = random.Random(2)
    chain = list(range(100, 400))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(5000, i) for i in range(5001, 5100)] + [(7, 7), (9, 8), (8, 9)]
    got = {r.node: r.root for r in linking.roots(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {i: 100 for i in range(100, 400)} | {i: 5000 for i in range(5000, 5100)} | {8: 8, 9: 8}
    assert linking.roots(spark.createDataFrame([], "x long, y long")).count() == 0


def brute_align(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    rows, held = [], Counter()
    for t in texts:
        ids = [a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)] if t else [[], []]
        parts = [[bytes(letters[x] for x in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in ids[0]],
                 [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
        if not t or any(b"".join(p) != b" " + t.encode() for p in parts):
            rows.append(([], [], [], []))
            continue
        spans = []
        for p in parts:
            ends = np.cumsum([len(x) for x in p]).tolist()
            spans.append(list(zip([0, *ends], ends)))
        links, groups, i, j, ga, gb = [], [], 0, 0, [], []
        while i < len(ids[0]) and j < len(ids[1]):
            links.append((ids[0][i], ids[1][j]))
            ea, eb = spans[0][i][1], spans[1][j][1]
            if ea <= eb:
                ga.append(str(ids[0][i]))
                i += 1
            if eb <= ea:
                gb.append(str(ids[1][j]))
                j += 1
            if ea == eb:
                groups.append(",".join(ga) + "|" + ",".join(gb))
                ga, gb = [], []
        rows.append((*ids, links, groups))
        held.update(set(links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(len(x), len(y), len(g), len(k), sum(held[p] == best[p[0]] for p in k), sum(held[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for x, y, k, g in rows]


@pytest.mark.parametrize("held", [alignment.HELD, 40])
def test_alignment_equals_brute_force(spark, held):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    texts += [None, "", " ", "  two  spaces ", "tab\tand\nline", "<|endoftext|> <unk> <s> <0x41>", "▁under", "日本語 ünï 🙂🙂 é", "aaa aaaa aaaaa", "\x00nul", "ﬁ ½", "same text", "same text", "x" * 3000, "a" + " " * 7000 + "b", "　wide"]
    rows = [(None if i % 17 == 3 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, row int, id string, n_a int").repartition(5)
    got = alignment.align(df, A, B, held=held)
    assert Counter(tuple(r) for r in got.collect()) == Counter((i, *x) for (i, _), x in zip(rows, brute_align(texts)))
    empty = alignment.align(df.where("false"), A, B)
    assert empty.count() == 0 and empty.columns == got.columns


def test_ranked_ids_are_the_librarys():
    both = alignment.Pair(A, B)
    assert both.ranked is not None
    rng = random.Random(4)
    pool = "etaoin shrdlu''’s're I'll 12 345 \n\t    éß日本🙂_-—" + "<|endoftext|>"
    for _ in range(400):
        t = "".join(rng.choices(pool, k=rng.randint(1, 80)))
        assert both.ranked(t) == both.model_a.encode(t, add_special_tokens=False).ids, t
    assert re.fullmatch(r"[0-9a-f]{64}", both.align(["one two"])["groups_sha256"][0])


def test_queries_of_the_round_return_every_document(spark):
    folder = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert queries.queries()["op12_simhash"](spark, folder).count() == n
    found = queries.queries()["op13_alignment"](spark, folder)
    assert found.count() == n and found.where(F.col("n_links") != F.col("n_a") + F.col("n_b") - F.col("n_groups")).count() == 0


def test_a_filter_of_terms_holds_them_and_few_others(spark):
    """Words that no language keeps mostly stay in the scan; a kept one never does. Before, every refused word left it."""
    from landwatch.llm import filters
    from landwatch.llm.batches import flat
    from landwatch.llm.hashing import LOWER, prefix_sums, span_hashes
    kept, other = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}ä" for i in range(300)], [f"anders{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    mask = filters.build(divergence.term_hashes(spark.createDataFrame([(t,) for t in kept], "term string")), "hash")
    raw, offsets = flat(pa.array([" ".join(kept).upper().replace("Ä", "ä"), " ".join(other)]))
    raw = LOWER[raw]
    starts, ends, doc = divergence.term_spans(raw, offsets)
    held = filters.held(mask, span_hashes(prefix_sums(raw), starts, ends))
    assert held[doc == 0].all() and held[doc == 1].sum() < 10
