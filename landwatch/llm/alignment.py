"""Alignment of two tokenizers over a corpus: groups of tokens between common ends, and how often ids are linked.

Tokenizer A is a byte-level BPE file that reads a space and the text, B a piece model that reads the text (it adds the
space itself). Where both join to the same bytes, offsets at which an A and a B token end cut them into groups, and tokens
whose bytes overlap are linked.

* Fast path: an array gives for each A id the B id of the same bytes. Such links, as nearly all one-to-one groups give, are
  counted per task in a vector as long as the vocabulary; no pair of theirs is shuffled.
* Other pairs of ids are counted per task in a table of bounded size, and enter the pair shuffle.
* The counts go back to the documents: the vector and the ``HELD`` commonest other pairs as arrays of fixed size; the rest by
  a join on the pair. A pair outside the arrays stands in less than one in ``HELD`` of the (document, pair) rows, so no key
  of that join is hot.

Null and empty texts, and those whose joined bytes differ from space and text, have no tokens: zeros and ''. Long texts
are steps of their own, whole. Repeated rows count as documents of their own and give repeated results; null ids too. Ties: all
links of the highest count of an A id are best. Other columns are ignored, whatever their names. An empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landwatch.llm.batches import STEP, slices, strings
from landwatch.llm.counting import commonest
from landwatch.llm.hashing import ragged
from landwatch.session import cut_lineage

#: Other pairs that the arrays hold, and that a task counts before it hands them on.
HELD, COUNTED = 1 << 18, 1 << 19
#: A fixed value: the split of byte-level vocabularies, as their library has it.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space that the ranked encoder's split would follow too deep.
DEEP = re.compile(r"\s{5000}")
c = F.col


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself where visible, the next free ones from 256 for the rest."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The bytes of every id."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)
        names = [str(i) for i in range(len(tokens))]
        self.inner, self.last = (np.array([n + sign for n in names], object) for sign in (",", "|"))
        self.closing = np.array([n + ";" for n in names], object)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.raw[ragged(self.start[ids], self.size[ids])]


def ranked(path: str, letters: dict[str, int]):
    """An encoder by ranks that gives the ids of a plain byte-level BPE file several times faster; None for other files.

    Equal, as ids rise with the merges: of two parts whose bytes join to a token, each was made by the merges of lower
    rank within it alone, so they are the two that the token's own merge lists.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, split = whole["model"], whole.get("pre_tokenizer") or {}
    special = {t["content"] for t in whole["added_tokens"]}
    order = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model.get("merges", [])]
    plain = (model["type"] == "BPE" and not whole["normalizer"] and not whole["post_processor"] and split.get("type") == "ByteLevel" and split.get("use_regex", True)
             and not split.get("add_prefix_space") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
    ranks = {bytes(letters[x] for x in w): i for w, i in model["vocab"].items() if w not in special}
    if not plain or order != sorted(set(order)) or len(ranks) != len(order) + 256 or min(order, default=256) <= max(ranks[bytes([b])] for b in range(256)):
        return None
    return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Pair:
    """Both tokenizers in a task."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.model_a, self.model_b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.model_a.encode_special_tokens = True
        self.model_a.no_truncation()
        self.model_a.no_padding()
        letters, added = byte_letters(), self.model_a.get_added_tokens_decoder()
        self.ranked = ranked(path_a, letters)
        tokens = [b""] * self.model_a.get_vocab_size(True)
        for word, i in self.model_a.get_vocab(True).items():
            tokens[i] = word.encode() if i in added else bytes(letters[x] for x in word)
        self.a = Vocabulary(tokens)
        model = self.model_b
        pieces = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]
        self.b = Vocabulary(pieces)
        order = sorted(range(len(pieces)), key=lambda i: (model.is_byte(i), i), reverse=True)
        same = {pieces[i]: i for i in order}  # a piece before a byte, the least id first
        self.same = np.array([same.get(t, -1) for t in tokens], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        found_a = [self.ranked(" " + t) if self.ranked and not DEEP.search(t) else self.model_a.encode(" " + t, add_special_tokens=False).ids for t in texts]
        found_b = self.model_b.encode(texts, out_type=int, num_threads=1, add_bos=False, add_eos=False) if texts else []
        out = []
        for found in (found_a, found_b):
            count = np.array([len(x) for x in found], np.int64)
            out += [np.fromiter(chain.from_iterable(found), np.int64, int(count.sum())), count]
        return tuple(out)

    def align(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Columns of a step: per text the numbers and the digest, and ``doc, pair, times`` of its distinct linked pairs."""
        n = len(texts)
        whole = [t.encode("utf-8", "surrogatepass") for t in texts]
        size = np.array([len(t) + 1 for t in whole], np.int64)
        a, count_a, b, count_b = self.encode(texts)
        good = size > 1
        for vocabulary, ids, count in ((self.a, a, count_a), (self.b, b, count_b)):
            good &= np.bincount(np.repeat(np.arange(n), count), vocabulary.size[ids], n).astype(np.int64) == size
        raw = np.frombuffer(b"".join(b" " + t for t, g in zip(whole, good) if g), np.uint8)
        owner = np.repeat(np.flatnonzero(good), size[good])
        for vocabulary, ids, count in ((self.a, a, count_a), (self.b, b, count_b)):
            differ = vocabulary.joined(ids[np.repeat(good, count)]) != raw
            good = good & ~np.isin(np.arange(n), owner[differ])
            owner, raw = owner[good[owner]], raw[good[owner]]
        a, b = a[np.repeat(good, count_a)], b[np.repeat(good, count_b)]
        count_a, count_b, size = count_a * good, count_b * good, size * good
        ends = np.cumsum(size)
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        mark_a, mark_b = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
        mark_a[end_a], mark_b[end_b] = True, True
        common = mark_a & mark_b
        cut = np.flatnonzero(mark_a | mark_b)  # one link ends here
        from_a, from_b = (np.cumsum(m)[cut] - m[cut] for m in (mark_a, mark_b))
        doc = np.searchsorted(ends, cut, side="left")
        wide = len(self.b.size)
        code = a[from_a] * wide + b[from_b]
        held, times = np.unique(doc * (len(self.a.size) * wide) + code, return_counts=True)
        group = np.cumsum(common)
        group_a, group_b = group[end_a] - common[end_a], group[end_b] - common[end_b]
        line = np.empty(len(a) + len(b), object)
        line[np.arange(len(a)) + np.searchsorted(group_b, group_a, side="left")] = np.where(common[end_a], self.a.last[a], self.a.inner[a])
        line[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = np.where(common[end_b], self.b.closing[b], self.b.inner[b])
        digest, at = [], 0
        for k in (count_a + count_b).tolist():
            digest.append(hashlib.sha256("".join(line[at:at + k].tolist())[:-1].encode()).hexdigest() if k else "")
            at += k
        groups = np.bincount(np.searchsorted(ends, np.flatnonzero(common), side="left"), minlength=n)
        per_doc = len(self.a.size) * wide
        return {"n_a": count_a, "n_b": count_b, "n_groups": groups, "n_links": np.bincount(doc, minlength=n), "groups_sha256": np.array(digest, object),
                "doc": held // per_doc, "pair": held % per_doc, "times": times}


def arrays(doc: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """``values``, sorted by text, as one list a text."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


LEFT = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
NUMBERS = {"own": pa.list_(pa.int32()), "own_times": pa.list_(pa.int32()), "pairs": pa.list_(pa.int64()), "pair_times": pa.list_(pa.int32())}
COUNTS = {"counted": pa.list_(pa.int64()), "docs": pa.list_(pa.int64()), "irregular": pa.bool_()}


def aligned(docs: DataFrame, ident: str, text: str, path_a: str, path_b: str) -> DataFrame:
    """Per row its numbers and its distinct pairs; per task the counts of documents a pair, those of the fast path by A id."""
    kind = docs.schema[ident].dataType.simpleString()
    schema = (f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, own array<int>, own_times array<int>,"
              " pairs array<long>, pair_times array<int>, counted array<long>, docs array<long>, irregular boolean")
    names = ["row", "id", *LEFT, *NUMBERS, *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, id_type = None, None
        waiting, rows = [], 0

        def told(values, numbers, irregular):
            for at in range(0, len(values), 8192):
                part = [pa.array([x[at:at + 8192]], pa.list_(pa.int64())) for x in (values, numbers)]
                none = [pa.nulls(1, t) for t in (pa.int64(), id_type, *[pa.int64()] * 4, pa.string(), *NUMBERS.values())]
                yield pa.RecordBatch.from_arrays([*none, *part, pa.array([irregular])], names=names)

        def merged():
            values, back = np.unique(np.concatenate([v for v, _ in waiting]), return_inverse=True)
            return values, np.bincount(back, np.concatenate([k for _, k in waiting]), len(values)).astype(np.int64)

        for batch in batches:
            if both is None:
                both, id_type = Pair(path_a, path_b), batch.column("id").type
                vector = np.zeros(len(both.same), np.int64)
                wide = len(both.b.size)
            for part in slices(batch, "_text", STEP):
                x, n = both.align(strings(part.column("_text"))), part.num_rows
                left, right = x["pair"] // wide, x["pair"] % wide
                own = both.same[left] == right
                vector += np.bincount(left[own], minlength=len(vector))
                rest = x["pair"][~own]
                waiting.append(np.unique(rest, return_counts=True))
                rows += len(waiting[-1][0])
                lists = [arrays(x["doc"][own], n, left[own], pa.int32()), arrays(x["doc"][own], n, x["times"][own], pa.int32()),
                         arrays(x["doc"][~own], n, rest, pa.int64()), arrays(x["doc"][~own], n, x["times"][~own], pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), *(pa.array(x[k]) for k in LEFT), *lists, *(pa.nulls(n, t) for t in COUNTS.values())], names=names)
                if rows > 2 * COUNTED:
                    waiting = [merged()]
                    rows = len(waiting[0][0])
                    if rows > COUNTED:
                        yield from told(*waiting[0], True)
                        waiting, rows = [], 0
        if both is not None:
            if waiting:
                yield from told(*merged(), True)
            some = np.flatnonzero(vector)
            yield from told(some, vector[some], False)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), c(f"`{ident}`").alias("id"), c(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, schema)


def column_sum(counts: DataFrame, irregular: bool) -> DataFrame:
    each = counts.where(c("irregular") == irregular).select(F.explode(F.arrays_zip("counted", "docs")).alias("_e"))
    return each.groupBy(c("_e.counted").alias("pair")).agg(F.sum("_e.docs").alias("n"))


def align(docs: DataFrame, path_a: str, path_b: str, ident: str = "doc_id", text: str = "text", held: int = HELD) -> DataFrame:
    """``ident, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    spark = docs.sparkSession
    found = cut_lineage(aligned(docs, ident, text, path_a, path_b))
    counts = found.where("counted is not null").select("counted", "docs", "irregular")
    pairs = cut_lineage(column_sum(counts, True))
    same = Pair(path_a, path_b)
    wide = len(same.b.size)
    own, best = np.zeros(len(same.same), np.int64), np.zeros(len(same.same), np.int64)
    for row in column_sum(counts, False).toLocalIterator():  # one row an A id
        own[row.pair] = best[row.pair] = row.n
    for row in pairs.groupBy(F.expr(f"pair div {wide}").alias("_a")).agg(F.max("n").alias("_m")).toLocalIterator():  # one row an A id
        best[row._a] = max(best[row._a], row._m)
    limit = commonest(pairs, held)
    top = pairs.where(c("n") > limit).toPandas().sort_values("pair")  # ``held`` rows at most
    shared = spark.sparkContext.broadcast((own, best, top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64)))
    kind = docs.schema[ident].dataType.simpleString()
    schema = f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<long>, rest_times array<int>"
    names = [x.split()[0] for x in schema.split(", ")]

    def totals(column: pa.Array, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return np.diff(sums[column.offsets.to_numpy() - column.offsets[0].as_py()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_, best_, key, number = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([x]) for x in batch.columns], names=batch.schema.names)
            a, times = batch.column("own").flatten().to_numpy(), batch.column("own_times").flatten().to_numpy().astype(np.int64)
            good = totals(batch.column("own"), times * (own_[a] == best_[a]))
            total = totals(batch.column("own"), times * own_[a])
            code, times = batch.column("pairs").flatten().to_numpy(), batch.column("pair_times").flatten().to_numpy().astype(np.int64)
            spot = np.minimum(np.searchsorted(key, code), max(len(key) - 1, 0))
            known = key[spot] == code if len(key) else np.zeros(len(code), bool)
            n = np.where(known, number[spot] if len(key) else 0, 0)
            good += totals(batch.column("pairs"), times * (known & (n == best_[code // wide])))
            total += totals(batch.column("pairs"), times * n)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("pairs").offsets.to_numpy()))[~known]
            rest = [arrays(doc, batch.num_rows, code[~known], pa.int64()), arrays(doc, batch.num_rows, times[~known], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("row", "id", *LEFT)), pa.array(good), pa.array(total), *rest], names=names)

    some = cut_lineage(found.where("row is not null").select("row", "id", *LEFT, *NUMBERS).mapInArrow(run, schema))
    asked = some.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("_e")).select("row", c("_e.rest").alias("pair"), c("_e.rest_times").alias("_t"))
    highest = spark.sparkContext.broadcast(best)  # by A id

    def judged(batches):
        for batch in batches:
            code, n, times = (batch.column(k).to_numpy() for k in ("pair", "n", "_t"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(times * (n == highest.value[code // wide])), pa.array(times * n)], names=["row", "n_best", "count_sum"])

    later = asked.join(pairs.where(c("n") <= limit), "pair").select("row", "pair", "n", c("_t").cast("long").alias("_t")).mapInArrow(judged, "row long, n_best long, count_sum long")
    fixed = F.struct("id", *LEFT)
    parts = some.select("row", fixed.alias("_f"), "n_best", "count_sum").unionByName(later.select("row", F.lit(None).cast(some.select(fixed).schema[0].dataType).alias("_f"), "n_best", "count_sum"))
    out = parts.groupBy("row").agg(F.first("_f", ignorenulls=True).alias("_f"), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select(c("_f.id").alias(ident), *(c(f"_f.{k}").alias(k) for k in LEFT[:4]), "n_best", "count_sum", c("_f.groups_sha256").alias("groups_sha256"))
