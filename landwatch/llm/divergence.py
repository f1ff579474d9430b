"""Audit of how sources differ in their words: exact divergences between the sources of a language, and the terms behind them.

Terms are runs of letters A-Z and of characters beyond ASCII, A-Z in lower case. A language keeps the terms that stand in
enough of its documents. Counts of kept terms in each (lang, source) group, smoothed and scaled to integers, give p; two
distributions differ by the sum of floor((p - q)^2 / (p + q)).

The kept terms are sorted over all partitions and numbered. The commonest ``HEAD`` of them form a minimal acyclic transducer,
built from the sorted terms with one root a language: equal endings are one state, and the outputs along a term add up to its
place in the order. Every text runs through it in a second scan, which counts places, not strings. Kept terms beyond the
transducer's bound are counted from the words it refuses and found by a join; a filter over their hashes thins those words in
the scan, and never drops a kept term. Numbers break ties, as their order is the
terms' own.

The matrix of pairs is summed over blocks of numbers: a task holds one block, sources by terms.

Null text, lang and source are ''. Empty texts and texts without terms still make their group. Long texts are read whole, one
at a time. Repeated rows and ids count each. Other columns are ignored, whatever their names. A language without kept terms
gives pairs of value 0 and no terms; an empty table gives an empty result. Ties have the lesser item (by UTF-8) first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landwatch.llm import filters
from landwatch.llm.batches import STEP, flat, slices
from landwatch.llm.counting import Tally, commonest
from landwatch.llm.hashing import LOWER, U, mix, prefix_sums, ragged, span_hashes
from landwatch.session import cut_lineage

#: Terms and bytes of a term in the transducer (16 MB of text at most), terms of a block of the pair matrix, cells that a task sums before it hands them on.
HEAD, LONGEST, BLOCK, CELLS = 1 << 18, 64, 512, 1 << 21
#: A fixed scale of the smoothed shares.
SCALE = 1_000_000_000
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
c = F.col


def term_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters, and the text of each."""
    inside = np.concatenate([[False], LETTER[raw], [False]])
    begin, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    begin[cut] = inside[1:-1][cut]  # a run does not cross texts
    end[cut - 1] = inside[1:-1][cut - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, side="right") - 1


def texts_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    data = raw[ragged(starts, size)]
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())


def coded(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct values, and each row's place among them."""
    packed = column.dictionary_encode()
    return packed.dictionary, packed.indices.to_numpy()


class Transducer:
    """A minimal acyclic automaton over bytes; outputs along an accepted word add up to its ordinal among its root's words."""

    def __init__(self, words: Iterator[tuple[str, bytes]]) -> None:
        """``words`` are (root, word), sorted and distinct."""
        self.register: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.below: list[int] = []
        self.roots: dict[str, int] = {}
        stack, before, root = [[False, [], []]], b"", None
        for name, word in words:
            if name != root:
                self._end(stack, before, root)
                stack, before, root = [[False, [], []]], b"", name
            same = 0
            while same < len(before) and same < len(word) and before[same] == word[same]:
                same += 1
            self._close(stack, before, same)
            stack.extend([False, [], []] for _ in range(len(word) - same))
            stack[-1][0] = True
            before = word
        self._end(stack, before, root)
        self._arrays()

    def _end(self, stack: list, word: bytes, root: str | None) -> None:
        if root is not None:
            self._close(stack, word, 0)
            self.roots[root] = self._frozen(stack[0])

    def _close(self, stack: list, word: bytes, depth: int) -> None:
        """Freeze the states of ``word`` deeper than ``depth``."""
        while len(stack) - 1 > depth:
            number = self._frozen(stack.pop())
            stack[-1][1].append(word[len(stack) - 1])
            stack[-1][2].append(number)

    def _frozen(self, state: list) -> int:
        key = (state[0], tuple(state[1]), tuple(state[2]))
        number = self.register.setdefault(key, len(self.states))
        if number == len(self.states):
            self.states.append(key)
            self.below.append(state[0] + sum(self.below[t] for t in state[2]))
        return number

    def _arrays(self) -> None:
        n = len(self.states)
        self.final = np.array([s[0] for s in self.states], bool)
        self.bits = np.zeros((n, 4), U)
        degree = np.array([len(s[1]) for s in self.states], np.int64)
        self.first = (np.cumsum(degree) - degree).astype(np.int32)
        self.target, self.output = np.zeros(int(degree.sum()), np.int32), np.zeros(int(degree.sum()), np.int32)
        at = 0
        for i, (final, labels, targets) in enumerate(self.states):
            passed = int(final)
            words = [0, 0, 0, 0]
            for label, to in zip(labels, targets):
                words[label >> 6] |= 1 << (label & 63)
                self.target[at], self.output[at] = to, passed
                passed += self.below[to]
                at += 1
            self.bits[i] = words
        self.ranks = np.zeros((n, 4), np.int32)
        self.ranks[:, 1:] = np.cumsum(np.bitwise_count(self.bits), axis=1)[:, :3]
        del self.register, self.states, self.below

    def ordinals(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, root: np.ndarray) -> np.ndarray:
        """The ordinal of every word among those of its root; -1 for a word that is not accepted. All words step together."""
        out = np.full(len(starts), -1, np.int64)
        row = np.flatnonzero(root >= 0)
        state, at, end, number = root[row].astype(np.int64), starts[row], ends[row], np.zeros(len(row), np.int64)
        bits, ranks = self.bits.ravel(), self.ranks.ravel()
        while len(row):
            byte = raw[at]
            cell = state * 4 + (byte >> 6)
            word, shift = bits[cell], (byte & 63).astype(U)
            on = np.flatnonzero((word >> shift) & U(1))
            word, shift, cell = word[on], shift[on], cell[on]
            edge = self.first[state[on]] + ranks[cell] + np.bitwise_count(word & ((U(1) << shift) - U(1)))
            row, at, end = row[on], at[on] + 1, end[on]
            state, number = self.target[edge].astype(np.int64), number[on] + self.output[edge]
            done = at == end
            told = done & self.final[state]
            out[row[told]] = number[told]
            on = ~done
            row, state, at, end, number = row[on], state[on], at[on], end[on], number[on]
        return out


def term_documents(docs: DataFrame) -> DataFrame:
    """``lang, term, n``: documents of a language that hold a term, summed per task as far as its table goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for part in slices(batch, "_text", STEP):
                raw, offsets = flat(part.column("_text"))
                raw = LOWER[raw]
                starts, ends, doc = term_spans(raw, offsets)
                names, code = coded(part.column("lang"))
                term = span_hashes(prefix_sums(raw), starts, ends)
                once = np.unique(mix(term + doc.astype(U)), return_index=True)[1]
                key, first, n = np.unique(mix(term[once] ^ mix(lang_hashes(names)[code[doc[once]]])), return_index=True, return_counts=True)
                pick = once[first]
                full = tally.add(key, n, [names.take(pa.array(code[doc[pick]])), texts_of(raw, starts[pick], ends[pick])])
                if full is not None:
                    yield full.rename_columns(["lang", "term", "n"])
        full = tally.end()
        if full is not None:
            yield full.rename_columns(["lang", "term", "n"])

    found = docs.select("lang", "_text").mapInArrow(run, "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def lang_hashes(names: pa.Array) -> np.ndarray:
    raw, offsets = flat(names)
    return span_hashes(prefix_sums(raw), offsets[:-1], offsets[1:])


def term_hashes(terms: DataFrame) -> DataFrame:
    """``hash`` of every term, the same as that of a word in a scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(batch.column("term"))
            yield pa.RecordBatch.from_arrays([pa.array(span_hashes(prefix_sums(raw), offsets[:-1], offsets[1:]).view(np.int64))], names=["hash"])

    return terms.select("term").mapInArrow(run, "hash long")


def numbered(kept: DataFrame) -> DataFrame:
    """``lang, term, n, ordinal``: the place of every row in the order of language and term, by a range sort and the counts of its partitions."""
    spark = kept.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = kept.repartitionByRange(width, "lang", "term").sortWithinPartitions("lang", "term")
    placed = cut_lineage(spread.select("lang", "term", "n", F.monotonically_increasing_id().alias("_at")))
    sizes = placed.groupBy(F.shiftright("_at", 33).cast("int").alias("_part")).agg(F.count("*").alias("_n")).orderBy("_part").collect()  # one row a partition
    starts = np.concatenate([[0], np.cumsum([r._n for r in sizes])]).tolist()
    offset = spark.createDataFrame([(r._part, at) for r, at in zip(sizes, starts)], "_part int, _start long")
    joined = placed.withColumn("_part", F.shiftright("_at", 33).cast("int")).join(F.broadcast(offset), "_part")  # one row a partition
    return joined.select("lang", "term", "n", (c("_start") + (c("_at").bitwiseAND((1 << 33) - 1))).alias("ordinal"))


def compiled(head: DataFrame) -> tuple[Transducer, dict[str, np.ndarray]]:
    """The transducer of at most ``HEAD`` short terms, and each language's ordinals by place."""
    rows = head.orderBy("lang", "term").select("lang", F.col("term").cast("binary").alias("term"), "ordinal").toPandas()  # bounded: HEAD terms of LONGEST bytes
    made = Transducer(zip(rows["lang"], map(bytes, rows["term"])))
    return made, {lang: part.to_numpy(np.int64) for lang, part in rows.groupby("lang", sort=False)["ordinal"]}


def recount(docs: DataFrame, kept: DataFrame, most: int = HEAD) -> DataFrame:
    """``lang, source, ordinal, n``: occurrences of every kept term in every group that has some."""
    short = F.octet_length("term") <= LONGEST
    limit = commonest(kept.where(short), most)
    top = short & (c("n") > limit)
    made, ordinals = compiled(kept.where(top))
    rest = kept.where(~top)
    refused = not rest.isEmpty()
    shared = docs.sparkSession.sparkContext.broadcast((made, ordinals, filters.build(term_hashes(rest), "hash") if refused else None))
    names = ["lang", "source", "ordinal", "term", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer, places, mask = shared.value
        known, other = Tally(), Tally()

        def shaped(full, column):
            if full is not None:
                none = [pa.nulls(full.num_rows, pa.string())] if column == "ordinal" else [pa.nulls(full.num_rows, pa.int64())]
                x = [full.column(2), *none] if column == "ordinal" else [*none, full.column(2)]
                yield pa.RecordBatch.from_arrays([full.column(0), full.column(1), *x, full.column(3)], names=names)

        for batch in batches:
            for part in slices(batch, "_text", STEP):
                raw, offsets = flat(part.column("_text"))
                raw = LOWER[raw]
                starts, ends, doc = term_spans(raw, offsets)
                langs, lang = coded(part.column("lang"))
                sources, source = coded(part.column("source"))
                group = mix(mix(lang_hashes(langs)[lang]) + lang_hashes(sources)[source])
                listed = langs.to_pylist()
                roots = np.array([transducer.roots.get(x, -1) for x in listed], np.int64)
                place = transducer.ordinals(raw, starts, ends, roots[lang[doc]])
                hit = np.flatnonzero(place >= 0)
                found = np.zeros(len(place), np.int64)
                for i, x in enumerate(listed):
                    if x in places:
                        own = hit[lang[doc[hit]] == i]
                        found[own] = places[x][place[own]]
                sides = [(known, hit, found[hit].view(U), "ordinal")]
                if refused:
                    late = np.flatnonzero(place < 0)
                    value = span_hashes(prefix_sums(raw), starts[late], ends[late])
                    likely = filters.held(mask, value)
                    sides.append((other, late[likely], value[likely], "term"))
                for tally, rows, value, column in sides:
                    key, first, n = np.unique(mix(group[doc[rows]] ^ mix(value)), return_index=True, return_counts=True)
                    pick = rows[first]
                    at = doc[pick]
                    told = pa.array(found[pick]) if column == "ordinal" else texts_of(raw, starts[pick], ends[pick])
                    yield from shaped(tally.add(key, n, [langs.take(pa.array(lang[at])), sources.take(pa.array(source[at])), told]), column)
        yield from shaped(known.end(), "ordinal")
        yield from shaped(other.end(), "term")

    seen = docs.select("lang", "source", "_text").mapInArrow(run, "lang string, source string, ordinal long, term string, n long")
    if refused:
        seen = cut_lineage(seen)
        late = seen.where("term is not null").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
        late = late.join(rest.select("lang", "term", "ordinal"), ["lang", "term"]).select("lang", "source", "ordinal", "n")
        seen = seen.where("term is null").select("lang", "source", "ordinal", "n").unionByName(late)
    return seen.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def share(number, total, terms):
    """1 + floor(SCALE * (number + 2) / (total + 2 * terms)), exact."""
    wide = "decimal(20,0)"
    return F.expr(f"1 + (cast({number} as {wide}) + 2) * cast({SCALE} as {wide}) div (cast({total} as {wide}) + 2 * cast({terms} as {wide}))")


def pair_sums(entries: DataFrame) -> DataFrame:
    """``lang, s, t, value`` for s < t, from ``lang, block, width, s, at, p``: a block has every source once with ``at`` -1 and the p of an absent term."""
    width = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["lang", "s", "t", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        held, parts = None, []

        def rows(lang, first, square):
            for i, line in enumerate(square):
                t = np.arange(first + i + 1, len(line))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(t), pa.string()), pa.array(np.full(len(t), first + i), pa.int32()), pa.array(t, pa.int32()), pa.array(line[t])], names=names)

        def block(key, pieces):
            (lang, _), wide = key, int(pieces[0]["width"][0])
            s, at, p = (np.concatenate([x[k] for x in pieces]) for k in ("s", "at", "p"))
            blank = at < 0
            grid = np.zeros((int(s.max()) + 1, wide), np.int64)
            grid[s[blank]] = p[blank][:, None]
            grid[s[~blank], at[~blank]] = p[~blank]
            whole = len(grid) ** 2 <= CELLS
            if whole and lang not in sums:
                for old in list(sums):
                    yield from rows(old, 0, sums.pop(old))
                sums[lang] = np.zeros((len(grid), len(grid)), np.int64)
            for i in range(len(grid) - 1):
                line = np.zeros(len(grid), np.int64)
                apart = grid[i + 1:] - grid[i]
                line[i + 1:] = (apart * apart // (grid[i + 1:] + grid[i])).sum(axis=1)
                if whole:
                    sums[lang][i] += line
                else:
                    yield from rows(lang, i, [line])

        for batch in batches:
            lang, number = batch.column("lang").to_pylist(), batch.column("block").to_numpy()
            new = [i for i in range(batch.num_rows) if i == 0 or (lang[i], number[i]) != (lang[i - 1], number[i - 1])]
            for a, e in zip(new, [*new[1:], batch.num_rows]):
                if held is not None and held != (lang[a], number[a]):
                    yield from block(held, parts)
                    parts = []
                held = (lang[a], number[a])
                parts.append({k: batch.column(k).to_numpy()[a:e] for k in ("width", "s", "at", "p")})
        if held is not None:
            yield from block(held, parts)
        for lang, square in sums.items():
            yield from rows(lang, 0, square)

    spread = entries.select("lang", "block", "width", "s", "at", "p").repartition(width, "lang", "block").sortWithinPartitions("lang", "block")
    return spread.mapInArrow(run, "lang string, s int, t int, value long").groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 10, top: int = 10, head: int = HEAD) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` against every other source, part ``term`` the ``top`` terms that a source has more of than its language."""
    plain = docs.select(*(F.coalesce(c(f"`{k}`"), F.lit("")).alias(n) for k, n in ((lang, "lang"), (source, "source"), (text, "_text"))))
    kept = cut_lineage(numbered(term_documents(plain).where(c("n") >= least)))
    counts = cut_lineage(recount(plain, kept, head))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.min("ordinal").alias("start"))
    groups = plain.select("lang", "source").distinct().join(langs, "lang", "left").join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("total", F.lit(0)).alias("total"))
    groups = cut_lineage(groups.withColumn("s", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    held = cut_lineage(counts.join(groups, ["lang", "source"]).select("lang", "source", "s", "ordinal", "n", "start", "v", share("n", "total", "v").alias("p")))

    blank = groups.where("v > 0").select("lang", "s", "v", share("0", "total", "v").alias("p"), F.explode(F.expr(f"sequence(0L, (v - 1) div {BLOCK})")).alias("block"))
    wide = F.least(F.lit(BLOCK), c("v") - c("block") * BLOCK).cast("int").alias("width")
    entries = blank.select("lang", "block", wide, "s", F.lit(-1).alias("at"), "p").unionByName(
        held.withColumn("block", F.expr(f"(ordinal - start) div {BLOCK}")).select("lang", "block", wide, "s", F.expr(f"cast((ordinal - start) % {BLOCK} as int)").alias("at"), "p"))
    sums = cut_lineage(pair_sums(entries))
    one = groups.select("lang", "source", "s")
    other = groups.select("lang", c("source").alias("item"), c("s").alias("t"))
    both = one.join(other, "lang").where("s <> t").withColumn("_low", F.least("s", "t")).withColumn("_high", F.greatest("s", "t"))  # the rows of the result
    told = sums.select("lang", c("s").alias("_low"), c("t").alias("_high"), "value")
    pairs = both.join(told, ["lang", "_low", "_high"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    all_ = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("_n")).join(groups.groupBy("lang").agg(F.sum("total").alias("_total"), F.max("v").alias("_v")), "lang")
    all_ = all_.select("lang", "ordinal", share("_n", "_total", "_v").alias("q"))
    more = held.join(all_, ["lang", "ordinal"]).where("p > q").select("lang", "source", "ordinal", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    best = more.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal"))).where(c("rank") <= top)
    terms = best.join(kept.select("ordinal", c("term").alias("item")), "ordinal").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
