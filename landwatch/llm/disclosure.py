"""Personal data and the terms that reveal it: information-theoretic sanitisation.

Base entities (email, ip, card, phone) are found by pattern and check. Words are what stands between
spaces once base entities are cut out. Over all distinct texts, the disclosure of an entity c by a term t
is PMI(c; t) / IC(c): how much of the entity's information the term gives away, 1 if the term is only
seen with it. All words of a text count as seen with all entities of that text, so copies of a text count
once. A pair needs ``support`` occurrences of the entity in texts with the term. A term above
``generalise`` is replaced by its class (a number, a word, a mixture) wherever it stands in a text that
holds the entity, one above ``remove`` is dropped. Base entities are always replaced by their kind.

Null texts count as empty and give no spans. Repeated rows give repeated results with the same spans.
Spans are code points, end exclusive; of spans that overlap the replacement keeps the first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landwatch.llm import filters
from landwatch.llm.batches import STEP, flat, slices, strings, unused
from landwatch.llm.hashing import LOWER, U, prefix_sums, span_hashes, word_hashes
from landwatch.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
TERM = re.compile(r"[^\x20\x09-\x0D]+")
#: Parts of a hot entity, term or text.
SALTS = 16
c = F.col


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of ``EMAIL``, found from each @: a run of name characters is not tried again from each place."""
    low = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > low and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            low = at = found.end()
        else:
            at += 1


def _luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """The matches of ``IP``, by groups of digits so that no run is tried from each place."""
    group = [m.span() for m in DIGITS.finditer(text)]
    i = 0
    while i + 3 < len(group):
        if all(group[k + 1][0] - group[k][1] == 1 and text[group[k][1]] == "." for k in range(i, i + 3)):
            parts = [text[s:e].lstrip("0") for s, e in group[i:i + 4]]
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in parts):
                yield group[i][0], group[i + 3][1]
            i += 4
        else:
            i += 1


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base entities, by start, then kind as listed."""
    found = []
    if "@" in text:
        found += [(s, 0, e) for s, e in _emails(text)]
    if text.count(".") > 2:
        found += [(s, 1, e) for s, e in _ips(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub("[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(ch.isdigit() for ch in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def _hashes(values: list[str]) -> np.ndarray:
    """Signed 64-bit hashes of lower-cased strings, the same as those of words in a scan."""
    raw, offsets = flat(pa.array(values, pa.large_string()))
    return span_hashes(prefix_sums(LOWER[raw]), offsets[:-1], offsets[1:]).view(np.int64)


def value_of(text: str, span: tuple[int, str, int]) -> str:
    """What names a base entity: its kind and text, numbers without signs between."""
    start, kind, end = span
    return kind + (text[start:end] if kind in ("email", "ip") else re.sub(r"[\x20().-]", "", text[start:end]))


def terms_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of all words of a text outside its base entities."""
    out, at = [], 0
    for start, _, end in [*base_spans(text), (len(text), "", len(text))]:
        out += [m.span() for m in TERM.finditer(text, at, max(at, start)) if any(map(str.isalnum, m.group()))]
        at = max(at, end)
    return out


def entities(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident, text_hash, base, held``: base spans of every whole text, and how often each entity stands in it."""
    schema = (f"{ident} {docs.schema[ident].dataType.simpleString()}, text_hash long, base array<struct<start:int,kind:string,end:int>>, "
              "held array<struct<entity:long,times:long>>")
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
    held_type = pa.list_(pa.struct([("entity", pa.int64()), ("times", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                base, who, ends = [], [], [0]
                for t in strings(part.column("_text")):
                    spans = base_spans(t)
                    base.append([dict(start=s, kind=k, end=e) for s, k, e in spans])
                    who += Counter(value_of(t, x) for x in spans).items()
                    ends.append(len(who))
                name, times = zip(*who) if who else ((),) * 2
                flat_held = pa.StructArray.from_arrays([pa.array(_hashes(name)), pa.array(times, pa.int64())], fields=list(held_type.value_type))
                yield pa.RecordBatch.from_arrays([part.column(ident), part.column("text_hash"), pa.array(base, base_type),
                                                  pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat_held).cast(held_type)],
                                                 names=[ident, "text_hash", "base", "held"])

    return docs.select(c(ident), F.xxhash64(text).alias("text_hash"), c(text).alias("_text")).mapInArrow(run, schema)


def standing(docs: DataFrame, texts: DataFrame, text: str, terms: DataFrame | None = None) -> DataFrame:
    """``text_hash, term, start, end`` of the words of ``texts``, each distinct text once.

    All words without their places, or the places of ``terms``. Filters thin the scan; texts and terms that only they let
    through may be among the rows.
    """
    placed = terms is not None
    shared = docs.sparkSession.sparkContext.broadcast((filters.build(texts, "text_hash"), filters.build(terms, "term") if placed else None))

    def run(batches):
        asked, mask = shared.value
        for batch in batches:
            batch = batch.filter(pa.array(filters.held(asked, batch.column("text_hash").to_numpy())))
            for part in slices(batch, "_text"):
                done = set()
                for whose, t in zip(part.column("text_hash").to_pylist(), strings(part.column("_text"))):
                    if whose in done:
                        continue
                    done.add(whose)
                    spans = terms_of(t)
                    term = _hashes([t[s:e] for s, e in spans])
                    if placed:
                        hit = filters.held(mask, term)
                        start, end = np.array(spans, np.int32).reshape(-1, 2)[hit].T
                        term = term[hit]
                        start, end = pa.array(start), pa.array(end)
                    else:
                        term = np.unique(term)
                        start = end = pa.nulls(len(term), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), whose, np.int64)), pa.array(term), start, end], names=["text_hash", "term", "start", "end"])

    return docs.select(F.xxhash64(text).alias("text_hash"), c(text).alias("_text")).mapInArrow(run, "text_hash long, term long, start int, end int").distinct()


def term_counts(docs: DataFrame, found: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """``term, texts``: in how many distinct texts each of ``terms`` stands; all texts are read.

    A filter over the terms thins the words in the scan. A task adds up texts that stand once; of
    texts that may stand again it gives the pairs, counted once each. Terms that only the filter lets through may be among the rows.
    """
    copied = found.groupBy("text_hash").count().where("count > 1")
    shared = docs.sparkSession.sparkContext.broadcast((filters.build(terms, "term"), filters.build(copied, "text_hash")))

    def run(batches):
        mask, copies = shared.value
        sums: dict[int, int] = {}
        for batch in batches:
            for part in slices(batch, "_text", STEP // 4):  # its arrays take many bytes a character
                raw, offsets = flat(part.column("_text"))
                word, counts = word_hashes(LOWER[raw], offsets)
                hit = filters.held(mask, word)
                whose = part.column("text_hash").to_numpy()
                owner = np.repeat(np.arange(len(counts)), counts)[hit]
                both = np.unique(np.stack([word[hit].view(np.int64), owner]), axis=1)
                again = filters.held(copies, whose)[both[1]]
                for term, n in zip(*np.unique(both[0][~again], return_counts=True)):
                    sums[int(term)] = sums.get(int(term), 0) + int(n)
                yield pa.RecordBatch.from_arrays([pa.array(both[0][again]), pa.array(whose[both[1][again]]), pa.array(np.ones(int(again.sum()), np.int64))], names=["term", "text_hash", "texts"])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.nulls(len(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["term", "text_hash", "texts"])

    seen = docs.select(F.xxhash64(text).alias("text_hash"), c(text).alias("_text")).mapInArrow(run, "term long, text_hash long, texts long")
    seen = cut_lineage(seen)
    once = seen.where("text_hash is not null").distinct().unionByName(seen.where("text_hash is null"))
    return once.groupBy("term").agg(F.sum("texts").alias("texts"))


def spans(docs: DataFrame, ident: str = "doc_id", text: str = "text", support: int = 3, generalise: float = 0.75,
          remove: float = 0.9) -> DataFrame:
    """``ident, text_hash, base, terms``: base spans and the spans of revealing terms, with kind ``generalised`` or ``removed``, of every row."""
    found = cut_lineage(entities(docs, ident, text))
    terms = revealing(docs, found, text, support, generalise, remove)
    none = F.expr("cast(array() as array<struct<start:int,kind:string,end:int>>)")
    return salted(found.drop("held"), terms, ["text_hash"], ident).withColumn("terms", F.coalesce("terms", none))


def salted(many: DataFrame, few: DataFrame, on: list[str], by: str) -> DataFrame:
    """Left join whose hot keys are spread by the hash of ``by``; ``few`` has one row a key and is repeated for each salt."""
    salt = unused(many, "_salt")
    few = few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(few, [*on, salt], "left").drop(salt)


def revealing(docs: DataFrame, found: DataFrame, text: str, support: int, generalise: float, remove: float) -> DataFrame:
    """``text_hash, terms``: the spans of revealing terms of every distinct text that has some."""
    n = float(found.select("text_hash").distinct().count())
    holds = cut_lineage(found.where(F.size("held") > 0).dropDuplicates(["text_hash"]).select("text_hash", F.explode("held").alias("_e")).select("text_hash", "_e.*"))
    # entities that stand equally often in the same texts have the same shares: one speaks for all
    mark = [F.bit_xor(F.xxhash64(F.lit(k), "text_hash", "times")).alias(f"_m{k}") for k in (1, 2)]
    own = holds.groupBy("entity").agg(F.count("*").alias("held_by"), F.sum("times").alias("_times"), *mark).where(c("_times") >= support)
    own = own.groupBy("held_by", "_times", "_m1", "_m2").agg(F.min("entity").alias("entity")).select("entity", "held_by")
    holds = cut_lineage(holds.join(own, "entity"))
    words = cut_lineage(standing(docs, holds.select("text_hash").distinct(), text).select("text_hash", "term"))
    least = words.groupBy("term").agg(F.count("*").alias("least"))

    def share(texts, both=c("both")):
        pmi = F.log2(F.lit(n) * both / (c("held_by") * F.greatest(texts, both)))
        return pmi / F.log2(F.greatest(F.lit(n), c("held_by") + 1) / c("held_by"))

    # a term stands in as many texts as have it beside an entity at least: pairs that fall short even so are not made
    most = F.least("held_by", "least")
    pairs = words.join(least, "term").join(holds, "text_hash").where(share(c("least"), most) >= generalise)
    pairs = cut_lineage(pairs.select("text_hash", "entity", "term", "times", "held_by", "least"))
    joint = pairs.groupBy("entity", "term").agg(F.count("*").alias("both"), F.sum("times").alias("_times"), F.first("held_by").alias("held_by"), F.first("least").alias("least"))
    joint = cut_lineage(joint.where((c("_times") >= support) & (share(c("least")) >= generalise)))
    counts = term_counts(docs, found, joint.select("term").distinct(), text)
    told = joint.join(counts, "term", "left").withColumn("_share", share(F.greatest("texts", "least"))).where(c("_share") >= generalise).select(
        "entity", "term", F.when(c("_share") >= remove, "removed").otherwise("generalised").alias("kind"))
    flagged = salted(pairs.select("text_hash", "entity", "term"), told, ["entity", "term"], "text_hash").where(c("kind").isNotNull())
    flagged = cut_lineage(flagged.groupBy("text_hash", "term").agg(F.max("kind").alias("kind")))
    places = standing(docs, flagged.select("text_hash").distinct(), text, flagged.select("term").distinct()).join(flagged, ["text_hash", "term"])
    return places.groupBy("text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("terms"))


def replaced(text: str, found: list[tuple[int, str, int]]) -> str:
    """The text with base entities as their kind, generalised terms as their class and removed terms gone."""
    out, at = [], 0
    for start, kind, end in found:
        if start < at:  # overlaps what has been replaced: that replacement stands for both
            at = max(at, end)
            continue
        out.append(text[at:start])
        if kind == "generalised":
            word = text[start:end]
            out.append("[number]" if word.isdigit() else "[word]" if word.isalpha() else "[mixed]")
        elif kind != "removed":
            out.append(f"[{kind}]")
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, ident: str = "doc_id", text: str = "text", support: int = 3, generalise: float = 0.75,
             remove: float = 0.9) -> DataFrame:
    """``docs`` with the text sanitised; all columns stay, whatever their names, and rows stay as they are; a null text stays null."""
    hashed, told = unused(docs, "_hash"), unused(docs, "_terms")
    terms = revealing(docs, cut_lineage(entities(docs, ident, text)), text, support, generalise, remove).select(
        c("text_hash").alias(hashed), c("terms").alias(told))
    rows = salted(docs.withColumn(hashed, F.xxhash64(text)), terms, [hashed], ident).drop(hashed)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                made = []
                for t, s in zip(part.column(text).to_pylist(), part.column(told).to_pylist()):
                    made.append(t if t is None else replaced(t, sorted(base_spans(t) + [(x["start"], x["kind"], x["end"]) for x in s or ()])))
                names = [k for k in part.schema.names if k != told]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()) if k == text else part.column(k) for k in names], names=names)

    return rows.mapInArrow(run, docs.schema)
