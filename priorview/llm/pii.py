"""Personal data: fixed patterns, and terms that reveal the entities they stand near."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from math import ceil
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A failing start inside a run of digits fails like the run's first digit, so only that is tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ".,;:!?()[]{}<>\"'|*#&%$"   # stripped from a word to give the term
FOLD = str.maketrans(ascii_uppercase, ascii_lowercase)
WINDOW = 8            # words on either side of an entity
SUPPORT = 3           # different contexts in which a term stands near an entity
REMOVE, GENERALISE = 0.9, 0.75
BROADCAST = 200_000   # most terms sent to a task at once


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[str, int, int]]:
    """Each @ with what may stand before it (down to the last match) and a domain after it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start. Linear in the length of the text."""
    out = _emails(text)
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(q := p.lstrip("0")) < 4 and int(q or 0) < 256 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def term(word: str) -> str:
    return word.strip(EDGES).translate(FOLD)


def term_column(word: Column) -> Column:
    word = F.btrim(word, F.lit(EDGES))
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, ascii_uppercase, ascii_lowercase))


def _entity(kind: str, value: str) -> int:
    value = value.translate(FOLD) if kind == "email" else value if kind == "ip" else _digits(value)
    return xxhash.xxh64_intdigest(f"{kind}:{value}") - (1 << 63)


def _taken(spans: list[tuple[str, int, int]]):
    """A test of whether an interval meets one of the spans."""
    starts, ends = [], []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def meets(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return k > 0 and ends[k - 1] > a

    return meets


def _contexts(text: str, window: int):
    """(entity, term or None, context) for each entity in the text and each term near it. The
    context is a hash of the words around, so copies of a passage are one context."""
    spans = base_spans(text)
    taken = _taken(spans)
    found = list(WORD.finditer(text)) if spans else []
    starts, ends = [m.start() for m in found], [m.end() for m in found]
    for kind, a, b in spans:
        # Whole words only: what is left of a word that the entity is part of is no term.
        last, first = bisect_right(ends, a), bisect_left(starts, b)
        before, after = found[max(0, last - window):last], found[first:first + window]
        near = [m for m in before + after if not taken(m.start(), m.end())]
        terms = [t for m in near if len(t := term(m[0])) > 2]
        context = xxhash.xxh64_intdigest(" ".join(terms)) - (1 << 63)
        entity = _entity(kind, text[a:b])
        yield entity, None, context
        for t in dict.fromkeys(terms):
            yield entity, t, context


def revealing_terms(docs: DataFrame, text_col: str = "text", window: int = WINDOW, support: int = SUPPORT,
                    least: float = GENERALISE) -> DataFrame:
    """(term, disclosure) of the terms that reveal an entity of the base patterns.

    With p(e) an entity's share of all occurrences of entities, and p(e|t) the share of a term's
    occurrences in the whole corpus that stand within `window` words of it, the disclosure is
    log(p(e|t) / p(e)) / -log(p(e)): the part of the entity's information that the term gives,
    1 when the term occurs nowhere else. Terms below `support` different contexts tell
    nothing and are left out; so are those below `least`.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def near(batches):
        for batch in batches:
            rows = [r for t in batch.column(0) for r in _contexts(t.as_py(), window)]
            e, t, c = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()), pa.array(t, pa.string()), pa.array(c, pa.int64())],
                                             ["entity", "term", "context"])

    found = stored(docs.select(text.alias("text")).mapInArrow(near, "entity long, term string, context long"), "contexts")
    entities = found.where("term is null").groupBy("entity").agg(F.count("*").alias("n_e"))
    total = found.where("term is null").count()
    pairs = (found.where("term is not null").groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
             .groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count("*").alias("contexts"))
             .where(F.col("contexts") >= support))
    pairs = stored(pairs, "term-pairs")
    terms = pairs.select("term").distinct()
    words = docs.select(F.explode(F.split(text, r"[\x20\x09-\x0D]+", -1)).alias("word")).select(term_column(F.col("word")).alias("term"))
    number = terms.count()
    if number <= BROADCAST:  # else whole counts first
        words = words.join(F.broadcast(terms), "term", "left_semi") if number else words.where("false")
    counts = words.groupBy("term").agg(F.count("*").alias("n_t"))
    p_e = F.col("n_e") / F.lit(max(total, 1))
    p_te = F.least(F.lit(1.0), F.col("n_te") / F.col("n_t"))
    scored = (pairs.join(counts, "term").join(entities, "entity").where(F.col("n_e") < total)
              .select("term", (F.log(p_te / p_e) / -F.log(p_e)).alias("disclosure")))
    return scored.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= least)


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None,
               block: int = BROADCAST) -> DataFrame:
    """(id, text, spans): all spans of each text, base kinds first, then revealing terms.

    spans is an array of (kind, start, end, replacement) in code points. Terms of the kinds
    `remove` and `generalise` never overlap a base span. `terms` is by default
    `revealing_terms(docs)`. It goes to the tasks in blocks of up to `block` terms, each block
    one more step over the rows, so no task holds more. Null texts are empty. Repeated rows
    stay, null ids stay null, other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    terms = stored(revealing_terms(docs, text_col) if terms is None else terms, "terms")
    blocks = max(1, ceil(terms.count() / block))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, text string, spans array<struct<kind:string,start:int,end:int,put:string>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("put", pa.string())]))

    def step(held, first):
        def run(batches):
            known = held.value
            for batch in batches:
                out = []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    spans = ([{"kind": n, "start": a, "end": b, "put": f"[{n.upper()}]"} for n, a, b in base_spans(text)]
                             if first else batch.column(2)[k].as_py())
                    more, taken = [], _taken([(s["kind"], s["start"], s["end"]) for s in spans]) if known else None
                    for m in WORD.finditer(text) if known else ():
                        t = term(m[0])
                        if t in known:
                            a = m.start() + len(m[0]) - len(m[0].lstrip(EDGES))
                            b = a + len(t)
                            if not taken(a, b):
                                removed = known[t] >= REMOVE
                                more.append({"kind": "remove" if removed else "generalise", "start": a, "end": b,
                                             "put": "" if removed else "[NUMBER]" if any(c.isdigit() for c in t) else "[WORD]"})
                    out.append(spans + sorted(more, key=lambda s: (s["kind"] != "remove", s["start"])))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, arrow)], ["id", "text", "spans"])
        return run

    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for k in range(blocks):
        part = terms.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k)
        held = spark.sparkContext.broadcast({r["term"]: r["disclosure"] for r in part.collect()})
        out = out.mapInArrow(step(held, k == 0), schema)
    return out


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """(id, text) with base spans and revealing terms replaced; of overlapping spans, the one
    that starts first."""

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts, last = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= last:
                        parts += [text[last:s["start"]], s["put"]]
                        last = s["end"]
                    elif s["end"] > last:  # overlaps: its rest goes too
                        last = s["end"]
                out.append("".join(parts) + text[last:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])

    found = with_spans(docs, id_col, text_col, terms)
    return found.mapInArrow(run, f"id {found.schema['id'].dataType.simpleString()}, text string")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for spans in batch.column(1).to_pylist():
                spans = [(s["kind"], s["start"], s["end"]) for s in spans]
                base = [s for s in spans if s[0] in KINDS]
                n = Counter(s[0] for s in base)
                rows.append((*(n[k] for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                                             ["doc_id", *KINDS, "base", "spans"])

    found = with_spans(table(spark, sf_dir, "documents")).select("id", "spans")
    return found.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
