r"""Information-theoretic sanitisation of personal data (operator 1).

Base detectors find e-mail addresses, IPs, card and phone numbers. Protected
entities are each distinct value, its class (mail domain, first half of an IP,
first four digits of a card, first digits of a phone number) and its kind.
Corpus co-occurrence then estimates how
strongly terms reveal entities (Sanchez and Batet, 2016): with documents as
units, IC(e) = log2(N / n_e) and PMI(e, t) = log2(N n_et / (n_e n_t)), n_et counting
documents with t within ``REACH`` words of e. A term discloses e from
PMI / IC >= ``DISCLOSURE`` on, if at least ``SUPPORT`` different surroundings hold both
(so that copies of a text, or a word met once, reveal nothing). Such terms are
spans of kind ``term`` wherever they occur: removed if they reveal all of e
(ratio 1, within 1e-9), else generalised to the shape of the word.

A term is a run of three or more letters and digits, each word lower-cased by
itself. Counts cover the whole corpus: per task and batch first, then summed.
Up to ``TOLD`` disclosing terms of together ``TOLD_CHARS`` characters (some MB) are
told to the tasks; beyond that each text's terms, found by the same code, meet
the disclosing ones in a join by the text's SHA-256.

Cases: a null text counts as empty; digests of no span are the SHA-256 of an
empty string; spans of different kinds may overlap, and a term that touches a
base span is left to it; rows with a null doc_id are treated like others;
repeated rows give repeated rows; other columns are ignored or passed on.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import fresh, map_arrow, materialize

KINDS = ("email", "ip", "card", "phone", "term")
REACH = 12
SUPPORT = 2
DISCLOSURE = 0.8
TOLD, TOLD_CHARS = 100_000, 2_000_000

# Possessive runs and look-behinds keep these linear on any text; what they find is what
# the plain forms find: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and so on.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TERM = re.compile(r"[^\W_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: the local run before it, no further back than the last match, and a domain after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        after = at + 1
        if start < at and (found := _DOMAIN.match(text, at)):
            yield start, found.end()
            last = after = found.end()
        else:
            last = at + 1
        at = text.find("@", after)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; kind by its place in KINDS."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


def entities(text: str, kind: int, start: int, end: int) -> list[str]:
    """The protected entities a span stands for: the value, its class and its kind."""
    value, name = text[start:end], KINDS[kind]
    if kind == 0:
        value = value.lower()
        of = value.rpartition("@")[2]
    elif kind == 1:
        of = ".".join(value.split(".")[:2])
    else:
        value = _NOT_DIGIT.sub("", value)
        of = value[:4]
    return [f"{name}:{value}", f"{name} of {of}", name]


def terms_of(text: str) -> set[str]:
    return {t.lower() for t in set(_TERM.findall(text))}


def _blank(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with spaces in place of spans, which may overlap."""
    parts, at = [], 0
    for start, _, end in spans:
        if end > at:
            start = max(start, at)
            parts += [text[at:start], " " * (end - start)]
            at = end
    return "".join([*parts, text[at:]])


def mentions(text: str, reach: int) -> dict[tuple[str, str, int], int]:
    """(entity, term, context) -> 1 where the pair of entity and term first occurs in the text, else 0.

    Terms are the ``reach`` next to the span on either side, however far; base spans
    hold no terms. The term '' is the entity itself. A context is a hash of all terms around.
    """
    spans = base_spans(text)
    found: dict[tuple[str, str, int], int] = {}
    if not spans:
        return found
    near = [(m.start(), m.group().lower()) for m in _TERM.finditer(_blank(text, spans))]
    starts, met = [s for s, _ in near], set()
    for start, kind, end in spans:
        left, right = bisect.bisect_left(starts, start), bisect.bisect_left(starts, end)
        terms = sorted({t for _, t in near[max(0, left - reach) : left] + near[right : right + reach]})
        context = xxhash.xxh3_64_intdigest("\n".join(terms).encode("utf-8", "replace")) >> 1
        for name in entities(text, kind, start, end):
            for t in ["", *terms]:
                found.setdefault((name, t, context), int((name, t) not in met))
                met.add((name, t))
    return found


def _shape(word: str) -> str:
    """The generalised form of a word: its kind and nothing of its letters."""
    return "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]"


def _counted(docs: DataFrame, count, kinds: list[tuple[str, pa.DataType]]) -> DataFrame:
    """Sums, per slice, of what ``count`` gives for each text: keys to numbers."""
    names = [n for n, _ in kinds] + ["docs"]

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(count(text))
            if counts:
                keys = list(zip(*counts, strict=True)) if len(kinds) > 1 else [list(counts)]
                yield pa.RecordBatch.from_arrays([*(pa.array(k, t) for k, (_, t) in zip(keys, kinds, strict=True)), pa.array(list(counts.values()), pa.int64())], names)

        return step

    return map_arrow(docs.select(F.col("text").cast("string")), make, ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in [*kinds, ("docs", pa.int64())]), text=0)


def _mentions(docs: DataFrame, reach: int) -> DataFrame:
    """(entity, term, context, docs): terms near entities; term '' is the entity itself."""
    return _counted(docs, lambda text: mentions(text, reach), [("entity", pa.string()), ("term", pa.string()), ("context", pa.int64())])


def _word_counts(docs: DataFrame) -> DataFrame:
    """(term, docs): documents that hold a term."""
    return _counted(docs, terms_of, [("term", pa.string())])


def disclosing_terms(docs: DataFrame, reach: int = REACH, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(term, ratio): the share of its most revealed entity's information that a term gives, where it passes."""
    spark = docs.sparkSession
    met = _mentions(docs, reach).groupBy("entity", "term", "context").agg(F.sum("docs").alias("docs"))
    pairs = met.groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("docs").alias("docs")).filter((F.col("term") == "") | (F.col("contexts") >= support))
    pairs = materialize(pairs, "pii-pairs")
    candidates = pairs.filter("term <> ''")
    if candidates.isEmpty():
        return spark.createDataFrame([], "term string, ratio double")
    n = docs.count()
    of_entity = pairs.filter("term = ''").select("entity", F.col("docs").alias("n_e"))
    terms = _word_counts(docs).groupBy("term").agg(F.sum("docs").alias("n_t"))
    both = candidates.join(of_entity, "entity").join(terms, "term")
    pmi = F.log2(F.lit(float(n)) * F.col("docs") / (F.col("n_e").cast("double") * F.col("n_t")))
    ic = F.log2(F.lit(float(n)) / F.col("n_e"))
    ratio = F.when(ic > 0, pmi / ic).otherwise(0.0)
    return both.groupBy("term").agg(F.max(ratio).alias("ratio")).filter(F.col("ratio") >= disclosure)


def _term_spans(text: str, terms, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the terms, but for those that touch a base span."""
    out, k, covered = [], 0, 0  # covered: where the base spans that start before the word end
    for m in _TERM.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            covered = max(covered, base[k][2])
            k += 1
        if covered <= m.start() and m.group().lower() in terms:
            out.append((m.start(), 4, m.end()))
    return out


def _replace(text: str, spans: list[tuple[int, int, int]], ratios) -> str:
    """Base spans become their kind; terms go, or become their shape. Overlapping spans act as one."""
    parts, at = [], 0
    for start, kind, end in spans:
        if end <= at:
            continue
        if start >= at:
            parts.append(text[at:start])
            if kind < 4:
                parts.append(f"[{KINDS[kind].upper()}]")
            elif ratios.get(text[start:end].lower(), 1.0) < 1 - 1e-9:
                parts.append(_shape(text[start:end]))
        at = end
    return "".join([*parts, text[at:]])


def _found(docs: DataFrame, told: dict[str, float], own: str | None = None) -> DataFrame:
    """Adds ``spans`` (kind, start, end) and ``clean_text``. With ``own``, each row's own terms come in that column."""
    added = [T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("clean_text", T.StringType())]
    names = docs.columns
    text_at, own_at = names.index("text"), names.index(own) if own else None
    kept = [k for k, c in enumerate(names) if c != own]
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            all_spans, clean = [], []
            terms = batch.column(own_at).to_pylist() if own_at is not None else None
            for k, text in enumerate(batch.column(text_at).to_pylist()):
                known = dict(terms[k] or ()) if terms else told
                spans = base_spans(text) if text else []
                if text and known:
                    spans = sorted(spans + _term_spans(text, known, spans))
                all_spans.append([{"kind": KINDS[i], "start": s, "end": e} for s, i, e in spans])
                clean.append(_replace(text, spans, known) if spans else text)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(all_spans, span_type), pa.array(clean, pa.string())], [*(names[k] for k in kept), "spans", "clean_text"])

        return step

    return map_arrow(docs, make, T.StructType([*(docs.schema.fields[k] for k in kept), *added]), text=text_at)


def _texts_terms(docs: DataFrame, key: str) -> DataFrame:
    """(id, term): the distinct terms of each distinct text."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids, found = [], []
            for i, text in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                terms = terms_of(text)
                ids += [i] * len(terms)
                found += terms
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.string())], ["id", "term"])

        return step

    return map_arrow(docs.select(F.col(key).alias("id"), "text").filter("text is not null"), make, "id string, term string", text=1).distinct()


def sanitize(docs: DataFrame, told: int = TOLD) -> DataFrame:
    """All columns of ``docs``, then ``spans`` and ``clean_text`` (which replace columns so named)."""
    docs = docs.drop("spans", "clean_text").withColumn("text", F.col("text").cast("string"))
    terms = materialize(disclosing_terms(docs), "pii-terms")
    n, chars = terms.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    if n <= told and chars <= TOLD_CHARS:
        return _found(docs, {r["term"]: r["ratio"] for r in terms.collect()})
    key, own = fresh("text_sha", docs), fresh("own_terms", docs)
    docs = docs.withColumn(key, F.sha2("text", 256))
    found = _texts_terms(docs, key).join(terms, "term").groupBy(F.col("id").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("term", "ratio"))).alias(own))
    return _found(docs.join(found, key, "left").drop(key), {}, own)


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests of ``sanitize``'s rows."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "term")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", name), ",").alias("spans"))
