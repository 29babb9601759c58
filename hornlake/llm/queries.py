"""The thin ``opN_*`` queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontam, fingerprint, langid, neardup, packing, pii, substring, tokencount, toxicity, urlgraph
from .common import table


def op1_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.sanitize(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def _remainder(of: int):
    """crc32 of the id as text, by remainder."""
    return F.crc32(F.col("doc_id").cast("string")) % of


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(_remainder(4) != 2))
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.keep_unique(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def learned_languages(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries from the rows outside the held-out fold (crc32 of the id, mod 5, is 0)."""
    return langid.learn(docs.filter(_remainder(5) != 0).select("doc_id", "text", "lang"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.classify(docs.select("doc_id", "text"), learned_languages(docs))
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_pii_sanitisation": op1_pii_sanitisation,
    "op2_fingerprints": op2_fingerprints,
    "op3_toxicity": op3_toxicity,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_url_filters": op8_url_filters,
    "op9_language_id": op9_language_id,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_OP4_WORDS = _WORDS.format("coalesce(text, '')")
_OP7_WORDS = _WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

_OP4 = f"""with w as (select doc_id, {_OP4_WORDS} ws from documents),
x as (select doc_id, k, array_to_string(ws[k:k + 49], ' ') t from (select doc_id, ws, unnest(range(1, len(ws) - 48)) k from w where len(ws) >= 50)),
m as (select t, min(doc_id) d from x group by t),
hit as (select distinct x.doc_id, unnest(range(k, k + 50)) i from x join m using (t) where x.doc_id > m.d),
v as (select doc_id, unnest(ws) word, unnest(range(1, len(ws) + 1)) i from w),
kept as (select doc_id, string_agg(word, ' ' order by i) t, count(*) n from v anti join hit using (doc_id, i) group by doc_id)
select w.doc_id, len(ws)::bigint n_words, (len(ws) - coalesce(kept.n, 0))::bigint n_removed, sha256(coalesce(kept.t, '')) kept_sha256
from w left join kept using (doc_id)"""

_OP7 = f"""with recursive w as (select doc_id, {_OP7_WORDS} ws from documents),
sh as (select distinct doc_id, array_to_string(ws[k:k + 4], ' ') s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) k from w where len(ws) > 0)),
n as (select doc_id, count(*) n from sh group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
t as (select a, b from e union select t.a, e.b from t join e on e.a = t.b),
c as (select a, least(a, min(b)) m from t group by a)
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(c.m, w.doc_id) component_id, coalesce(c.m, w.doc_id) = w.doc_id kept
from w left join n using (doc_id) left join c on c.a = w.doc_id"""


def _op8() -> str:
    """The link graph's ranks, a common table expression a round."""
    host = lambda u: f"translate(regexp_extract(coalesce({u}, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rule, verdict = "null", "null"
    for at, start, what in sorted(urlgraph.RULES, key=lambda r: (len(r[0] + r[1]), r)):
        fits = f"(host = '{at}' or ends_with(host, '.{at}')) and starts_with(path, '{start}')"
        rule, verdict = f"case when {fits} then '{at}{start}' else {rule} end", f"case when {fits} then '{what}' else {verdict} end"
    link = r"""regexp_extract_all(coalesce(html, ''), '(?i)(?:href|src)\s*=\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]*)', 1)"""
    target = host("case when starts_with(link, '//') then 'http:' || link else link end")
    parts = [
        f"p as (select page_id, html, {host('url')} host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path from pages)",
        f"r as (select page_id, host, path, html, {rule} as rule, {verdict} ruled from p)",
        "h as (select host, avg((coalesce(ruled, '') = 'allow')::int) allowed, avg((coalesce(ruled, '') = 'block')::int) blocked from r where host <> '' group by host)",
        f"k as (select host src, unnest({link}) link from r)",
        f"e as (select src, dst, count(*) n from (select src, {target} dst from k) where src <> dst and src <> '' and dst <> '' group by 1, 2)",
    ]
    for name, column, src, dst in (("t", "allowed", "src", "dst"), ("d", "blocked", "dst", "src")):
        parts.append(f"{name}s as (select host, {column} / sum({column}) over () restart from h where {column} > 0)")
        parts.append(f"{name}e as (select {src} src, {dst} dst, n / sum(n) over (partition by {src}) share from e)")
        parts.append(f"{name}0 as (select host, restart rank from {name}s)")
        for i in range(urlgraph.ROUNDS):
            parts.append(f"{name}m{i} as materialized (select dst host, sum(share * rank) rank from {name}e join {name}{i} on host = src group by dst)")
            back = f"(select {1 - urlgraph.DAMPING} + {urlgraph.DAMPING} * greatest(0, 1 - coalesce(sum(rank), 0)) from {name}m{i})"
            parts.append(f"{name}{i + 1} as materialized (select host, sum(rank) rank from (select host, rank * {urlgraph.DAMPING} rank from {name}m{i} union all select host, restart * {back} from {name}s) group by host)")
    last, digits = urlgraph.ROUNDS, urlgraph.DIGITS
    trust, distrust = (f"coalesce({x}.rank, 0)" for x in "td")
    share = f"round({distrust} / nullif({trust} + {distrust}, 0), {digits})"
    return f"""with {", ".join(parts)}
    select page_id, r.host, path, rule, coalesce(ruled, case when {share} > {urlgraph.THRESHOLD} then 'block' else 'allow' end) verdict
    from r left join t{last} t on t.host = r.host left join d{last} d on d.host = r.host"""


ORACLE_SQL: dict[str, str] = {"op4_substring_dedup": _OP4, "op7_minhash_near_dedup": _OP7, "op8_url_filters": _op8()}
