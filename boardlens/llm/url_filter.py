"""URL filters: allow and block rules by host and path, else a weighted vocabulary of URL terms.

The host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; the path goes on up to `?`, `#` or the
end. A rule (host, path prefix) fits its host and all subdomains if the path starts with the rule's; of the rules that
fit, the one with the longest text wins. Urls without a rule are judged by their terms: an Aho-Corasick automaton finds all
vocabulary terms of the url, A-Z lower-cased, an occurrence counts if no ASCII letter or digit stands next to it, and a url is
blocked by one strict term, or by LEAST_SOFT or more distinct soft terms whose weights add up to `soft_limit` or more.

Cases: a null url, or one without `://`, has empty host and path and no rule; a null url has no terms and is allowed; very long
urls are judged whole; of rules with equally long texts the later one wins; a weight of exactly the limit blocks; repeated rows
are judged each for itself; an empty table gives no rows; ids are of any type; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.llm.store import mapped

#: Fixed rules of the query: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
STRICT = (
    "porn", "porno", "pornhub", "xxx", "hentai", "milf", "camgirl", "camgirls", "escort", "escorts", "hardcore-sex", "sexcam", "sexcams", "nsfw", "warez", "torrent", "torrents", "keygen", "keygens", "crackz", "serialz", "phishing", "malware", "ransomware", "spyware", "carding", "darknet-market",
)
#: Soft terms with weights: 3 for words that rarely stand in harmless urls, 1 for those that often do.
SOFT = {
    "casino": 3, "viagra": 3, "cialis": 3, "jackpot": 3, "sexy": 3, "nude": 3, "nudes": 3, "erotic": 3, "fetish": 3, "payday": 3,
    "adult": 2, "sex": 2, "betting": 2, "poker": 2, "slots": 2, "roulette": 2, "lottery": 2, "replica": 2, "replicas": 2, "crack": 2, "cracked": 2, "pills": 2, "hookup": 2, "singles": 2, "bitcoin-doubler": 2, "get-rich": 2,
    "bonus": 1, "cheap": 1, "free": 1, "dating": 1, "loan": 1, "loans": 1, "credit": 1, "win": 1, "winner": 1, "prize": 1, "deal": 1, "discount": 1, "hot": 1, "girls": 1, "download": 1, "serial": 1, "pharmacy": 1, "forex": 1, "crypto": 1, "miracle": 1,
}
SOFT_LIMIT, LEAST_SOFT = 4, 2
_LOWER = {k: k + 32 for k in range(0x41, 0x5B)}


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The fitting rule with the longest text as struct<rule, verdict>; null if none fits. A few rules become one expression."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, own, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(own + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class TermMatcher:
    """Aho-Corasick over the vocabulary; built once in each task."""

    def __init__(self, strict, soft: dict[str, int]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term in strict:
            self.automaton.add_word(term, (term, None))
        for term, weight in soft.items():
            self.automaton.add_word(term, (term, weight))
        self.any = bool(strict or soft)
        if self.any:
            self.automaton.make_automaton()

    def hits(self, url: str) -> tuple[int, int, int]:
        """(strict occurrences, distinct soft terms, their weight). Letters and digits are those of ASCII."""
        strict, soft = 0, {}
        if self.any:
            text = f" {url.translate(_LOWER)} "
            for end, (term, weight) in self.automaton.iter(text):
                a, b = text[end - len(term)], text[end + 1]
                if (a.isascii() and a.isalnum()) or (b.isascii() and b.isalnum()):
                    continue
                if weight is None:
                    strict += 1
                else:
                    soft[term] = weight
        return strict, len(soft), sum(soft.values())


def _term_rows(strict, soft):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = TermMatcher(strict, soft)
        for batch in batches:
            found = [matcher.hits(u or "") for u in batch.column(1).to_pylist()]
            counts = [pa.array([f[i] for f in found], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts], names=["id", "url", "strict_hits", "soft_terms", "soft_weight"])

    return rows


def url_filter(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, url, host, path, rule, strict_hits, soft_terms, soft_weight, verdict) for each row of pages."""
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    kind = dict(own.dtypes)["id"]
    hits = mapped(own, _term_rows(strict, soft), f"id {kind}, url string, strict_hits int, soft_terms int, soft_weight int")
    out = hits.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    out = out.withColumn("fit", F.when(F.col("url").contains("://"), rule_of(F.col("host"), F.col("path"), rules)))
    by_terms = F.when((F.col("strict_hits") > 0) | ((F.col("soft_terms") >= LEAST_SOFT) & (F.col("soft_weight") >= soft_limit)), "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "url", "host", "path", F.col("fit.rule").alias("rule"), "strict_hits", "soft_terms", "soft_weight", F.coalesce("fit.verdict", by_terms).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url", "strict_hits", "soft_terms", "soft_weight")


def _hit(term: str) -> str:
    return rf"regexp_matches(u, '(^|[^a-z0-9]){term}($|[^a-z0-9])')"


_SOFT_COUNT = " + ".join(f"CASE WHEN {_hit(t)} THEN 1 ELSE 0 END" for t in SOFT)
_SOFT_SUM = " + ".join(f"CASE WHEN {_hit(t)} THEN {w} ELSE 0 END" for t, w in SOFT.items())
ORACLE = {
    "op3_url_filter": rf"""
WITH p AS (SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
  coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{h}', '{q}')" for v, h, q in RULES)}) AS t(verdict, h, q)),
f AS (SELECT page_id, host, path, arg_max(h || q, len(h || q)) AS rule, arg_max(verdict, len(h || q)) AS verdict
      FROM (SELECT DISTINCT page_id, host, path FROM p) d JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN {_hit("(" + "|".join(STRICT) + ")")} OR ({_SOFT_COUNT} >= {LEAST_SOFT} AND {_SOFT_SUM} >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f USING (page_id, host, path)
"""
}
QUERIES = {"op3_url_filter": op3_url_filter}
