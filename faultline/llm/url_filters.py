"""URL filters: host and path rules first, then a weighted vocabulary found with an Aho-Corasick automaton.

A term of the vocabulary counts where it stands between boundaries (anything but a-z and 0-9, or an end of the
lower-cased URL). A strict term rejects alone; soft terms reject when the weights of *distinct* ones reach the
limit. Hosts, paths and rules are column expressions; only the automaton runs in Arrow batches, without a shuffle.

NULL and empty URLs, and URLs without ``://``, have an empty host and path, fit no rule and have no terms unless
the string itself holds some. Repeated rows are judged one by one; other columns pass through, and a column that
has the name of a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT = 2
SOFT = 1
LIMIT = 2

#: Terms that reject alone, and terms that reject when several differ.
STRICT_TERMS = (
    "porn", "porno", "xxx", "hentai", "escort", "escorts", "camgirls", "casino", "casinos", "viagra", "cialis", "malware", "warez",
    "phishing", "jackpot", "torrents", "keygen", "spam", "adult-x",
)
SOFT_TERMS = (
    "adult", "ads", "bet", "bets", "betting", "bonus", "cheap", "click", "coupon", "crack", "dating", "deal", "deals", "discount", "farm",
    "free", "gambling", "hot", "loan", "loans", "lottery", "nude", "pill", "pills", "poker", "pharmacy", "promo", "replica", "sex", "sexy",
    "slots", "track", "tracker", "win", "winner",
)
VOCABULARY = {**dict.fromkeys(STRICT_TERMS, STRICT), **dict.fromkeys(SOFT_TERMS, SOFT)}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``text`` is ``host/path``; the verdict holds for the host, its subdomains and paths that start alike."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_of(url: Column) -> Column:
    """Host part with A-Z lowered, empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Path up to ``?`` or ``#``, empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Index of the longest rule that fits, NULL if none does."""
    found = F.lit(None).cast("int")
    for i, rule in sorted(enumerate(rules), key=lambda r: len(r[1].text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.lit(i)).otherwise(found)
    return found


def _automaton(vocabulary: dict[str, int]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for term, weight in vocabulary.items():
        made.add_word(term, (len(term), term, weight))
    if vocabulary:
        made.make_automaton()
    return made


def _boundary(url: str, at: int) -> bool:
    return not (0 <= at < len(url) and ("a" <= url[at] <= "z" or "0" <= url[at] <= "9"))


def term_hits(url: str, automaton: ahocorasick.Automaton) -> dict[str, int]:
    """Weights of the distinct terms of a lower-cased URL that stand between boundaries."""
    hits = {}
    for end, (length, term, weight) in automaton.iter(url):
        if _boundary(url, end - length) and _boundary(url, end + 1):
            hits[term] = weight
    return hits


def judge(df: DataFrame, url: str = "url", rules: tuple[Rule, ...] = (), vocabulary: dict[str, int] | None = None, limit: int = LIMIT) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``strict_terms``, ``soft_terms`` and ``verdict`` (allow or block) to every row."""
    terms = VOCABULARY if vocabulary is None else vocabulary

    @F.pandas_udf("struct<strict_terms:array<string>,soft_terms:array<string>>")
    def find(urls: pd.Series) -> pd.DataFrame:
        automaton = _automaton(terms)
        found = [term_hits(u, automaton) if terms and u else {} for u in urls]
        return pd.DataFrame({
            "strict_terms": [sorted(t for t, w in hits.items() if w >= limit) for hits in found],
            "soft_terms": [sorted(t for t, w in hits.items() if w < limit) for hits in found],
        })

    def by_rule(part: str) -> Column:
        """The rule's text or verdict as a map from its index."""
        pairs = [F.lit(x) for i, r in enumerate(rules) for x in (i, getattr(r, part))]
        return F.create_map(*pairs)[F.col("_rule")] if rules else F.lit(None).cast("string")

    weight = F.create_map(*[F.lit(x) for pair in terms.items() for x in pair]) if terms else F.create_map(F.lit(""), F.lit(0))
    soft = F.aggregate("soft_terms", F.lit(0), lambda total, term: total + weight[term])
    place = F.col(f"`{url}`")
    return (
        df.withColumns({"host": host_of(place), "path": path_of(place), "_found": find(F.translate(place, UPPER, LOWER))})
        .withColumns({"_rule": matching_rule(F.col("host"), F.col("path"), rules), "strict_terms": F.col("_found.strict_terms"), "soft_terms": F.col("_found.soft_terms")})
        .withColumns({
            "rule": by_rule("text"),
            "verdict": F.coalesce(by_rule("verdict"), F.when((F.size("strict_terms") > 0) | (soft >= limit), "block").otherwise("allow")),
        })
        .drop("_found", "_rule")
    )
