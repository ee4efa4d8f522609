"""URL filter: domain rules first, then a weighted vocabulary.

Rules are (action, 'host/path') pairs; the longest that fits decides. Other
urls are judged by terms found with an Aho-Corasick automaton and counted only
between boundaries: one strict term, or several distinct soft terms, block.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A strict term blocks alone; soft terms block in numbers.
STRICT = (
    "adult", "casino", "escort", "gambling", "hentai", "malware", "nude", "phishing", "pills", "poker", "porn",
    "sex", "spam", "viagra", "warez", "xxx",
)
SOFT = (
    "ads", "bet", "bets", "bonus", "cheap", "click", "crack", "dating", "deal", "farm", "free", "hack", "hot",
    "jackpot", "loan", "offer", "pharma", "promo", "seo", "torrent", "track", "win",
)
MIN_SOFT = 2


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host follows the first ``://`` and ends before ``/``,
    ``?`` or ``#``, A-Z lower-cased; the path goes on to ``?`` or ``#``. Both
    are empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(action, rule) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<action:string,rule:string>")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


@lru_cache(maxsize=8)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for strong, terms in ((False, soft), (True, strict)):
        for term in terms:
            made.add_word(term, (term, strong))
    if len(made):
        made.make_automaton()
    return made


def count_terms(url: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """(distinct strict terms, distinct soft terms) between boundaries: no
    ASCII letter or digit before or after."""
    text = url.translate(_FOLD)
    automaton = _automaton(strict, soft)
    hits: dict[str, bool] = {}
    if len(automaton):
        for end, (term, strong) in automaton.iter(text):
            start = end - len(term) + 1
            if text[start - 1 : start] not in _INNER and text[end + 1 : end + 2] not in _INNER:
                hits[term] = strong
    n_strict = sum(hits.values())
    return n_strict, len(hits) - n_strict


_FOLD = str.maketrans(UPPER, LOWER)
_INNER = frozenset(LOWER + "0123456789")


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    url_col: str = "url",
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    min_soft: int = MIN_SOFT,
) -> DataFrame:
    """``pages`` plus host, path, rule, n_strict, n_soft and verdict (allow or
    block). Columns of these names are replaced. Null and empty urls match no
    rule and no term and are allowed; repeated rows stay; one pass, no shuffle."""
    strict, soft = tuple(strict), tuple(soft)

    @pandas_udf("struct<n_strict:int,n_soft:int>")
    def terms(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([count_terms(u or "", strict, soft) for u in urls], columns=["n_strict", "n_soft"])

    made = ("host", "path", "rule", "n_strict", "n_soft", "verdict")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in made]
    host, path = split_url(F.col(url_col))
    page = F.struct(*kept) if kept else F.struct(F.lit(0))
    split = pages.select(page.alias("page"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    split = split.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("terms", terms("url"))
    bad = (F.col("terms.n_strict") > 0) | (F.col("terms.n_soft") >= min_soft)
    return split.select(
        *(["page.*"] if kept else []),
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.col("terms.n_strict").alias("n_strict"),
        F.col("terms.n_soft").alias("n_soft"),
        F.coalesce(F.col("found.action"), F.when(bad, "block").otherwise("allow")).alias("verdict"),
    )
