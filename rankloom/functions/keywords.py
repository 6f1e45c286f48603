"""Keyword expressions: normal form, intent, difficulty, opportunity."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rankloom.functions.numbers import clamp, rounded
from rankloom.functions.text import squeeze

EDGE_PUNCTUATION = " .,;:!?\"'()[]{}"

# Intent markers, most specific intent first; the first hit decides.
INTENT_MARKERS = {
    "TRANSACTIONAL": ["buy", "price", "pricing", "order", "cheap", "discount", "coupon", "deal",
                      "cost", "quote", "hire", "book now", "for sale", "purchase"],
    "LOCAL": ["near me", "nearby", "open now", "address", "phone number", "directions",
              "locations", "opening hours", "map"],
    "COMMERCIAL": ["best", "top", "review", "reviews", "vs", "versus", "compare", "comparison",
                   "alternative", "alternatives", "ranked", "pros and cons"],
    "NAVIGATIONAL": ["login", "sign in", "official site", ".com", "homepage"],
    "INFORMATIONAL": ["how to", "how do", "what is", "what are", "guide", "tutorial", "tips",
                      "ideas", "learn", "why", "when", "examples", "meaning", "definition"],
}
QUESTION_FORM = r"^(who|what|where|when|why|how|which|can|does|is|are)\b"

# Worth of an intent in the opportunity score.
INTENT_VALUE = {"TRANSACTIONAL": 1.0, "COMMERCIAL": 0.9, "LOCAL": 0.85,
                "NAVIGATIONAL": 0.5, "INFORMATIONAL": 0.7}
OTHER_INTENT_VALUE = 0.6


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None else unicodedata.normalize("NFKC", s))


def fold_keyword(keyword: Column) -> Column:
    """Lower-case, collapse white space, strip edge punctuation — F6 after Unicode folding."""
    return F.trim(squeeze(F.lower(F.coalesce(keyword, F.lit("")))), F.lit(EDGE_PUNCTUATION))


def with_normalized_keyword(df: DataFrame, source: str = "keyword",
                            target: str = "normalized_keyword") -> DataFrame:
    """Add the normal form of a keyword column.

    Only rows outside ASCII take the Arrow round trip for Unicode folding; all others stay in
    generated code.  Call it right on a scan: the two branches read that scan twice.
    """
    foreign = F.coalesce(F.col(source).rlike(r"[^\x00-\x7F]"), F.lit(False))
    ascii_rows = df.where(~foreign).withColumn(target, fold_keyword(F.col(source)))
    other_rows = df.where(foreign).withColumn(target, fold_keyword(_nfkc(F.col(source))))
    return ascii_rows.unionByName(other_rows)


def _marker_groups() -> list[tuple[str, float, list[str]]]:
    """Neighbouring markers of one intent with one confidence, in order of precedence."""
    groups: list[tuple[str, float, list[str]]] = []
    for intent, markers in INTENT_MARKERS.items():
        for marker in markers:
            confidence = round(min(0.95, 0.55 + 0.05 * len(marker.split())), 2)
            if groups and groups[-1][:2] == (intent, confidence):
                groups[-1][2].append(marker)
            else:
                groups.append((intent, confidence, [marker]))
    return groups


def intent_of(keyword: Column, word_boundary: bool = False) -> Column:
    """Struct(intent, confidence) by marker words.

    Markers match as substrings ("ideal" holds "deal"); ``word_boundary=True`` asks for whole
    words instead.  Confidence is 0.55 plus 0.05 per word of the first marker that hits.
    """
    text = F.lower(F.coalesce(keyword, F.lit("")))
    edge = (r"(?<![a-z0-9])", r"(?![a-z0-9])") if word_boundary else ("", "")

    def answer(intent: str, confidence: float) -> Column:
        return F.struct(F.lit(intent).alias("intent"), F.lit(confidence).alias("confidence"))

    chain = F
    for intent, confidence, markers in _marker_groups():
        pattern = edge[0] + "(?:" + "|".join(re.escape(m) for m in markers) + ")" + edge[1]
        chain = chain.when(text.rlike(pattern), answer(intent, confidence))
    return (chain.when(F.trim(text).rlike(QUESTION_FORM), answer("INFORMATIONAL", 0.6))
            .otherwise(answer("INFORMATIONAL", 0.35)))


def is_strong_host(domain: Column) -> Column:
    """A short root domain, taken as a sign of authority."""
    host = F.coalesce(domain, F.lit(""))
    return (F.size(F.split(host, r"\.")) <= 2) & (F.length(host) <= 20)


def saturation_of(top_hosts: Column) -> Column:
    """Share of strong hosts among the first ten of an array; 0.5 without results."""
    top = F.slice(top_hosts, 1, 10)
    strong = F.size(F.filter(top, is_strong_host))
    return F.when(F.size(F.coalesce(top_hosts, F.array().cast("array<string>"))) > 0,
                  strong / F.size(top)).otherwise(0.5)


def competition_part(competition: Column) -> Column:
    return F.coalesce(clamp(competition, 0.0, 1.0), F.lit(0.5))


def demand_tier(volume: Column) -> Column:
    v = F.coalesce(volume, F.lit(0))
    return (F.when(v >= 100000, 0.9).when(v >= 10000, 0.7).when(v >= 1000, 0.5).otherwise(0.3))


def keyword_difficulty(competition: Column, volume: Column,
                       saturation: Column | None = None) -> Column:
    """40 % result saturation, 35 % vendor competition, 25 % demand, as 0–100 (F8)."""
    part = F.coalesce(saturation, F.lit(0.5)) if saturation is not None else F.lit(0.5)
    return rounded(100 * (0.40 * part + 0.35 * competition_part(competition)
                          + 0.25 * demand_tier(volume)), 1)


def difficulty_note(competition: Column, volume: Column,
                    saturation: Column | None = None) -> Column:
    part = F.coalesce(saturation, F.lit(0.5)) if saturation is not None else F.lit(0.5)

    def percent(x: Column) -> Column:
        return rounded(x * 100, 0).cast("int")

    # Fixed value: the wording of the note.
    return F.format_string("top-10 saturation %d%%, vendor competition %d%%, demand tier %d%%",
                           percent(part), percent(competition_part(competition)),
                           percent(demand_tier(volume)))


def opportunity_score(volume: Column, difficulty: Column, intent: Column,
                      rank: Column | None = None) -> Column:
    """Log demand × achievability × intent value × rank proximity, 0–100.

    Ranks 4–15 gain 20 %, ranks 1–3 have little left to win and lose 30 %.
    """
    demand = F.least(F.lit(1.0), F.log10(F.coalesce(volume, F.lit(0)) + 1) / 5.0)
    achievable = 1.0 - F.coalesce(clamp(difficulty, 0.0, 100.0), F.lit(50.0)) / 100.0
    value = F.lit(OTHER_INTENT_VALUE)
    for name, worth in INTENT_VALUE.items():
        value = F.when(intent == name, worth).otherwise(value)
    position = rank if rank is not None else F.lit(None).cast("int")
    near = (F.when(position.isNull() | (position == 0), 1.0)
            .when(position.between(4, 15), 1.2).when(position <= 3, 0.7).otherwise(1.0))
    return rounded(clamp(100 * demand * achievable * value * near, 0.0, 100.0), 1)
