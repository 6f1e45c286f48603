"""Personal data: base patterns, and further spans by weak supervision.

Base spans (e-mail, IP, card, phone) are leftmost non-overlapping matches that pass a check.  Looser
patterns give further candidates.  Labelers vote yes, no or abstain on every candidate and base span:
its form, gazetteers (names, domain endings, calling codes), words before it, and its plausibility.
Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability and how
likely each pattern is private; these likelihoods are the soft labels of a logistic regression on
span features, which decides about candidates.  Base spans always stay.

Everything is DataFrame operations: the match positions follow from the pieces between matches.  The
driver sees counts of vote patterns and of discrete feature rows only, some thousand at most.

Null and empty texts have no spans.  Rows are judged one by one, so repeated ids do not matter.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import begin, stage

BASE_KINDS = ("email", "ip", "card", "phone")
LOOSE_KINDS = ("email", "phone", "ssn", "iban", "secret", "name")
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret", "name")
VOTES = ("v_form", "v_list", "v_words", "v_sense")

_LOCAL = "A-Za-z0-9._%+-"
#: A match begins where a run of its first class does, or where the match before it ended.
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Single blanks and hyphens between digits are joined to them first, so that one class is enough.
JOINT, SPARE = "￿", "￾"
CARD = f"[0-9{JOINT}]{{16,}}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

LOOSE = {
    "email": r"(?i)[a-z0-9._%+-]++ ?[(\[]at[)\]] ?[a-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[a-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "secret": r"(?i)(?<![a-z])(?:password|passwd|secret|api[_-]?key|access[_-]?token)[=:] ?[^\s,;]{6,}",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?",
}
#: Gazetteers and cue words, in the languages of the corpus.
ENDINGS = ("com", "org", "net", "edu", "gov", "de", "fr", "es", "uk", "eu", "io")
NAMES = ("anna", "maria", "john", "james", "mary", "peter", "paul", "pierre", "marie", "jean", "hans", "anja", "jose", "carmen", "luis", "smith", "müller", "garcia", "martin")
CUES = ("mail", "phone", "tel", "call", "fax", "contact", "card", "account", "ssn", "social security", "iban", "konto", "telefon", "compte", "cuenta", "teléfono", "login", "user", "address", "key")
COUNTER_CUES = ("version", "isbn", "page", "chapter", "figure", "section", "order", "no.", "nr.", "ref")

_SPAN = "struct<kind:string,start:int,end:int,body:string,before:string>"


def spans(text: Column, pattern: str, kind: str) -> Column:
    """Matches in order with their code point positions and up to 40 characters before each."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("body")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        end = at + F.length(x["body"])
        one = F.struct(F.lit(kind).alias("kind"), at.alias("start"), end.alias("end"), x["body"].alias("body"), F.right(x["gap"], F.lit(40)).alias("before"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(pairs, start, add, lambda acc: acc["out"])


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(
        i % 2 == 1, F.substr(back, i, F.lit(1)).cast("int")).otherwise(
        F.substr(back, i, F.lit(1)).cast("int") * 2 - F.when(F.substr(back, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)))
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    """All base spans by kind, then start.  Cheap tests spare most texts the patterns."""
    email = F.when(F.contains(text, F.lit("@")), spans(text, EMAIL, "email")).otherwise(_none())
    ip = F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), F.filter(spans(text, IP, "ip"), lambda s: F.forall(
        F.split(s["body"], r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255)))).otherwise(_none())
    joined = F.regexp_replace(F.replace(text, F.lit(JOINT), F.lit(SPARE)), r"(?<=[0-9])[\x20-](?=[0-9])", JOINT)
    card = F.when(text.rlike(r"[0-9][0-9\x20-]{15}"), F.filter(spans(joined, CARD, "card"), lambda s: F.length(_digits(s["body"])).between(
        16, 19) & luhn(_digits(s["body"])))).otherwise(_none())
    phone = F.when(F.contains(text, F.lit("+")), F.filter(spans(text, PHONE, "phone"), lambda s: F.length(_digits(s["body"])).between(
        8, 15))).otherwise(_none())
    return F.concat(email, ip, card, phone)


def candidates(text: Column) -> Column:
    numeric = text.rlike(r"[0-9]{3}[\x20.)-]|[A-Z]{2}[0-9]{2}")
    tests = {"email": text.rlike(r"(?i)[(\[]at[)\]]"), "secret": text.rlike(r"[=:]"), "name": F.lit(True)}
    return F.concat(*[F.when(tests.get(kind, numeric), spans(text, LOOSE[kind], kind)).otherwise(_none()) for kind in LOOSE_KINDS])


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(r"(?i)(?<![a-zäöüéèñ])(?:" + "|".join(w.replace(".", r"\.") for w in words) + ")")


def voted(span: Column, base: bool) -> Column:
    """The span with the labelers' votes and the other features: 1 yes, -1 no, 0 abstains."""
    body, digits, before = span["body"], _digits(span["body"]), F.lower(span["before"])
    form = F.lit(1) if base else F.when(body.rlike(r"[(\[]|[=:]\S*[0-9]|^[A-Z]{2}[0-9]{2}"), 1).otherwise(0)
    lists = (F.when(body.rlike(r"(?i)[.\])]\s*(?:" + "|".join(ENDINGS) + ")$") | _any(body, NAMES) | body.rlike(r"^\+(?:1|33|34|44|49)(?![0-9])"), 1)
             .when(span["kind"].isin("ssn", "phone") & digits.rlike("^(?:000|666|9)"), -1).otherwise(0))
    words = F.when(_any(before, COUNTER_CUES), -1).when(_any(before, CUES), 1).otherwise(0)
    sense = (F.when((F.length(digits) > 0) & (F.length(F.replace(digits, F.left(digits, F.lit(1)))) == 0) & (F.length(digits) > 4), -1)
             .when((F.length(body) >= 6) & (F.length(body) <= 64), 1).otherwise(0))
    return F.struct(
        span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"), form.alias("v_form"), lists.alias("v_list"),
        words.alias("v_words"), sense.alias("v_sense"), F.least(F.floor(F.length(body) / 8), F.lit(4)).cast("int").alias("size"),
        F.when(F.length(digits) * 2 >= F.length(body), 2).when(F.length(digits) > 0, 1).otherwise(0).alias("digits"))


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans with votes) and loose (candidates that meet no base span, with votes)."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select(F.col("doc_id").cast("long"), base_spans(text).alias("b"), candidates(text).alias("c"))
    free = F.filter("c", lambda c: ~F.exists("b", lambda b: (c["start"] < b["end"]) & (b["start"] < c["end"])))
    return found.select("doc_id", F.transform("b", lambda s: voted(s, True)).alias("base"), F.transform(free, lambda s: voted(s, False)).alias("loose"))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[tuple[float, float]]]:
    """Share of private spans, and per labeler (right when private, right when not), by expectation-maximisation."""
    prior, skill = 0.7, [(0.8, 0.7)] * len(VOTES)
    for _ in range(rounds):
        likely = [likelihood(p, prior, skill) for p, _ in patterns]
        total, yes = sum(n for _, n in patterns), sum(n * q for (_, n), q in zip(patterns, likely))
        prior = min(max((yes + 1) / (total + 2), 0.01), 0.99)
        skill = []
        for k in range(len(VOTES)):
            right_yes = sum(n * q for (p, n), q in zip(patterns, likely) if p[k] == 1)
            cast_yes = sum(n * q for (p, n), q in zip(patterns, likely) if p[k])
            right_no = sum(n * (1 - q) for (p, n), q in zip(patterns, likely) if p[k] == -1)
            cast_no = sum(n * (1 - q) for (p, n), q in zip(patterns, likely) if p[k])
            # Smoothed towards a labeler that is better than chance, so that the two classes cannot change places.
            skill.append(((right_yes + 8) / (cast_yes + 10), (right_no + 7) / (cast_no + 10)))
    return prior, skill


def likelihood(votes: tuple[int, ...], prior: float, skill: list[tuple[float, float]]) -> float:
    odds = math.log(prior / (1 - prior))
    for v, (yes, no) in zip(votes, skill):
        odds += 0.0 if v == 0 else math.log(yes / (1 - no)) if v > 0 else math.log((1 - yes) / no)
    return 1 / (1 + math.exp(-odds))


_FEATURES = [f"is_{k}" for k in KINDS] + list(VOTES) + ["size", "digits"]


def _features(span: Column) -> list[Column]:
    return [(span["kind"] == k).cast("double") for k in KINDS] + [span[f].cast("double") for f in (*VOTES, "size", "digits")]


def span_model(found: DataFrame) -> tuple[list[float], float] | None:
    """Weights and intercept of the span classifier; None without any span."""
    every = found.select(F.explode(F.concat("base", "loose")).alias("s"))
    counts = stage(every.groupBy(*[F.col(f"s.{c}") for c in ("kind", *VOTES, "size", "digits")]).agg(F.count(F.lit(1)).alias("n")))
    votes = [(tuple(r[v] for v in VOTES), r.n) for r in counts.groupBy(*VOTES).agg(F.sum("n").alias("n")).orderBy(*VOTES).collect()]
    if not votes:
        return None
    prior, skill = reliabilities(votes)
    odds = F.lit(math.log(prior / (1 - prior)))
    for v, (yes, no) in zip(VOTES, skill):
        odds = odds + F.when(F.col(v) == 1, math.log(yes / (1 - no))).when(F.col(v) == -1, math.log((1 - yes) / no)).otherwise(0.0)
    soft = counts.withColumn("q", 1 / (1 + F.exp(-odds))).select(
        *[f.alias(n) for f, n in zip(_features(F.struct("kind", *VOTES, "size", "digits")), _FEATURES)],
        F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("q") * F.col("n")).alias("weight")),
                          F.struct(F.lit(0.0).alias("label"), ((1 - F.col("q")) * F.col("n")).alias("weight")))).alias("t")).select(*_FEATURES, "t.*")
    data = stage(soft.where("weight > 0"))
    fit = LogisticRegression(maxIter=30, regParam=1e-3, weightCol="weight").fit(
        VectorAssembler(inputCols=_FEATURES, outputCol="features").transform(data))
    return list(fit.coefficients), float(fit.intercept)


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, base and added spans of every row."""
    begin(docs.sparkSession)
    found = stage(marked(docs))
    model = span_model(found)
    if model is None:
        return found.select("doc_id", "base", F.col("loose").alias("added"))
    weights, shift = model

    def private(s: Column) -> Column:
        total = F.lit(shift)
        for w, f in zip(weights, _features(s)):
            total = total + F.lit(float(w)) * f
        return total >= 0

    return found.select("doc_id", "base", F.filter("loose", private).alias("added"))


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])

    def listed(found: Column) -> Column:
        keyed = F.transform(found, lambda s: F.struct(F.element_at(rank, s["kind"]).alias("k"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("kind")))
        return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["s"].cast("string"), s["e"].cast("string"))), ",")

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return detected(docs).select("doc_id", *map(of_kind, BASE_KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))
