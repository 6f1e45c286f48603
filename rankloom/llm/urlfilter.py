"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for the rest.

URLs that a rule decides are the labelled ones.  Features are the URL's length, path depth, digit
ratio, character entropy, numbers of parameters, host labels and hyphens, and for the host's last
label the share of blocked URLs and the number of labelled ones.  A labelled URL's share is counted
over the folds that it is not in, or its own label would be one of its features.  Everything is DataFrame
operations; the trees are fitted by Spark's own learner on at most ``sample`` labelled URLs (those
with the smallest hash of their id), while the suffix statistics count all of them.

Null URLs and those without ``://`` have an empty host and path, fit no rule and are judged by their
other features.  If the labelled URLs do not hold both verdicts, the rest gets the one there is, or
allow.  Repeated page ids are judged row by row.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import begin, stage

#: Fixed values of the contract: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SAMPLE = 20_000
TREES, DEPTH, FOLDS = 12, 3, 5
FEATURES = ["f_length", "f_depth", "f_digits", "f_entropy", "f_parameters", "f_labels", "f_hyphens", "f_host", "f_suffix_share", "f_suffix_count"]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), "^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule and its verdict; the longest rule that fits wins, null if none does."""
    out = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fits = [F.when((F.col("host") == h) | F.col("host").endswith(f".{h}"), F.col("path").startswith(p)).otherwise(False) for h, p, _ in rules]
    ordered = sorted(zip(rules, fits), key=lambda r: -len(r[0][0] + r[0][1]))
    rule = F.coalesce(*[F.when(fit, F.lit(h + p)) for (h, p, _), fit in ordered])
    verdict = F.coalesce(*[F.when(fit, F.lit(v)) for (_, _, v), fit in ordered])
    return out.withColumn("rule", rule).withColumn("said", verdict)


def featured(pages: DataFrame) -> DataFrame:
    """Lexical features of ``url``; ``suffix`` is the host's last label."""
    url, n = F.coalesce("url", F.lit("")), F.length(F.coalesce("url", F.lit("")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    shares = F.transform(F.array_distinct(F.split(url, "")), lambda c: (n - F.length(F.replace(url, c))) / n)
    entropy = F.aggregate(shares, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return pages.select(
        "*", F.element_at(F.split("host", r"\."), -1).alias("suffix"), n.cast("double").alias("f_length"),
        F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double").alias("f_depth"),
        F.when(n > 0, F.length(F.regexp_replace(url, "[^0-9]", "")) / n).otherwise(0.0).alias("f_digits"),
        F.when(n > 0, entropy).otherwise(0.0).alias("f_entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("f_parameters"),
        F.size(F.split("host", r"\.")).cast("double").alias("f_labels"),
        (F.length("url") - F.length(F.replace("url", F.lit("-")))).cast("double").alias("f_hyphens"),
        F.length("host").cast("double").alias("f_host"))


def suffix_statistics(pages: DataFrame) -> DataFrame:
    """Per host suffix the numbers of labelled and of blocked URLs, in all and by fold (``n_of``, ``blocked_of``)."""
    blocked = F.col("said") == "block"
    return pages.where("said IS NOT NULL").groupBy(F.col("suffix").alias("_suffix")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(blocked).alias("blocked"),
        F.array(*[F.count_if(F.col("fold") == f) for f in range(FOLDS)]).alias("n_of"),
        F.array(*[F.count_if(blocked & (F.col("fold") == f)) for f in range(FOLDS)]).alias("blocked_of"))


def judged(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's likelihood that the URL is to be blocked."""
    spark = begin(pages.sparkSession)
    plain = featured(ruled(pages.select("page_id", "url"), rules)).withColumn(
        "fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int"))
    known = stage(suffix_statistics(plain))
    n, blocked = (F.coalesce(c, F.lit(0)) - F.when(F.col("said").isNotNull(), F.get(f"{c}_of", F.col("fold"))).otherwise(0) for c in ("n", "blocked"))
    rows = (plain.join(known, plain["suffix"] == known["_suffix"], "left").drop("_suffix")
            .withColumn("f_suffix_share", (blocked + 1) / (n + 2)).withColumn("f_suffix_count", F.log1p(F.coalesce("n", F.lit(0))))
            .fillna(0.0, FEATURES))
    labelled = stage(rows.where("said IS NOT NULL").select("page_id", (F.col("said") == "block").cast("double").alias("label"), *FEATURES)
                     .orderBy(F.xxhash64("page_id"), "page_id").limit(sample))
    totals = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked")).first()
    keep = ["page_id", "host", "path", "rule", "said"]
    if not totals.n or totals.blocked in (0.0, float(totals.n)):
        likely = F.lit(1.0 if totals.n and totals.blocked else 0.0)
        out = rows.select(*keep, likely.alias("likely"))
    else:
        vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
        learner = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, featuresCol="features", labelCol="label")
        spark.sparkContext.setJobDescription("gradient-boosted trees")
        model = learner.fit(vector.transform(labelled))
        spark.sparkContext.setJobDescription(None)
        out = model.transform(vector.transform(rows.select(*keep, *FEATURES))).select(
            *keep, vector_to_array("probability").getItem(1).alias("likely"))
    return out.withColumn("verdict", F.coalesce("said", F.when(F.col("likely") >= 0.5, "block").otherwise("allow"))).drop("said")


def report(pages: DataFrame) -> DataFrame:
    """The digest columns of the query, and the likelihood."""
    return judged(pages).select("page_id", "host", "path", "rule", "verdict", "likely")
