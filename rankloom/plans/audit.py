"""Site audit over all crawl runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.functions import urls as U
from rankloom.functions.numbers import rounded
from rankloom.functions.scores import (
    BUCKET_WEIGHTS, CATEGORY_BUCKET, SEVERITIES, SEVERITY_POINTS, issue_message, lookup,
    severity_rank,
)
from rankloom.operators.ranking import top_n
from rankloom.operators.rules import Rule, catalogue
from rankloom.session import stage

RUN = "crawl_run_id"
HIT = [RUN, "url", "code"]
DUPLICATE_KINDS = {
    "DUPLICATE_TITLE": "title", "DUPLICATE_META_DESCRIPTION": "meta_description",
    "DUPLICATE_CONTENT": "content_hash",
}


def local_hits(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """All page-local rules in one scan: an array of fired codes, exploded."""
    fired = F.array(*[F.when(r.condition, F.lit(r.code)) for r in rules if r.condition is not None])
    codes = F.filter(fired, lambda c: c.isNotNull())
    return pages.select(RUN, "url", F.explode(codes).alias("code"))


def duplicate_hits(pages: DataFrame) -> DataFrame:
    """Pages sharing a title, description or content hash within a run.

    Copies are counted with a combined aggregate and only values seen twice come back.  They are
    stored, so that both sides of the join are plain shuffles and adaptive execution can split a
    value that fills a large part of a run.
    """
    values = F.array(*[F.struct(F.lit(code).alias("code"),
                                F.lower(T.strip(F.coalesce(F.col(c), F.lit("")))).alias("value"))
                       for code, c in DUPLICATE_KINDS.items()])
    rows = (pages.where(F.col("status_code") == 200)
            .select(RUN, "url", F.explode(values).alias("v"))
            .where(F.col("v.value") != "")
            # A fixed-width digest of long values keeps the shuffle small.
            .select(RUN, "url", F.col("v.code").alias("code"), F.md5("v.value").alias("digest")))
    key = [RUN, "code", "digest"]
    shared = stage(rows.groupBy(*key).count().where(F.col("count") > 1).select(*key))
    return rows.join(shared, key, "left_semi").select(*HIT)


def mark_duplicates(pages: DataFrame) -> DataFrame:
    """Flag pages whose content hash occurs more than once in their run (A3)."""
    key = [RUN, "content_hash"]
    shared = stage(pages.where(F.col("content_hash").isNotNull()).groupBy(*key).count()
                   .where(F.col("count") > 1).select(*key, F.lit(True).alias("_dup")))
    flagged = pages.join(shared, key, "left")
    return flagged.withColumn("is_duplicate", F.coalesce("_dup", F.lit(False))).drop("_dup")


def _tag(rows: DataFrame, code: str) -> DataFrame:
    return rows.select(RUN, "url", F.lit(code).alias("code"))


def orphan_hits(pages: DataFrame, links: DataFrame) -> DataFrame:
    """OK pages below the homepage that no internal link points at."""
    targets = (links.where("is_internal")
               .select(RUN, F.col("normalized_to_url").alias("normalized_url")).distinct())
    rows = pages.where((F.col("status_code") == 200) & (F.coalesce("depth", F.lit(1)) > 0))
    return _tag(rows.join(targets, [RUN, "normalized_url"], "left_anti"), "ORPHAN_PAGE")


def broken_link_hits(pages: DataFrame, links: DataFrame) -> DataFrame:
    """OK pages with a link to a URL that failed in the same run.

    The failed URLs are stored, so that a much-linked one can be split; the many links of one page
    shrink to one row before the join back to the pages.
    """
    broken = stage(pages.where(F.coalesce("status_code", F.lit(0)) >= 400)
                   .select(RUN, F.col("normalized_url").alias("normalized_to_url")).distinct())
    edges = links.select(RUN, "from_url", "normalized_to_url")
    sources = (edges.join(broken, [RUN, "normalized_to_url"], "left_semi")
               .select(RUN, F.col("from_url").alias("url")).distinct())
    ok = pages.where(F.col("status_code") == 200).select(RUN, "url")
    return _tag(ok.join(sources, [RUN, "url"], "left_semi"), "BROKEN_INTERNAL_LINK")


def redirect_hits(pages: DataFrame) -> DataFrame:
    """Chains and loops among redirecting pages, keyed on the requested URL.

    Pages sharing one redirect target are many-to-one, so adaptive execution splits that side.
    """
    edges = (pages.where(F.coalesce("redirect_target", F.lit("")) != "")
             .select(RUN, "url", "normalized_url", U.normalize_url(F.col("redirect_target")).alias("target"))
             .where(F.col("target") != ""))
    nexts = edges.select(RUN, F.col("normalized_url").alias("target"),
                         F.col("target").alias("next_target")).groupBy(RUN, "target").agg(
        F.min("next_target").alias("next_target"))
    hops = edges.join(nexts, [RUN, "target"], "left")
    chain = F.when(F.col("next_target").isNotNull(), F.lit("REDIRECT_CHAIN"))
    loop = F.when((F.col("target") == F.col("normalized_url"))
                  | (F.col("next_target") == F.col("normalized_url")), F.lit("REDIRECT_LOOP"))
    codes = F.filter(F.array(chain, loop), lambda c: c.isNotNull())
    return hops.select(RUN, "url", F.explode(codes).alias("code"))


def canonical_hits(pages: DataFrame) -> DataFrame:
    """OK pages whose canonical is not among the run's OK URLs.

    A page that names itself is settled on the row and never reaches the join.
    """
    ok = pages.where(F.col("status_code") == 200)
    live = stage(ok.select(RUN, F.col("normalized_url").alias("canonical_normalized")).distinct())
    named = (ok.where(F.coalesce("canonical", F.lit("")) != "")
             .select(RUN, "url", "normalized_url",
                     U.normalize_url(F.col("canonical")).alias("canonical_normalized"))
             .where(F.col("canonical_normalized") != F.col("normalized_url")))
    missing = named.join(live, [RUN, "canonical_normalized"], "left_anti")
    return _tag(missing.where(F.col("canonical_normalized").isNotNull()), "CANONICAL_CONFLICT")


def rule_hits(pages: DataFrame, links: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Distinct (run, url, code) of all 26 rules."""
    rules = rules if rules is not None else catalogue()
    # A page's URL is unique in its run, so local hits are distinct; only joined ones are merged.
    joined = duplicate_hits(pages)
    for part in (orphan_hits(pages, links), broken_link_hits(pages, links), redirect_hits(pages), canonical_hits(pages)):
        joined = joined.unionByName(part)
    return local_hits(pages, rules).unionByName(joined.distinct())


def issues(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """One issue per run and enabled firing rule with its full affected count."""
    counts = hits.groupBy(RUN, "code").agg(F.count("*").alias("affected_count"))
    # The catalogue has 26 rows, whatever the crawl size.
    return (counts.join(F.broadcast(rules.where("enabled")), "code")
            .withColumn("message", issue_message(F.col("name"), F.col("affected_count"))))


def instances(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """The affected URLs of each issue (K8), or the first ``limit`` of each for a listing."""
    return top_n(hits, [RUN, "code"], [F.asc("url")], limit)


def bucket_scores(issue_rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Score of each of the seven buckets per run, 100 without issues."""
    bucket = F.coalesce(lookup(F.col("category"), CATEGORY_BUCKET), F.lit("technical"))
    counted = (issue_rows.withColumn("bucket", bucket)
               .join(runs.select(RUN, "pages_crawled"), RUN))
    coverage = F.least(F.lit(1.0), F.col("affected_count") / F.greatest(F.lit(1), F.col("pages_crawled")))
    # Each (run, bucket) holds at most the 26 rules, whatever the crawl size.
    points = lookup(F.col("severity"), SEVERITY_POINTS, 3.0) * coverage
    lost = counted.groupBy(RUN, "bucket").agg(F.sum(points).alias("deduction"))
    every = runs.select(RUN, F.explode(F.array(*[F.lit(b) for b in BUCKET_WEIGHTS])).alias("bucket"))
    score = F.greatest(F.lit(0.0), 100.0 - F.coalesce("deduction", F.lit(0.0)))
    return every.join(lost, [RUN, "bucket"], "left").select(
        RUN, "bucket", rounded(score, 1).alias("score"))


def health(bucket_rows: DataFrame) -> DataFrame:
    """Weighted 0–100 health score per run."""
    return bucket_rows.groupBy(RUN).agg(
        rounded(F.sum(F.col("score") * lookup(F.col("bucket"), BUCKET_WEIGHTS, 0.0)), 1)
        .alias("health_score"))


def severity_counts(issue_rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rules firing per severity and affected URLs per run, zeros included."""
    per = [F.count(F.when(F.col("severity") == s, F.lit(1))).alias(s.lower()) for s in SEVERITIES]
    counted = issue_rows.groupBy(RUN).agg(
        *per, F.count("*").alias("rules_firing"), F.sum("affected_count").alias("issues_found"))
    names = [*[s.lower() for s in SEVERITIES], "rules_firing", "issues_found"]
    return runs.select(RUN, "pages_crawled").join(counted, RUN, "left").select(
        RUN, "pages_crawled", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def audit_summary(issue_rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Severity counts, bucket scores and health score per run (Q1, Q2)."""
    scores = bucket_scores(issue_rows, runs)
    wide = scores.groupBy(RUN).pivot("bucket", list(BUCKET_WEIGHTS)).agg(F.max("score"))
    return (severity_counts(issue_rows, runs).join(wide, RUN).join(health(scores), RUN))


def seen(issue_rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Issues with the first and the last run of their project in which the rule fired (L4)."""
    dated = issue_rows.join(runs.select(RUN, "project_id", "created_at"), RUN)
    spans = dated.groupBy("project_id", "code").agg(F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
    return dated.drop("created_at").join(spans, ["project_id", "code"])


def issue_list(issue_rows: DataFrame, severity: str | None = None, category: str | None = None,
               search: str | None = None) -> DataFrame:
    """Filtered issues with a severity rank to sort by (Q3, L4)."""
    rows = issue_rows
    if severity:
        rows = rows.where(F.col("severity") == severity.upper())
    if category:
        rows = rows.where(F.col("category") == category)
    if search:
        rows = rows.where(T.contains_ci(F.col("message"), search) | T.contains_ci(F.col("name"), search)
                          | T.contains_ci(F.col("code"), search))
    return rows.withColumn("severity_rank", severity_rank(F.col("severity")))


def issue_order(sort: str = "severity") -> list[Column]:
    """Order over the whole listing, not only within a page (L4)."""
    first = {"severity": [F.asc("severity_rank"), F.desc("affected_count")],
             "affected": [F.desc("affected_count")], "recent": [F.desc("last_seen")]}[sort]
    return [*first, F.asc(RUN), F.asc("code")]


def page_list(pages: DataFrame, status_code: int | None = None, indexability: str | None = None,
              search: str | None = None) -> DataFrame:
    """Filtered pages with their first heading (Q5)."""
    rows = pages
    if status_code:
        rows = rows.where(F.col("status_code") == status_code)
    if indexability:
        rows = rows.where(F.col("indexability") == indexability)
    if search:
        rows = rows.where(T.contains_ci(F.col("url"), search) | T.contains_ci(F.col("title"), search)
                          | T.contains_ci(F.col("meta_description"), search))
    return rows.withColumn("h1", F.try_element_at("h1_text", F.lit(1)))


def page_order() -> list[Column]:
    """Shallow pages first."""
    return [F.asc("depth"), F.asc("page_id")]
