"""Line dedup: a suffix array over line ids by distributed prefix doubling.

Texts are split at line feeds.  Lines that occur once cannot lie in a repeated run, so only stretches
of repeated lines with ``min_words`` words in all enter the array.  Each of their places gets the rank
of its line; rank and partner's rank (k lines on) give the rank of the next 2k lines, until no class splits
any more, or once k reaches the longest of the shortest runs with ``min_words`` words: what lies beyond
decides no run, as suffixes that share as many lines share the run.  Ranks count the suffixes before a
class, so neighbours in the array are found by an equality join.  Their longest common prefixes come
from the ranks of all levels, largest first.  The array is
cut where the common prefix is shorter than the fewest lines that hold ``min_words`` words; each
interval between cuts is one repeated run, and its first place by (doc_id, line) stays.  In the
same way each line's shortest run of ``min_words`` words that ends there is looked up among earlier
ones, by the ranks of the two halves that cover it.  Both kinds of later copies are deleted, and
together they cover the maximal repeated runs, beginnings and ends.

All of it is DataFrame operations.  Frequent lines and pairs are counted before they are shuffled,
and ranks within a large class are summed over slices of the partner's rank.

The measure decides what counts as a run: 40 words by default, so that short common lines of otherwise
different documents stay; one word deletes all later copies of any line with a word in it.

Null ids take no part and keep their text; a null text stays null.  Rows that repeat a ``doc_id`` and
its text count as one document.  Copies that overlap their own original leave it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import begin, same, stage

MIN_WORDS = 40
#: The characters between words.
SPACE = " \t\x0b\f\r"
#: Classes of one slice are numbered together.
SLICE = 4096


def line_table(docs: DataFrame) -> DataFrame:
    """doc, row_key, line number, two hashes and the words of every line."""
    # The text is hashed before its lines are made, once a document.
    split = (docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
             .select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("row_key"), F.split("text", "\n").alias("bodies"))
             .select("doc", "row_key", F.posexplode("bodies").alias("line", "body")))
    return split.select("doc", "row_key", "line", F.xxhash64("body").alias("h1"),
                        F.hash("body", F.length("body")).alias("h2"), words_in(F.col("body")).alias("words"))


def words_in(body: Column) -> Column:
    """Words of a line; where single blanks alone part them, which is the rule, blanks plus one."""
    bare, blank = F.trim(body, F.lit(SPACE)), F.trim(body)
    odd = body.contains("  ")
    for c in SPACE[1:]:
        odd = odd | body.contains(c)
    single = F.octet_length(blank) - F.octet_length(F.replace(blank, F.lit(" "), F.lit(""))) + 1
    return F.when(odd, F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"\s+")))).when(blank == "", 0).otherwise(single)


def repeated(lines: DataFrame, min_words: int) -> DataFrame:
    """Places in stretches of repeated lines that hold ``min_words`` words, with ``need`` and ``back``:
    the fewest lines from the place on, and up to it, that do so; null if the stretch has not as many."""
    again = lines.where("line = 0").groupBy("doc", "row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not again.isEmpty():
        lines = stage(lines.distinct())
    twice = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    held = stage(lines.join(twice, ["h1", "h2"]))
    placed = held.withColumn("stretch", F.expr("line - row_number() OVER (PARTITION BY doc, row_key ORDER BY line)"))
    own = "PARTITION BY doc, row_key, stretch"
    summed = placed.withColumn("up_to", F.expr(f"sum(words) OVER ({own} ORDER BY line)")).withColumn(
        "all_words", F.expr(f"sum(words) OVER ({own})")).where(F.col("all_words") >= min_words)
    # The nearest place whose running sum reaches the goal, by merging goals and sums in one order;
    # backwards the same with all signs changed.
    base = ["doc", "row_key", "stretch", "line", "h1", "h2"]
    before = F.col("up_to") - F.col("words")
    rows = summed.select(*base, F.explode(F.array(*[F.struct(
        F.lit(way).alias("way"), F.lit(sums).alias("sums"), at.alias("at"), reached.cast("int").alias("reached")) for way, sums, at, reached in (
            (1, 0, before + min_words, F.lit(None)), (1, 1, F.col("up_to"), F.col("line")),
            (-1, 0, min_words - F.col("up_to"), F.lit(None)), (-1, 1, -before, -F.col("line")))])).alias("x")).select(*base, "x.*")
    last = f"min(reached) OVER ({own}, way ORDER BY at DESC, sums DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return (rows.withColumn("reached_at", F.expr(last)).where("sums = 0")
            .withColumn("span", F.when(F.col("way") == 1, F.col("reached_at") - F.col("line") + 1).otherwise(F.col("line") + F.col("reached_at") + 1))
            .groupBy("doc", "row_key", "line", "h1", "h2").agg(F.max(F.when(F.col("way") == 1, F.col("span"))).alias("need"),
                                                              F.max(F.when(F.col("way") == -1, F.col("span"))).alias("back")))


def first_ranks(places: DataFrame) -> DataFrame:
    """Each place with the number of places whose line comes before its own, in hash order."""
    lines = places.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.shiftright("h1", 52))
    blocks = lines.groupBy("block").agg(F.sum("n").alias("n")).withColumn(  # 4,096 rows at most
        "offset", F.expr("sum(n) OVER (ORDER BY block) - n")).select("block", "offset")
    ranked = (lines.withColumn("inner", F.expr("sum(n) OVER (PARTITION BY block ORDER BY h1, h2) - n"))
              .join(blocks, "block").select("h1", "h2", (F.col("offset") + F.col("inner")).alias("rank")))
    return places.join(ranked, ["h1", "h2"]).select("doc", "row_key", "line", "need", "back", "rank")


def doubled(places: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Places with the rank of 2k lines, from ranks of k lines; and the classes (rank, partner, n)."""
    own = "OVER (PARTITION BY doc, row_key ORDER BY line)"
    paired = places.withColumn("partner", F.expr(
        f"CASE WHEN lead(line, {k}) {own} = line + {k} THEN lead(rank, {k}) {own} ELSE -1 END"))
    classes = (paired.groupBy("rank", "partner").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("slice", F.floor(F.col("partner") / SLICE)))
    slices = classes.groupBy("rank", "slice").agg(F.sum("n").alias("n")).select(
        "rank", "slice", F.expr("sum(n) OVER (PARTITION BY rank ORDER BY slice) - n").alias("offset"))
    inner = F.expr("sum(n) OVER (PARTITION BY rank, slice ORDER BY partner) - n")
    ranked = (classes.withColumn("inner", inner).join(slices, ["rank", "slice"])
              .select("rank", "partner", (F.col("rank") + F.col("offset") + F.col("inner")).alias("next")))
    return paired.join(ranked, ["rank", "partner"]).select("doc", "row_key", "line", "need", "back", F.col("next").alias("rank")), classes


def suffix_array(places: DataFrame) -> list[DataFrame]:
    """Places ranked by their first 1, 2, 4 … lines; the last one tells apart all shortest runs, ``need`` or ``back`` lines long."""
    levels = [stage(first_ranks(places))]
    longest = places.agg(F.greatest(F.max("need"), F.max("back"))).first()[0] or 1
    ranks = F.sum(F.col("rank").cast("decimal(20, 0)"))  # grows whenever a class splits
    before = levels[0].agg(ranks).first()[0]
    while 1 << (len(levels) - 1) < longest:
        levels.append(stage(doubled(levels[-1], 1 << (len(levels) - 1))[0]))
        after = levels[-1].agg(ranks).first()[0]
        if after == before:
            return levels[:-1]
        before = after
    return levels


def with_common_prefix(pairs: DataFrame, levels: list[DataFrame], longest: int) -> DataFrame:
    """``pairs`` of places (a_, b_) of different suffixes with ``common``: how many lines agree, exact up to ``longest``."""
    out = pairs.withColumn("common", F.lit(0))
    # Different suffixes have different ranks in the last level.
    for m in range(min(len(levels) - 1, max(1, longest).bit_length()) - 1, -1, -1):
        for side in "ab":
            at = levels[m].select(F.col("doc").alias("_d"), F.col("row_key").alias("_k"), F.col("line").alias("_l"), F.col("rank").alias(f"{side}_at"))
            out = out.join(at, (F.col(f"{side}_doc") == F.col("_d")) & (F.col(f"{side}_key") == F.col("_k"))
                           & (F.col(f"{side}_line") + F.col("common") == F.col("_l")), "left").drop("_d", "_k", "_l")
        out = out.withColumn("common", F.col("common") + F.when(F.col("a_at") == F.col("b_at"), 1 << m).otherwise(0)).drop("a_at", "b_at")
        if m % 3 == 0:
            out = stage(out)
    return out


def last_cut(classes: DataFrame) -> DataFrame:
    """Each class with the largest ``cut`` at or before it: within slices, slices of slices, and over those."""
    sliced = classes.withColumn("s1", F.floor(F.col("rank") / SLICE)).withColumn("s2", F.floor(F.col("s1") / SLICE))
    one = sliced.groupBy("s1", "s2").agg(F.max("cut").alias("top"))
    two = one.groupBy("s2").agg(F.max("top").alias("top"))
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    two = two.select("s2", F.expr(f"max(top) OVER (ORDER BY s2 {before})").alias("c2"))
    one = one.select("s1", F.expr(f"max(top) OVER (PARTITION BY s2 ORDER BY s1 {before})").alias("c1"))
    inner = F.expr("max(cut) OVER (PARTITION BY s1 ORDER BY rank)")
    return (sliced.withColumn("c0", inner).join(one, "s1").join(two, "s2")
            .withColumn("run", F.coalesce("c0", "c1", "c2")).drop("s1", "s2", "c0", "c1", "c2", "cut"))


def runs_from(levels: list[DataFrame]) -> DataFrame:
    """doc, row_key, line, need and run of the places whose shortest run occurs in some interval; ``run`` names it."""
    order = levels[-1]
    classes = stage(order.groupBy("rank").agg(F.min(F.struct("doc", "row_key", "line")).alias("p"), F.count(F.lit(1)).alias("n"), F.min("need").alias("need")))
    longest = classes.agg(F.max("need")).first()[0] or 1
    above = classes.select((F.col("rank") + F.col("n")).alias("rank"), F.col("p").alias("q"))
    pairs = classes.join(above, "rank").where("need IS NOT NULL").select(
        "rank", *[F.col(f"{s}.{c}").alias(f"{side}_{n}") for s, side in (("p", "a"), ("q", "b"))
                  for c, n in (("doc", "doc"), ("row_key", "key"), ("line", "line"))])
    common = with_common_prefix(pairs, levels, longest).select("rank", "common")
    # A class that cannot hold enough words, or shares too little with the one before it, begins anew.
    cut = F.when(F.coalesce(F.col("common") >= F.col("need"), F.lit(False)), None).otherwise(F.col("rank"))
    runs = last_cut(classes.join(common, "rank", "left").select("rank", "need", cut.alias("cut")))
    return order.drop("need", "back").join(runs.where("need IS NOT NULL"), "rank").select(
        "doc", "row_key", "line", "need", F.struct("run", F.lit(0).alias("size"), F.lit(0).cast("long").alias("tail")).alias("run"))


def runs_up_to(levels: list[DataFrame]) -> DataFrame:
    """The same for the shortest runs that end at each line, named by their size and the ranks of the halves that cover them."""
    top = F.lit(len(levels) - 1)
    ends = levels[0].where("back IS NOT NULL").select(
        "doc", "row_key", (F.col("line") - F.col("back") + 1).alias("line"), F.col("back").alias("need"),
        F.least(F.floor(F.log2("back") + 1e-9).cast("int"), top).alias("m"))
    deepest = ends.agg(F.max("m")).first()[0]
    if deepest is None:
        return ends.select("doc", "row_key", "line", "need", F.struct(F.lit(0).cast("long").alias("run"), F.col("need").cast("int").alias("size"), F.lit(0).cast("long").alias("tail")).alias("run"))
    ranks = levels[0].select(F.lit(0).alias("m"), "doc", "row_key", "line", "rank")
    for m in range(1, deepest + 1):
        ranks = ranks.unionByName(levels[m].select(F.lit(m).alias("m"), "doc", "row_key", "line", "rank"))
    at = ["m", "doc", "row_key", "line"]
    headed = ends.join(ranks.withColumnRenamed("rank", "head"), at)
    second = headed.withColumn("first", F.col("line")).withColumn("line", (F.col("line") + F.col("need") - F.expr("shiftleft(1, m)")).cast("int"))
    return second.join(ranks.withColumnRenamed("rank", "tail"), at).select(
        "doc", "row_key", F.col("first").alias("line"), "need",
        F.struct(F.col("head").alias("run"), F.col("need").cast("int").alias("size"), F.col("tail").alias("tail")).alias("run"))


def later_copies(places: DataFrame) -> DataFrame:
    """doc, row_key, begin, end (exclusive) of lines to delete, as disjoint ranges."""
    levels = suffix_array(places)
    found = stage(runs_from(levels).unionByName(runs_up_to(levels)))
    firsts = stage(found.groupBy("run").agg(F.min(F.struct("doc", "row_key", "line")).alias("f"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    own = (F.col("doc") == F.col("f.doc")) & (F.col("row_key") == F.col("f.row_key"))
    later = (found.join(firsts, "run").where(~(own & (F.col("line") == F.col("f.line"))))
             .select("doc", "row_key", F.when(own, F.greatest("line", F.col("f.line") + F.col("need"))).otherwise(F.col("line")).alias("line"),
                     (F.col("line") + F.col("need")).alias("end")).where("line < end")
             .groupBy("doc", "row_key", "line").agg(F.max("end").alias("end")))
    reach = F.expr("max(end) OVER (PARTITION BY doc, row_key ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    island = F.expr("sum(CASE WHEN line <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc, row_key ORDER BY line)")
    return (later.withColumn("reach", reach).withColumn("island", island)
            .groupBy("doc", "row_key", "island").agg(F.min("line").alias("begin"), F.max("end").alias("end")).drop("island"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with the text that is left, plus ``lines_before`` and ``lines_removed``."""
    begin(docs.sparkSession)
    lines = stage(line_table(docs))
    ranges = later_copies(stage(repeated(lines, min_words)))
    by_doc = ranges.groupBy("doc", "row_key").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("ranges")).select(
        F.col("doc").alias("__doc"), F.col("row_key").alias("__key"), F.col("ranges").alias("__ranges"))
    joined = docs.join(by_doc, same(docs["doc_id"].cast("long"), F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__key")), "left")
    joined = joined.withColumn("__lines", F.split(docs["text"], "\n"))
    kept = F.expr("array_join(flatten(zip_with(concat(array(0), __ranges.end), concat(__ranges.begin, array(size(__lines))),"
                  " (s, e) -> slice(__lines, s + 1, e - s))), '\\n')")
    removed = F.expr("aggregate(__ranges, 0L, (n, r) -> n + r.end - r.begin)")
    names = [c for c in docs.columns if c not in ("text", "lines_before", "lines_removed")]
    return joined.select(*[docs[c] for c in names], F.when(F.col("__ranges").isNull(), docs["text"]).otherwise(kept).alias("text"),
                         F.when(docs["text"].isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("lines_before"),
                         F.coalesce(removed, F.lit(0)).cast("long").alias("lines_removed"))


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    return deduplicated(docs.select("doc_id", "text"), min_words).select("doc_id", "lines_before", "lines_removed", "text")


def with_lines_left(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents after deletion, all their columns; those of which nothing is left go."""
    out = deduplicated(docs, min_words)
    return out.where("lines_removed < lines_before OR lines_removed = 0").select(*docs.columns)
