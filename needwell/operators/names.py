"""Company names of one place that say the same in more or fewer words.

The token-set ratio of two names looks at their common words s and at what is left of each. With the
lengths of these words joined by blanks it is 200 * s / (2 * s + 1 + r), r being the shorter rest, and
100 where one name has all the words of the other. Words are compared whole, in any order and once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needwell.session import staged

# Fixed value: ratio in percent from which two names are flagged.
FUZZY_THRESHOLD = 92
#: lists of a word longer than this are split by a second word
LONG_LIST = 500

_PLACE = ["country", "city"]


def name_tokens(name: Column) -> Column:
    """Sorted distinct words of a name."""
    words = F.filter(F.split(F.lower(name), r"(?U)[^\w]+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(words))


def name_classes(companies: DataFrame) -> DataFrame:
    """country, city, tokens, id, class_id: companies whose names have the same words share the smallest id."""
    rows = companies.select(
        F.coalesce(F.lower("country"), F.lit("")).alias("country"),
        F.coalesce(F.lower("city"), F.lit("")).alias("city"),
        F.col("id"),
        name_tokens(F.col("business_name")).alias("tokens"),
    ).where(F.size("tokens") > 0)
    firsts = rows.groupBy(*_PLACE, "tokens").agg(F.min("id").alias("class_id"))
    return rows.join(firsts, [*_PLACE, "tokens"])


def token_set_ratio(common: Column, rest_a: Column, rest_b: Column) -> Column:
    """Ratio of two names from their common words and the rests of both, all as arrays."""
    length = lambda words: F.length(F.array_join(words, " "))
    s, r = length(common), F.least(length(rest_a), length(rest_b))
    return F.when(s == 0, 0.0).when(r == 0, 100.0).otherwise(F.lit(200.0) * s / (2 * s + 1 + r))


def similar_names(companies: DataFrame, threshold: float = FUZZY_THRESHOLD, long_list: int = LONG_LIST) -> DataFrame:
    """id_a, id_b, similarity: classes of equal names (see :func:`name_classes`) that reach the threshold, each pair once."""
    sets = name_classes(companies).where(F.col("id") == F.col("class_id")).select(*_PLACE, "tokens", "id")
    return similar_sets(sets, threshold, long_list)


def similar_sets(sets: DataFrame, threshold: float = FUZZY_THRESHOLD, long_list: int = LONG_LIST) -> DataFrame:
    """Similar pairs of distinct word sets (country, city, tokens, id).

    Words are ordered by how rare they are in the place. The name that has the shorter rest can
    miss only so many letters, its slack. So the other one has one of its rarest words, up to as
    many as the slack can hold: it is looked up in the lists of these words alone, and found under the
    first one it has. From there on the other name must have letters enough, which is
    checked on the list entry. A list of a frequent word is split by the next word both have.
    """
    slack = 2 * (100 - threshold) / threshold
    words = sets.select(*_PLACE, "id", F.explode("tokens").alias("word"))
    often = words.groupBy(*_PLACE, "word").agg(F.count("*").alias("n"))
    ranked = words.join(often, [*_PLACE, "word"]).groupBy(*_PLACE, "id").agg(
        F.array_sort(F.collect_list(F.struct("n", "word"))).alias("r")
    )
    letters = lambda ws: F.aggregate(ws, F.lit(0), lambda a, w: a + F.length(w["word"]))
    ranked = staged(ranked.withColumn("letters", letters(F.col("r"))), "names")

    def upto(start: Column) -> Column:
        """Words from a place on that have to be tried: as long as those before could all be missing."""
        size = F.size("r")
        tried = F.filter(
            F.sequence(F.least(start, size), size),
            lambda i: (i < size) & (letters(F.slice("r", start + 1, F.greatest(i - start, F.lit(0)))) <= F.col("spare")),
        )
        return F.transform(tried, lambda i: F.struct(i.alias("at"), F.element_at("r", i + 1).alias("w")))

    # what a rest may have: 1 + rest <= slack * common
    probes = ranked.withColumn("spare", F.greatest(F.lit(slack) * (F.col("letters") + F.size("r") - 1) - 1, F.lit(0.0)))
    probes = probes.select("*", F.inline(upto(F.lit(0))))
    probes = probes.where(F.col("w.n") > 1)
    one = probes.where(F.col("w.n") <= long_list).withColumn("key", F.array("w.word"))
    # the word itself may be all that the names have in common
    long_probes = probes.where(F.col("w.n") > long_list)
    alone = long_probes.where(F.col("letters") - F.length("w.word") <= F.col("spare")).withColumn("key", F.array("w.word"))
    paired = long_probes.where(F.col("letters") - F.length("w.word") > F.col("spare"))
    paired = paired.withColumnsRenamed({"w": "v", "at": "first"})
    paired = paired.select("*", F.inline(upto(F.col("first") + 1)))
    paired = paired.withColumn("key", F.array("v.word", "w.word"))
    shape = [*_PLACE, "id", "r", "letters", "spare", "key"]
    wanted = one.select(*shape).unionByName(alone.select(*shape)).unionByName(paired.select(*shape))

    entries = ranked.select("*", F.posexplode("r").alias("at", "w"))
    left = F.col("letters") - letters(F.slice("r", F.lit(1), F.col("at")))
    entries = entries.withColumn("left", left).where(F.col("w.n") > 1)
    single = entries.withColumn("key", F.array("w.word"))
    double = entries.where(F.col("w.n") > long_list).select(
        "*", F.explode(F.slice("r", F.col("at") + 2, F.size("r"))).alias("x")
    )
    double = double.withColumn("key", F.array("w.word", "x.word"))
    kept = [*_PLACE, "key", F.col("id").alias("other"), F.col("r").alias("other_r"), "left"]
    listed = single.select(*kept).unionByName(double.select(*kept))

    plain = lambda ws: F.transform(ws, lambda w: w["word"])
    met = wanted.join(listed, [*_PLACE, "key"]).where(
        (F.col("id") != F.col("other")) & (F.col("left") >= F.col("letters") - F.col("spare"))
    )
    met = met.select("id", "other", "key", plain(F.col("r")).alias("a"), plain(F.col("other_r")).alias("b"))
    common = F.array_intersect("a", "b")
    met = met.withColumn("common", common).where(F.slice("common", 1, F.size("key")) == F.col("key"))
    rest_a, rest_b = (F.array_except(x, "common") for x in ("a", "b"))
    size = lambda x: F.length(F.array_join(x, " "))
    # both sides may find each other: the one with the shorter rest reports
    shorter = (size(rest_a) < size(rest_b)) | ((size(rest_a) == size(rest_b)) & (F.col("id") < F.col("other")))
    scored = met.where(shorter).withColumn("similarity", token_set_ratio(F.col("common"), rest_a, rest_b))
    return scored.where(F.col("similarity") >= threshold).select(
        F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"), "similarity"
    )


def name_links(companies: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """id, class_id, links: the class of every named company and how many other classes are similar to it."""
    classes = name_classes(companies).select("id", "class_id")
    pairs = similar_names(companies, threshold)
    ends = pairs.select(F.col("id_a").alias("class_id")).unionByName(pairs.select(F.col("id_b").alias("class_id")))
    counted = ends.groupBy("class_id").agg(F.count("*").alias("links"))
    return classes.join(counted, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
