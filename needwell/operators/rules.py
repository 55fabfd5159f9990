"""Values read by rule tables of any length: registered domains and phone numbers.

Rules are given as tables; short ones ship as defaults. Distinct values are
resolved once, however often they occur, and rows without a value never enter a
join, so neither a common host nor missing ones make a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from needwell.functions.contact import DIALLING_RULES
from needwell.functions.text import strip
from needwell.functions.urls import PUBLIC_SUFFIXES, host_name

OK, NO_RULE, INVALID = "ok", "no_rule", "invalid"


def default_suffixes(spark: SparkSession) -> DataFrame:
    """The short suffix table: suffix."""
    return spark.createDataFrame([(s,) for s in PUBLIC_SUFFIXES], "suffix STRING")


def default_dialling(spark: SparkSession) -> DataFrame:
    """The short table of dialling rules: region, code, national, trunk."""
    return spark.createDataFrame(list(DIALLING_RULES), "region STRING, code STRING, national STRING, trunk STRING")


def join_present(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Left join on a key that is unique in ``known``, reading ``df`` once.

    Rows whose key is NULL find nothing; a second key, a hash of the whole row, deals them out evenly.
    """
    hashable = [f.name for f in df.schema if not isinstance(f.dataType, MapType | VariantType)]
    apart = F.when(F.col(key).isNull(), F.xxhash64(*hashable)).otherwise(F.lit(0).cast("long"))
    joined = df.withColumn("_apart", apart).join(known.withColumn("_apart", F.lit(0).cast("long")), [key, "_apart"], "left")
    return joined.select(*df.columns, *[c for c in known.columns if c != key])


def with_registered_domain(df: DataFrame, url: str, suffixes: DataFrame, out: str = "domain") -> DataFrame:
    """Adds the label before the longest public suffix plus that suffix, else NULL.

    A rule ``*.x`` stands for every name right below ``x``; ``!y.x`` takes ``y.x``
    out of it again. A host under no rule has no domain.
    """
    keyed = df.withColumn("_host", F.nullif(host_name(F.col(url)), F.lit("")))
    hosts = keyed.select("_host").where(F.col("_host").isNotNull()).distinct().withColumn("_l", F.split("_host", r"\."))
    n = F.size("_l")

    def tail(at: Column) -> Column:
        return F.array_join(F.slice("_l", at, n), ".")

    def form(rule: Column, at: Column, exception: bool) -> Column:
        return F.struct(rule.alias("suffix"), at.alias("at"), F.lit(exception).alias("exception"))

    forms = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.array(
            form(tail(i), i, False),
            form(F.concat(F.lit("*."), tail(i + 1)), i, False),
            form(F.concat(F.lit("!"), tail(i)), i + 1, True),
        ),
    )
    offered = hosts.select("_host", "_l", F.inline(F.flatten(forms)))
    hits = offered.join(suffixes.select("suffix").distinct(), "suffix")
    longest = hits.groupBy("_host").agg(F.min(F.struct((~F.col("exception")).alias("_o"), "at"))["at"].alias("_at"))
    labels = F.split("_host", r"\.")
    owner = F.array_join(F.slice(labels, F.col("_at") - 1, F.size(labels)), ".")
    domains = longest.where((F.col("_at") > 1) & (F.col("_at") <= F.size(labels))).select("_host", owner.alias(out))
    return join_present(keyed, domains, "_host").drop("_host")


def with_phone(df: DataFrame, phone: str, rules: DataFrame, region: str = "US", out: str = "phone_e164") -> DataFrame:
    """Adds the number in E.164 form, and in ``<out>_state`` why it has none.

    ``ok``; ``no_rule`` where no calling code of the table fits, or the region is
    not in it; ``invalid`` for all else. ``region`` reads national numbers.
    """
    keyed = df.withColumn("_number", F.nullif(strip(F.col(phone)), F.lit("")))
    text, digits = F.col("_number"), F.col("_digits")
    numbers = keyed.select("_number").where(text.isNotNull()).distinct().withColumn("_digits", F.regexp_replace(text, "[^0-9]", ""))
    plausible = numbers.where(text.rlike(r"^\+?[0-9()\s./\-]+$"))
    abroad = plausible.where(text.startswith("+")).select(
        "_number", "_digits", F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.left(digits, k))).alias("code")
    )
    fits = F.rlike(digits, F.concat(F.lit("^"), F.col("code"), F.col("national"), F.lit("$")))
    named = abroad.join(rules, "code").select("_number", F.when(fits, F.concat(F.lit("+"), digits)).alias(out))
    own = plausible.where(~text.startswith("+")).withColumn("region", F.lit(region)).join(rules, "region")
    pattern = F.concat(F.lit("^(?:"), F.col("trunk"), F.lit(")?("), F.col("national"), F.lit(")$"))
    short = F.call_function("regexp_extract", digits, pattern, F.lit(1))
    at_home = own.select("_number", F.when(short != "", F.concat(F.lit("+"), F.col("code"), short)).alias(out))
    read = named.unionByName(at_home).groupBy("_number").agg(F.max(out).alias(out))
    joined = join_present(keyed, read.withColumn("_ruled", F.lit(True)), "_number")
    unruled = F.col("_ruled").isNull() & text.rlike(r"^\+?[0-9()\s./\-]+$")
    state = F.when(F.col(out).isNotNull(), OK).when(unruled, NO_RULE).otherwise(INVALID)
    return joined.withColumn(f"{out}_state", F.when(text.isNotNull(), state)).drop("_number", "_ruled")
