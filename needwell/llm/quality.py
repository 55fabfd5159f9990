"""Quality rules with adaptive thresholds, all in column functions.

Each text is measured once. Fixed base rules reject short and repetitive texts. The other rules have
no fixed cutoff: per language and source, mergeable quantile sketches of each measure give the
quartiles of texts that pass the base rules, and a text outside a wide fence around them is rejected.

The sketch of a group is a histogram over buckets whose width grows with the value (exact below 32,
then 16 buckets per power of two, so a quantile is off by one sixteenth at most). Histograms of parts
merge by adding counts, so they are built by one aggregation that combines before it shuffles; the
result is the same in any order of merging, and has a row per group, measure and used bucket. A
group of under MIN_GROUP texts takes the merged sketches of its language, or then of everything.

Defined cases: a null text is empty and fails the base rules; null languages and sources are groups
of their own; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, table
from .staging import staged

MIN_GROUP = 100
FENCE = 3.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: measure in thousandths: (least distance of the fence from the quartile below, above); None: no fence there
MEASURES: dict[str, tuple[int | None, int | None]] = {
    "m_word_chars": (2000, 4000),
    "m_symbols": (None, 100),
    "m_dup_lines": (None, 300),
    "m_repeats": (None, 300),
}

_WS = r"[\x20\x09-\x0D]+"


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns kept, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    split = docs.select(*keep, text.alias("_text")).select(
        *keep,
        F.array_remove(F.split("_text", _WS), "").alias("_words"),
        F.length(F.regexp_replace("_text", _WS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    n = F.size("_words")
    hashed = split.select(
        *keep,
        "word_chars",
        "n_symbols",
        n.cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.transform("_words", lambda w: F.xxhash64(w))).alias("_h"),
    )
    pair = F.zip_with("_h", F.slice("_h", 2, F.size("_h")), lambda a, b: F.xxhash64(a, b))
    windows = hashed.withColumn("_pair", pair).withColumn(
        "_windows",
        F.slice(
            F.zip_with("_pair", F.slice("_h", 3, F.size("_h")), lambda a, b: F.xxhash64(a, b)),
            F.lit(1),
            F.greatest(F.size("_h") - 2, F.lit(0)),
        ),
    )
    # only a text with a repeated window has them sorted, each beside its position
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ranked = windows.withColumn(
        "_ranked",
        F.when(repeated, F.sort_array(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))),
    )
    twins = F.zip_with(
        "_ranked",
        F.slice("_ranked", 2, F.size("_ranked")),
        lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])),
    )
    starts = F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull())))
    covered = F.array_distinct(F.flatten(F.transform("_starts", lambda i: F.array(i, i + 1, i + 2))))
    return (
        ranked.withColumn("_starts", starts)
        .withColumn("n_repeat_words", F.coalesce(F.when(F.size("_starts") > 0, F.size(covered)), F.lit(0)).cast("long"))
        .select(
            *keep,
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            (
                (F.col("n_words") < MIN_WORDS)
                | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
            ).alias("base_failed"),
        )
    )


def _per_thousand(part: Column, whole: Column) -> Column:
    return F.floor(part * 1000 / F.greatest(whole, F.lit(1))).cast("long")


def with_measures(measured: DataFrame) -> DataFrame:
    n = F.col("n_words")
    return measured.withColumns(
        {
            "m_word_chars": _per_thousand(F.col("word_chars"), n),
            "m_symbols": _per_thousand(F.col("n_symbols"), n),
            "m_dup_lines": _per_thousand(F.col("n_dup_lines"), n),
            "m_repeats": _per_thousand(F.col("n_repeat_words"), n),
        }
    )


def bucket(value: Column) -> Column:
    """Bucket of a whole number: itself below 32, then 16 per power of two; increasing in the value."""
    power = F.length(F.bin(value)) - 5
    return F.when(value < 32, value).otherwise(16 * power + F.floor(value / F.pow(F.lit(2), power))).cast("int")


def bucket_floor(number: Column) -> Column:
    """The least value of a bucket."""
    power = F.floor(number / 16) - 1
    return F.when(number < 32, number).otherwise((number - 16 * power) * F.pow(F.lit(2), power)).cast("long")


def sketches(measures: DataFrame) -> DataFrame:
    """lang, source, name, bucket, n: the histograms of texts that pass the base rules."""
    named = F.array(*[F.struct(F.lit(m).alias("name"), bucket(F.col(m)).alias("bucket")) for m in MEASURES])
    return (
        measures.where(~F.col("base_failed"))
        .select("lang", "source", F.inline(named))
        .groupBy("lang", "source", "name", "bucket")
        .agg(F.count("*").alias("n"))
    )


def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """by, name, n_texts, q1, q3 out of histograms, merged over what `by` leaves out."""
    merged = sketch.groupBy(*by, "name", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "name")
    ranked = merged.withColumn("_upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("_all", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("_upto") * 4 >= F.col("_all") * q, F.col("bucket")))
    return ranked.groupBy(*by, "name").agg(
        F.max("_all").alias("n_texts"), bucket_floor(at(1)).alias("q1"), bucket_floor(at(3)).alias("q3")
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source, and the lower and upper fence of each measure; a row per group."""
    own = _quartiles(sketch, ["lang", "source"])
    lang = _quartiles(sketch, ["lang"]).select(
        F.col("lang").alias("_lang"), F.col("name").alias("_name"), *[F.col(c).alias(f"l_{c}") for c in ("n_texts", "q1", "q3")]
    )
    every = _quartiles(sketch, []).select(F.col("name").alias("_every"), F.col("q1").alias("e_q1"), F.col("q3").alias("e_q3"))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("name") == F.col("_name"))).join(
        every, F.col("name") == F.col("_every")
    )
    pick = lambda q: (
        F.when(F.col("n_texts") >= MIN_GROUP, F.col(q))
        .when(F.col("l_n_texts") >= MIN_GROUP, F.col(f"l_{q}"))
        .otherwise(F.col(f"e_{q}"))
    )
    spread = joined.select("lang", "source", "name", pick("q1").alias("q1"), pick("q3").alias("q3"))
    fences = []
    for name, (below, above) in MEASURES.items():
        of = lambda c, name=name: F.max(F.when(F.col("name") == name, c))
        reach = FENCE * (F.col("q3") - F.col("q1"))
        if below is not None:
            fences.append(of(F.col("q1") - F.greatest(reach, F.lit(below))).alias(f"low_{name}"))
        if above is not None:
            fences.append(of(F.col("q3") + F.greatest(reach, F.lit(above))).alias(f"high_{name}"))
    return spread.groupBy("lang", "source").agg(*fences)


def judge(measures: DataFrame, fences: DataFrame) -> DataFrame:
    """Add `kept`: base rules passed and every measure inside the fences of its group."""
    inside = []
    for name, (below, above) in MEASURES.items():
        if below is not None:
            inside.append(F.col(name) >= F.col(f"low_{name}"))
        if above is not None:
            inside.append(F.col(name) <= F.col(f"high_{name}"))
    own = fences.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    ok = F.coalesce(reduce(lambda a, b: a & b, inside), F.lit(False))
    return measures.join(own, same, "left").withColumn("kept", ~F.col("base_failed") & ok)


BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judged(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Measures and verdict of every row.

    The measures are written once: a filter on a computed measure would be pushed below it and
    compute it anew, and the verdict needs them a second time anyway.
    """
    measures = staged(with_measures(measure(docs, keep)), "quality")
    return judge(measures, thresholds(sketches(measures)))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns, base_failed and kept of every row."""
    return _judged(docs, ("doc_id", "lang", "source")).select("doc_id", *BASE_COLUMNS, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of documents that pass, with their columns as they are."""
    rows = docs.select("lang", "source", "text", F.struct(*docs.columns).alias("_row"))
    return _judged(rows, ("lang", "source", "_row")).where("kept").select("_row.*")


def _sql() -> str:
    """The same measures, histograms and fences in SQL."""
    n = "greatest(n_words, 1)"
    parts = {"m_word_chars": "word_chars", "m_symbols": "n_symbols", "m_dup_lines": "n_dup_lines", "m_repeats": "n_repeat_words"}
    ratios = ", ".join(f"({part} * 1000) // {n} AS {name}" for name, part in parts.items())
    named = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS name, {m} AS v FROM measured WHERE NOT base_failed" for m in MEASURES)
    floor = "CASE WHEN {b} < 32 THEN {b} ELSE ({b} - 16 * ({b} // 16 - 1)) << ({b} // 16 - 1) END"

    def quartiles(by: str) -> str:
        keys = f"{by}, name" if by else "name"
        return f"""SELECT {keys}, max(total) AS n_texts,
          {floor.format(b="min(bucket) FILTER (WHERE 4 * upto >= total)")} AS q1,
          {floor.format(b="min(bucket) FILTER (WHERE 4 * upto >= 3 * total)")} AS q3
        FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}) AS total
              FROM (SELECT {keys}, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY {keys}"""

    fences, inside = [], []
    for name, (below, above) in MEASURES.items():
        if below is not None:
            fences.append(f"max(q1 - greatest({FENCE} * (q3 - q1), {below})) FILTER (WHERE name = '{name}') AS low_{name}")
            inside.append(f"{name} >= low_{name}")
        if above is not None:
            fences.append(f"max(q3 + greatest({FENCE} * (q3 - q1), {above})) FILTER (WHERE name = '{name}') AS high_{name}")
            inside.append(f"{name} <= high_{name}")
    pick = ", ".join(
        f"CASE WHEN own.n_texts >= {MIN_GROUP} THEN own.{q} WHEN l.n_texts >= {MIN_GROUP} THEN l.{q} ELSE e.{q} END AS {q}"
        for q in ("q1", "q3")
    )
    return rf"""
    WITH words AS (
      SELECT doc_id, lang, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
      FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
    windows AS (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS held
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
    repeated AS (
      SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE held > 1) GROUP BY doc_id),
    counted AS (
      SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM words LEFT JOIN repeated USING (doc_id)),
    measured AS (
      SELECT *, {ratios}, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted),
    sketch AS (
      SELECT lang, source, name, count(*) AS n,
        CASE WHEN v < 32 THEN v ELSE 16 * (length(bin(v)) - 5) + (v >> (length(bin(v)) - 5)) END AS bucket
      FROM ({named}) GROUP BY lang, source, name, bucket),
    own AS ({quartiles("lang, source")}), l AS ({quartiles("lang")}), e AS ({quartiles("")}),
    spread AS (
      SELECT own.lang, own.source, own.name, {pick} FROM own
      JOIN l ON own.lang IS NOT DISTINCT FROM l.lang AND own.name = l.name JOIN e ON own.name = e.name),
    fences AS (SELECT lang, source, {", ".join(fences)} FROM spread GROUP BY lang, source)
    SELECT doc_id, {", ".join(BASE_COLUMNS)}, base_failed, NOT base_failed AND coalesce({" AND ".join(inside)}, false) AS kept
    FROM measured LEFT JOIN fences ON measured.lang IS NOT DISTINCT FROM fences.lang AND measured.source IS NOT DISTINCT FROM fences.source"""


SQL = _sql()


@query("op8_quality", SQL)
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality(table(spark, sf_dir, "documents"))
