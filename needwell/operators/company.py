"""Company dimension: domains, duplicates, merging, profile fit, links and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from needwell.functions.text import clean_text
from needwell.functions.urls import host_name
from needwell.operators.connect import connected
from needwell.operators.names import FUZZY_THRESHOLD, name_classes, similar_names
from needwell.operators.rules import join_present, with_registered_domain
from needwell.session import staged

# --- duplicates and merging ------------------------------------------------------


def name_key(name: Column) -> Column:
    """Clean lower-cased name for exact comparison."""
    return F.lower(clean_text(name))


def completeness(df: DataFrame, ignore: Sequence[str] = ("id",)) -> Column:
    """Number of filled fields of a row."""
    total = F.lit(0)
    for f in df.schema:
        if f.name in ignore:
            continue
        if isinstance(f.dataType, T.ArrayType):
            filled = F.size(F.coalesce(F.col(f.name), F.array().cast(f.dataType))) > 0
        elif isinstance(f.dataType, T.StringType):
            filled = F.coalesce(F.col(f.name), F.lit("")) != ""
        else:
            filled = F.col(f.name).isNotNull()
        total = total + filled.cast("int")
    return total


def _merge_keys() -> dict[str, Column]:
    """What rows of one company share, by pass; NULL where a row has nothing to share."""
    return {
        "domain": F.nullif(F.lower("domain"), F.lit("")),
        "name_city": F.when(
            (F.coalesce("business_name", F.lit("")) != "") & (F.coalesce("city", F.lit("")) != ""),
            F.concat_ws("\x01", name_key(F.col("business_name")), F.lower("city")),
        ),
    }


def with_merge_key(companies: DataFrame, by: str) -> DataFrame:
    """Adds ``_key``; rows without one get a key of their own and stay alone."""
    return companies.withColumn("_key", F.coalesce(_merge_keys()[by], F.concat(F.lit("\x02"), F.col("id"))))


def _order(companies: DataFrame) -> Column:
    """What the kept row of a group is greatest in: filled fields, then id."""
    return F.struct(completeness(companies), F.col("id"))


def merge_companies(companies: DataFrame, by: str) -> DataFrame:
    """One row per key: the most complete row, gaps filled from the next ones, lists united."""
    return merge_groups(with_merge_key(companies, by)).drop("_key")


def merge_groups(keyed: DataFrame) -> DataFrame:
    """One row per ``_key``: the most complete row, gaps filled from the next ones.

    Scalars reduce with map-side combine. Lists are united item by item: items are made
    distinct before they are gathered, so what one row holds in the end is what its
    list holds, however many rows the group has.
    """
    columns = [c for c in keyed.columns if c != "_key"]
    lists = [f.name for f in keyed.schema if isinstance(f.dataType, T.ArrayType)]
    ranked = keyed.withColumn("_order", _order(keyed.drop("_key")))

    def present(name: str) -> Column:
        blank = isinstance(keyed.schema[name].dataType, T.StringType)
        return (F.coalesce(F.col(name), F.lit("")) != "") if blank else F.col(name).isNotNull()

    merged = ranked.groupBy("_key").agg(
        *[F.max_by(F.col(c), F.when(present(c), F.col("_order"))).alias(c) for c in columns if c not in lists]
    )
    if lists:
        united = list_items(keyed).groupBy("_key").agg(
            *[F.array_sort(F.collect_list(F.when(F.col("field") == c, F.col("item")))).alias(c) for c in lists]
        )
        merged = merged.join(united, "_key", "left")
    empty = F.array().cast("array<string>")
    return merged.select("_key", *[F.coalesce(F.col(c), empty).alias(c) if c in lists else F.col(c) for c in columns])


def list_items(keyed: DataFrame) -> DataFrame:
    """The distinct list items of each group as rows: _key, field, item."""
    lists = [f.name for f in keyed.schema if isinstance(f.dataType, T.ArrayType)]

    def labelled(name: str) -> Column:
        values = F.coalesce(F.col(name), F.array().cast("array<string>"))
        return F.transform(values, lambda x: F.struct(F.lit(name).alias("field"), x.alias("item")))

    return keyed.select("_key", F.inline(F.flatten(F.array(*[labelled(c) for c in lists])))).distinct()


def merge_log(companies: DataFrame, by: str) -> DataFrame:
    """Which row each merged row went into: (kept_id, merged_id, rule)."""
    return _decided(with_merge_key(companies, by), F.lit(by))


def _decided(keyed: DataFrame, rule: Column) -> DataFrame:
    rows = keyed.select("_key", "id", _order(keyed.drop("_key", "_rule")).alias("_order"), rule.alias("rule"))
    kept = rows.groupBy("_key").agg(F.max_by("id", "_order").alias("kept_id"))
    joined = rows.join(kept, "_key").where(F.col("id") != F.col("kept_id"))
    return joined.select("kept_id", F.col("id").alias("merged_id"), "rule")


def merge_in_passes(companies: DataFrame, suffixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Companies merged by registered domain, then by name and city; and the decisions of both passes.

    A row without a domain takes that of its website. Decisions name the row that is left in the end.
    """
    sited = with_registered_domain(companies, "website", suffixes, out="_site")
    named = sited.withColumn("domain", F.coalesce(F.nullif("domain", F.lit("")), F.col("_site"))).select(*companies.columns)
    once = merge_companies(named, "domain")
    second = merge_log(once, "name_city")
    moved = second.select(F.col("merged_id").alias("kept_id"), F.col("kept_id").alias("_final"))
    first = merge_log(named, "domain").join(moved, "kept_id", "left")
    first = first.select(F.coalesce("_final", "kept_id").alias("kept_id"), "merged_id", "rule")
    return merge_companies(once, "name_city"), first.unionByName(second)


def company_links(companies: DataFrame, fuzzy: float | None = FUZZY_THRESHOLD) -> DataFrame:
    """a, b, rule: pairs that hold groups of one company together.

    Every row of a key is tied to the smallest id of that key, so a key of n rows makes n - 1
    pairs; similar names tie their classes and a class its members. ``fuzzy=None`` leaves names out.
    """
    tied = []
    for rule, key in _merge_keys().items():
        rows = companies.select("id", key.alias("_k")).where(F.col("_k").isNotNull())
        first = rows.groupBy("_k").agg(F.min("id").alias("b"))
        tied.append(rows.join(first, "_k").select(F.col("id").alias("a"), "b", F.lit(rule).alias("rule")))
    if fuzzy is not None and {"city", "country"} <= set(companies.columns):
        members = name_classes(companies).select(F.col("id").alias("a"), F.col("class_id").alias("b"))
        pairs = similar_names(companies, fuzzy).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
        tied.append(members.unionByName(pairs).withColumn("rule", F.lit("similar_name")))
    links = tied[0]
    for more in tied[1:]:
        links = links.unionByName(more)
    return links.where("a != b")


def merge_connected(
    companies: DataFrame, suffixes: DataFrame, fuzzy: float | None = FUZZY_THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """Companies merged over all passes at once, and the decision for every merged row.

    Rows belong together if a chain of shared domains, of shared names in a city, or of similar
    names leads from one to the other, whichever pass finds each step. A row without a domain takes that of
    its website. A decision names the row that is left in the end and the first
    pass, cheapest first, that ties the merged row to any other.
    """
    sited = with_registered_domain(companies, "website", suffixes, out="_site")
    named = sited.withColumn("domain", F.coalesce(F.nullif("domain", F.lit("")), F.col("_site"))).select(*companies.columns)
    named = staged(named, "companies")
    links = staged(company_links(named, fuzzy), "company-links")
    groups = connected(links.select("a", "b")).select(F.col("node").alias("id"), F.col("label").alias("_label"))
    order = F.when(F.col("rule") == "domain", 0).when(F.col("rule") == "name_city", 1).otherwise(2)
    ends = links.select(F.col("a").alias("id"), "rule").unionByName(links.select(F.col("b").alias("id"), "rule"))
    rules = ends.groupBy("id").agg(F.min_by("rule", order).alias("_rule"))
    keyed = named.join(groups, "id", "left").join(rules, "id", "left")
    keyed = staged(keyed.select(*named.columns, F.coalesce("_label", "id").alias("_key"), "_rule"), "company-groups")
    return merge_groups(keyed.drop("_rule")).drop("_key"), _decided(keyed, F.col("_rule"))


def repoint_links(leads: DataFrame, decisions: DataFrame, link: str = "lead_id") -> DataFrame:
    """Leads whose link follows a merged company to the kept one."""
    moved = decisions.select(F.col("merged_id").alias(link), F.col("kept_id").alias("_kept"))
    joined = join_present(leads, moved, link)
    return joined.withColumn(link, F.coalesce("_kept", link)).select(*leads.columns)


# --- profile fit ------------------------------------------------------------------

FACTORS = (
    "industry_match",
    "location_match",
    "size_match",
    "has_website",
    "has_email",
    "tech_signal",
    "data_quality",
)


def score_profiles(companies: DataFrame, profiles: Sequence[Mapping]) -> DataFrame:
    """Companies against several ideal-customer profiles, one row per company and profile.

    A profile holds ``name``, ``weights`` and the wanted ``industries``, ``cities``,
    ``sizes``, ``tech_present`` and ``tech_absent``. Profiles are configuration and
    enter the plan as literals; no join takes place.
    """

    def member(column: str, values: Sequence[str]) -> Column:
        wanted = [v.lower() for v in values]
        return F.coalesce(F.lower(column).isin(*wanted), F.lit(False)) if wanted else F.lit(False)

    def stack(values: Sequence[str], mode) -> Column:
        have = F.coalesce(F.col("tech_stack"), F.array().cast("array<string>"))
        return mode(have, F.array(*[F.lit(v) for v in values]).cast("array<string>"))

    def filled(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit("")) != ""

    scored = []
    for profile in profiles:
        weights = {f: float(profile["weights"].get(f, 0)) for f in FACTORS}
        has_all = F.size(stack(profile.get("tech_present", ()), F.array_intersect)) > 0
        lacks = F.size(stack(profile.get("tech_absent", ()), F.array_intersect)) == 0
        shares = {
            "industry_match": member("industry", profile.get("industries", ())).cast("double"),
            "location_match": member("city", profile.get("cities", ())).cast("double"),
            "size_match": member("company_size", profile.get("sizes", ())).cast("double"),
            "has_website": filled("website").cast("double"),
            "has_email": filled("email").cast("double"),
            "tech_signal": (has_all & lacks).cast("double"),
            "data_quality": F.coalesce(F.col("data_quality_score"), F.lit(0)) / F.lit(100.0),
        }
        parts = {f: F.lit(weights[f]) * shares[f] for f in FACTORS}
        total = parts[FACTORS[0]]
        for f in FACTORS[1:]:
            total = total + parts[f]
        whole = sum(weights.values()) or 1.0
        points = F.rint(F.lit(100.0) * total / F.lit(whole)).cast("int")
        scored.append(
            F.struct(
                F.lit(profile["name"]).alias("profile"),
                F.least(F.greatest(points, F.lit(0)), F.lit(100)).alias("lead_score"),
                F.struct(*[parts[f].alias(f) for f in FACTORS]).alias("breakdown"),
            )
        )
    return companies.select("*", F.explode(F.array(*scored)).alias("_fit")).select(
        *[c for c in companies.columns if c != "lead_score"], "_fit.profile", "_fit.lead_score", "_fit.breakdown"
    )


# --- reports ----------------------------------------------------------------------


def quality_band(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 50, "medium").when(score >= 25, "low").otherwise("poor")


def company_stats(companies: DataFrame) -> DataFrame:
    """Counts by source, by status and by quality band, and the total, in one pass."""
    base = companies.select(
        F.col("lead_source").alias("source"), "status", quality_band(F.col("data_quality_score")).alias("band")
    )
    keys = [F.col("source"), F.col("status"), F.col("band")]
    return base.groupingSets([[keys[0]], [keys[1]], [keys[2]], []], *keys).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n")
    )


def missing_fields(companies: DataFrame, suppliers: Mapping[str, str]) -> DataFrame:
    """Empty fields of each company and the sources that could fill them."""
    checks = []
    for name, supplier in suppliers.items():
        empty = F.coalesce(F.col(name).cast("string"), F.lit("")) == ""
        checks.append(F.when(empty, F.struct(F.lit(name).alias("field"), F.lit(supplier).alias("source"))))
    gaps = F.filter(F.array(*checks), lambda g: g.isNotNull())
    return companies.select(
        "id",
        F.transform(gaps, lambda g: g["field"]).alias("missing"),
        F.array_sort(F.array_distinct(F.transform(gaps, lambda g: g["source"]))).alias("could_fill"),
    )


def filter_companies(companies: DataFrame, **wanted: object) -> DataFrame:
    """Rows under any set of export filters; absent filters do not restrict.

    Equality: country, state, city, industry, category, size, source.
    Thresholds: min_score, min_quality, updated_since. Search: keyword.
    """
    columns = {"size": "company_size", "source": "lead_source"}
    known = {"country", "state", "city", "industry", "category", "size", "source"}
    for key, value in wanted.items():
        if value is None:
            continue
        if key in known:
            test = F.lower(columns.get(key, key)) == str(value).lower()
        elif key == "min_score":
            test = F.col("lead_score") >= value
        elif key == "min_quality":
            test = F.col("data_quality_score") >= value
        elif key == "updated_since":
            test = F.col("last_updated") >= value
        elif key == "keyword":
            test = F.exists("keywords", lambda k: F.lower(k) == F.lit(str(value).lower()))
        else:
            raise ValueError(f"unknown filter {key!r}")
        companies = companies.where(test)
    return companies


def host_tails(host: Column) -> Column:
    """A host and every domain above it."""
    labels = F.split(F.lower(host), r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def purge_domains(df: DataFrame, domains: DataFrame, hosts: Sequence[Column], key: str) -> DataFrame:
    """Rows none of whose hosts is a purged domain or below one.

    ``hosts`` are host columns (of URLs or addresses), ``key`` identifies a row.
    Only the keys of affected rows are shuffled against the table.
    """
    listed = domains.select(F.lower("domain").alias("_d")).distinct()
    given = F.filter(F.array(*hosts), lambda h: F.coalesce(h, F.lit("")) != "")
    tails = F.array_distinct(F.flatten(F.transform(given, host_tails)))
    affected = df.select(key, F.explode(tails).alias("_d")).join(listed, "_d", "left_semi")
    return df.join(affected.select(key).distinct(), key, "left_anti").select(*df.columns)


#: columns of each stored table that name a site, by URL or address
SITE_COLUMNS = {
    "leads": ("post_url", "author_profile_url", "website", "contact_email"),
    "companies": ("domain", "website", "email"),
    "rejects": ("source_url",),
    "progress": ("url",),
}


def purge_tables(tables: Mapping[str, DataFrame], domains: DataFrame) -> dict[str, DataFrame]:
    """Stored tables without the rows that name a purged domain, or one below it, in any column.

    The hosts of all site columns are gathered in one pass and looked up once each, however many rows
    share one. The rows are read once more and meet the hosts that have to go, column by column.
    """
    listed = domains.select(F.lower("domain").alias("_d")).distinct()
    left = {}
    for name, rows in tables.items():
        columns = SITE_COLUMNS[name]
        hosts = rows.select(F.explode(F.array_distinct(F.array(*[_host(c) for c in columns]))).alias("_host"))
        hosts = hosts.where(F.col("_host").isNotNull()).distinct()
        above = hosts.select("_host", F.explode(host_tails(F.col("_host"))).alias("_d"))
        gone = staged(above.join(listed, "_d", "left_semi").select("_host").distinct(), "gone")
        kept = rows
        for column in columns:
            kept = kept.join(gone, _host(column) == gone["_host"], "left_anti")
        left[name] = kept
    return left


def _host(column: str) -> Column:
    return F.nullif(host_name(F.col(column)), F.lit(""))


# --- enrichment of companies and links --------------------------------------------


def phrase_trie(taxonomy: DataFrame) -> DataFrame:
    """node, word, next, industry: the phrases (keyword, industry) as paths from the node ''.

    A node is named by the words that lead to it; ``industry`` is set where a phrase ends.
    """
    words = F.filter(F.split(F.lower("keyword"), r"(?U)[^\w]+"), lambda w: w != "")
    phrases = taxonomy.select(words.alias("w"), "industry").where(F.size("w") > 0).distinct()
    join = lambda n: F.array_join(F.slice("w", F.lit(1), n), " ")
    steps = phrases.select("*", F.posexplode("w").alias("i", "word"))
    steps = steps.select(
        join(F.col("i")).alias("node"),
        "word",
        join(F.col("i") + 1).alias("next"),
        F.when(F.col("i") == F.size("w") - 1, F.col("industry")).alias("industry"),
    )
    return steps.distinct()


def phrases_found(texts: DataFrame, trie: DataFrame) -> DataFrame:
    """id, phrase, industry: from each word of (id, field) the longest phrase of the trie that begins there.

    The trie is walked a level at a time: a place in a text goes on to the next level only if
    its words so far begin some phrase, and takes along the words that the longest phrase could need.
    """
    trie = staged(trie, "trie")
    depth = trie.agg(F.max(F.size(F.split("next", " ")))).first()[0] or 0
    words = F.filter(F.split(F.lower("field"), r"(?U)[^\w]+"), lambda w: w != "")
    fields = texts.withColumn("_w", words).select("id", F.monotonically_increasing_id().alias("_f"), "_w")
    places = fields.select("id", "_f", F.posexplode("_w").alias("_at", "word"), "_w").select(
        "id", "_f", "_at", "word", F.slice("_w", F.col("_at") + 2, F.lit(max(depth - 1, 1))).alias("_rest")
    )
    open_, found = places.withColumn("node", F.lit("")), None
    steps = trie.select("node", "word", "next").distinct()
    ends = trie.where("industry IS NOT NULL").select(F.col("next").alias("phrase"), "industry").distinct()
    for level in range(depth):
        walked = staged(open_.join(steps, ["node", "word"]), "phrases")
        reached = walked.select("id", "_f", "_at", F.lit(level).alias("_level"), F.col("next").alias("phrase"))
        reached = reached.join(ends.select("phrase").distinct(), "phrase", "left_semi")
        found = reached if found is None else found.unionByName(reached)
        open_ = walked.where(F.size("_rest") > 0).select(
            "id", "_f", "_at", F.col("next").alias("node"),
            F.element_at("_rest", 1).alias("word"), F.slice("_rest", F.lit(2), F.size("_rest")).alias("_rest"),
        )
    if found is None:
        return texts.select("id", F.col("field").alias("phrase"), F.lit(None).cast("string").alias("industry")).limit(0)
    longest = found.groupBy("id", "_f", "_at").agg(F.max_by("phrase", "_level").alias("phrase"))
    return longest.select("id", "phrase").distinct().join(ends, "phrase").select("id", "phrase", "industry")


def classify_industry(companies: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Industry with most keyword hits in name, description and lists; ties by name.

    ``taxonomy`` holds (keyword, industry); a keyword is a phrase of any number of words, and counts where
    its words follow each other within one field and no longer phrase begins at the same word.
    """
    fields = F.concat(F.array("business_name", "description"), F.coalesce("keywords", F.array().cast("array<string>")))
    found = phrases_found(companies.select("id", F.explode(fields).alias("field")), phrase_trie(taxonomy))
    hits = found.groupBy("id", F.col("industry").alias("_sector")).agg(F.count(F.lit(1)).alias("n"))
    best = hits.groupBy("id").agg(F.min_by("_sector", F.struct(-F.col("n"), F.col("_sector"))).alias("_industry"))
    joined = companies.join(best, "id", "left")
    return joined.withColumn("industry", F.coalesce("_industry", "industry")).drop("_industry")


# Fingerprints of common site technology, as lower-case patterns over page source.
TECH_FINGERPRINTS = (
    ("wordpress", r"wp-content|wp-includes"),
    ("shopify", r"cdn\.shopify\.com"),
    ("google_analytics", r"google-analytics\.com|gtag\("),
    ("hubspot", r"js\.hs-scripts\.com"),
    ("tracker", r"track\(\d+\)"),
    ("html5", r"<!doctype html>"),
)


def detect_tech(pages: DataFrame, html: str = "html", fingerprints: Sequence[tuple[str, str]] = TECH_FINGERPRINTS) -> DataFrame:
    """Adds ``tech_stack``: names of the fingerprints found in a page."""
    found = F.array(*[F.when(F.col(html).rlike(f"(?i){p}"), F.lit(n)) for n, p in fingerprints])
    return pages.withColumn("tech_stack", F.filter(found, lambda t: t.isNotNull()))


def link_companies(leads: DataFrame, companies: DataFrame) -> DataFrame:
    """Fills ``lead_id`` of leads whose stated company has a row of that name."""
    named = (
        companies.select(name_key(F.col("business_name")).alias("_name"), "id")
        .where(F.col("_name") != "")
        .groupBy("_name")
        .agg(F.min("id").alias("_company_id"))
    )
    keyed = leads.withColumn("_name", F.nullif(name_key(F.col("company")), F.lit("")))
    joined = join_present(keyed, named, "_name")
    return joined.withColumn("lead_id", F.coalesce("lead_id", "_company_id")).drop("_name", "_company_id")


def leads_with_company(leads: DataFrame, companies: DataFrame) -> DataFrame:
    """Leads with name and domain of their linked company, if any."""
    dim = companies.select(F.col("id").alias("lead_id"), F.col("business_name").alias("linked_name"), F.col("domain").alias("linked_domain"))
    return join_present(leads, dim, "lead_id")


def clear_broken_links(leads: DataFrame, companies: DataFrame) -> DataFrame:
    """``lead_id`` set to NULL where the company row is gone."""
    present = companies.select(F.col("id").alias("lead_id"), F.lit(True).alias("_present"))
    joined = join_present(leads, present, "lead_id")
    linked = F.when(F.col("_present"), F.col("lead_id"))
    return joined.withColumn("lead_id", linked).drop("_present").select(*leads.columns)


def best_per_author(leads: DataFrame) -> DataFrame:
    """The best lead of each author and need, with the number of leads it stands for.

    An aggregate rather than a window: a busy author combines before the shuffle.
    """
    order = F.struct(F.coalesce("lead_score", F.lit(-1)), F.col("first_seen"), F.col("post_url"))
    return leads.groupBy(F.lower("author_name").alias("author_key"), "need_category").agg(
        F.max_by("post_url", order).alias("post_url"),
        F.max("lead_score").alias("lead_score"),
        F.count(F.lit(1)).alias("leads"),
    )
