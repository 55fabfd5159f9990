"""Company dimension derived from the customer table, and its reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needwell.operators import company, ingest, names, rules, runs
from needwell.functions.urls import host_name
from needwell.session import staged
from workload import dialect as q
from workload.ingest import tagged
from workload.leads import RESCORED, UPSERT_SQL, merged_leads, merged_with_stored, rescored
from workload.registry import query, table
from workload.runs import ATTEMPTS_SQL, attempts
from workload.views import now



_EXPR = {
    "id": "concat('c', c_custkey)",
    "business_name": "concat('Acme ', c_mktsegment, ' Group ', c_custkey % 211)",
    "domain": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('d', c_custkey % 500, '.example.com') END",
    "website": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('https://www.d', c_custkey % 500, '.example.com/') END",
    "email": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('info@mail.d', c_custkey % 450, '.example.com') END",
    "phone": "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('+1', c_custkey) END",
    "industry": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE lower(c_mktsegment) END",
    "city": "concat('City ', c_nationkey)",
    "country": "concat('Land ', c_nationkey % 5)",
    "company_size": "CASE WHEN c_custkey % 2 = 0 THEN '11-50' ELSE '51-200' END",
    "description": "concat('We sell ', lower(c_mktsegment), ' and seo')",
    "lead_source": "lower(c_mktsegment)",
    "status": "CASE WHEN c_acctbal > 5000 THEN 'scored' ELSE 'new' END",
}
_INTS = {"data_quality_score": "CAST(c_custkey % 101 AS INT)"}


def companies(spark: SparkSession, sf_dir: str, changed: dict[str, str] | None = None) -> DataFrame:
    """Company rows, one per customer; some expressions may be changed."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        *[F.expr(e).alias(n) for n, e in {**_EXPR, **_INTS, **(changed or {})}.items()],
        F.expr("array(lower(c_mktsegment), concat('k', c_custkey % 7))").alias("keywords"),
        F.expr("array('shopify', concat('t', c_custkey % 3))").alias("tech_stack"),
    )


COMPANIES_SQL = (
    "companies",
    "SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in {**_EXPR, **_INTS}.items())
    + ", [lower(c_mktsegment), concat('k', c_custkey % 7)] AS keywords, ['shopify', concat('t', c_custkey % 3)] AS tech_stack FROM customer",
)
_NAMES = [*_EXPR, *_INTS]
_FILLED = " + ".join(f"(coalesce({n}, '') <> '')::INT" for n in _EXPR if n != "id") + " + 3"
_KEYS = {
    "domain": "coalesce(nullif(lower(domain), ''), '#' || id)",
    "name_city": "lower(business_name) || '|' || lower(city)",
    "label": "label",
}


_LISTS = ("keywords", "tech_stack")


def _merge_ctes(source: str, by: str, out: str) -> tuple[tuple[str, str], ...]:
    """Rows of a table with key and rank, and what each group leaves."""
    key = _KEYS[by]
    values = []
    for name in [*_EXPR, *_INTS]:
        given = f"{name} IS NOT NULL" if name in _INTS else f"coalesce({name}, '') <> ''"
        values.append(f"first({name} ORDER BY filled DESC, id DESC) FILTER (WHERE {given}) AS {name}")
    lists = ", ".join(f"list_sort(list_distinct(flatten(list({name})))) AS {name}" for name in _LISTS)
    return (
        (f"{out}_keyed", f"SELECT *, {key} AS k, {_FILLED} AS filled FROM {source}"),
        (out, f"SELECT k, {', '.join(values)}, {lists} FROM {out}_keyed GROUP BY k"),
        (
            f"{out}_log",
            f"""SELECT kept_id, id AS merged_id, '{by}' AS rule FROM {out}_keyed
              JOIN (SELECT k, first(id ORDER BY filled DESC, id DESC) AS kept_id FROM {out}_keyed GROUP BY k) USING (k)
              WHERE id <> kept_id""",
        ),
    )


_ROW_SQL = ", ".join([*_EXPR, *_INTS, *(f"array_to_string({name}, ',') AS {name}" for name in _LISTS)])


def _rows(merged: DataFrame) -> DataFrame:
    return merged.select(*_EXPR, *_INTS, *[F.array_join(name, ",").alias(name) for name in _LISTS])


def _merge_sql(by: str) -> str:
    return f"{q.with_ctes(COMPANIES_SQL, *_merge_ctes('companies', by, 'merged'))} SELECT {_ROW_SQL} FROM merged"


@query("company_merge", _merge_sql("domain"))
def company_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies of one domain merged without losing a filled field."""
    return _rows(company.merge_companies(companies(spark, sf_dir), "domain"))


@query("company_merge_by_name", _merge_sql("name_city"))
def company_merge_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies of one name and city merged."""
    return _rows(company.merge_companies(companies(spark, sf_dir), "name_city"))


@query(
    "merge_decisions",
    f"""{q.with_ctes(COMPANIES_SQL, *_merge_ctes('companies', 'domain', 'merged'))} SELECT k, count(*) - 1 AS merged,
      max(filled)::INTEGER AS kept_filled FROM merged_keyed GROUP BY k HAVING count(*) > 1""",
)
def merge_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each kept company absorbed, and how complete the kept one is."""
    rows = companies(spark, sf_dir)
    log = company.merge_log(rows, "domain")
    kept = company.with_merge_key(rows, "domain").select(
        F.col("id").alias("kept_id"), F.col("_key").alias("k"), company.completeness(rows).alias("filled")
    )
    counted = log.groupBy("kept_id").agg(F.count(F.lit(1)).alias("merged"))
    return counted.join(kept, "kept_id").select("k", "merged", F.col("filled").alias("kept_filled"))


# half of the rows state a domain in capitals, all others have it in their website only
_SITED = {
    "domain": "CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN NULL ELSE concat('D', c_custkey % 500, '.co.uk') END",
    "website": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('https://www.d', c_custkey % 500, '.co.uk/') END",
}


def _chain_ctes() -> tuple[tuple[str, str], ...]:
    sited = {**_EXPR, **_INTS, **_SITED}
    resolved = {**sited, "domain": f"coalesce({_SITED['domain']}, regexp_extract({_SITED['website']}, 'www[.](.*)/', 1))"}
    columns = ", ".join(f"nullif({e}, '') AS {n}" if n == "domain" else f"{e} AS {n}" for n, e in resolved.items())
    lists = "[lower(c_mktsegment), concat('k', c_custkey % 7)] AS keywords, ['shopify', concat('t', c_custkey % 3)] AS tech_stack"
    return (
        ("sited", f"SELECT {columns}, {lists} FROM customer"),
        *_merge_ctes("sited", "domain", "once"),
        ("first_pass", "SELECT * EXCLUDE (k) FROM once"),
        *_merge_ctes("first_pass", "name_city", "twice"),
        (
            "decisions",
            """SELECT coalesce(t.kept_id, o.kept_id) AS kept_id, o.merged_id, o.rule FROM once_log o
              LEFT JOIN twice_log t ON t.merged_id = o.kept_id UNION ALL SELECT * FROM twice_log""",
        ),
    )


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = companies(spark, sf_dir, _SITED)
    return company.merge_in_passes(rows, rules.default_suffixes(spark))


@query("companies_after_passes", f"{q.with_ctes(*_chain_ctes())} SELECT {_ROW_SQL} FROM twice")
def companies_after_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies merged by registered domain, then by name and city."""
    return _rows(_chain(spark, sf_dir)[0])


@query("pass_decisions", f"{q.with_ctes(*_chain_ctes())} SELECT * FROM decisions")
def pass_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which company each merged one ended in, over both passes."""
    return _chain(spark, sf_dir)[1]


_WORDS = ("Bright Oak", "Acme", "Globex Studio", "Nord", "Bread & Co", "Pixel Media Lab", "Quiet", "Oak", "Harbour Light", "Blue Acme", "Fern", "Studio Nord", "Media")
_SHORT_NAME = f"""concat_ws(' ', element_at({{words}}, CAST(c_custkey % {len(_WORDS)} + 1 AS INT)), CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) END,
    CASE WHEN c_custkey % 3 = 0 THEN 'Group' END, CASE WHEN c_custkey % 5 = 0 THEN 'GmbH' END, CASE WHEN c_custkey % 7 > 2 THEN concat('N', c_custkey % 37) END)"""
_SHORT = _SHORT_NAME.format(words="array(" + ", ".join(f"'{w}'" for w in _WORDS) + ")")
_SHORT_SQL = _SHORT_NAME.format(words="[" + ", ".join(f"'{w}'" for w in _WORDS) + "]").replace("element_at", "list_extract")


def _similar_ctes(rows: str) -> tuple[tuple[str, str], ...]:
    """Word sets of (id, business_name, city, country), their classes, and similar classes of a place."""
    joined = lambda words: f"(list_sum(list_transform({words}, lambda w: length(w))) + len({words}) - 1)"
    rest = lambda a: f"list_filter({a}.tok, lambda w: NOT list_contains(m, w))"
    return (
        ("c", rf"""SELECT id, lower(city) AS city, lower(country) AS country, list_sort(list_distinct(list_filter(
            regexp_split_to_array(lower(business_name), '[^a-z0-9_]+'), lambda w: w <> ''))) AS tok FROM {rows}"""),
        ("s", "SELECT city, country, tok, min(id) AS id, count(*) AS n FROM c GROUP BY ALL"),
        ("p", f"""SELECT a.id AS id_a, b.id AS id_b, {joined('m')} AS same,
            least(coalesce({joined(rest('a'))}, 0), coalesce({joined(rest('b'))}, 0)) AS rest
          FROM (SELECT s AS a, t AS b, list_intersect(s.tok, t.tok) AS m FROM s JOIN s t ON s.city = t.city AND s.country = t.country AND s.id < t.id)
          WHERE len(m) > 0"""),
        ("alike", """SELECT id_a, id_b, CASE WHEN rest <= 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * same / (2 * same + 1 + rest) END AS similarity FROM p
          WHERE rest <= 0 OR 200.0::DOUBLE * same / (2 * same + 1 + rest) >= 92"""),
    )


_NAMED_ROWS = ("named_rows", f"SELECT concat('c', c_custkey) AS id, {_SHORT_SQL} AS business_name, concat('City ', c_nationkey) AS city, 'Land' AS country FROM customer")


def _named_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.expr("concat('c', c_custkey)").alias("id"),
        F.expr(_SHORT).alias("business_name"),
        F.expr("concat('City ', c_nationkey)").alias("city"),
        F.lit("Land").alias("country"),
    )


@query(
    "similar_companies",
    f"{q.with_ctes(_NAMED_ROWS, *_similar_ctes('named_rows'))} SELECT id_a, id_b, round(similarity * 100)::BIGINT AS similarity FROM alike",
)
def similar_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names of a city that say the same in more or fewer words, in hundredths of a percent.

    Each name stands for all companies that have its words.
    """
    pairs = names.similar_names(_named_rows(spark, sf_dir))
    return pairs.withColumn("similarity", F.round(F.col("similarity") * 100).cast("bigint"))


@query(
    "company_name_links",
    f"""{q.with_ctes(_NAMED_ROWS, *_similar_ctes('named_rows'), ('ends', 'SELECT id_a AS id FROM alike UNION ALL SELECT id_b FROM alike'))}
    SELECT c.id, s.id AS class_id, (SELECT count(*) FROM ends WHERE ends.id = s.id) AS links FROM c JOIN s USING (city, country, tok)""",
)
def company_name_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every named company, and how many classes are similar to it."""
    return names.name_links(_named_rows(spark, sf_dir))


# three rows in a row share a domain, half of them by their website only; names are shared or similar across these
_TIED = {
    "business_name": "concat('Oak', c_custkey % 53, ' ', c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN ' Group' ELSE '' END, CASE WHEN c_custkey % 3 = 0 THEN ' Holding' ELSE '' END)",
    "domain": "CASE WHEN c_custkey % 2 = 0 OR c_custkey % 5 = 0 THEN NULL ELSE concat('T', CAST(floor(c_custkey / 3) AS BIGINT), '.co.uk') END",
    "website": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('https://www.t', CAST(floor(c_custkey / 3) AS BIGINT), '.co.uk/') END",
}


def _tied_ctes() -> tuple[tuple[str, str], ...]:
    tied = {**_EXPR, **_INTS, **_TIED}
    tied["domain"] = f"coalesce({_TIED['domain']}, regexp_extract({_TIED['website']}, 'www[.](.*)/', 1))"
    columns = ", ".join(f"nullif({e}, '') AS {n}" if n == "domain" else f"{e} AS {n}" for n, e in tied.items())
    lists = "[lower(c_mktsegment), concat('k', c_custkey % 7)] AS keywords, ['shopify', concat('t', c_custkey % 3)] AS tech_stack"
    return (
        ("tied", f"SELECT {columns}, {lists} FROM customer"),
        *_similar_ctes("tied"),
        ("classes", "SELECT c.id, s.id AS class_id, s.n FROM c JOIN s USING (city, country, tok)"),
        ("links", """SELECT a.id AS x, b.id AS y, 'domain' AS rule FROM tied a JOIN tied b ON lower(a.domain) = lower(b.domain) AND a.id <> b.id
          UNION ALL SELECT a.id, b.id, 'name_city' FROM tied a JOIN tied b ON lower(a.business_name) = lower(b.business_name) AND lower(a.city) = lower(b.city) AND a.id <> b.id
          UNION ALL SELECT id, class_id, 'similar_name' FROM classes WHERE n > 1
          UNION ALL SELECT class_id, id, 'similar_name' FROM classes WHERE n > 1
          UNION ALL SELECT id_a, id_b, 'similar_name' FROM alike UNION ALL SELECT id_b, id_a, 'similar_name' FROM alike"""),
        ("steps", "SELECT DISTINCT x, y FROM links"),
        ("reach", "SELECT id AS x, id AS y FROM tied UNION SELECT reach.x, steps.y FROM reach JOIN steps ON steps.x = reach.y"),
        ("labels", "SELECT x AS id, min(y) AS label FROM reach GROUP BY x"),
        ("ruled", "SELECT x AS id, min(rule) AS own_rule FROM links GROUP BY x"),
        ("labelled", "SELECT tied.*, label FROM tied JOIN labels USING (id)"),
        *_merge_ctes("labelled", "label", "joined"),
    )


def _tied(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return company.merge_connected(companies(spark, sf_dir, _TIED), rules.default_suffixes(spark))


def _recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


@query("connected_companies", f"{_recursive(q.with_ctes(*_tied_ctes()))} SELECT {_ROW_SQL} FROM joined")
def connected_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies merged along chains of shared domains, shared names and similar names."""
    return _rows(_tied(spark, sf_dir)[0])


@query(
    "connected_decisions",
    f"{_recursive(q.with_ctes(*_tied_ctes()))} SELECT kept_id, merged_id, own_rule AS rule FROM joined_log JOIN ruled ON ruled.id = merged_id",
)
def connected_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which company each merged one ended in, and the first pass that ties it to another."""
    return _tied(spark, sf_dir)[1]


PROFILES = (
    {
        "name": "shops",
        "weights": {
            "industry_match": 30, "location_match": 20, "size_match": 15, "has_website": 10,
            "has_email": 10, "tech_signal": 10, "data_quality": 5,
        },
        "industries": ("furniture", "household"),
        "cities": ("City 1", "City 2", "City 3"),
        "sizes": ("11-50",),
        "tech_present": ("shopify",),
        "tech_absent": ("t0",),
    },
    {"name": "machines", "weights": {"industry_match": 3, "data_quality": 1}, "industries": ("machinery",)},
)


@query(
    "profile_scores",
    f"""{q.with_ctes(COMPANIES_SQL, ('f', '''SELECT id,
        (coalesce(industry IN ('furniture', 'household'), false))::INT * 30.0::DOUBLE + (city IN ('City 1', 'City 2', 'City 3'))::INT * 20.0::DOUBLE
        + (company_size = '11-50')::INT * 15.0::DOUBLE + (website IS NOT NULL)::INT * 10.0::DOUBLE + (email IS NOT NULL)::INT * 10.0::DOUBLE
        + (NOT list_contains(tech_stack, 't0'))::INT * 10.0::DOUBLE + 5.0::DOUBLE * (data_quality_score / 100.0::DOUBLE) AS a,
        (coalesce(industry = 'machinery', false))::INT * 3.0::DOUBLE + 1.0::DOUBLE * (data_quality_score / 100.0::DOUBLE) AS b FROM companies'''))}
    SELECT id, 'shops' AS profile, round_even(100.0::DOUBLE * a / 100.0::DOUBLE, 0)::INTEGER AS lead_score FROM f
    UNION ALL SELECT id, 'machines', round_even(100.0::DOUBLE * b / 4.0::DOUBLE, 0)::INTEGER FROM f""",
)
def profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies against two ideal-customer profiles side by side."""
    return company.score_profiles(companies(spark, sf_dir), PROFILES).select("id", "profile", "lead_score")


@query(
    "company_stats",
    f"""{q.with_ctes(COMPANIES_SQL, ('b', '''SELECT lead_source AS source, status, CASE WHEN data_quality_score >= 75 THEN 'high'
        WHEN data_quality_score >= 50 THEN 'medium' WHEN data_quality_score >= 25 THEN 'low' ELSE 'poor' END AS band FROM companies'''))}
    SELECT source, status, band, count(*) AS n FROM b GROUP BY GROUPING SETS ((source), (status), (band), ())""",
)
def company_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source, status and quality band in one pass."""
    return company.company_stats(companies(spark, sf_dir)).drop("level")


@query(
    "company_filters",
    f"""{q.with_ctes(COMPANIES_SQL)} SELECT id, business_name FROM companies WHERE country = 'Land 2' AND industry = 'building'
      AND data_quality_score >= 30 AND company_size = '11-50' AND list_contains(keywords, 'k3')""",
)
def company_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export filters combined."""
    rows = company.filter_companies(
        companies(spark, sf_dir), country="land 2", industry="Building", min_quality=30, size="11-50", keyword="K3", city=None
    )
    return rows.select("id", "business_name")


@query(
    "missing_company_data",
    f"""{q.with_ctes(COMPANIES_SQL)} SELECT id, array_to_string(list_filter([CASE WHEN website IS NULL THEN 'website' END,
      CASE WHEN email IS NULL THEN 'email' END, CASE WHEN phone = '' THEN 'phone' END], lambda x: x IS NOT NULL), ',') AS missing,
      array_to_string(list_sort(list_distinct(list_filter([CASE WHEN website IS NULL THEN 'search' END,
      CASE WHEN email IS NULL THEN 'website' END, CASE WHEN phone = '' THEN 'website' END], lambda x: x IS NOT NULL))), ',') AS could_fill
    FROM companies""",
)
def missing_company_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty fields and what could fill them."""
    gaps = company.missing_fields(companies(spark, sf_dir), {"website": "search", "email": "website", "phone": "website"})
    return gaps.select("id", F.array_join("missing", ",").alias("missing"), F.array_join("could_fill", ",").alias("could_fill"))


_PURGED = "SELECT concat('d', n_nationkey * 7, '.example.com') AS domain FROM nation"


@query(
    "purged_companies",
    f"""{q.with_ctes(COMPANIES_SQL, ('gone', _PURGED))} SELECT id FROM companies WHERE NOT EXISTS (SELECT 1 FROM gone g
      WHERE g.domain = companies.domain OR 'info@mail.' || g.domain = email)""",
)
def purged_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies left after purging a list of domains from URLs and addresses."""
    gone = table(spark, sf_dir, "nation").select(F.expr("concat('d', n_nationkey * 7, '.example.com')").alias("domain"))
    rows = companies(spark, sf_dir)
    hosts = [host_name(F.col("website")), F.substring_index("email", "@", -1)]
    return company.purge_domains(rows, gone, hosts, "id").select("id")


_OPTED_OUT = ("bakery-shop.example", "d7.example.com", "Example.org", "User-3.Social.example")
# rejected posts of a user stand below a host of their own
_OWN_HOST = (r"social\.example/posts/(user-\d)_", "www.$1.social.example/")


@query(
    "purged_tables",
    f"""{q.with_ctes(*UPSERT_SQL, COMPANIES_SQL, ATTEMPTS_SQL)}
    SELECT 'leads' AS tab, count(*) AS n FROM merged WHERE NOT regexp_matches(lower(concat_ws(' ', contact_email, website)),
      '[@./](bakery-shop[.]example|example[.]org)( |/|$)')
    UNION ALL SELECT 'companies', count(*) FROM companies WHERE coalesce(domain, '') <> 'd7.example.com' AND coalesce(email, '') <> 'info@mail.d7.example.com'
    UNION ALL SELECT 'rejects', count(*) FROM tagged WHERE reason IS NOT NULL AND post_url NOT LIKE 'https://social.example/posts/user-3%'
    UNION ALL SELECT 'progress', count(*) FROM (SELECT DISTINCT source, query, url FROM attempts WHERE outcome = 'ok')""",
)
def purged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left in each stored table after an opt-out list; leads and rejects come from posts that are cleaned once."""
    posts = staged(ingest.settled(tagged(spark, sf_dir)), "posts")
    tables = {
        "leads": merged_with_stored(ingest.valid_rows(posts)),
        "companies": companies(spark, sf_dir),
        "rejects": ingest.reject_rows(posts, now()).withColumn("source_url", F.regexp_replace("source_url", *_OWN_HOST)),
        "progress": runs.seen_urls(attempts(spark, sf_dir)),
    }
    left = company.purge_tables(tables, spark.createDataFrame([(d,) for d in _OPTED_OUT], "domain STRING"))
    counted = [rows.agg(F.lit(name).alias("tab"), F.count(F.lit(1)).alias("n")) for name, rows in left.items()]
    return reduce(DataFrame.unionByName, counted)


_TAXONOMY = (("furniture", "home"), ("household", "home"), ("machinery", "industry"), ("building", "industry"), ("seo", "marketing"), ("automobile", "vehicles"), ("group", "holding"))


@query(
    "company_industries",
    f"""{q.with_ctes(COMPANIES_SQL,
      ('tax', 'SELECT * FROM (VALUES ' + ', '.join(f"({q.lit(k)}, {q.lit(i)})" for k, i in _TAXONOMY) + ') AS t(keyword, sector)'),
      ('tok', "SELECT DISTINCT id, unnest(regexp_split_to_array(lower(business_name || ' ' || description || ' ' || array_to_string(keywords, ' ')), '[^a-z0-9_]+')) AS w FROM companies"),
      ('hits', 'SELECT id, sector, count(*) AS n FROM tok JOIN tax ON w = keyword GROUP BY 1, 2'))}
    SELECT id, sector AS industry FROM hits QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, sector) = 1""",
)
def company_industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industry by keyword taxonomy."""
    taxonomy = spark.createDataFrame(list(_TAXONOMY), "keyword STRING, industry STRING")
    return company.classify_industry(companies(spark, sf_dir), taxonomy).select("id", "industry")


_PHRASES = (
    ("we sell", "trade"), ("we sell furniture and seo", "home"), ("sell household and seo", "home"), ("acme building group", "construction"),
    ("Acme  AUTOMOBILE Group 7", "vehicles"), ("seo", "marketing"), ("and seo", "marketing"), ("machinery", "industry"), ("sell machinery and seo or more", "never"),
    ("long list of six given words", "lists"),
)


@query(
    "company_phrases",
    f"""{q.with_ctes(COMPANIES_SQL,
      ('tax', 'SELECT k, len(k) AS n, sector FROM (SELECT DISTINCT regexp_split_to_array(lower(keyword), ' + q.lit('[^a-z0-9_]+') + ') AS k, sector FROM (VALUES '
        + ', '.join(f"({q.lit(k)}, {q.lit(i)})" for k, i in _PHRASES) + ') AS t(keyword, sector))'),
      ('fields', "SELECT id, unnest([business_name, concat(description, CASE WHEN data_quality_score % 3 = 0 THEN ', a long list of six given words' ELSE '' END)] || keywords) AS field FROM companies"),
      ('tok', "SELECT id, row_number() OVER () AS f, list_filter(regexp_split_to_array(lower(field), '[^a-z0-9_]+'), lambda w: w <> '') AS w FROM fields"),
      ('spots', 'SELECT id, f, w, unnest(range(1, len(w) + 1)) AS i FROM tok'),
      ('hit', 'SELECT id, f, i, tax.k, sector, n FROM spots JOIN tax ON w[i : i + n - 1] = tax.k'),
      ('longest', 'SELECT DISTINCT id, k, sector FROM hit QUALIFY rank() OVER (PARTITION BY id, f, i ORDER BY n DESC) = 1'),
      ('votes', 'SELECT id, sector, count(*) AS n FROM longest GROUP BY 1, 2'))}
    SELECT id, sector AS industry FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, sector) = 1""",
)
def company_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industry by phrases of one to six words, the longest that begins at a word winning."""
    taxonomy = spark.createDataFrame(list(_PHRASES), "keyword STRING, industry STRING")
    more = F.when(F.col("data_quality_score") % 3 == 0, ", a long list of six given words").otherwise("")
    rows = companies(spark, sf_dir).withColumn("description", F.concat("description", more)).withColumn("industry", F.lit(None).cast("string"))
    return company.classify_industry(rows, taxonomy).where("industry IS NOT NULL").select("id", "industry")


@query(
    "page_technology",
    r"""SELECT page_id, array_to_string(list_filter([CASE WHEN regexp_matches(html, '(?i)wp-content|wp-includes') THEN 'wordpress' END,
      CASE WHEN regexp_matches(html, '(?i)cdn\.shopify\.com') THEN 'shopify' END,
      CASE WHEN regexp_matches(html, '(?i)google-analytics\.com|gtag\(') THEN 'google_analytics' END,
      CASE WHEN regexp_matches(html, '(?i)js\.hs-scripts\.com') THEN 'hubspot' END,
      CASE WHEN regexp_matches(html, '(?i)track\(\d+\)') THEN 'tracker' END,
      CASE WHEN regexp_matches(html, '(?i)<!doctype html>') THEN 'html5' END], lambda x: x IS NOT NULL), ',') AS tech FROM pages""",
)
def page_technology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technology fingerprints in whole pages."""
    found = company.detect_tech(table(spark, sf_dir, "pages"))
    return found.select("page_id", F.array_join("tech_stack", ",").alias("tech"))


# --- links between leads and companies -----------------------------------------

_NAMED = """SELECT concat('s', s_suppkey) AS id, CASE s_suppkey % 5 WHEN 0 THEN 'ACME  Studios' WHEN 1 THEN 'Globex'
    WHEN 2 THEN 'Bread & Co' ELSE s_name END AS business_name, concat('s', s_suppkey, '.example.com') AS domain FROM supplier"""


def named_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    name = F.expr("CASE s_suppkey % 5 WHEN 0 THEN 'ACME  Studios' WHEN 1 THEN 'Globex' WHEN 2 THEN 'Bread & Co' ELSE s_name END")
    return s.select(
        F.expr("concat('s', s_suppkey)").alias("id"),
        name.alias("business_name"),
        F.expr("concat('s', s_suppkey, '.example.com')").alias("domain"),
    )


_LINK_SQL = (
    ("named", _NAMED),
    ("dim", rf"SELECT lower(regexp_replace(business_name, '\s+', ' ', 'g')) AS k, min(id) AS company_id FROM named GROUP BY 1"),
    ("linked", "SELECT m.post_url, d.company_id AS lead_id FROM merged m LEFT JOIN dim d ON d.k = lower(m.company)"),
)


@query(
    "lead_companies",
    f"""{q.with_ctes(*UPSERT_SQL, *_LINK_SQL)} SELECT l.post_url, l.lead_id, n.business_name AS linked_name, n.domain AS linked_domain
      FROM linked l LEFT JOIN named n ON n.id = l.lead_id""",
)
def lead_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads linked to company rows by stated name, then joined to them."""
    dim = named_companies(spark, sf_dir)
    linked = company.link_companies(merged_leads(spark, sf_dir), dim)
    return company.leads_with_company(linked, dim).select("post_url", "lead_id", "linked_name", "linked_domain")


@query(
    "broken_links_cleared",
    f"""{q.with_ctes(*UPSERT_SQL, *_LINK_SQL)} SELECT post_url, CASE WHEN lead_id IN (SELECT id FROM named WHERE business_name <> 'Globex')
      THEN lead_id END AS lead_id FROM linked""",
)
def broken_links_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to deleted companies become NULL."""
    dim = named_companies(spark, sf_dir)
    linked = company.link_companies(merged_leads(spark, sf_dir), dim)
    return company.clear_broken_links(linked, dim.where("business_name <> 'Globex'")).select("post_url", "lead_id")


@query(
    "best_lead_per_author",
    f"""{q.with_ctes(*RESCORED)} SELECT lower(author_name) AS author_key, need_category, max(new_lead_score) AS lead_score, count(*) AS leads,
      max_by(post_url, (coalesce(new_lead_score, -1), first_seen, post_url)) AS post_url FROM scored GROUP BY 1, 2""",
)
def best_lead_per_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lead per author and need: the best one."""
    return company.best_per_author(rescored(spark, sf_dir))



