"""Personal data in texts, all in column functions: patterns propose, checksums confirm, context scores.

Kinds email, ip, card and phone are the base: leftmost non-overlapping matches of a fixed pattern
per kind, failing matches dropped without a second try. Two kinds are added: `iban` (of the fixed length
of its country, confirmed by mod-97) and `ssn` (no checksum exists; only context words nearby lift it over
the threshold).
Every span has a score: the kind's own, plus a bonus for context words within CONTEXT characters.
Base spans are kept at any score. Only the first four characters of an `iban` are taken as the match, the
rest is looked ahead for, so a failing number hides none that begins inside it.

The patterns are written so that the Java matcher never goes back: possessive repeats, and a start
only where a run starts or the previous match ended. They find what the plain patterns find, in
linear time and without recursion, in texts of any length. Positions need no second search: the
pieces between matches (`split`) and the matches themselves add up to them.

Defined cases: a null text is empty and has no spans; rows are independent, so repeated rows and
null ids simply repeat; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table

CONTEXT = 40
THRESHOLD = 0.5
BONUS = 0.3
BLOCK = 256

_LOCAL = "[A-Za-z0-9._%+-]"

#: characters of an account number by country, of the IBAN registry and of countries that use the form without being in it
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "IR IS TR DZ", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC",
    33: "RU",
}
_LISTED = "|".join(" ".join(IBAN_LENGTHS.values()).split())
#: a number of any length that is an account number's is taken for a country without an entry
_IBAN = "(?:%s)(?![A-Za-z0-9])" % "|".join(
    [rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}+" for n, c in IBAN_LENGTHS.items()]
    + [rf"(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}+"]
)
#: no less than what follows a head: 30 signs, a blank before each, one that must not follow, and the context
TAIL = 2 * 30 + 1 + CONTEXT

#: kind: (pattern, characters without which there is no match, base score, context words)
KINDS = {
    "email": (
        rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        0.9,
        "mail|contact|write|reach",
    ),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"\bip\b|address|host|server|login"),
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+", None, 0.8, "card|visa|credit|pay"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.6, r"phone|tel\b|call|mobile|fax"),
    "iban": (rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}} ?[A-Z0-9])(?={_IBAN})[A-Z]{{2}}[0-9]{{2}}", None, 0.8, "iban|bank|account"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, "ssn|social|security|taxpayer"),
}
BASE = ("email", "ip", "card", "phone")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _chars(text: Column) -> Column:
    return F.array_remove(F.split(text, ""), "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    values = F.transform(
        _chars(F.reverse(digits)),
        lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")),
    )
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether letters and digits of an account number pass the mod-97 check."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    step = lambda a, c: F.when(
        c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97
    ).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_chars(turned), F.lit(0), step) == 1


def _short(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


CONFIRM: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _short),
    "card": lambda m: F.length(_digits(m)).between(14, 19) & luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
    "iban": mod97,
    "ssn": lambda m: ~F.substr(m, F.lit(1), F.lit(3)).isin("000", "666") & (F.left(m, F.lit(1)) != "9"),
}


def _running(steps: Column) -> Column:
    """Prefix sums of an array of longs: inside blocks, then over the blocks, so long arrays stay cheap."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")),
        lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)),
    )
    empty = F.array().cast("array<bigint>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("bigint"))
    append = lambda a, v: F.concat(a, F.array(last(a) + v))
    inside = F.transform(blocks, lambda b: F.aggregate(b, empty, append))
    totals = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, v: a + v)), empty, append)
    return F.flatten(
        F.transform(
            inside,
            lambda sums, i: F.transform(
                sums, lambda v: v + F.when(i > 0, F.get(totals, i - 1)).otherwise(F.lit(0).cast("bigint"))
            ),
        )
    )


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id and `spans`, an array of kind, start, end, score in order of start, then kind as listed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("_text")).select(
        "doc_id",
        "_text",
        *[
            (
                F.when(F.contains(F.col("_text"), F.lit(needs)), F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
                if needs
                else F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
            ).alias(f"_m_{kind}")
            for kind, (pattern, needs, _, _) in KINDS.items()
        ],
    )
    split = found.select(
        "doc_id",
        *[f"_m_{kind}" for kind in KINDS],
        *[F.when(F.size(f"_m_{kind}") > 0, F.split("_text", pattern, -1)).alias(f"_p_{kind}") for kind, (pattern, *_) in KINDS.items()],
    )
    ends = split.select(
        "*",
        *[
            F.when(
                F.size(f"_m_{kind}") > 0,
                _running(
                    F.zip_with(
                        F.slice(f"_p_{kind}", 1, F.size(f"_m_{kind}")),
                        f"_m_{kind}",
                        lambda p, m: (F.length(p) + F.length(m)).cast("bigint"),
                    )
                ),
            ).alias(f"_e_{kind}")
            for kind in KINDS
        ],
    )
    return ends.select("doc_id", F.array_sort(F.concat(*[_spans(k, i) for i, k in enumerate(KINDS)])).alias("spans"))


def _tail(kind: str, i: Column) -> Column:
    """TAIL characters after match i, those of later matches included."""
    later = lambda of: F.slice(F.col(f"_{of}_{kind}"), i + 2, F.lit(TAIL // 4 + 1))
    joined = F.zip_with(later("p"), later("m"), lambda p, m: F.concat(F.left(p, F.lit(TAIL)), F.coalesce(m, F.lit(""))))
    return F.left(F.array_join(joined, ""), F.lit(TAIL))


def _spans(kind: str, order: int) -> Column:
    _, _, base, words = KINDS[kind]
    pieces = F.col(f"_p_{kind}")
    typed = "array<struct<start:bigint,kind_no:int,kind:string,end:bigint,score:double>>"

    def span(match: Column, i: Column) -> Column:
        start = F.get(F.col(f"_e_{kind}"), i) - F.length(match)
        after = F.get(pieces, i + 1)
        if kind == "iban":
            tail = _tail(kind, i)
            head, match = F.length(match), F.regexp_extract(F.concat(match, tail), f"^{_IBAN}", 0)
            after = F.substr(tail, F.length(match) - head + 1)
        near = F.concat_ws(" ", F.right(F.get(pieces, i), F.lit(CONTEXT)), F.left(after, F.lit(CONTEXT)))
        score = F.lit(base) + F.when(F.rlike(F.lower(near), F.lit(words)), F.lit(BONUS)).otherwise(F.lit(0.0))
        return F.when(
            CONFIRM[kind](match),
            F.struct(
                start.alias("start"),
                F.lit(order).alias("kind_no"),
                F.lit(kind).alias("kind"),
                (start + F.length(match)).alias("end"),
                F.round(F.least(score, F.lit(1.0)), 2).alias("score"),
            ),
        )

    spans = F.filter(F.transform(f"_m_{kind}", span), lambda s: s.isNotNull())
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= THRESHOLD)
    return F.when(F.size(f"_m_{kind}") > 0, spans).otherwise(F.array()).cast(typed)


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = find_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE))
    counts = [F.size(_of_kind("spans", kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
