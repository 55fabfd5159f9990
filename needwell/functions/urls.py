"""URL handling with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from needwell.config import Platform
from needwell.functions.text import last_without_digit, strip

# Query parameters starting with one of these are tracking noise.
TRACKING_PREFIXES = ("utm_", "fbclid", "gclid", "mc_", "ref", "trk", "originaltrk")

# A compact public-suffix list; pass a longer table where it matters, see needwell.operators.rules.
PUBLIC_SUFFIXES = (
    "com", "org", "net", "edu", "gov", "info", "biz", "io", "co", "ai", "app", "dev",
    "in", "co.in", "uk", "co.uk", "org.uk", "ac.uk", "de", "fr", "es", "it", "nl", "eu",
    "us", "ca", "au", "com.au", "nz", "co.nz", "jp", "co.jp", "br", "com.br", "sg", "com.sg",
    "example",
)

_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _tidy(url: Column) -> Column:
    """Trimmed, with embedded tabs and line ends dropped as URL readers do."""
    return F.translate(strip(url), "\t\n\r", "")


def _part(url: Column, index: int) -> Column:
    return F.regexp_extract(url, _PARTS, index)


def is_valid_url(url: Column) -> Column:
    """http(s) scheme and a host; NULL counts as invalid."""
    return F.coalesce(_tidy(url).rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def _form_decode(part: Column) -> Column:
    """Form decoding that leaves a stray ``%`` alone."""
    safe = F.regexp_replace(part, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(safe)


def _form_encode(part: Column) -> Column:
    """Form encoding with ``~`` kept and ``*`` escaped."""
    return F.replace(F.replace(F.url_encode(part), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _tracking(name: Column) -> Column:
    return name.rlike("^(?:" + "|".join(TRACKING_PREFIXES) + ")")


def _kept_query(query: Column) -> Column:
    """The query re-encoded pair by pair without tracking parameters."""

    def encode(pair: Column) -> Column:
        name = _form_decode(F.regexp_extract(pair, r"(?s)^([^=]*)", 1))
        value = _form_decode(F.regexp_extract(pair, r"(?s)^[^=]*=(.*)$", 1))
        return F.when(
            (pair != "") & ~_tracking(F.lower(name)),
            F.concat(_form_encode(name), F.lit("="), _form_encode(value)),
        )

    pairs = F.transform(F.split(query, "&", -1), encode)
    return F.array_join(F.filter(pairs, lambda p: p.isNotNull()), "&")


def normalize_url(url: Column) -> Column:
    """Host lower-cased, fragment and tracking parameters dropped; NULL if not http(s)."""
    tidy = _tidy(url)
    base = F.concat(
        F.lower(_part(tidy, 1)), F.lit("://"), F.lower(_part(tidy, 2)), _part(tidy, 3)
    )
    kept = _kept_query(_part(tidy, 4))
    with_query = F.when(kept != "", F.concat(base, F.lit("?"), kept)).otherwise(base)
    return F.when(
        is_valid_url(url),
        F.when(F.contains(tidy, F.lit("?")), with_query).otherwise(base),
    )


def canonical_post_url(url: Column) -> Column:
    """The URL up to its first ``?``."""
    return F.substring_index(url, "?", 1)


def unwrap_redirect(href: Column, platform: Platform = Platform()) -> Column:
    """Target of a search redirect link; ``//host`` becomes https."""
    query = F.regexp_extract(href, r"^[^?#]*\?([^#]*)", 1)
    raw = F.regexp_extract(query, rf"(?:^|&){platform.redirect_param}=([^&]+)", 1)
    # decoded twice: once as a form value, once as a plain quoted string
    target = _form_decode(F.replace(_form_decode(raw), F.lit("+"), F.lit("%2B")))
    wrapped = F.contains(href, F.lit(platform.redirect_marker)) | href.startswith("/l/")
    return (
        F.when(wrapped & (raw != ""), target)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .otherwise(href)
    )


def is_post_url(url: Column, platform: Platform = Platform()) -> Column:
    """The URL points at a post of the platform."""
    return url.rlike("(?i)" + platform.post_url_pattern)


def network_location(url: Column) -> Column:
    """Lower-cased host part of a URL."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))


def host_name(url: Column) -> Column:
    """Bare host: no scheme, credentials, port or trailing dot."""
    rest = F.regexp_replace(F.lower(strip(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//", "")
    location = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.regexp_replace(location, r"^.*@|:\d*$|\.$", "")


def absolute_profile_url(href: Column, platform: Platform = Platform()) -> Column:
    """A profile link made absolute; NULL for anything else."""
    return F.when(
        F.contains(href, F.lit(platform.profile_path)),
        F.when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("/"), F.concat(F.lit(platform.site), href))
        .when(href.startswith("http"), canonical_post_url(href)),
    )


def author_from_slug(url: Column) -> Column:
    """Author name spelled in a post URL, trailing id tokens dropped."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    slug = F.regexp_extract(F.regexp_extract(path, r"/posts/([^/?#]+)", 1), r"^([^_]*)", 1)
    words = F.filter(F.split(slug, "-", -1), lambda w: w != "")
    name = F.array_join(F.slice(words, 1, last_without_digit(words)), " ")
    return F.nullif(F.initcap(name), F.lit(""))
