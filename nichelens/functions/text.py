"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from nichelens.functions.constants import ENGAGEMENT_KEYS, PENALTIES


def normalize_phrase(c: Column) -> Column:
    """Lower case, apostrophes dropped, all else but a-z and 0-9 to single spaces. NULL stays NULL."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "['’ʼ′]", ""), "[^a-z0-9]+", " "))


def tokens_of(c: Column) -> Column:
    return F.filter(F.split(normalize_phrase(c), " "), lambda t: t != "")


def singular(w: Column) -> Column:
    """Plural endings that are certain are dropped: ies to y, es after ss, x, z, ch, sh, and s not after s, u, i, w, a, e."""
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    return (
        F.when(F.length(w) <= 3, w)
        .when(w.endswith("ies") & (F.length(w) > 4), F.concat(cut(3), F.lit("y")))
        .when(w.rlike("(sses|xes|zes|ches|shes)$"), cut(2))
        .when(w.rlike("[^suiwae]s$"), cut(1))
        .otherwise(w)
    )


def canonical_phrase(c: Column) -> Column:
    return F.array_join(F.transform(tokens_of(c), singular), " ")


def contains_word(haystack: Column, needle: str) -> Column:
    """Whether ``needle`` occurs on word boundaries of a normalized text."""
    return haystack.rlike(rf"(?<![a-z0-9])\Q{needle}\E(?![a-z0-9])")


def penalty_terms(phrase: Column, terms: Sequence[str] = PENALTIES) -> Column:
    norm = normalize_phrase(phrase)
    return F.array_compact(F.array(*[F.when(contains_word(norm, t), F.lit(t)) for t in terms]))


def has_marker(text: Column, markers: Sequence[str]) -> Column:
    """Whether any marker is a substring of the lower-cased text; NULL counts as no text."""
    return F.coalesce(F.lower(text).rlike("|".join(rf"\Q{m}\E" for m in markers)), F.lit(False))


def markers_in(text: Column, markers: Sequence[str]) -> Column:
    """How many different markers occur in the lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(m)).cast("int") for m in markers), F.lit(0))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def content_hash(parts: Column) -> Column:
    """SHA-256 over the parts, each with one kind of line end, trimmed and followed by NUL."""
    one = lambda p: F.concat(F.regexp_replace(F.regexp_replace(p, "\r\n|\r", "\n"), r"(?U)^\s+|\s+$", ""), F.lit("\x00"))
    return F.sha2(F.array_join(F.transform(parts, one), ""), 256)


def engagement(metric: Column, value: Column, metadata: Column) -> Column:
    """A signal's talk: its value if the metric counts as talk, plus the talk counts of its metadata that are numbers."""
    keys = list(ENGAGEMENT_KEYS)
    counts = F.map_values(F.map_filter(metadata, lambda k, _: F.lower(k).isin(keys)))
    zero = F.lit(0.0)
    extra = F.aggregate(counts, zero, lambda a, v: a + F.greatest(F.coalesce(v.try_cast("double"), zero), zero))
    return F.when(F.lower(metric).isin(keys), F.coalesce(value, zero)).otherwise(zero) + F.coalesce(extra, zero)


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))


def host_allowed(url: Column, domains: Column) -> Column:
    """Whether the host of ``url`` is one of the domains, or lies below a domain written as '*.suffix'."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    fits = lambda d: F.when(d.startswith("*."), host.endswith(F.substring(d, F.lit(2), F.length(d)))).otherwise(host == d)
    return F.coalesce(F.exists(domains, lambda d: fits(F.lower(d))), F.lit(False))


def record_field(record: Column, name: str) -> Column:
    """A text field of an answer written as JSON, or as 'name: value | name: value'; NULL where it isn't there."""
    as_json = F.when(F.ltrim(record).startswith("{"), F.get_json_object(record, f"$.{name}"))
    plain = F.regexp_extract(record, rf"(?is)(?:^|\|)\s*{name}\s*[:=]\s*(.*?)\s*(?:\||$)", 1)
    return F.coalesce(as_json, F.when(~F.ltrim(record).startswith("{") & (plain != ""), plain))


def revenue_seed(entity: Column, category: Column, version: str) -> Column:
    """32-bit seed: the first eight hex digits of the SHA-256 of 'entity|category|version'."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", entity, category, F.lit(version)), 256), 1, 8), 16, 10).cast("bigint")
