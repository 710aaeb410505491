"""The registry of sources and the recorded responses that stand in for them."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Request parameters that only say where to go on.
CURSOR_PARAMS = ("after", "before", "cursor", "since_id", "min_id", "max_id")


def violations(sources: DataFrame) -> DataFrame:
    """(id, rule) of each broken rule: id shape, positive budget and rate, layers present and unique, domains bare, tier A never in L0, unique ids."""
    c = F.col
    rules = {
        "id is not snake case": ~c("id").rlike("^[a-z][a-z0-9_]*$"),
        "budget is not positive": c("budget_per_day") <= 0,
        "rate is not positive": c("rps") <= 0,
        "layers are missing or repeated": (F.size("layers") == 0) | (F.size(F.array_distinct("layers")) < F.size("layers")),
        "domains are missing or not bare hosts": (F.size("domains") == 0) | F.exists("domains", lambda d: ~d.rlike(r"^(\*\.)?[a-z0-9.-]+$")),
        "tier A collects in L0": (c("tier") == "A") & F.array_contains("layers", "L0"),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(True)), F.lit(name)) for name, r in rules.items()]))
    twice = sources.groupBy("id").count().where("count > 1").select("id", F.lit("id is not unique").alias("rule"))
    return sources.select("id", F.explode(broken).alias("rule")).unionByName(twice)


def for_layer(sources: DataFrame, layer: str) -> DataFrame:
    """Enabled sources of a layer in the registry's order."""
    return sources.where(F.col("enabled") & F.array_contains("layers", layer)).orderBy("ord")


def summary(sources: DataFrame) -> DataFrame:
    """Per tier: sources, enabled ones, and the daily budget of these."""
    return sources.groupBy("tier").agg(F.count("*").alias("n"), F.count_if("enabled").alias("n_enabled"), F.coalesce(F.sum(F.when(F.col("enabled"), F.col("budget_per_day"))), F.lit(0)).alias("budget"))


def allowed_domains(sources: DataFrame) -> DataFrame:
    return sources.where("enabled").select("id", F.explode("domains").alias("domain")).distinct()


def quota(spent: Column, budget: Column) -> tuple[Column, Column]:
    """What remains of a budget, and the burnt share in percent."""
    return F.greatest(budget - spent, F.lit(0)), F.when(budget > 0, F.lit(100.0) * spent / budget).otherwise(F.lit(0.0))


def canonical_url(url: str, cursors: bool = True) -> str:
    """The URL with its parameters sorted; without ``cursors`` those that only say where to go on are dropped."""
    s = urlsplit(url)
    q = sorted((k, v) for k, v in parse_qsl(s.query, keep_blank_values=True) if cursors or k not in CURSOR_PARAMS)
    return urlunsplit((s.scheme, s.netloc.lower(), s.path, urlencode(q), ""))


class Recorded:
    """Recorded responses by canonical URL; a request that isn't there gets the response with the newest cursor."""

    def __init__(self, responses: Mapping[str, Mapping]):
        self.exact = {canonical_url(u): r for u, r in responses.items()}
        self.loose: dict[str, tuple[str, Mapping]] = {}
        for u, r in responses.items():
            key, cursor = canonical_url(u, False), max((v for k, v in parse_qsl(urlsplit(u).query) if k in CURSOR_PARAMS), default="")
            if key not in self.loose or cursor >= self.loose[key][0]:
                self.loose[key] = (cursor, r)

    @classmethod
    def read(cls, path: str) -> Recorded:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f)["responses"])

    def get(self, url: str) -> Mapping | None:
        hit = self.exact.get(canonical_url(url))
        return hit if hit is not None else self.loose.get(canonical_url(url, False), ("", None))[1]


def merged_settings(*layers: Mapping) -> dict:
    """Settings of several layers, later ones winning key by key."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged_settings(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), dict) else v
    return out


def days_to_fetch(watermark: Column, today: Column, most: int = 3) -> Column:
    """The complete days after the watermark, at most ``most``; without a watermark yesterday alone."""
    first, last = F.coalesce(F.date_add(watermark, 1), F.date_sub(today, 1)), F.date_sub(today, 1)
    return F.when(first <= last, F.slice(F.sequence(first, last), 1, most)).otherwise(F.array().cast("array<date>"))


def requests(spark: SparkSession, source: str, terms: Sequence[str], template: str) -> DataFrame:
    """The fixed request list of a source: one row per term."""
    rows = [(source, i, t, template.format(t)) for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, "source_id string, ord int, term string, url string")
