"""Layered settings per repository: defaults, then global, then the repository's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline import fixed_values as fv
from driftline.functions.joins import measured

_LAYERS = "map<string,struct<value:string,layer:string>>"


def _is_object(text: Column) -> Column:
    """True for a well-formed JSON object."""
    return F.coalesce(
        F.startswith(F.schema_of_variant(F.try_parse_json(text)), F.lit("OBJECT")), F.lit(False)
    )


def _layer(text: Column, name: str) -> Column:
    """Key -> (value, layer) of a settings text; empty when missing or malformed."""
    parsed = F.when(_is_object(text), F.from_json(text, "map<string,string>"))
    tagged = F.transform_values(
        parsed, lambda k, v: F.struct(v.alias("value"), F.lit(name).alias("layer"))
    )
    return F.coalesce(tagged, F.create_map().cast(_LAYERS))


def _over(base: Column, top: Column) -> Column:
    """Shallow merge: keys of ``top`` replace those of ``base``."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(top, k)), top)


def _defaults() -> Column:
    values = (fv.DEFAULT_MAX_MINUTES, fv.DEFAULT_MAX_LINES)
    entry = lambda v: F.struct(
        F.lit(str(v)).alias("value"), F.lit("default").alias("layer")
    )
    pairs = [c for k, v in zip(fv.CONFIG_KEYS, values) for c in (F.lit(k), entry(v))]
    return F.create_map(*pairs).cast(_LAYERS)


def effective_config(
    repos: DataFrame, repo_files: DataFrame, global_text: str | None = None
) -> DataFrame:
    """Long form (repo, key, value, layer): where every setting comes from.

    ``repo_files`` has repo and content, at most one row per repository.
    """
    merged = repos.join(measured(repo_files), "repo", "left").withColumn(
        "settings", _over(_defaults(), _layer(F.lit(global_text), "global"))
    )
    merged = merged.withColumn("settings", _over(F.col("settings"), _layer(F.col("content"), "repo")))
    return merged.select("repo", F.explode("settings").alias("key", "v")).select(
        "repo", "key", "v.value", "v.layer"
    )


def thresholds(config: DataFrame) -> DataFrame:
    """One row per repository with both thresholds as numbers."""
    value = lambda key: F.max(
        F.when(F.col("key") == key, F.col("value").try_cast("double"))
    ).alias(key)
    return config.groupBy("repo").agg(*[value(k) for k in fv.CONFIG_KEYS])


def config_warnings(repo_files: DataFrame, global_text: str | None = None) -> DataFrame:
    """One row per settings text that could not be read and is ignored."""
    broken = repo_files.filter(F.col("content").isNotNull() & ~_is_object(F.col("content")))
    warnings = broken.select(
        "repo", F.format_string("Repo config malformed (%s)", F.col("repo").cast("string")).alias("warning")
    )
    if global_text is None:
        return warnings
    everywhere = repo_files.filter(~_is_object(F.lit(global_text)))
    return warnings.unionByName(
        everywhere.select("repo", F.lit("Global config malformed").alias("warning"))
    )


def config_updates(requests: DataFrame, current: DataFrame, request: str = "request") -> DataFrame:
    """Check requested changes and merge the acceptable ones.

    Unknown keys are left out; a request without a known key, or with a value
    that is not a positive whole number, changes nothing. ``current`` has the
    thresholds per repository.
    """
    parsed = F.try_parse_json(F.col(request))
    named = F.filter(
        F.json_object_keys(F.col(request)), lambda k: k.isin(fv.CONFIG_KEYS)
    )

    def number(key: str) -> Column:
        found = F.try_variant_get(parsed, f"$.{key}", "variant")
        whole = F.schema_of_variant(found) == "BIGINT"
        return F.when(whole, F.try_variant_get(parsed, f"$.{key}", "bigint"))

    rows = requests.withColumns({"named": named, **{f"new_{k}": number(k) for k in fv.CONFIG_KEYS}})
    good = F.create_map(
        *[c for k in fv.CONFIG_KEYS for c in (F.lit(k), F.coalesce(F.col(f"new_{k}") > 0, F.lit(False)))]
    )
    rows = rows.withColumn("good", good).withColumn(
        "bad", F.get(F.filter("named", lambda k: ~F.col("good")[k]), F.lit(0))
    )
    error = F.when(F.coalesce(F.size("named"), F.lit(0)) <= 0, fv.CONFIG_NO_KEYS).when(
        F.col("bad").isNotNull(), F.format_string(fv.CONFIG_BAD_VALUE, "bad")
    )
    rows = rows.withColumn("error", error).join(measured(current), "repo", "left")
    accepted = F.col("error").isNull()
    merged = [
        F.when(accepted, F.coalesce(F.col(f"new_{k}").cast("double"), F.col(k))).otherwise(F.col(k)).alias(k)
        for k in fv.CONFIG_KEYS
    ]
    message = F.when(accepted, F.format_string(fv.CONFIG_UPDATED, F.size("named")))
    return rows.select(
        "repo", accepted.alias("success"), "error", message.alias("message"), *merged
    )
