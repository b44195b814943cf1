"""Source adapters: service and API records of one schema from raw tables of several shapes, each shape a table of field paths.

A path is a column (`name`), a place in a JSON column (`column:$.a.b`), a place in
an element of an exploded JSON list (`$.a.b`, `$` for a plain string), or a fixed
text (`=text`). Of several paths the first that isn't blank counts. JSON is read
once into VARIANT values; what isn't JSON has no fields.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.functions.text import api_id, normalize_text, present, service_id

Paths = tuple[str, ...]


@dataclass(frozen=True)
class Adapter:
    """Where a source keeps its fields.

    lists: JSON list columns whose elements are records; without, a row is one.
    fields: paths by field (services: name, description, provider, host, key;
    APIs: name, description, endpoint, method, operation, parameters, key).
    identity: how a service is told apart: `name`, `key` (key, else name), or
    `host_name` (host and name where there is a host). Names and keys in
    identities are normalised.
    """

    source: str
    services: dict[str, Paths]
    service_lists: Paths = ()
    identity: str = "name"
    prefix: str = ""
    apis: dict[str, Paths] = field(default_factory=dict)
    api_lists: Paths = ()
    parent: dict[str, Paths] = field(default_factory=dict)


_NAMES = ("$.service_name", "$.tool_name", "$.name", "$")
ADAPTERS = {
    "flat": Adapter(
        "ToolBench", {"name": ("candidate_service_name",), "description": ("candidate_service_description",), "host": ("metadata_json:$.candidate_service_host", "metadata_json:$.candidate_service_home_url")}, identity="host_name",
        apis={"name": ("candidate_api_name",), "description": ("candidate_api_description",), "method": ("metadata_json:$.candidate_api_method",), "required": ("metadata_json:$.candidate_required_parameters_json",), "optional": ("metadata_json:$.candidate_optional_parameters_json",)},
    ),
    "plain": Adapter("MetaTool", {"key": ("service_id",), "name": ("service_name",), "description": ("service_description",)}, identity="key"),
    "listed": Adapter(
        "StableToolBench", {"name": _NAMES}, ("candidate_services_json",), apis={"name": ("$.api_name", "$.name"), "description": ("$.api_description",), "method": ("$.method",)}, api_lists=("candidate_apis_json",), parent={"name": _NAMES},
    ),
    "keyed": Adapter(
        "ToolBench", {"name": ("$.service_name", "$.service_key"), "key": ("$.service_key", "$.service_name"), "description": ("$.service_description",), "provider": ("=RapidAPI",)}, ("candidate_services_json", "provisional_gold_services_json"), "key", "static::",
        apis={"name": ("$.api_name", "$.function_name", "$.function_key"), "key": ("$.function_key", "$.function_name", "$.api_name"), "description": ("$.api_description",), "method": ("$.method",), "endpoint": ("$.url",), "operation": ("$.function_name",)},
        api_lists=("candidate_apis_json", "provisional_gold_apis_json"), parent={"name": ("$.service_name", "$.service_key"), "key": ("$.service_key", "$.service_name")},
    ),
    "bundles": Adapter(
        "ShortcutsBench", {"key": ("AppName",), "name": ("display_name", "AppName"), "description": ("display_description",), "provider": ("AppName",)}, identity="key",
        apis={"name": ("$.APIName",), "method": ("=INTENT",)}, api_lists=("APIs",), parent={"name": ("display_name", "AppName"), "key": ("AppName",)},
    ),
}


def _records(raw: DataFrame, lists: Paths) -> DataFrame:
    """The rows, or the elements of their JSON lists as the VARIANT `_e` beside the row."""
    if not lists:
        return raw.withColumn("_e", F.lit(None).cast("variant"))
    each = F.concat(*(F.coalesce(F.try_variant_get(F.try_parse_json(c), "$", "array<variant>"), F.array().cast("array<variant>")) for c in lists))
    return raw.withColumn("_e", F.explode(each))


def _value(path: str) -> Column:
    if path.startswith("="):
        return F.lit(path[1:])
    if path == "$":
        return F.when(F.schema_of_variant("_e") == "STRING", F.try_variant_get("_e", "$", "string"))
    if path.startswith("$"):
        return F.try_variant_get("_e", path, "string")
    if ":" in path:
        column, inner = path.split(":", 1)
        return F.try_variant_get(F.try_parse_json(column), inner, "string")
    return F.col(path).cast("string")


def _first(fields: dict[str, Paths], name: str) -> Column:
    return F.coalesce(*(present(_value(p)) for p in fields.get(name, ())), F.lit("")) if fields.get(name) else F.lit("")


def _identified(rows: DataFrame, adapter: Adapter) -> DataFrame:
    """Adds _identity and _basis from the columns _name, _key and _host; records without a name go."""
    named = rows.withColumns({"_n": normalize_text(F.col("_name")), "_k": normalize_text(F.col("_key"))})
    if adapter.identity == "host_name":
        quoted = lambda c: F.regexp_replace(c, r'(["\\])', r"\\$1")
        both = F.concat(F.lit('["'), quoted(F.col("_host")), F.lit('","'), quoted(F.col("_n")), F.lit('"]'))
        identity, basis = F.when(F.col("_host") != "", both).otherwise(F.col("_n")), F.when(F.col("_host") != "", "host_plus_source_name").otherwise("normalized_source_name")
    elif adapter.identity == "key":
        identity, basis = F.coalesce(F.nullif("_k", F.lit("")), F.col("_n")), F.when(F.col("_k") != "", "source_key").otherwise("normalized_source_name")
    else:
        identity, basis = F.col("_n"), F.lit("normalized_source_name")
    return named.withColumns({"_identity": F.concat(F.lit(adapter.prefix), identity), "_basis": basis}).where("_name != '' and _n != ''")


def service_records(raw: DataFrame, adapter: Adapter) -> DataFrame:
    """service_id, source, identity, basis, name, description, provider, host of every service of the raw rows, one each.

    Of several records with one id the longest description and the least name and
    provider count; a host stands for a marketplace provider. Parents that only
    APIs name are services as well. Rows without a name give none; nulls are blank.
    """
    rows = _records(raw, adapter.service_lists).select(*(_first(adapter.services, k).alias(f"_{k}") for k in ("name", "key", "description", "provider", "host")))
    if adapter.parent:
        more = _records(raw, adapter.api_lists).select(*(_first(adapter.parent, k).alias(f"_{k}") for k in ("name", "key")), F.lit("").alias("_description"), _first(adapter.services, "provider").alias("_provider"), F.lit("").alias("_host"))
        rows = rows.unionByName(more)
    found = _identified(rows, adapter).withColumn("_provider", F.when((F.col("_host") != "") & (F.col("_provider") == ""), "RapidAPI").otherwise(F.col("_provider")))
    longest = F.max_by("_description", F.struct(F.length("_description"), "_description"))
    return found.groupBy(service_id(F.lit(adapter.source), F.col("_identity")).alias("service_id")).agg(
        F.lit(adapter.source).alias("source"), F.min("_identity").alias("identity"), F.min("_basis").alias("basis"), F.min("_name").alias("name"), longest.alias("description"), F.max("_provider").alias("provider"), F.max("_host").alias("host")
    )


def api_records(raw: DataFrame, adapter: Adapter) -> DataFrame:
    """api_id, service_id, source, name, description, endpoint, method, operation, parameters of every API, one each.

    A name (or url) that begins with / is an endpoint, any other name an operation.
    parameters is JSON with the required and optional lists where the source has
    them. APIs without a name or parent give none.
    """
    parent = adapter.parent or adapter.services
    rows = _records(raw, adapter.api_lists).select(
        *(_first(parent, k).alias(f"_{k}") for k in ("name", "key", "host")), *(_first(adapter.apis, k).alias(f"_api_{k}") for k in ("name", "key", "description", "endpoint", "method", "operation", "required", "optional")),
    )
    name = F.col("_api_name")
    path = F.coalesce(*(F.when(F.startswith(c, F.lit("/")), c) for c in (name, F.col("_api_endpoint"))), F.lit(""))
    operation = F.coalesce(F.nullif("_api_operation", F.lit("")), F.when(~F.startswith(name, F.lit("/")), name), F.lit(""))
    lists = [F.coalesce(F.nullif(f"_api_{k}", F.lit("")), F.lit("[]")) for k in ("required", "optional")]
    parameters = F.concat(F.lit('{"optional":'), lists[1], F.lit(',"required":'), lists[0], F.lit("}")) if "required" in adapter.apis else F.lit("{}")
    found = _identified(rows, adapter).where("_api_name != ''")
    own = service_id(F.lit(adapter.source), F.col("_identity"))
    found = found.select(own.alias("service_id"), api_id(own, F.coalesce(F.nullif("_api_key", F.lit("")), name)).alias("api_id"), name.alias("name"), F.col("_api_description").alias("description"), path.alias("endpoint"), F.upper("_api_method").alias("method"), operation.alias("operation"), parameters.alias("parameters"))
    rest = [c for c in found.columns if c not in ("service_id", "api_id", "description")]
    return found.groupBy("api_id", "service_id").agg(F.max_by("description", F.struct(F.length("description"), "description")).alias("description"), *(F.min(c).alias(c) for c in rest)).withColumn("source", F.lit(adapter.source))
