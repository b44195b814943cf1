"""Scalar text functions: normalisation, tokens, identifiers, signatures, lenient JSON."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

SPACES = r"[ \t\n\x0B\f\r]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\x0B\f\r]"
# Words that carry no topic.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "for", "from", "get", "give", "help", "i", "in", "is", "it", "list", "me",
    "my", "need", "of", "on", "or", "please", "provide", "search", "some", "suggest", "the", "to", "tool", "use", "using", "want", "with",
)


def text_or_empty(c: Column) -> Column:
    """Missing is the empty string; surrounding white space never counts."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def present(c: Column) -> Column:
    """Null for null, empty and blank strings."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def normalize_ascii(c: Column, lower: bool = True) -> Column:
    """Collapse white space, trim and lower-case: equals normalize_text on ASCII, inside whole-stage code."""
    flat = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACES, " "))
    return F.lower(flat) if lower else flat


def _normalized(values: pd.Series, fold: bool) -> pd.Series:
    def one(v: str | None) -> str:
        flat = " ".join(unicodedata.normalize("NFKC", v or "").split())
        return flat.casefold() if fold else flat

    return values.map(one)


def normalize_text(c: Column, casefold: bool = True) -> Column:
    """NFKC, white space collapsed, optionally case-folded; ASCII rows skip Python by normalize_ascii."""
    ascii_only = F.octet_length(F.coalesce(c, F.lit(""))) == F.length(F.coalesce(c, F.lit("")))

    def exact(values: pd.Series) -> pd.Series:
        return _normalized(values, casefold)

    udf = pandas_udf(exact, "string")
    return F.when(ascii_only, normalize_ascii(c, casefold)).otherwise(udf(F.when(ascii_only, F.lit("")).otherwise(c)))


def nfkc(c: Column) -> Column:
    """NFKC and nothing else; ASCII rows skip Python."""

    @pandas_udf("string")
    def exact(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    ascii_only = F.octet_length(c) == F.length(c)
    return F.when(ascii_only, c).otherwise(exact(F.when(~ascii_only, c)))


def tokens(c: Column) -> Column:
    """Words and single punctuation marks of the lower-cased text, repeats kept."""
    return F.regexp_extract_all(normalize_ascii(c), F.lit(TOKEN), F.lit(0))


def content_tokens(c: Column) -> Column:
    """Distinct ASCII words of three letters and more without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z][a-z0-9]{2,}"), F.lit(0))
    return F.array_sort(F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOPWORDS))))


def stable_hash(*parts: Column, length: int = 24) -> Column:
    """SHA-256 of a compact JSON array of strings, its first `length` hex digits."""
    return F.substring(F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))), 256), 1, length)


def array_hash(values: Column, length: int = 24) -> Column:
    return F.substring(F.sha2(F.to_json(values), 256), 1, length)


def safe_component(c: Column) -> Column:
    """A lower-case slug of at most 80 characters."""
    slug = F.regexp_replace(normalize_ascii(c), "[^a-z0-9._-]+", "-")
    return F.substring(F.regexp_replace(slug, "^-+|-+$", ""), 1, 80)


def service_id(namespace: Column, identity: Column) -> Column:
    """svc::namespace::identity; an empty or long slug gives way to a hash of the raw identity."""
    slug = safe_component(identity)
    raw = F.substring(F.sha2(F.concat(F.lit('"'), identity.cast("string"), F.lit('"')), 256), 1, 24)
    return F.concat_ws("::", F.lit("svc"), safe_component(namespace), F.when((slug == "") | (F.length(slug) > 64), raw).otherwise(slug))


def api_id(parent: Column, identity: Column) -> Column:
    raw = F.substring(F.sha2(F.concat(F.lit('"'), identity.cast("string"), F.lit('"')), 256), 1, 24)
    return F.concat_ws("::", F.lit("api"), parent, raw)


def signature(*parts: Column) -> Column:
    """SHA-1 of the normalised parts, one a line."""
    return F.sha1(F.concat_ws("\n", *(normalize_ascii(p) for p in parts)))


def candidate_bucket(n: Column) -> Column:
    """Upper bounds 5, 20, 50 and 100; fewer than two candidates also fall in the first bucket."""
    return F.when(n <= 5, "2-5").when(n <= 20, "6-20").when(n <= 50, "21-50").when(n <= 100, "51-100").otherwise("101+")


def to_int(c: Column) -> Column:
    """A whole number, 0 for anything else."""
    v = F.trim(c.cast("string"))
    return F.when(v.rlike(r"^[+-]?\d{1,18}$"), v).otherwise("0").cast("bigint")


def truthy(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin("1", "true", "yes", "y", "t")


def json_strings(c: Column) -> Column:
    """A JSON list of strings; null and blank give an empty list, other text a list of itself."""
    parsed = F.from_json(c, "array<string>")
    return F.when(present(c).isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(parsed, F.array(c)))


def json_string_lists(c: Column) -> Column:
    """A JSON list of lists; a flat list is one alternative, empty alternatives are dropped."""
    nested = F.from_json(c, "array<array<string>>")
    flat = F.from_json(c, "array<string>")
    return F.filter(F.coalesce(nested, F.when(flat.isNotNull(), F.array(flat)), F.array().cast("array<array<string>>")), lambda a: F.size(a) > 0)


def json_kind(c: Column) -> Column:
    """empty, json, integer, number or string; JSON is tried first, so a bare integer is json."""
    v = present(c)
    return (
        F.when(v.isNull(), "empty").when(F.try_parse_json(v).isNotNull(), "json").when(v.rlike(r"^[+-]?\d+$"), "integer").when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "number").otherwise("string")
    )


def document_text(*parts: Column) -> Column:
    return F.trim(F.concat_ws(" ", *(text_or_empty(p) for p in parts)))


def is_endpoint_like(c: Column) -> Column:
    """camelCase, snake_case or path-like names."""
    return F.coalesce(c.rlike(r"^[a-z]+[A-Z]|[a-z0-9]_[a-z0-9]|/"), F.lit(False))


def redact(c: Column) -> Column:
    """Keys, bearer tokens and home paths masked."""
    out = F.regexp_replace(c, r"(?i)(bearer\s+)[A-Za-z0-9._-]+", "$1[REDACTED]")
    out = F.regexp_replace(out, r"(?i)((?:api[_-]?key|token|secret|password)[\"']?\s*[:=]\s*[\"']?)[^\"'\s,;]+", "$1[REDACTED]")
    return F.regexp_replace(out, r"(/home/|/Users/)[^/\s]+", "$1[USER]")


def is_iso_timestamp(c: Column) -> Column:
    v = F.regexp_replace(F.trim(c), "Z$", "+00:00")
    return v.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?([+-]\d{2}:\d{2})?)?$") & F.try_to_timestamp(v).isNotNull()


def percent(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, "n/a").otherwise(F.format_string("%.2f%%", 100.0 * numerator / denominator))


def char_ngrams(c: Column) -> Column:
    """Every 2-, 3- and 4-gram of the normalised text padded by two blanks on each side."""
    padded = F.concat(F.lit("  "), normalize_ascii(c), F.lit("  "))
    of_size = lambda p, n: F.transform(F.sequence(F.lit(1), F.length(p) - (n - 1)), lambda i: F.substring(p, i, F.lit(n)))
    return F.flatten(F.transform(F.array(padded), lambda p: F.flatten(F.array(*(of_size(p, n) for n in (2, 3, 4))))))


def gram_bucket(gram: Column, bits: int = 11) -> Column:
    """The low bits of the first 8 bytes of the gram's SHA-256."""
    return F.conv(F.substring(F.sha2(gram, 256), 14, 3), 16, 10).cast("int").bitwiseAND(F.lit((1 << bits) - 1))


def task_id(c: Column) -> Column:
    """A task id without its source prefix, folded."""
    return F.regexp_replace(normalize_text(c), r"^(?:toolbench|stabletoolbench)[_:\-]+", "")


def names_of(c: Column, keys: list[str]) -> Column:
    """Names in a JSON list of objects (the first key that isn't empty) or of strings; one object or string counts as a list of one."""
    items = F.coalesce(F.from_json(c, "array<string>"), F.when(present(c).isNotNull(), F.array(c)), F.array().cast("array<string>"))
    first = lambda x: F.coalesce(*(F.nullif(F.get_json_object(x, f"$.{k}"), F.lit("")) for k in keys))
    return F.filter(F.transform(items, lambda x: F.when(F.trim(x).startswith("{"), first(x)).otherwise(F.nullif(x, F.lit("")))), lambda x: x.isNotNull())


def repacked(c: Column, fields: dict[str, list[str]]) -> Column:
    """A JSON list of objects in unified fields: each the first of its source keys that isn't empty, else the empty string; plain strings fill the first field ending in _name."""
    items = F.coalesce(F.from_json(c, "array<string>"), F.when(present(c).isNotNull(), F.array(c)), F.array().cast("array<string>"))
    named = next(k for k in fields if k.endswith("_name"))
    take = lambda x, ks: F.coalesce(*(F.nullif(F.get_json_object(x, f"$.{k}"), F.lit("")) for k in ks), F.lit(""))
    whole = lambda x: F.struct(*(F.when(F.trim(x).startswith("{"), take(x, ks)).otherwise(x if k == named else F.lit("")).alias(k) for k, ks in fields.items()))
    return F.transform(F.filter(items, lambda x: x.isNotNull() & (x != "")), whole)


def unified_task_type(source: Column) -> Column:
    """The task type that a source's name for it stands for; the first that fits counts."""
    s = F.lower(F.coalesce(source, F.lit("")))
    return (
        F.when(s.contains("composable") | s.contains("g3"), "composable_service_discovery").when(s.contains("multi_api"), "multi_api_recommendation").when(s.contains("multi") | s.contains("g2"), "multi_service_discovery")
        .when(s.contains("api"), "single_api_recommendation").when(s.contains("single") | s.contains("g1") | s.contains("external"), "single_service_discovery").otherwise("unknown")
    )


# The pool that each policy decision leads to, and the release status and pool of each.
POOLS = {
    "source_specific_keep_candidate": "keep_candidate", "source_specific_keep_candidate_as_is": "keep_candidate_as_is", "source_specific_uncertain": "uncertain", "source_specific_remove": "remove",
    "rewrite_pool_only": "rewrite_pool", "leakage_rewrite_pool": "rewrite_pool", "candidate_space_reconstruction_pool": "reconstruction_pool", "composable_dependency_review_pool": "composable_review_pool",
    "source_check_only": "source_check_only", "still_clean_candidate": "keep_candidate", "downgrade_to_uncertain": "uncertain", "dryrun_remove": "remove",
}
RELEASE = {
    "keep_candidate": "main_candidate_pool", "keep_candidate_as_is": "main_candidate_pool", "rewrite_pool": "rewrite_candidate_pool", "reconstruction_pool": "reconstruction_candidate_pool",
    "composable_review_pool": "composable_dependency_review_pool", "remove": "excluded_pool", "source_check_only": "future_source_check_pool",
}


def _looked_up(c: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.coalesce(c, F.lit(""))), F.lit(default))


def policy_pool(decision: Column) -> Column:
    return _looked_up(decision, POOLS, "unknown")


def release_pool(pool: Column) -> Column:
    return _looked_up(pool, RELEASE, "not_applicable")
