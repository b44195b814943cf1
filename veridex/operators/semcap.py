"""Whether gold capabilities answer what a query asks for: phrase tables over one automaton, rules as data.

All phrases of a table form one automaton, which reads every text once in Arrow
batches and tells which phrases it holds; rules are set operations on these
numbers, so their cost doesn't grow with the phrases. Tables: requirements (what
a query asks for when it holds a trigger, what covers it, what speaks against
it) and reasons (phrases that texts need and lack).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.functions.text import normalize_ascii


@cache
def _automaton(phrases: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for k, p in enumerate(phrases):
        made.add_word(p, k)
    made.make_automaton()
    return made


def phrases_in(text: Column, phrases: tuple[str, ...]) -> Column:
    """The numbers of the phrases that a text holds anywhere, ascending; null and empty texts hold none."""

    @F.pandas_udf("array<int>")
    def found(texts: pd.Series) -> pd.Series:
        made = _automaton(phrases)
        return texts.map(lambda t: sorted({k for _, k in made.iter(t)}) if t else [])

    return found(text) if phrases else F.array().cast("array<int>")


@dataclass(frozen=True)
class Requirement:
    """What a query asks for if it holds a trigger; covered by a positive phrase, unless a negative one stands there (no positives: always)."""

    label: str
    triggers: tuple[str, ...]
    positive: tuple[str, ...]
    negative: tuple[str, ...] = ()


@dataclass(frozen=True)
class Reason:
    """Given where every list of `need` has a phrase in its text and no list of `lack` has."""

    kind: str
    name: str
    need: tuple[tuple[str, tuple[str, ...]], ...]
    lack: tuple[tuple[str, tuple[str, ...]], ...] = ()


#: What is asked for where no trigger stands.
GENERAL = "general_information"


def requirement_table(rows: list[tuple]) -> tuple[Requirement, ...]:
    """Requirements from (label, triggers, positive[, negative]) rows, such as a released table has them."""
    return tuple(Requirement(r[0], tuple(r[1]), tuple(r[2]), tuple(r[3]) if len(r) > 3 else ()) for r in rows)


class _Texts:
    """Texts whose phrases are looked up once, by column."""

    def __init__(self, rows: DataFrame, texts: dict[str, Column], requirements: tuple[Requirement, ...], reasons: tuple[Reason, ...], collapse: bool):
        fold = normalize_ascii if collapse else F.lower
        listed = [w for r in requirements for group in (r.triggers, r.positive, r.negative) for w in group] + [w for r in reasons for side in (r.need, r.lack) for _, words in side for w in words]
        self.number = {p: k for k, p in enumerate(sorted(set(listed)))}
        self.rows = rows.withColumns({f"_found_{k}": phrases_in(fold(c), tuple(self.number)) for k, c in texts.items()})

    def has(self, text: str, words: tuple[str, ...]) -> Column:
        return F.arrays_overlap(f"_found_{text}", F.array(*(F.lit(self.number[w]) for w in words)).cast("array<int>"))

    def reasons(self, listed: tuple[Reason, ...], kind: str) -> Column:
        out = []
        for r in (r for r in listed if r.kind == kind):
            when = F.lit(True)
            for text, words in r.need:
                when &= self.has(text, words)
            for text, words in r.lack:
                when &= ~self.has(text, words)
            out.append(F.when(when, F.lit(r.name)))
        return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def _asked(texts: _Texts, requirements: tuple[Requirement, ...]) -> dict[str, Column]:
    """asked, covered and missing labels of a row, sorted."""
    asked = F.array_compact(F.array(*(F.when(texts.has("query", r.triggers), F.lit(r.label)) for r in requirements)))
    asked = F.when(F.size(asked) == 0, F.array(F.lit(GENERAL))).otherwise(F.array_sort(asked))

    def held(r: Requirement) -> Column:
        yes = texts.has("coverage", r.positive) if r.positive else F.lit(True)
        return yes & ~texts.has("coverage", r.negative) if r.negative else yes

    covers = F.array_compact(F.array(F.lit(GENERAL), *(F.when(held(r), F.lit(r.label)) for r in requirements)))
    return {"requirements": asked, "covered": F.array_intersect(asked, covers), "missing": F.array_except(asked, covers)}


def semcap(rows: DataFrame, requirements: tuple[Requirement, ...] | None = None, reasons: tuple[Reason, ...] | None = None, collapse: bool = False) -> DataFrame:
    """Adds requirements, covered, missing, mismatch, uncertain, ok (arrays), semantic, coverage_pred, their confidences and types, needs_review.

    Columns read: query; gold (names and descriptions of the gold services and
    apis) and coverage_text (the same and the gold among the candidates, gold where
    the column is missing). A reason of mismatch decides; then missing
    requirements without a reason for ok, then reasons for doubt. Where every
    requirement is covered that is a reason for ok, where some are one for doubt.
    Texts are compared in lower case, with white space as it stands unless
    `collapse` makes it single spaces, as later releases do.
    Defined results: null texts are empty; a query that asks for nothing known
    asks for general information, which anything covers; repeated rows give one
    row each; other columns stay.
    """
    requirements, reasons = REQUIREMENTS if requirements is None else requirements, REASONS if reasons is None else reasons
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    coverage = text("coverage_text") if "coverage_text" in rows.columns else text("gold")
    texts = _Texts(rows, {"query": text("query"), "gold": text("gold"), "coverage": coverage}, requirements, reasons, collapse)
    out = texts.rows.withColumns(_asked(texts, requirements)).withColumns({k: texts.reasons(reasons, k) for k in ("mismatch", "uncertain", "ok")})
    whole = (F.size("missing") == 0) & (F.col("requirements") != F.array(F.lit(GENERAL)))
    out = out.withColumns({
        "ok": F.when(whole, F.array_append("ok", F.lit("all_detected_requirements_covered"))).otherwise(F.col("ok")),
        "uncertain": F.when(~whole & (F.size("covered") > 0), F.array_append("uncertain", F.lit("partial_requirement_coverage"))).otherwise(F.col("uncertain")),
    })
    some = lambda k: F.size(k) > 0
    state = F.when(some("mismatch"), "mismatch").when(some("missing") & ~some("ok"), "missing").when(some("uncertain") & ~some("ok"), "unclear").when(some("uncertain"), "partly").otherwise("ok")
    first = lambda k: F.coalesce(F.get(k, F.lit(0)), F.lit(""))
    pick = lambda **of: F.coalesce(*(F.when(F.col("_state") == k, v if isinstance(v, Column) else F.lit(v)) for k, v in of.items()))
    sure = F.when(some("ok"), F.lit("high")).otherwise("medium")
    out = out.withColumn("_state", state).withColumns({
        "semantic": pick(mismatch="mismatch", missing="uncertain", unclear="uncertain", partly="ok", ok="ok"),
        "semantic_confidence": pick(mismatch="high", missing="medium", unclear="medium", partly="medium", ok=sure),
        "coverage_pred": pick(mismatch="coverage_mismatch", missing="coverage_uncertain", unclear="coverage_uncertain", partly="coverage_uncertain", ok="coverage_ok"),
        "coverage_confidence": pick(mismatch="high", missing="medium", unclear="medium", partly="medium", ok=sure),
        "semantic_type": pick(mismatch=first("mismatch"), missing="partial_or_unclear_domain_match", unclear="unclear_scope", partly="", ok=""),
        "coverage_type": pick(mismatch=first("mismatch"), missing="partial_or_unclear_coverage", unclear=first("uncertain"), partly=first("uncertain"), ok=""),
    })
    review = (F.col("coverage_pred") != "coverage_ok") | (F.col("semantic") != "ok") | (F.col("coverage_confidence") != "high")
    return out.withColumn("needs_review", review).drop("_state", "_found_query", "_found_gold", "_found_coverage")


# Requirements of the first release, in its order.
REQUIREMENTS = requirement_table([
    ("traffic_route", ["traffic", "route", "directions", "driving time"], ["traffic", "route"]),
    ("weather", ["weather", "forecast", "temperature", "rain", "snow"], ["weather", "forecast"]),
    ("hotel_venue_event", ["hotel", "venue", "concert", "event planner", "event planning", "attraction", "zoo"], ["hotel", "venue", "event", "popular times", "busy and popular"]),
    ("restaurant_place_reviews", ["restaurant", "review", "gas station", "place", "popular times", "walmart"], ["restaurant", "place", "review", "popular times", "busy and popular"]),
    ("social_profile", ["linkedin", "profile", "company data"], ["linkedin", "company data", "profile"]),
    ("company_list", ["company", "companies", "courier", "shipping company", "carrier list"], ["company", "companies", "courier", "shipping"]),
    ("company_images_or_extra_data", ["image", "images", "photo", "logo", "additional data", "extra data"], ["image", "images", "logo", "additional"]),
    ("package_tracking", ["package", "parcel", "mail", "postal", "tracking number", "track my", "shipment"], ["package", "parcel", "mail", "postal", "tracking", "track"]),
    ("container_tracking", ["container", "bill of lading", "vessel"], ["container", "bill of lading", "vessel"]),
    ("postal_code", ["postal code", "zip code", "postcode"], ["postal", "zip", "postcode"]),
    ("customs_transitaire", ["customs", "transitaire", "freight forwarder", "gondrand", "new caledonia"], ["transitaire", "customs", "freight"]),
    ("news_search", ["news", "article", "headline"], ["news", "currents", "article", "headline"]),
    ("image_search", ["image search", "find images", "search images", "retrieve images"], ["image", "images", "imagesearch"]),
    ("web_search", ["web search", "search the web", "find websites", "web page"], ["web", "search", "websearch"]),
    ("fake_user", ["fake user", "random user", "gender"], ["fake", "user", "gender"]),
    ("trustpilot_review", ["trustpilot", "review", "star", "business unit"], ["trustpilot", "review", "star"]),
    ("squake_project_health", ["squake", "checkhealth", "projects", "api health"], ["squake", "project", "checkhealth", "health"]),
    ("translation_generation", ["translate", "translation", "ascii art", "hashtag", "generate"], ["translate", "translation", "ascii", "hashtag", "generate"]),
    ("geocode", ["latitude", "longitude", "geocode", "coordinates"], ["latitude", "longitude", "geocode", "coordinates"]),
    ("country_facts", ["population", "country name", "facts", "capital", "languages"], ["population", "country", "fact", "capital", "language"]),
    ("finance_market", ["ipo", "stock", "market", "ticker", "exchange"], ["ipo", "stock", "market", "ticker", "finance"]),
    ("recipe_instruction", ["recipe", "recipes", "ingredients", "cooking instruction", "cooking instructions"], ["recipe", "ingredient", "cooking"]),
    ("whatsapp_registration_status", ["registered on whatsapp", "whatsapp for business", "business status"], ["registered", "whatsapp for business", "business status"]),
    ("bookstore_author_profile", ["bookstore", "bookstores", "author profiles", "authors", "new books"], ["bookstore", "author", "book"]),
    ("place_reviews_ratings", ["top-rated", "ratings", "pizza restaurants", "reviews and ratings"], ["rating", "ratings", "restaurant", "place review"]),
    ("transit_agency_local_scope", ["transit agencies", "transit agency"], ["transit agency", "transit agencies"]),
])

_Q, _G, _C = "query", "gold", "coverage"
_COMPANY = ("company", "companies", "courier", "shipping")
_SPECIAL = ("same-day", "same day", "custom packaging", "remote area", "remote-area", "international shipping", "images", "additional data")
_PARCEL = ("package", "parcel", "mail", "postal")
_BOX = ("container", "bill of lading", "vessel")
_GEO = ("latitude", "longitude", "coordinates", "geocode")
_COOK = ("recipe", "recipes", "ingredients", "cooking instruction", "cooking instructions")
# Reasons of the first release, in its order.
REASONS = (
    Reason("mismatch", "package_or_mail_tracking_mapped_to_container_tracking", ((_Q, _PARCEL), (_G, _BOX))),
    Reason("mismatch", "container_tracking_requirement_not_covered", ((_Q, ("container", "bill of lading")),), ((_G, _BOX),)),
    Reason("mismatch", "hotel_venue_place_requirement_not_covered", ((_Q, ("hotel", "venue", "concert", "zoo", "gas station", "restaurant")),), ((_C, ("hotel", "venue", "event", "concert", "zoo", "gas station", "restaurant", "popular times", "busy and popular", "place")),)),
    Reason("mismatch", "geocode_requirement_not_covered", ((_Q, _GEO),), ((_C, _GEO),)),
    Reason("mismatch", "traffic_requirement_not_covered", ((_Q, ("traffic",)),), ((_C, ("traffic", "route")),)),
    Reason("mismatch", "weather_requirement_not_covered", ((_Q, ("weather", "forecast")),), ((_C, ("weather", "forecast")),)),
    Reason("mismatch", "generation_or_translation_requirement_not_covered", ((_Q, ("ascii art", "hashtag", "translate", "translation")),), ((_C, ("ascii", "hashtag", "translate", "translation", "generate")),)),
    Reason("mismatch", "company_images_or_additional_data_missing", ((_Q, ("image", "images", "photo", "logo", "additional data")), (_Q, ("company", "companies"))), ((_C, ("image", "photo", "logo", "additional")),)),
    Reason("mismatch", "country_facts_not_covered_by_language_only_api", ((_Q, ("country", "population", "facts", "capital")), (_G, ("language",))), ((_G, ("population", "capital", "country facts")),)),
    Reason("mismatch", "recipe_ingredients_and_instructions_not_covered", ((_Q, _COOK),), ((_C, ("recipe", "ingredient", "cooking")),)),
    Reason("mismatch", "whatsapp_registered_check_not_in_gold_apis", ((_Q, ("registered on whatsapp",)),), ((_G, ("is registered", "registered on whatsapp")),)),
    Reason("mismatch", "whatsapp_business_account_check_not_in_gold_apis", ((_Q, ("whatsapp for business",)),), ((_G, ("is whatsapp for business", "whatsapp for business?")),)),
    Reason("mismatch", "whatsapp_registration_or_business_status_not_covered", ((_Q, ("registered on whatsapp", "whatsapp for business", "business status")),), ((_C, ("registered", "whatsapp for business", "business status")),)),
    Reason("mismatch", "bookstore_or_author_profile_requirement_not_covered", ((_Q, ("bookstore", "bookstores", "author profiles", "authors")),), ((_C, ("bookstore", "bookstores", "author", "book")),)),
    Reason("mismatch", "turkey_transit_agency_not_covered_by_new_caledonia_transitaires", ((_Q, ("turkey", "istanbul")), (_Q, ("transit agency", "transit agencies")), (_G, ("transitaire",)))),
    Reason("uncertain", "restaurant_reviews_may_be_confused_with_product_reviews", ((_Q, ("pizza", "restaurant", "restaurants")), (_Q, ("review", "reviews", "rating", "ratings", "top-rated")), (_G, ("product review", "product reviews")))),
    Reason("uncertain", "logistics_company_specialization_or_extra_data_unclear", ((_Q, _COMPANY), (_C, _COMPANY), (_Q, _SPECIAL))),
    Reason("ok", "transitaire_customs_lookup_covered", ((_Q, ("customs", "transitaire", "new caledonia", "gondrand")), (_G, ("transitaire",)))),
    Reason("ok", "squake_project_health_covered", ((_Q, ("squake", "checkhealth", "projects", "api health")), (_G, ("squake", "checkhealth", "project")))),
    Reason("ok", "fake_user_gender_covered", ((_Q, ("fake user", "random user", "gender")), (_C, ("fake", "user", "gender")))),
    Reason("ok", "trustpilot_endpoint_covered", ((_Q, ("trustpilot",)), (_C, ("trustpilot", "review", "star")))),
    Reason("ok", "news_search_covered", ((_Q, ("news", "article", "headline")), (_C, ("news", "currents", "article", "headline", "search")))),
    Reason("ok", "image_search_covered", ((_Q, ("image search", "find images", "search images", "retrieve images")), (_C, ("image", "imagesearch", "search")))),
    Reason("ok", "web_search_covered", ((_Q, ("web search", "search the web", "find websites")), (_C, ("web", "search")))),
    Reason("ok", "company_or_logistics_list_covered", ((_Q, _COMPANY), (_C, _COMPANY)), ((_Q, _SPECIAL),)),
    Reason("ok", "package_or_postal_tracking_covered", ((_Q, _PARCEL), (_C, ("package", "parcel", "postal", "tracking", "track"))), ((_G, ("container",)),)),
)
