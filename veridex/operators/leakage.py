"""Leakage of answer names into query texts, with offsets, strength and rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.functions.text import SPACES, nfkc, normalize_ascii, normalize_text
from veridex.plans.scratch import Scratch

# Surfaces that are ordinary words and need a person's judgement.
GENERIC = (
    "calculator", "command", "discount", "generate", "go", "hashtags", "id", "languages", "local", "me",
    "peers", "review", "revise", "translate", "translation", "trending", "view", "weather",
)


def is_generic(surface: Column) -> Column:
    return normalize_ascii(surface).isin(*GENERIC)


def surface_pattern(surface: Column) -> Column:
    """A pattern for the surface: any white space between its words, word boundaries only at alphanumeric ends."""
    words = F.split(normalize_ascii(surface, lower=False), " ")
    quoted = F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"([\\^$.|?*+()\[\]{}])", r"\\$1")), r"\s+")
    head = F.when(surface.rlike(r"^\s*[\p{L}\p{N}]"), r"(?<![\p{L}\p{N}_])").otherwise("")
    tail = F.when(surface.rlike(r"[\p{L}\p{N}]\s*$"), r"(?![\p{L}\p{N}_])").otherwise("")
    return F.concat(F.lit("(?iu)"), head, quoted, tail)


def surface_hits(rows: DataFrame, row_id: str, text: str, surfaces: str) -> DataFrame:
    """(row_id, surface, matched, start_offset, end_offset, generic) of every occurrence of a row's own surfaces in its text.

    Text and surfaces are compared in NFKC, so composed and decomposed letters and
    ligatures are one; offsets and what matched are those of the normalised text.
    The text between occurrences and the occurrences themselves add up to the
    offsets, so an equal string that is no occurrence of its own is passed over.
    """
    texts = rows.select(row_id, nfkc(F.col(text)).alias("t"), surfaces)
    each = texts.select(row_id, "t", F.explode(F.array_distinct(surfaces)).alias("surface")).where(F.length(F.trim("surface")) > 0).withColumn("s", nfkc(F.col("surface")))
    pattern = surface_pattern(F.col("s"))
    found = each.select(row_id, "surface", F.regexp_extract_all("t", pattern, F.lit(0)).alias("hits"), F.transform(F.split("t", pattern, -1), F.length).alias("between")).where("size(hits) > 0")
    at = found.select(row_id, "surface", "hits", "between", F.posexplode("hits").alias("k", "matched"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    start = total(F.slice("between", F.lit(1), F.col("k") + 1)) + total(F.transform(F.slice("hits", F.lit(1), F.col("k")), F.length))
    return at.select(row_id, "surface", "matched", start.alias("start_offset"), (start + F.length("matched")).alias("end_offset"), is_generic(F.col("surface")).alias("generic"))


def target_hits(tasks: DataFrame, services: DataFrame, apis: DataFrame) -> DataFrame:
    """Distinct hits of a task's gold names in its query, by what the task asks for.

    tasks: task_id, query, target (service or api), gold_services, gold_apis,
    paired_apis (gold APIs of the paired task); services: service_id, name; apis:
    api_id, surfaces (array). A service task also reports surfaces of the paired
    task's APIs, as clues. Returns task_id, target_id, level, matched offsets,
    generic, and blocking (not generic).
    """
    side = lambda column, level, when: tasks.where(when).select("task_id", "query", F.explode(F.array_distinct(column)).alias("target_id"), F.lit(level).alias("level"))
    is_service = F.col("target") == "service"
    asked = side("gold_services", "service", is_service).join(services.select(F.col("service_id").alias("target_id"), F.array("name").alias("surfaces")), "target_id")
    clues = side("paired_apis", "api_clue_in_service_task", is_service).unionByName(side("gold_apis", "api", ~is_service)).join(apis.select(F.col("api_id").alias("target_id"), "surfaces"), "target_id")
    rows = asked.unionByName(clues).withColumn("key", F.struct("task_id", "target_id", "level"))
    found = surface_hits(rows, "key", "query", "surfaces")
    out = found.select("key.*", normalize_ascii(F.col("surface")).alias("surface"), "start_offset", "end_offset", "generic")
    return out.distinct().withColumn("blocking", ~F.col("generic"))


def leak_strength(query: Column, name: Column, dialect: str = "any_long_name") -> Column:
    """none, weak or strong. any_long_name: any non-generic name of 4 letters is strong; multi_word: only names of several words."""
    q, n = normalize_ascii(query), normalize_ascii(name)
    strong = F.length(n) >= 4 if dialect == "any_long_name" else n.contains(" ")
    return F.when((n == "") | ~q.contains(n), "none").when(~is_generic(name) & strong, "strong").otherwise("weak")


def remove_names(query: Column, names: Column) -> Column:
    """The query without connector and name, longest names first, white space tidied."""
    ordered = F.array_sort(F.filter(names, lambda n: F.length(F.trim(n)) > 0), lambda a, b: F.length(b) - F.length(a))
    quoted = lambda n: F.regexp_replace(n, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    tail = lambda n: F.when(n.rlike(r"[\p{L}\p{N}_]$"), r"(?![\p{L}\p{N}_])").otherwise("")  # noqa: E731  a name that ends in a sign ends there
    pattern = lambda n: F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}_])(?:(?:using|use|via|with|on|from|through)\s+)?(?:the\s+)?"), quoted(n), tail(n))
    bare = F.aggregate(ordered, query, lambda q, n: F.regexp_replace(q, pattern(n), F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, SPACES, " "), r" ([,.!?;:])", "$1"))


# Words that carry no meaning of a query.
MEANINGLESS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "could", "for", "from", "give", "help", "i", "in", "is", "it", "me", "my", "of", "on",
    "please", "provide", "the", "to", "use", "using", "via", "want", "with", "would", "you", "api", "service", "tool", "endpoint", "call",
)


def meaning_tokens(query: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(*MEANINGLESS) & (F.length(w) > 1))))


def verified_rewrite(query: Column, service_names: Column, api_names: Column) -> tuple[Column, Column]:
    """The query without its gold names where that is safe, and a status.

    Names go longest first, a service's only after using, with, via or from, an
    API's only after use, call or using the. Statuses in order:
    REWRITE_NOT_APPLICABLE (no name there, or one that stands elsewhere),
    REWRITE_UNSAFE_MEANING_LOSS (too little or other words lost),
    REWRITE_UNSAFE_GRAMMAR (a connector or conjunction is left alone),
    REWRITE_STILL_LEAKING, REWRITE_VALID.
    """
    quoted = lambda n: F.regexp_replace(F.regexp_replace(F.trim(n), r"([\\^$.|?*+()\[\]{}])", r"\\$1"), r"\s+", r"\\s+")
    edge = lambda x: F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), x, F.lit(r"(?:\s+(?:api|tool|service|endpoint))?(?![A-Za-z0-9])"))
    service = lambda n: edge(F.concat(F.lit(r"(?:using|with|via|from)\s+(?:the\s+)?"), quoted(n)))
    api = lambda n: edge(F.concat(F.lit(r"(?:(?:use|call)\s+(?:the\s+)?"), quoted(n), F.lit(r"|using\s+the\s+"), quoted(n), F.lit(")")))
    there = lambda q, n: F.rlike(q, F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), quoted(n), F.lit("(?![A-Za-z0-9])")))
    item = lambda level, pattern: lambda n: F.struct((-F.length(n)).alias("size"), F.lit(level).alias("level"), F.lower(n).alias("key"), n.alias("name"), pattern(n).alias("pattern"))
    leaking = lambda names: F.filter(names, lambda n: (F.length(F.trim(n)) > 0) & there(query, n))
    names = F.array_sort(F.concat(F.transform(leaking(service_names), item("service", service)), F.transform(leaking(api_names), item("api", api))))
    bare = F.aggregate(names, query, lambda q, x: F.regexp_replace(q, x["pattern"], F.lit("")))
    flat = F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"\s+([,.;:!?])", "$1")
    flat = F.regexp_replace(F.regexp_replace(flat, r"([,;:])\1+", "$1"), r"(?i)\b(?:and|also)\s*([?.!,])", "$1")
    clean = F.regexp_replace(F.regexp_replace(flat, r"([.!?])\s*([.!?])+", "$1"), r"^[ ,;:]+|[ ,;:]+$", "")
    gone = F.flatten(F.transform(names, lambda x: F.regexp_extract_all(F.lower(x["name"]), F.lit("[a-z0-9]+"), F.lit(0))))
    lost = F.array_except(F.array_except(meaning_tokens(query), gone), meaning_tokens(clean))
    alone = clean.rlike(r"(?i)\b(?:using|with|via|from|use|call)\s+(?:the\s*)?(?:[,.!?]|$)|\b(?:and|also)\s+(?:and|also)\b")
    stays = F.exists(names, lambda x: ~F.rlike(query, x["pattern"]))
    status = (
        F.when((F.size(names) == 0) | stays, "REWRITE_NOT_APPLICABLE").when((F.size(meaning_tokens(clean)) < 2) | (F.size(lost) > 0), "REWRITE_UNSAFE_MEANING_LOSS")
        .when(alone, "REWRITE_UNSAFE_GRAMMAR").when(F.exists(names, lambda x: there(clean, x["name"])), "REWRITE_STILL_LEAKING").otherwise("REWRITE_VALID")
    )
    return F.when(F.size(names) == 0, query).otherwise(clean), status


def containment(items: DataFrame, documents: DataFrame, words: int = 5) -> DataFrame:
    """(item_id, doc_id) where the document holds the item's whole normalised text.

    Pairs meet on the item's first words, so no document is compared with items that it shares nothing with.
    items: item_id, text; documents: doc_id, text.
    """
    parts = lambda c: F.split(normalize_ascii(F.col(c)), " ")
    i = items.select("item_id", normalize_ascii(F.col("text")).alias("item"), parts("text").alias("w")).where("item != ''")
    i = i.select("item_id", "item", F.least(F.size("w"), F.lit(words)).alias("n"), F.xxhash64(F.slice("w", 1, words)).alias("key"))
    sizes = [r[0] for r in i.select("n").distinct().orderBy("n").collect()] or [words]
    d = documents.select("doc_id", normalize_ascii(F.col("text")).alias("t"), parts("text").alias("w"))
    grams = F.flatten(F.array(*(F.transform(F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>")), lambda p: F.xxhash64(F.slice("w", p, F.lit(n)))) for n in sizes)))  # noqa: B023
    hits = d.select("doc_id", F.explode(F.array_distinct(grams)).alias("key")).join(i, "key").select("doc_id", "item_id", "item").distinct()
    whole = hits.join(d.select("doc_id", "t"), "doc_id")
    return whole.where(F.concat(F.lit(" "), "t", F.lit(" ")).contains(F.concat(F.lit(" "), "item", F.lit(" ")))).select("item_id", "doc_id").distinct()


# Names that are common words of such queries.
COMMON_TERMS = (
    "all", "api", "count", "current", "find", "get", "image", "latest", "list", "map", "news", "review", "route", "search", "track", "tracking",
    "translate", "translation", "weather",
)
#: Prefixes of names (8 bytes each) that are sent to every task; beyond, steps down the trie shuffle.
BROADCAST_PREFIXES = 2_000_000


def phrase_tokens(c: Column) -> Column:
    """The words of a phrase: runs of a-z and 0-9 of the case-folded NFKC text."""
    return F.filter(F.split(normalize_text(c), "[^a-z0-9]+"), lambda w: w != "")


def _step(node: Column, token: Column) -> Column:
    return F.xxhash64(node, token)


def phrase_hits(queries: DataFrame, names: DataFrame, longest: int | None = None) -> DataFrame:
    """(query_id, name_id, start, n_tokens): every place where a name's words stand in a query one after the other.

    queries: query_id, text; names: name_id, name. All names form a trie of token
    prefixes. Every token position of a query starts at its root and goes down as
    long as its next token has an edge, so what is read grows with the positions
    and the depth that they reach, never with queries x names; a level is a join,
    written before the next. Hashes only lead down the trie: words are compared at
    its end. Names without words match nothing, nulls are empty, repeated rows
    give a hit once for each different query_id and name_id.
    """
    scratch = Scratch(queries.sparkSession, "phrases")
    known = scratch.keep(names.select("name_id", phrase_tokens(F.col("name")).alias("words")).where("size(words) > 0").distinct())
    walk = F.aggregate("words", F.array(F.lit(0).cast("long")), lambda path, w: F.array_append(path, _step(F.element_at(path, -1), w)))
    paths = known.select("name_id", "words", walk.alias("path"))
    prefixes = scratch.keep(paths.select(F.explode(F.slice("path", F.lit(2), F.size("path") - 1)).alias("node")).distinct())
    if prefixes.count() <= BROADCAST_PREFIXES:
        prefixes = F.broadcast(prefixes)
    ends = paths.select("name_id", "words", F.element_at("path", -1).alias("node"))
    texts = scratch.keep(queries.select("query_id", phrase_tokens(F.col("text")).alias("q")).where("size(q) > 0").distinct())
    depth_of = known.agg(F.max(F.size("words")).alias("m")).first()["m"] or 0
    at = texts.select("query_id", F.posexplode("q").alias("start", "token"), "q").select("query_id", "start", F.slice("q", F.col("start") + 1, F.lit(depth_of)).alias("ahead") if depth_of else "q", F.lit(0).cast("long").alias("node"))
    found = None
    for depth in range(1, min(depth_of, longest or depth_of) + 1):
        step = at.where(F.size("ahead") >= depth).select("query_id", "start", "ahead", _step(F.col("node"), F.get("ahead", F.lit(depth - 1))).alias("node"))
        at = scratch.keep(step.join(prefixes, "node"))
        if not at.limit(1).count():
            break
        here = at.join(ends.where(F.size("words") == depth), "node").where(F.slice("ahead", F.lit(1), F.lit(depth)) == F.col("words")).select("query_id", "name_id", "start", F.lit(depth).alias("n_tokens"))
        found = here if found is None else found.unionByName(here)
    if found is None:
        found = texts.limit(0).select("query_id").crossJoin(known.limit(0).select("name_id")).select("query_id", "name_id", F.lit(0).alias("start"), F.lit(0).alias("n_tokens"))
    return found.distinct()


def phrase_leaks(queries: DataFrame, names: DataFrame, gold: DataFrame | None = None, common: tuple[str, ...] = COMMON_TERMS, common_share: float | None = None, least: int = 3) -> DataFrame:
    """query_id, status and the numbers of telling and common names of every query that a name of the catalog leaks into, or no_obvious_leak.

    A name that is one of the common words (given, or found in `common_share` of
    all queries and more) is a common_word_overlap; any other of `least`
    characters and more an exact_unique_name_leak, which decides. gold: (query_id,
    name_id) pairs to look at; without it every name of the catalog counts.
    """
    words = phrase_tokens(F.col("name"))
    listed = names.select("name_id", F.array_join(words, " ").alias("phrase"), F.size(words).alias("k")).distinct()
    often = F.col("phrase").isin(*common) if common else F.lit(False)
    if common_share is not None:
        all_ids = queries.select("query_id").distinct().count()
        in_queries = queries.select("query_id", F.explode(F.array_distinct(phrase_tokens(F.col("text")))).alias("phrase")).distinct().groupBy("phrase").agg(F.count("*").alias("df"))
        listed = listed.join(in_queries.where(F.col("df") >= common_share * all_ids), "phrase", "left")
        often = often | ((F.col("k") == 1) & F.col("df").isNotNull())
    listed = listed.select("name_id", "phrase", often.alias("common"))
    hits = phrase_hits(queries, names).select("query_id", "name_id").distinct()
    if gold is not None:
        hits = hits.join(gold.select("query_id", "name_id").distinct(), ["query_id", "name_id"])
    counted = hits.join(listed, "name_id").groupBy("query_id").agg(F.count_if(~F.col("common") & (F.length("phrase") >= least)).alias("telling"), F.count_if(F.col("common")).alias("common"))
    n = lambda k: F.coalesce(F.col(k), F.lit(0))
    status = F.when(n("telling") > 0, "exact_unique_name_leak").when(n("common") > 0, "common_word_overlap").otherwise("no_obvious_leak")
    return queries.select("query_id").distinct().join(counted, "query_id", "left").select("query_id", status.alias("status"), n("telling").alias("telling"), n("common").alias("common"))
