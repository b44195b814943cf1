"""Names in queries: the trie against nested search, NFKC surfaces, removed names, and payloads of any depth."""

import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from veridex.operators import leakage as L
from veridex.operators import traces as X


def phrase(text):
    return re.sub(r"[^a-z0-9]+", " ", unicodedata.normalize("NFKC", text or "").casefold()).strip()


@pytest.mark.parametrize("seed", range(3))
def test_phrase_hits_equal_nested_search(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(L, "BROADCAST_PREFIXES", 0)
    rng = random.Random(seed)
    words = ["get", "Weather", "api", "naïve", "C++", "x1", "of", "the", "ﬁle", "-"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    queries = [(i, text(25)) for i in range(80)] + [(90, None), (91, ""), (3, "get the api"), (92, "the " * 400)]
    names = [(i, text(5)) for i in range(60)] + [(70, None), (71, "the the the"), (72, "get the"), (72, "get the")]
    rows = L.phrase_hits(spark.createDataFrame(queries, "query_id int, text string"), spark.createDataFrame(names, "name_id int, name string")).collect()
    want = set()
    for q, t in queries:
        for n, name in names:
            have, look = phrase(t).split(), phrase(name).split()
            want |= {(q, n, k, len(look)) for k in range(len(have)) if look and have[k : k + len(look)] == look}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_phrase_leaks_by_gold_and_common_words(spark):
    queries = spark.createDataFrame([(1, "ask Weather for rain"), (2, "use the Big Map now"), (3, "the api"), (4, "go ai"), (5, None)], "query_id int, text string")
    names = spark.createDataFrame([(1, "weather"), (2, "big map"), (3, "API"), (4, "ai"), (5, "rain")], "name_id int, name string")
    gold = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4)], "query_id int, name_id int")
    assert {r.query_id: r.status for r in L.phrase_leaks(queries, names, gold).collect()} == {1: "common_word_overlap", 2: "exact_unique_name_leak", 3: "common_word_overlap", 4: "no_obvious_leak", 5: "no_obvious_leak"}
    assert {r.query_id: r.status for r in L.phrase_leaks(queries, names).collect()}[1] == "exact_unique_name_leak"
    assert {r.query_id: r.status for r in L.phrase_leaks(queries, names, common=(), common_share=0.2).collect()}[1] == "common_word_overlap"
    assert L.phrase_leaks(queries, names.limit(0)).where("status = 'no_obvious_leak'").count() == 5


def test_surfaces_in_normal_form(spark):
    rows = spark.createDataFrame([(1, "a Café here", ["Café"]), (2, "the ﬁle api", ["file api"]), (3, "Cafés café", ["Café"]), (4, None, ["x"]), (5, "ＡＢＣ x", ["abc"])], "id int, t string, s array<string>")
    got = sorted((r.id, r.matched, r.start_offset, r.end_offset) for r in L.surface_hits(rows, "id", "t", "s").collect())
    assert got == [(1, "Café", 2, 6), (2, "file api", 4, 12), (3, "café", 6, 10), (5, "ABC", 0, 3)]


def test_removed_names_end_in_signs(spark):
    rows = [("use C++ now please", ["C++"], "now please"), ("ask with the Map api", ["Map"], "ask api"), ("Mapping stays", ["Map"], "Mapping stays"), ("via .NET!", [".NET"], "!"), ("C++11 x", ["C++"], "11 x"), ("a_Map b", ["Map"], "a_Map b")]
    df = spark.createDataFrame([(q, n) for q, n, _ in rows], "q string, n array<string>")
    assert [r[0] for r in df.select(L.remove_names(F.col("q"), F.col("n"))).collect()] == [w for _, _, w in rows]


def test_payloads_of_any_depth(spark):
    deep = "7"
    for k in range(300):
        deep = f'{{"k{k}": {deep}}}' if k % 2 else f"[{deep}]"
    inner = json.dumps({"a": json.dumps({"b": [1, "x", None]})})
    rows = {(r.id, r.path): (r.key, r.value, r.kind) for r in X.flatten(spark.createDataFrame([(1, deep), (2, inner), (3, "plain"), (4, None), (5, "[" * 200_000 + "]" * 200_000)], "id int, d string"), "id", "d").collect()}
    first = [v for (i, _), v in rows.items() if i == 1]
    assert first == [("k1", "7", "number")]
    assert {p: v for (i, p), v in rows.items() if i == 2} == {"$.a.decoded.b[0]": ("b", "1", "number"), "$.a.decoded.b[1]": ("b", "x", "string"), "$.a.decoded.b[2]": ("b", None, "null")}
    assert rows[3, "$"] == ("", "plain", "string") and rows[5, "$"][2] == "string" and not any(i == 4 for i, _ in rows)
