"""Five source shapes become records of one schema."""

import json

from veridex.sources.adapters import ADAPTERS, api_records, service_records


def one(df, key, *columns):
    rows = {r[key]: tuple(r[c] for c in columns) for r in df.collect()}
    assert len(rows) == df.count()
    return rows


def test_flat_rows(spark):
    meta = json.dumps({"candidate_service_host": "h.io", "candidate_api_method": "get", "candidate_required_parameters_json": '[{"name":"q"}]'})
    home = json.dumps({"candidate_service_host": " ", "candidate_service_home_url": "home"})
    rows = [("Maps", "short", "/find", "d", meta), ("maps", "a longer text", "/find", "dd", meta), ("Maps", None, "list", None, "not json"), (None, "x", "y", "z", None), ("Other", "o", None, None, home)]
    raw = spark.createDataFrame(rows, "candidate_service_name string, candidate_service_description string, candidate_api_name string, candidate_api_description string, metadata_json string")
    got = one(service_records(raw, ADAPTERS["flat"]), "identity", "name", "description", "provider", "host", "basis")
    assert got == {'["h.io","maps"]': ("Maps", "a longer text", "RapidAPI", "h.io", "host_plus_source_name"), "maps": ("Maps", "", "", "", "normalized_source_name"), '["home","other"]': ("Other", "o", "RapidAPI", "home", "host_plus_source_name")}
    apis = api_records(raw, ADAPTERS["flat"])
    assert one(apis, "name", "endpoint", "operation", "method", "description", "parameters") == {"/find": ("/find", "", "GET", "dd", '{"optional":[],"required":[{"name":"q"}]}'), "list": ("", "list", "", "", '{"optional":[],"required":[]}')}
    known = {r.service_id for r in service_records(raw, ADAPTERS["flat"]).collect()}
    assert all(r.service_id in known and r.api_id.startswith(f"api::{r.service_id}::") for r in apis.collect())


def test_plain_and_listed_rows(spark):
    plain = spark.createDataFrame([("S1", "One", "d"), ("S1", "One", "dd"), ("", "Two", None), ("S3", " ", "x")], "service_id string, service_name string, service_description string")
    assert one(service_records(plain, ADAPTERS["plain"]), "identity", "name", "description") == {"s1": ("One", "dd"), "two": ("Two", "")}
    services, apis = json.dumps(["Weather", {"tool_name": "News"}, {"x": 1}, None, 7]), json.dumps([{"service_name": "Maps", "api_name": "/route", "method": "post"}, {"name": "News", "api_name": "top"}, "text", {"api_name": "lost"}])
    listed = spark.createDataFrame([(services, apis), (services, None), ("[broken", '{"no": "list"}')], "candidate_services_json string, candidate_apis_json string")
    assert set(one(service_records(listed, ADAPTERS["listed"]), "identity", "name")) == {"weather", "news", "maps", "text"}
    assert one(api_records(listed, ADAPTERS["listed"]), "name", "endpoint", "operation", "method") == {"/route": ("/route", "", "POST"), "top": ("", "top", "")}


def test_keyed_and_bundled_rows(spark):
    lists = [json.dumps([{"service_key": "K1", "service_name": "Maps", "service_description": "m"}]), json.dumps([{"service_key": "K2"}]), json.dumps([{"service_key": "K1", "service_name": "Maps", "function_key": "f1", "function_name": "route", "url": "/r"}]), None]
    keyed = spark.createDataFrame([tuple(lists)], "candidate_services_json string, provisional_gold_services_json string, candidate_apis_json string, provisional_gold_apis_json string")
    assert one(service_records(keyed, ADAPTERS["keyed"]), "identity", "name", "description", "provider") == {"static::k1": ("Maps", "m", "RapidAPI"), "static::k2": ("K2", "", "RapidAPI")}
    assert one(api_records(keyed, ADAPTERS["keyed"]), "name", "endpoint", "operation") == {"route": ("/r", "route")}
    apps = spark.createDataFrame([("com.x", "Notes", "n", json.dumps([{"APIName": "com.x.Open"}, {"APIName": ""}])), ("com.y", None, None, None)], "AppName string, display_name string, display_description string, APIs string")
    assert one(service_records(apps, ADAPTERS["bundles"]), "identity", "name", "provider") == {"com.x": ("Notes", "com.x"), "com.y": ("com.y", "com.y")}
    assert one(api_records(apps, ADAPTERS["bundles"]), "name", "method") == {"com.x.Open": ("INTENT",)}
    assert service_records(apps.limit(0), ADAPTERS["bundles"]).count() == 0
