import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assaylake.functions import deepjson
from assaylake.operators import shredding
from assaylake.operators.shredding import packet_nodes, parsed

SCHEMA = "packet_id long, packet_json string, node string, label string"  # with columns that clash by name


def packets(spark, *texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)


def found(spark, *texts):
    return sorted(tuple(r) for r in shredding.content_nodes(shredding.packet_nodes(packets(spark, *texts))).select("packet_id", "event_no", "trace_id", "source_type", "node_path", "node_kind").collect())


def test_traces_as_list_lone_event_old_key_and_null(spark):
    event = {"trace_id": "t", "source_type": "user", "content": {"a/b": [1, {"~": None}], "s": "x", "t": True}}
    nodes = [("/a~1b", "array"), ("/a~1b/0", "number"), ("/a~1b/1", "object"), ("/a~1b/1/~0", "null"), ("/s", "string"), ("/t", "boolean")]
    texts = [
        json.dumps({"authenticated_upstream_trace": [{}, event]}),
        json.dumps({"authenticated_upstream_trace": event}, indent=2),
        json.dumps({"upstream_trace": [event], "authenticated_upstream_trace": None}),
        json.dumps({"authenticated_upstream_trace": None}), None, "", "{", "[]", '{"authenticated_upstream_trace": [{"content": NaN}]}',
    ]
    want = [(0, 1), (1, 0), (2, 0)]
    assert found(spark, *texts) == sorted((p, e, "t", "user", path, kind) for p, e in want for path, kind in nodes)


def test_string_contents_are_decoded_and_attributes_default_to_blank(spark):
    trace = [{"content": '{"k": [0]}'}, {"trace_id": None, "source_type": None, "content": "no json"}, {"content": '"scalar"'}, {"content": None}, "odd", {"content": [[]]}]
    assert found(spark, json.dumps({"authenticated_upstream_trace": trace})) == [(0, 0, "", "", "/k", "array"), (0, 0, "", "", "/k/0", "number"), (0, 5, "", "", "/0", "array")]


def test_entities_pivot_scalars_of_objects(spark):
    text = json.dumps({"task_id": "t", "domain": None, "boundary": {"boundary_id": "b", "trace_cut": 4, "more": {"x": 1}}})
    row = shredding.packet_table(packets(spark, text, "{")).collect()
    assert [tuple(r) for r in row] == [(0, "t", None, "b", None, None, "4")]


def test_very_long_deep_and_empty_input(spark):
    deep = '{"authenticated_upstream_trace":{"content":' + "[" * 400 + "]" * 400 + "}}"
    long = json.dumps({"authenticated_upstream_trace": {"content": {"x": "y" * 1_000_000, "l": list(range(20_000))}}})
    counts = {r.packet_id: r["count"] for r in shredding.content_nodes(shredding.packet_nodes(packets(spark, deep, long, "[" * 200_000))).groupBy("packet_id").count().collect()}
    assert counts == {0: 399, 1: 20_002}
    none = spark.createDataFrame([], SCHEMA)
    assert shredding.content_nodes(shredding.packet_nodes(none)).count() == 0
    assert shredding.packet_table(none).count() == 0


JSON = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab/~\"\\é", max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab/~", max_size=3), x, max_size=3), max_leaves=12)


def rebuilt(rows):
    kids = {}
    for r in rows:
        kids.setdefault(r.parent, []).append(r)

    def build(r):
        below = sorted(kids.get(r.node, []), key=lambda x: x.ordinal)
        if r.kind == "object":
            return {x.label: build(x) for x in below}
        if r.kind == "array":
            return [build(x) for x in below]
        return {"null": lambda: None, "string": lambda: r.scalar}.get(r.kind, lambda: json.loads(r.scalar))()

    return build(kids[None][0])


@settings(max_examples=1, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(JSON, min_size=60, max_size=60))
def test_shredding_is_a_round_trip(spark, values):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "id long, j string")
    by = {}
    for r in shredding.shred(df, "id", "j").collect():
        by.setdefault(r.id, []).append(r)
    assert [rebuilt(by[i]) for i in range(len(values))] == values


def test_repeated_packets_are_each_shredded(spark):
    text = json.dumps({"authenticated_upstream_trace": {"content": {"a": 1}}})
    df = packets(spark, text, text)
    assert shredding.content_nodes(shredding.packet_nodes(df)).groupBy("node_path").agg(F.count("*").alias("n")).first().n == 2


def test_conditions_paths_and_deep_search(spark):
    from assaylake.operators import predicates

    atoms = spark.createDataFrame([("t", "a", "known", "true"), ("t", "b", "unknown", "null"), ("t", "c", "known", '"x=y"')], "task_id string, key string, status string, value_json string")
    rows = ["a=known", "!a=known", "a=True", "b=None", "b=unknown", "c=x=y", "!c=z", "d=known", "a"]
    df = spark.createDataFrame([("t", r) for r in rows], "task_id string, condition string")
    got = {r.condition: r.verdict for r in predicates.evaluated(df, atoms, ["task_id"], "condition").collect()}
    assert got == {"a=known": "satisfied", "!a=known": "contradicted", "a=True": "satisfied", "b=None": "satisfied", "b=unknown": "satisfied", "c=x=y": "satisfied", "!c=z": "satisfied", "d=known": "missing", "a": "contradicted"}
    docs = spark.createDataFrame([(1, '{"a": {"b": null}}'), (2, '{"a": {}}'), (3, "{"), (4, None), (5, '{"a": {"b": "v"}, "v": 1}')], "id long, j string")
    exists, value = predicates.at_path(F.col("j"), "a", "b")
    assert [tuple(r) for r in docs.select(exists, value).collect()] == [(True, "null"), (False, None), (False, None), (False, None), (True, "v")]
    nodes = shredding.shred(docs, "id", "j")
    assert [(r.id, r.n_hits) for r in predicates.containing(nodes, ["id"], "v", labels=True).collect()] == [(5, 2)]


@pytest.mark.parametrize("depth", [100, 100_000])
def test_documents_of_any_depth(depth):
    text = '{"a": [' * (depth // 2) + '{"b": 1.5, "a": ["x", null, {}, []]}' + "]}" * (depth // 2)
    valid, value = parsed(text)
    assert valid and deepjson.strings_in(value) == ["x"]
    assert deepjson.canonical(value) == text.replace(" ", "").replace('"b":1.5,"a":["x",null,{},[]]', '"a":["x",null,{},[]],"b":1.5')
    assert not parsed(text[:-1])[0] and not parsed(text + "]")[0]


def test_deep_packets_keep_all_nodes(spark):
    depth = 20_000
    text = '{"upstream_trace": {"trace_id": "t", "content": ' + "[" * depth + "7" + "]" * depth + "}}"
    nodes = packet_nodes(spark.createDataFrame([(1, text), (2, "[" * depth)], "packet_id long, packet_json string")).filter("node_path is not null")
    got = nodes.selectExpr("count(*) n", "max(length(node_path)) longest", "count(distinct packet_id) p").first()
    assert (got.n, got.longest, got.p) == (depth, 2 * depth, 1)


@pytest.mark.parametrize("text", ["1", "-0.5e3", '"a\\u00e9"', "true", "[]", "{}", '{"a":{"b":[1,2,{"c":null}]},"a":3}', "[1,]", "{1:2}", "nul", "NaN", "[1 2]", '{"a" 1}', "01", "", "[", '"a'])
def test_the_loop_parses_as_the_standard_parser_does(text):
    try:
        want = json.loads(text, parse_constant=lambda _: 1 / 0)
    except (ValueError, ZeroDivisionError):
        with pytest.raises(ValueError):
            assert deepjson.deep_value(text)[1] == len(text) or deepjson.loads("]")
    else:
        assert deepjson.deep_value(text) == (want, len(text)) and "".join(deepjson._pieces(want)) == deepjson.canonical(want)
