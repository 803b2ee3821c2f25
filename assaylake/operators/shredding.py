"""Nested records as flat tables: an adjacency table of nodes, and entity tables pivoted from it.

`shred` stores every node of a JSON document with its number, its parent's number, its label (the key in an object), its
ordinal (its place among its siblings) and, for scalars, its text. `entities` joins object nodes with their scalar children
and pivots the labels into columns. Packets are documents whose events hang below a trace; `packet_nodes` numbers the events
and gives the nodes below an event's content their JSON Pointer.

Null, blank and invalid documents give no rows (NaN and Infinity are no JSON). Of a key that repeats in an object the last
value counts. Documents may be of any depth; the pointers of a deep document are as long as it is deep. Node numbers are unique
within a document.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions import deepjson
from assaylake.functions.arrow import map_rows

TRACE_KEYS = ("authenticated_upstream_trace", "upstream_trace")
NODE_COLUMNS = "node long, parent long, label string, ordinal long, kind string, scalar string"


def parsed(text: str | None) -> tuple[bool, object]:
    """(valid, value) of a JSON text."""
    if text is None or not text.strip():
        return False, None
    try:
        return True, deepjson.loads(text)
    except ValueError:
        return False, None


def kind_of(value: object) -> str:
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array"
    if isinstance(value, str):
        return "string"
    if isinstance(value, bool):
        return "boolean"
    return "null" if value is None else "number"


def scalar_of(value: object) -> str | None:
    """The text of a scalar: strings as they are, others as JSON; null for objects, arrays and null."""
    if value is None or isinstance(value, dict | list):
        return None
    return value if isinstance(value, str) else json.dumps(value)


def pointer_step(label: object) -> str:
    return "/" + str(label).replace("~", "~0").replace("/", "~1")


def walk(value: object, first: int = 0, parent: int | None = None, label: str | None = None, ordinal: int = 0, path: str = "") -> Iterator[tuple]:
    """(node, parent, label, ordinal, value, path) of a value and all below it, numbered from `first`, parents first."""
    stack, number = [(value, parent, label, ordinal, path)], first
    while stack:
        value, above, name, place, path = stack.pop()
        here, number = number, number + 1
        yield here, above, name, place, value, path
        if isinstance(value, dict):
            stack.extend((v, here, k, n, path + pointer_step(k)) for n, (k, v) in reversed(list(enumerate(value.items()))))
        elif isinstance(value, list):
            stack.extend((v, here, None, n, f"{path}/{n}") for n, v in reversed(list(enumerate(value))))


def path_weight(row: tuple) -> int:
    return len(row[-1] or "")


def shred(documents: DataFrame, key: str, document: str) -> DataFrame:
    """The adjacency table of a JSON column: key, node, parent, label, ordinal, kind, scalar, path (JSON Pointer)."""

    def make():
        def row(id_, text):
            valid, value = parsed(text)
            if valid:
                for node, parent, label, ordinal, x, path in walk(value):
                    yield id_, node, parent, label, ordinal, kind_of(x), scalar_of(x), path

        return row

    kind = dict(documents.select(key).dtypes)[key]
    return map_rows(documents, [key, document], make, f"{key} {kind}, {NODE_COLUMNS}, path string", weigh=path_weight)


def entities(nodes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, node, parent and one column per label: object nodes joined with their scalar children, pivoted.

    Objects without any such child keep a row of nulls. One pass: an object meets its children in the aggregation over the
    object's number, so nothing is joined twice.
    """
    link = lambda entity, parent, label, scalar: F.array(F.struct(entity.alias("entity"), parent.alias("parent"), label.alias("label"), scalar.alias("scalar")))
    none, nowhere = F.lit(None).cast("string"), F.lit(None).cast("long")
    owner = F.when(F.col("kind") == "object", link(F.col("node"), F.col("parent"), none, none))
    child = F.when(
        ~F.col("kind").isin("object", "array") & F.col("label").isin(*columns) & F.col("parent").isNotNull(), link(F.col("parent"), nowhere, F.col("label"), F.col("scalar"))
    )
    links = nodes.select(*keys, F.inline(F.coalesce(owner, child)))
    return (
        links.groupBy(*keys, F.col("entity").alias("node"))
        .agg(F.max("parent").alias("parent"), *[F.max(F.when(F.col("label") == c, F.col("scalar"))).alias(c) for c in columns])
    )


def packet_nodes(packets: DataFrame, key: str = "packet_id", document: str = "packet_json") -> DataFrame:
    """The adjacency table of packets' events: key, event_no, node, parent, label, ordinal, kind, scalar, node_path.

    The trace is the value of the first of TRACE_KEYS that isn't null: a list of events, or one lone event. node_path is the
    pointer from the event's content for nodes below it, and null for the event, its attributes and the content itself. A
    content that is a string is decoded first, where it is JSON.
    """

    def make():
        def row(id_, text):
            valid, packet = parsed(text)
            if not valid or not isinstance(packet, dict):
                return
            trace = next((packet[k] for k in TRACE_KEYS if packet.get(k) is not None), None)
            events = trace if isinstance(trace, list) else [] if trace is None else [trace]
            number = 0
            for event_no, event in enumerate(events):
                if not isinstance(event, dict):
                    yield id_, event_no, number, None, None, event_no, kind_of(event), scalar_of(event), None
                    number += 1
                    continue
                root = number
                yield id_, event_no, root, None, None, event_no, "object", None, None
                number += 1
                for place, (label, value) in enumerate(event.items()):
                    is_content = label == "content"
                    if is_content and isinstance(value, str):
                        decoded, inner = parsed(value)
                        value = inner if decoded else value
                    for node, parent, name, ordinal, x, path in walk(value, number, root, label, place):
                        yield id_, event_no, node, parent, name, ordinal, kind_of(x), scalar_of(x), path if is_content and path else None
                        number = node + 1

        return row

    kind = dict(packets.select(key).dtypes)[key]
    return map_rows(packets, [key, document], make, f"{key} {kind}, event_no long, {NODE_COLUMNS}, node_path string", weigh=path_weight)


EVENT_COLUMNS = ["trace_id", "source_type", "tool", "success"]


def packet_events(nodes: DataFrame, key: str = "packet_id") -> DataFrame:
    """key, event_no, node and the event's attributes as text; one row per event that is an object."""
    of_events = nodes.filter(F.col("node_path").isNull())
    return entities(of_events, [key, "event_no"], EVENT_COLUMNS).filter(F.col("parent").isNull()).drop("parent")


def content_nodes(nodes: DataFrame, key: str = "packet_id") -> DataFrame:
    """key, event_no, trace_id, source_type ('' for null or absent), node, parent, label, ordinal, node_path, node_kind, scalar."""
    events = packet_events(nodes, key).select(key, "event_no", F.coalesce("trace_id", F.lit("")).alias("trace_id"), F.coalesce("source_type", F.lit("")).alias("source_type"))
    below = nodes.filter(F.col("node_path").isNotNull()).withColumnRenamed("kind", "node_kind")
    return below.join(events, [key, "event_no"]).select(
        key, "event_no", "trace_id", "source_type", "node", "parent", "label", "ordinal", "node_path", "node_kind", "scalar"
    )


def packet_table(packets: DataFrame) -> DataFrame:
    """One row per packet with valid JSON: its own attributes and its boundary's."""
    nodes = shred(packets, "packet_id", "packet_json")
    roots = entities(nodes.filter("parent is null or parent = 0"), ["packet_id"], ["task_id", "domain"]).filter("node = 0").drop("node", "parent")
    boundary = nodes.filter("label = 'boundary' and parent = 0 and kind = 'object'").select("packet_id", "node")
    columns = ["boundary_id", "source_role", "target_role", "trace_cut"]
    below = entities(nodes, ["packet_id"], columns).join(boundary, ["packet_id", "node"]).select("packet_id", *columns)
    return roots.join(below, "packet_id", "left")
