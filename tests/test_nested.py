from pyspark.sql import Row
from pyspark.sql import types as T

from tesselade.operators.nested import links, schema_graph, shred

ITEM = T.StructType([T.StructField("criterion", T.StringType()), T.StructField("score", T.IntegerType())])
NODE = T.StructType([T.StructField("name", T.StringType()), T.StructField("nodes", T.ArrayType(T.StructType([T.StructField("name", T.StringType())])))])
SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("at", T.IntegerType()),
        T.StructField("a", T.StructType([T.StructField("items", T.ArrayType(ITEM)), T.StructField("pos", T.StringType())])),
        T.StructField("b", T.StructType([T.StructField("items", T.ArrayType(ITEM))])),
        T.StructField("nodes", T.ArrayType(NODE)),
        T.StructField("tags", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("node", T.StringType()),
    ]
)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def sample(spark):
    data = [
        (1, 1, ([("x", 1), None, (None, None)], "p"), ([("y", 2)],), [("n", [("m",), None])], {"k": 5}, "clash"),
        (1, 2, ([("x", 1), None, (None, None)], "p"), ([("y", 2)],), [("n", [("m",), None])], {"k": 5}, "clash"),
        (2, None, None, (None,), [], {}, None),
        (3, 1, (None, None), None, None, None, ""),
        (None, 1, ([("z", 9)], "q"), None, None, None, "no key"),
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_shared_recursive_and_inlined(spark):
    tables = shred(sample(spark), "id", "at", skip=("at",))
    assert set(tables) == {"record", "items", "nodes", "tags"}
    assert rows(tables["record"]) == [(1, "p", "clash"), (2, None, None), (3, None, "")]
    assert tables["record"].columns == ["id", "a_pos", "node_"]
    items = sorted((r.id, r.branch, r.pos, r.criterion, r.score) for r in tables["items"].collect())
    assert [i for i in items if i[3]] == [(1, "a.items", 0, "x", 1), (1, "b.items", 0, "y", 2)]
    assert (1, "a.items", 2, None, None) in items and len(items) == 3
    nodes = {(r.node, r.parent, r.parent_table, r.name) for r in tables["nodes"].collect()}
    assert nodes == {("nodes[0]", "", "record", "n"), ("nodes[0]/nodes.nodes[0]", "nodes[0]", "nodes", "m")}
    assert [(r.key, r.value) for r in tables["tags"].collect()] == [("k", 5)]


def test_every_child_has_its_parent(spark):
    tables = shred(sample(spark), "id", "at")
    known = {("record", r.id, "") for r in tables["record"].collect()}
    children = [(name, r) for name, df in tables.items() if name != "record" for r in df.collect()]
    known |= {(name, r.id, r.node) for name, r in children}
    assert children and all((r.parent_table, r.id, r.parent) in known for _, r in children)


def test_links(spark):
    found = links(sample(spark), "id", {"one": "a.items", "two": "b.items", "three": "nodes"}, "at")
    assert rows(found) == [(1, "one", 0), (1, "one", 2), (1, "three", 0), (1, "two", 0)]


def test_empty_and_plain(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert all(df.count() == 0 for df in shred(empty, "id").values())
    only_key = spark.createDataFrame([Row(id=1), Row(id=1)])
    assert rows(shred(only_key, "id")["record"]) == [(1,)]


def test_graph_lists_parents_first():
    graph = schema_graph(SCHEMA, "id")
    assert graph[0].branch == "" and all(graph.index(e.parent) < graph.index(e) for e in graph[1:])
