"""Shared inlining of nested records into related flat tables.

The schema graph of a DataFrame is analysed once on the driver (it is as large
as the schema, never as the data). Singleton structs are inlined into the table
of their owner. Every repeated element (array or map) gets a table. Elements of
one name and one column signature that hang below several parents share a
table, and an element that holds itself again below (same name, overlapping
columns) is folded into one recursive table. Each table is a narrow
``explode`` of the source; nothing is joined, so the plan has no shuffle besides
the one that keeps a single delivery of each record.

Keys: ``node`` is the place of a row inside its record, such as
``a.items[2]`` (the record itself is the empty string). (key, parent) of a
child equals (key, node) of exactly one row of ``parent_table``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselade.session import first_delivery

RESERVED = ("node", "parent", "parent_table", "branch", "pos")


@dataclass
class Element:
    """A repeated element of the schema graph, or the root."""

    branch: str
    name: str
    parent: Element | None
    repeated: T.DataType | None
    columns: list[tuple[str, tuple[str, ...], T.DataType]] = field(default_factory=list)
    steps: tuple[str, ...] = ()
    children: list[Element] = field(default_factory=list)
    table: str = ""

    def signature(self) -> tuple:
        return self.name, tuple((c, t.simpleString()) for c, _, t in self.columns)

    def above(self) -> list[Element]:
        return [] if self.parent is None else [self.parent, *self.parent.above()]


def _slug(text: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in text).lower()


def schema_graph(schema: T.StructType, key: str, skip: tuple[str, ...] = ()) -> list[Element]:
    """All elements of a schema, the root first, parents before children."""
    found: list[Element] = []

    def repeat(owner: Element, steps: tuple[str, ...], kind: T.DataType) -> None:
        name = steps[-1] if steps else "item"
        branch = ".".join(x for x in (owner.branch, *(steps or ("item",))) if x)
        element = Element(branch, name, owner, kind, steps=steps)
        owner.children.append(element)
        found.append(element)
        if isinstance(kind, T.MapType):
            element.columns.append(("key", ("key",), kind.keyType))
            value, at = kind.valueType, ("value",)
        else:
            value, at = kind.elementType, ()
        inline(element, at, value)

    def inline(owner: Element, steps: tuple[str, ...], kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                inline(owner, (*steps, f.name), f.dataType)
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            repeat(owner, steps, kind)
        else:
            owner.columns.append(("_".join(map(_slug, steps)) or "value", steps, kind))

    root = Element("", "record", None, None)
    found.append(root)
    for f in schema.fields:
        if f.name != key and f.name not in skip:
            inline(root, (f.name,), f.dataType)
    for e in found:
        taken: dict[str, int] = {}
        for i, (c, steps, kind) in enumerate(e.columns):
            c = f"{c}_" if c in (*RESERVED, key) else c
            taken[c] = taken.get(c, 0) + 1
            e.columns[i] = (c if taken[c] == 1 else f"{c}_{taken[c]}", steps, kind)
    _name_tables(found)
    return found


def _name_tables(found: list[Element]) -> None:
    root, repeated = found[0], found[1:]
    root.table = "record"
    groups: dict[tuple, list[Element]] = {}
    for e in repeated:
        groups.setdefault(e.signature(), []).append(e)
    names: dict[str, int] = {}

    def fresh(name: str) -> str:
        names[name] = names.get(name, 0) + 1
        return name if names[name] == 1 else f"{name}_{names[name]}"

    for e in repeated:
        columns = {c for c, _, _ in e.columns}
        again = [a for a in e.above() if a.repeated is not None and a.name == e.name and columns & {c for c, _, _ in a.columns}]
        if again:  # the element holds itself: one recursive table
            e.table = again[0].table
        elif len(shared := groups[e.signature()]) > 1:
            e.table = shared[0].table or fresh(_slug(e.name))
        else:
            e.table = fresh(_slug(e.branch))


def _reach(value: Column, steps: tuple[str, ...]) -> Column:
    for s in steps:
        value = value.getField(s)
    return value


def _entries(container: Column, kind: T.DataType) -> Column:
    return F.map_entries(container) if isinstance(kind, T.MapType) else container


def _labelled(label: Column):
    return lambda place: F.struct(label, place.alias("pos"))


def _rows(records: DataFrame, key: str, element: Element) -> DataFrame:
    """Rows of one element: key, parent, node, pos and the element's value."""
    at = element.parent
    if at is None:
        raise ValueError("the root has no rows of its own here")
    if at.repeated is None:
        owner, parent = records, F.lit("")
        container = _reach(F.col(f"`{element.steps[0]}`"), element.steps[1:])
    else:
        owner, parent = _rows(records, key, at), F.col("node")
        container = _reach(F.col("value"), element.steps)
    exploded = owner.select(key, parent.alias("parent"), F.posexplode(_entries(container, element.repeated)).alias("pos", "value"))
    label = F.concat(F.lit(f"{element.branch}["), F.col("pos").cast("string"), F.lit("]"))
    node = label if at.repeated is None else F.concat(F.col("parent"), F.lit("/"), label)
    return exploded.where(F.col("value").isNotNull()).withColumn("node", node)


def shred(df: DataFrame, key: str, order: str | None = None, skip: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Related flat tables of ``df``, by name; ``record`` is the root.

    Null structs and null arrays leave null columns and no child rows. A null
    array element gives no row but keeps its place: ``pos`` counts it. An
    element whose fields are all null is a row. Records delivered several
    times count once (see ``first_delivery``); rows without key are left out.
    Names that clash with the key or link columns get a trailing underscore,
    names that clash after flattening a number. An empty table gives empty
    tables of the same columns.
    """
    graph = schema_graph(df.schema, key, skip)
    types: dict[str, dict[str, T.DataType]] = {}
    for e in graph:
        for c, _, kind in e.columns:
            types.setdefault(e.table, {}).setdefault(c, kind)
        types.setdefault(e.table, {})
    tables: dict[str, DataFrame] = {}
    for e in graph:
        wanted = types[e.table]
        if e.parent is None:
            tops = sorted({steps[0] for _, steps, _ in e.columns})
            one = first_delivery(df, key, [f"`{c}`" for c in tops] or [F.lit(None).alias("_none")], order)
            tables[e.table] = one.select(key, *[_reach(F.col(f"`{steps[0]}`"), steps[1:]).alias(c) for c, steps, _ in e.columns])
            continue
        top = ([a for a in e.above() if a.repeated is not None] or [e])[-1].steps[0]
        rows = _rows(first_delivery(df, key, [f"`{top}`"], order), key, e)
        own = {c: _reach(F.col("value"), steps) for c, steps, _ in e.columns}
        part = rows.select(
            key, "node", "parent", F.lit(e.parent.table).alias("parent_table"), F.lit(e.branch).alias("branch"), "pos",
            *[own.get(c, F.lit(None).cast(kind)).cast(kind).alias(c) for c, kind in wanted.items()],
        )
        tables[e.table] = tables[e.table].unionByName(part) if e.table in tables else part
    return tables


def links(df: DataFrame, key: str, branches: dict[str, str], order: str | None = None) -> DataFrame:
    """Child rows of top-level branches without their content.

    ``branches`` maps a label to the dotted path of an array. Places of the
    non-null elements are packed into one small array a record before the
    shuffle that keeps one delivery, and unpacked after it, so the nested
    content itself never leaves the scan. Result: key, branch, pos.
    """
    wanted = {path: label for label, path in branches.items()}
    graph = [e for e in schema_graph(df.schema, key) if e.branch in wanted and e.parent is not None and e.parent.repeated is None]
    missing = set(wanted) - {e.branch for e in graph}
    if missing:
        raise ValueError(f"no repeated element below the record: {sorted(missing)}")
    packed = []
    for e in graph:
        items = _entries(_reach(F.col(f"`{e.steps[0]}`"), e.steps[1:]), e.repeated)
        places = F.filter(F.transform(items, lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())
        label = F.lit(wanted[e.branch]).alias("branch")
        packed.append(F.transform(F.coalesce(places, F.array().cast("array<int>")), _labelled(label)))
    one = first_delivery(df, key, [F.concat(*packed).alias("places")], order)
    return one.select(key, F.explode("places").alias("place")).select(key, "place.branch", "place.pos")
