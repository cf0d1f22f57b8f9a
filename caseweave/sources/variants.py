"""Helpers over VARIANT columns.

``try_parse_json`` rejects duplicate keys, so a parsed document is strict JSON.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..runtime import materialize


def parse(text) -> Column:
    return F.try_parse_json(F.col(text) if isinstance(text, str) else text)


def at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def items(v: Column, path: str = "$") -> Column:
    """Array elements; empty when the value is missing or no array."""
    return F.coalesce(at(v, path, "array<variant>"), F.array().cast("array<variant>"))


def fields(v: Column, path: str = "$") -> Column:
    """Object members as a map; NULL when the value is no object."""
    return at(v, path, "map<string,variant>")


def kind(v: Column) -> Column:
    """JSON kind: object, array, string, number, boolean or null."""
    s = F.schema_of_variant(v)
    return (F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string")
            .when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").when(s.isNotNull(), "number"))


def text(v: Column, path: str) -> Column:
    """String member; NULL when missing or of another kind."""
    x = at(v, path)
    return F.when(F.schema_of_variant(x) == "STRING", at(v, path, "string"))


def bad_text(v: Column, path: str, required: bool = False) -> Column:
    """A member that is present but no non-empty printable string, or absent though required."""
    x = at(v, path)
    value = F.coalesce(text(v, path), F.lit(""))
    bad = (value == "") | value.rlike(r"[\x00-\x1F\x7F]")
    return F.when(x.isNull(), F.lit(required)).otherwise(bad)


def flag(v: Column, path: str) -> Column:
    x = at(v, path)
    return F.when(F.schema_of_variant(x) == "BOOLEAN", at(v, path, "boolean"))


def digest(v: Column) -> Column:
    """SHA-256 of JSON with sorted keys and no whitespace."""
    return F.sha2(F.to_json(v), 256)


def tri_state(members: Column, name: str) -> Column:
    """Struct (state, sha256): absent, null or present member of a member map."""
    has = F.coalesce(F.map_contains_key(members, name), F.lit(False))
    x = members[name]
    null = F.coalesce(F.is_variant_null(x), F.lit(False))
    return F.struct(F.when(~has, "absent").when(null, "null").otherwise("present").alias("state"),
                    F.when(has, digest(x)).alias("sha256"))


LEVELS = 8  # levels that one projection unfolds


def walk(df, keep: list[str], doc: Column, indexed: bool):
    """Every node of a document, however deep: ``keep``, path, v.

    A projection unfolds several levels as arrays inside the record's own row,
    so nothing is shuffled or parsed twice.  Records that go deeper are written
    with their open nodes and unfolded further until none is left.  Array
    positions are part of the path only when ``indexed``.
    """
    def children(node):
        members = F.transform(F.map_entries(fields(node["v"])), lambda e: F.named_struct(
            F.lit("path"), F.concat(node["path"], F.lit("."), e["key"]), F.lit("v"), e["value"]))
        spot = (lambda i: F.concat(node["path"], F.lit("["), i.cast("string"), F.lit("]"))) if indexed else (
            lambda i: F.concat(node["path"], F.lit("[]")))
        elements = F.transform(items(node["v"]), lambda x, i: F.named_struct(F.lit("path"), spot(i), F.lit("v"), x))
        return F.coalesce(members, elements)

    root = F.array(F.named_struct(F.lit("path"), F.lit("$"), F.lit("v"), doc))
    level, done = df.filter(doc.isNotNull()).select(*keep, root.alias("__l0")), []
    while True:
        for d in range(LEVELS):
            level = level.withColumn(f"__l{d + 1}", F.flatten(F.transform(f"__l{d}", children)))
        nodes = F.concat(*[F.col(f"__l{d}") for d in range(LEVELS)])
        done.append(level.select(*keep, F.explode(nodes).alias("__n")).select(*keep, "__n.path", "__n.v"))
        deeper = level.filter(F.size(f"__l{LEVELS}") > 0).select(*keep, F.col(f"__l{LEVELS}").alias("__l0"))
        if deeper.isEmpty():
            break
        level = materialize(deeper)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
