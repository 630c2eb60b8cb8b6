"""Strict reading: what is wrong in a document, told apart as its readers would stumble over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAULT = "array<struct<path:string,fault:string>>"
NUMBERS = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL")


def kind(v: Column) -> Column:
    """The type of a variant by its name alone; VOID is an explicit null, SQL null is a missing value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def items(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def given(v: Column, required: bool, then: Column) -> Column:
    """missing (where it may not be) and null, before anything else."""
    return F.when(v.isNull(), F.lit("missing") if required else F.lit(None)).when(kind(v) == "VOID", "null").otherwise(then)


def number(v: Column, required: bool = False) -> Column:
    return given(v, required, F.when(~kind(v).isin(*NUMBERS), "type"))


def text(v: Column) -> Column:
    return given(v, False, F.when(kind(v) != "STRING", "type"))


def point(v: Column, required: bool = False) -> Column:
    """Two numbers; any other count is a wrong length, whatever stands in it."""
    inner = F.array_compact(F.transform(items(v), lambda x: number(x, True)))
    return given(v, required, F.when(kind(v) != "ARRAY", "type").when(F.size(items(v)) != 2, "length").otherwise(F.get(inner, F.lit(0))))


def position(v: Column) -> Column:
    """A point, or a number or the text of one."""
    scalar = F.when(~kind(v).isin(*NUMBERS, "STRING") | F.try_variant_get(v, "$", "double").isNull(), "type")
    return given(v, False, F.when(kind(v) == "ARRAY", point(v)).otherwise(scalar))


#: What the readers take from the elements of each part, and how they take it.
PARTS = {
    "walls": {"start": lambda v: point(v, True), "end": lambda v: point(v, True), "thickness": number},
    "doors": {"wall_index": number, "position": position, "width": number, "height": number},
    "windows": {"wall_index": number, "position": position, "width": number, "height": number, "sill_height": number},
    "rooms": {"label": text, "polygon": lambda v: given(v, False, F.when(kind(v) != "ARRAY", "type")), "area": lambda v: F.when(kind(v) != "VOID", number(v))},
}


def entry(path: Column, fault: Column) -> Column:
    return F.when(fault.isNotNull(), F.struct(path.alias("path"), fault.alias("fault")))


def part_faults(doc: Column, part: str) -> Column:
    whole = field(doc, f"$.{part}")
    at = lambda i: F.concat(F.lit(f"$.{part}["), i.cast("string"), F.lit("]"))

    def element(e: Column, i: Column) -> Column:
        found = [entry(F.concat(at(i), F.lit(f".{name}")), check(field(e, f"$.{name}"))) for name, check in PARTS[part].items()]
        rows = F.array(*found)
        if part == "rooms":
            ring = items(field(e, "$.polygon"))
            rows = F.concat(rows, F.transform(ring, lambda p, j: entry(F.concat(at(i), F.lit(".polygon["), j.cast("string"), F.lit("]")), point(p, True))))
        return F.when(kind(e) == "OBJECT", rows).otherwise(F.array(entry(at(i), F.when(kind(e) == "VOID", "null").otherwise("type"))))

    own = F.array(entry(F.lit(f"$.{part}"), given(whole, False, F.when(kind(whole) != "ARRAY", "type"))))
    return F.concat(own, F.flatten(F.transform(items(whole), element)))


def strict_faults(docs: DataFrame, id_col: str = "plan_id", json_col: str = "doc") -> DataFrame:
    """(plan_id, path, fault) of every place at which a reader that takes each value as it stands would fail.

    Faults: not json; missing (a wall's end); null, where a value is given as null, which isn't the same as leaving it
    out; type; length (a point of other than two numbers). A document without rows is fine. Each is parsed once and
    walked within its row, so nothing is shuffled; keys that no reader takes don't matter.
    """
    d = docs.select(docs[id_col].alias("plan_id"), docs[json_col].alias("__json"), F.try_parse_json(docs[json_col]).alias("__v"))
    v = F.col("__v")
    root = F.when(v.isNull(), "not json").when(kind(v) != "OBJECT", "type")
    scale = field(v, "$.scale")
    pixels = number(field(scale, "$.pixels_per_meter"))
    found = [F.array(entry(F.lit("$"), root)), F.array(entry(F.lit("$.scale"), given(scale, False, F.when(kind(scale) != "OBJECT", "type"))), entry(F.lit("$.scale.pixels_per_meter"), pixels))]
    found += [part_faults(v, p) for p in PARTS]
    return d.select("plan_id", F.inline(F.array_compact(F.flatten(F.array(*found)))))
