"""JSON lines to documents of a schema.

A line that isn't a JSON object is skipped; a value that doesn't fit its field
leaves only that field empty. Of equal keys in a line the first counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.plans.schema import FieldSpec, Schema


#: Unknown keys that may become fields; the driver plans a column for each.
MOST_KEYS = 10_000
_STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _object(line: Column) -> Column:
    """A line as a map of variants; null unless it is one JSON object."""
    got = F.from_json(line, "map<string,variant>", _STRICT)
    return F.when(F.rtrim(F.translate(line, "\t\r\n", "   ")).endswith("}"), got)


def parsed(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Adds _object, a map of variants: null for lines that are no object. Blank lines go."""
    kept = lines.where(F.trim(F.col(line_col)) != "")
    return kept.withColumn("_object", _object(F.col(line_col)))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _plain(value: Column) -> Column:
    """Whether a value is neither null nor nested."""
    kind = _kind(value)
    return value.isNotNull() & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "VOID")


def coerced(spec: FieldSpec, value: Column) -> Column:
    """A JSON value as the field's type; null where it doesn't fit."""
    text = F.when(_plain(value), F.try_variant_get(value, "$", "string"))
    if spec.kind in ("long", "int"):
        whole = F.trim(text).rlike(r"^[+-]?[0-9]+$") & _kind(value).isin("BIGINT", "STRING")
        return F.when(whole, F.trim(text).try_cast("bigint" if spec.kind == "long" else "int"))
    if spec.kind == "bytes":
        return text.cast("binary")
    return text


def inferred(objects: DataFrame, schema: Schema, order: Column) -> list[FieldSpec]:
    """Fields for keys that the schema doesn't know, by the first value in line order; the driver sees a row a key."""
    known = [schema.json_key(f) for f in schema.fields] + [f for f in schema.fields if f not in schema.aliases]
    pairs = objects.where("_object is not null").select(order.alias("at"), F.explode("_object").alias("key", "value"))
    pairs = pairs.where(~F.col("key").isin(known) if known else F.lit(True)).where(_plain(F.col("value")))
    first = pairs.withColumn("kind", _kind(F.col("value"))).groupBy("key").agg(F.min_by("kind", "at").alias("kind")).orderBy("key").limit(MOST_KEYS + 1).collect()
    if len(first) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} unknown keys: a table can't have a column for each")
    out = []
    for key, kind in first:
        if schema.policy == "stored-only":
            out.append(FieldSpec.only_stored(key))
        elif kind == "BIGINT":
            out.append(FieldSpec.long_point(key).with_doc_values("numeric"))
        else:
            out.append(FieldSpec.keyword(key))
    return out


def bind(lines: DataFrame, schema: Schema, line_col: str = "value", order: Column | None = None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, Schema]:
    """Documents (with the columns of `keep`) and the schema they have, grown by new keys where the policy says so."""
    objects = parsed(lines, line_col)
    grown = Schema(dict(schema.fields), dict(schema.aliases), schema.policy)
    if schema.policy != "strict":
        for spec in inferred(objects, schema, order if order is not None else F.monotonically_increasing_id()):
            if spec.name not in grown.fields:
                grown.add(spec)
    value = lambda name: F.try_element_at(F.col("_object"), F.lit(grown.json_key(name)))
    columns = [coerced(spec, value(spec.name)).alias(spec.name) for spec in grown.fields.values()]
    return objects.where("_object is not null").select(*keep, *columns), grown


def counts(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """ok and failed lines."""
    fine = _object(F.col(line_col)).isNotNull()
    return lines.where(F.trim(F.col(line_col)) != "").agg(F.count_if(fine).alias("ok"), F.count_if(~fine).alias("failed"))
