"""JSON payloads of any shape into typed columns, and back; what cannot be read gives the empty value, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.functions.wording import unfenced

GROUP = "struct<any_of:array<string>>"
CONSTRAINTS = f"struct<must:array<{GROUP}>,preferred:array<string>,mentioned:array<string>,excluded:array<string>>"


def vector(raw: Column) -> Column:
    """A vector written as a JSON list; null if it is none, is empty or has a part that is no number."""
    read = F.from_json(raw, "array<double>", {"mode": "PERMISSIVE"})
    return F.when((F.size(read) > 0) & F.forall(read, lambda x: x.isNotNull()), read)


def constraints(raw: Column) -> Column:
    """A constraints payload with every list there; all empty unless it has a must or a preferred list."""
    read = F.from_json(raw, CONSTRAINTS)
    known = F.get_json_object(raw, "$.must").isNotNull() | F.get_json_object(raw, "$.preferred").isNotNull()
    own = lambda k, kind: F.coalesce(F.when(known, read[k]), F.array().cast(f"array<{kind}>")).alias(k)
    return F.struct(own("must", GROUP), own("preferred", "string"), own("mentioned", "string"), own("excluded", "string"))


def string_map(raw: Column) -> Column:
    """The values of a model's JSON object that are strings, trimmed, without blank ones; empty for anything else, code fences aside."""
    read = F.from_json(unfenced(raw), "map<string,variant>", {"allowSingleQuotes": "false"})
    texts = F.map_filter(read, lambda _, v: F.schema_of_variant(v) == "STRING")
    trimmed = F.transform_values(texts, lambda _, v: F.trim(v.cast("string")))
    return F.coalesce(F.map_filter(trimmed, lambda _, v: v != ""), F.create_map().cast("map<string,string>"))


def result_list(raw: Column, element: str, key: str = "comparison_results") -> Column:
    """The list that a model's JSON is, or holds under key; empty for anything else."""
    t = unfenced(raw)
    listed = F.coalesce(F.from_json(F.get_json_object(t, f"$.{key}"), f"array<{element}>"), F.when(F.ltrim(t).startswith("["), F.from_json(t, f"array<{element}>")))
    return F.coalesce(listed, F.array().cast(f"array<{element}>"))


def literal_list(raw: Column) -> Column:
    """A cell with a list in single or double quotes; one item for other text, none for blank."""
    t = F.trim(raw)
    read = F.from_json(t, "array<string>", {"allowSingleQuotes": "true"})
    kept = F.filter(F.transform(read, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.coalesce(t, F.lit("")) == "", F.array().cast("array<string>")).when(t.startswith("[") & read.isNotNull(), kept).otherwise(F.array(t))
