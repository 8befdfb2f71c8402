"""JSON values held against a JSON Schema: the schema is compiled once, into expressions over variants.

Known are type, properties, required, additionalProperties, items, enum, const, anyOf, $ref into the schema, bounds of texts,
numbers and arrays, and the format uuid; other words are ignored. Violations name the place and the rule, never the value.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.validators import bound

#: Levels of a schema that refers to itself which are compiled; values nested deeper are reported.
DEPTH = 8

_NAMES = {
    "object": r"^OBJECT", "array": r"^ARRAY", "string": r"^STRING$", "boolean": r"^BOOLEAN$", "null": r"^VOID$",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)",
}
_UUID = r"(?i)^(urn:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"
_NONE = "cast(array() as array<string>)"


def violations(text: Column, schema: dict, name: str = "arguments") -> Column:
    """The reasons why a JSON text does not satisfy the schema, in order; empty if it does, null for a null text.

    What is no JSON at all has the one violation "not JSON".
    """
    parsed = F.try_parse_json(text)
    checked = bound(parsed, lambda v: _Compiler(schema).check(v, schema, F.lit(name), 0))
    return F.when(text.isNotNull(), F.when(parsed.isNull(), F.array(F.lit(f"{name}: not JSON"))).otherwise(checked))


def _all(parts: list[Column]) -> Column:
    return F.flatten(F.array(*parts)) if parts else F.expr(_NONE)


def _if(bad: Column, path: Column, what: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.concat(path, F.lit(f": {what}")))).otherwise(F.expr(_NONE))


class _Compiler:
    def __init__(self, root: dict):
        self.root = root

    def resolved(self, ref: str) -> dict | None:
        node: object = self.root
        for part in ref.removeprefix("#/").split("/") if ref.startswith("#/") else [None]:
            node = node.get(part) if isinstance(node, dict) else None
        return node if isinstance(node, dict) else None

    def check(self, v: Column, schema: dict, path: Column, depth: int) -> Column:
        """Violations of a variant; path is the place, a text."""
        if depth > DEPTH:
            return F.array(F.concat(path, F.lit(": nested too deeply")))
        if "$ref" in schema:
            target = self.resolved(str(schema["$ref"]))
            return F.array(F.concat(path, F.lit(": the schema has an unresolvable reference"))) if target is None else self.check(v, target, path, depth + 1)
        return bound(F.struct(v.alias("v"), F.schema_of_variant(v).alias("kind")), lambda x: self.judged(x["v"], x["kind"], schema, path, depth))

    def judged(self, v: Column, kind: Column, schema: dict, path: Column, depth: int) -> Column:
        own = _all([part for part in (self.constants(v, kind, schema, path), self.text(v, kind, schema, path), self.number(v, kind, schema, path), self.items(v, kind, schema, path, depth), self.members(v, kind, schema, path, depth)) if part is not None])
        if "type" in schema:
            names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            fits = F.lit(False)
            for n in names:
                fits = fits | (kind.rlike(_NAMES[n]) if n in _NAMES else F.lit(True))
            own = F.when(fits, own).otherwise(F.array(F.concat(path, F.lit(f": must be of type {'/'.join(names)}"))))
        if "anyOf" in schema:
            some = F.lit(False)
            for branch in schema["anyOf"]:
                some = some | (F.size(self.check(v, branch, path, depth + 1)) == 0)
            own = F.when(some, own).otherwise(F.array(F.concat(path, F.lit(": does not match any allowed form"))))
        return own

    @staticmethod
    def equals(v: Column, kind: Column, value: object) -> Column:
        """Whether a variant is a given plain value; numbers are compared as such."""
        if value is None:
            return kind == "VOID"
        if isinstance(value, bool):
            return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == value)
        if isinstance(value, (int, float)):
            return kind.rlike(_NAMES["number"]) & (F.try_variant_get(v, "$", "double") == float(value))
        if isinstance(value, str):
            return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == value)
        return F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value))))

    def constants(self, v: Column, kind: Column, schema: dict, path: Column) -> Column | None:
        parts = []
        if "const" in schema:
            parts.append(_if(~F.coalesce(self.equals(v, kind, schema["const"]), F.lit(False)), path, "is not the allowed constant"))
        if "enum" in schema:
            among = F.lit(False)
            for value in schema["enum"]:
                among = among | F.coalesce(self.equals(v, kind, value), F.lit(False))
            parts.append(_if(~among, path, f"must be one of {', '.join(map(repr, schema['enum']))}"))
        return _all(parts) if parts else None

    @staticmethod
    def text(v: Column, kind: Column, schema: dict, path: Column) -> Column | None:
        t, parts = F.try_variant_get(v, "$", "string"), []
        if "minLength" in schema:
            parts.append(_if(F.length(t) < schema["minLength"], path, "is too short"))
        if "maxLength" in schema:
            parts.append(_if(F.length(t) > schema["maxLength"], path, "is too long"))
        if schema.get("format") == "uuid":
            parts.append(_if(~t.rlike(_UUID), path, "must be a UUID"))
        return F.when(kind == "STRING", _all(parts)).otherwise(F.expr(_NONE)) if parts else None

    @staticmethod
    def number(v: Column, kind: Column, schema: dict, path: Column) -> Column | None:
        x, parts = F.try_variant_get(v, "$", "double"), []
        if "minimum" in schema:
            parts.append(_if(x < float(schema["minimum"]), path, f"is below the minimum {schema['minimum']}"))
        if "maximum" in schema:
            parts.append(_if(x > float(schema["maximum"]), path, f"is above the maximum {schema['maximum']}"))
        return F.when(kind.rlike(_NAMES["number"]), _all(parts)).otherwise(F.expr(_NONE)) if parts else None

    def items(self, v: Column, kind: Column, schema: dict, path: Column, depth: int) -> Column | None:
        all_, parts = F.try_variant_get(v, "$", "array<variant>"), []
        if "minItems" in schema:
            parts.append(_if(F.size(all_) < schema["minItems"], path, "has too few items"))
        if "maxItems" in schema:
            parts.append(_if(F.size(all_) > schema["maxItems"], path, "has too many items"))
        if isinstance(schema.get("items"), dict):
            each = lambda x, i: self.check(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), depth + 1)
            parts.append(F.flatten(F.transform(all_, each)))
        return F.when(kind.startswith("ARRAY"), _all(parts)).otherwise(F.expr(_NONE)) if parts else None

    def members(self, v: Column, kind: Column, schema: dict, path: Column, depth: int) -> Column | None:
        known, more = schema.get("properties", {}), schema.get("additionalProperties")
        if not known and not schema.get("required") and (more is None or more is True):
            return None

        def judged(m: Column) -> Column:
            parts = [_if(~F.map_contains_key(m, name), F.concat(path, F.lit(f".{name}")), "is required") for name in schema.get("required", [])]
            for name, rule in known.items():
                parts.append(F.when(F.map_contains_key(m, name), self.check(F.try_element_at(m, F.lit(name)), rule, F.concat(path, F.lit(f".{name}")), depth + 1)).otherwise(F.expr(_NONE)))
            other = F.filter(F.map_keys(m), lambda k: ~k.isin(*known) if known else F.lit(True))
            label = lambda k: F.when(k.rlike(r"^[\p{L}_][\p{L}\p{N}_]{0,39}$"), k).otherwise("(unusual name)")
            if more is False:
                parts.append(F.transform(other, lambda k: F.concat(path, F.lit(": the property "), label(k), F.lit(" is not allowed"))))
            elif isinstance(more, dict):
                parts.append(F.flatten(F.transform(other, lambda k: self.check(F.try_element_at(m, k), more, F.concat(path, F.lit("."), label(k)), depth + 1))))
            return _all(parts)

        return F.when(kind.startswith("OBJECT"), bound(F.try_variant_get(v, "$", "map<string,variant>"), judged)).otherwise(F.expr(_NONE))
