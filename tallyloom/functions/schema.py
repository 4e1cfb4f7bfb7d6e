"""JSON schemas as columns: a schema is compiled once to an expression over VARIANT that lists what each value violates."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the formats look like.
FORMATS = {
    "date-time": r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]*$",
}
# The envelope of an event and some of its payloads.
HASH, UUID = "^sha256:[0-9a-f]{64}$", "^uuid:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
_TEXT = {"type": "string", "minLength": 1}
_HASH = {"type": "string", "pattern": HASH}


def _object(required: list[str], **properties: dict) -> dict:
    return {"type": "object", "required": required, "properties": properties}


PAYLOADS = {
    "event.retracted": _object(["retracted_event_id", "reason"], retracted_event_id=_HASH, reason=_TEXT),
    "event.superseded": _object(["superseded_event_id", "superseding_event_id", "reason"], superseded_event_id=_HASH, superseding_event_id=_HASH, reason=_TEXT),
    "observation.flagged": _object(
        ["observation_id", "flagged_by", "reason", "weight_ppm"],
        observation_id={"type": "string", "pattern": "^observation:sha256:[0-9a-f]{64}$"},
        flagged_by={"type": "string", "enum": ["human", "agent"]},
        reason=_TEXT,
        weight_ppm={"type": "integer", "minimum": 0, "maximum": 1_000_000},
    ),
}


def event_schema(types: list[str], payloads: Mapping[str, dict] = PAYLOADS) -> dict:
    """The envelope's schema; a payload is checked by its event's type."""
    uuid = {"type": "string", "pattern": UUID}
    envelope = _object(
        ["spec_version", "event_type", "event_id", "occurred_at", "actor", "run", "inputs", "payload"],
        spec_version={"type": "string", "pattern": r"^\d+\.\d+\.\d+$"},
        event_type={"enum": types},
        event_id=_HASH,
        occurred_at={"type": "string", "format": "date-time"},
        actor=_object(["type", "id", "version"], type={"type": "string", "enum": ["human", "agent", "projector"]}, id=_TEXT, version=_TEXT),
        run=_object(["run_id", "batch_id", "configuration_hash"], run_id=uuid, batch_id=uuid, configuration_hash=_HASH),
        inputs={"type": "array", "items": _HASH},
        payload={"type": "object"},
    )
    by_type = [{"if": {"properties": {"event_type": {"const": t}}}, "then": {"properties": {"payload": s}}} for t, s in payloads.items()]
    return {**envelope, "not": {"required": ["ledger_position"]}, "allOf": by_type}


def _kind(shape: Column) -> Column:
    """The JSON type of a variant by its schema; null where there is none."""
    number = shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return (
        F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null").when(number, "number")
    )


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _bad(wrong: Column, path: Column, rule: str) -> Column:
    """path: rule where wrong is true."""
    return F.when(F.coalesce(wrong, F.lit(False)), F.concat(path, F.lit(f": {rule}")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it: rules nest, and expressions would grow with each level."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _none() -> Column:
    return F.array().cast("array<string>")


class Compiler:
    def __init__(self, root: Mapping[str, object]):
        self.root = root

    def _resolve(self, schema: Mapping) -> Mapping:
        """Follows $ref within the schema's own $defs."""
        while "$ref" in schema:
            ref = schema["$ref"]
            if not ref.startswith("#/"):
                raise ValueError(f"only references within the schema are known, not {ref}")
            found = self.root
            for part in ref[2:].split("/"):
                found = found[part]
            schema = {**found, **{k: v for k, v in schema.items() if k != "$ref"}}
        return schema

    def found(self, schema: Mapping, value: Column, path: Column) -> Column:
        """The array of what a variant violates; a value that isn't there violates nothing here."""
        kind = lambda v: _let(F.schema_of_variant(v), _kind)
        typed = lambda v: _let(F.struct(v.alias("v"), kind(v).alias("kind")), with_text)
        text = lambda x: F.when(~x["kind"].isin("object", "array"), _text(x["v"]))  # noqa: E731  theirs would be all that they hold, and no rule reads it
        with_text = lambda x: _let(F.struct(x["v"].alias("v"), x["kind"].alias("kind"), text(x).alias("text")), lambda y: self._rules(self._resolve(schema), y, path))
        return _let(value, lambda v: F.when(v.isNotNull(), typed(v)).otherwise(_none()))

    def _rules(self, schema: Mapping, x: Column, path: Column) -> Column:
        value, kind, text, one = x["v"], x["kind"], x["text"], []
        number = F.try_variant_get(value, "$", "double")
        member = lambda name: F.try_variant_get(value, f"$['{name}']", "variant")
        if "type" in schema:
            wanted = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
            fits = kind.isin([w for w in wanted if w != "integer"])
            one.append(_bad(~(fits | ((kind == "number") & (number == F.floor(number))) if "integer" in wanted else fits), path, "type"))
        if "enum" in schema:
            listed = (kind != "null") & text.isin([str(v) for v in schema["enum"] if v is not None])
            one.append(_bad(~(F.coalesce(listed, F.lit(False)) | ((kind == "null") & F.lit(None in schema["enum"]))), path, "enum"))
        if "const" in schema:
            one.append(_bad(~text.eqNullSafe(F.lit(str(schema["const"]))), path, "const"))
        string = kind == "string"
        if "pattern" in schema:
            one.append(_bad(string & ~text.rlike(schema["pattern"]), path, "pattern"))
        if schema.get("format") in FORMATS:
            one.append(_bad(string & ~text.rlike(FORMATS[schema["format"]]), path, "format"))
        if "minLength" in schema:
            one.append(_bad(string & (F.length(text) < schema["minLength"]), path, "minLength"))
        for rule, less in (("minimum", True), ("maximum", False)):
            if rule in schema:
                one.append(_bad((kind == "number") & ((number < schema[rule]) if less else (number > schema[rule])), path, rule))
        for name in schema.get("required", []):
            one.append(_bad((kind == "object") & member(name).isNull(), F.concat(path, F.lit(f".{name}")), "required"))
        items = F.try_variant_get(value, "$", "array<variant>")
        if "minItems" in schema:
            one.append(_bad((kind == "array") & (F.size(items) < schema["minItems"]), path, "minItems"))
        out = [F.array_compact(F.array(*one))] if one else []
        for name, inner in schema.get("properties", {}).items():
            out.append(self.found(inner, member(name), F.concat(path, F.lit(f".{name}"))))
        if schema.get("additionalProperties") is False:
            known = F.array(*map(F.lit, schema["properties"])) if schema.get("properties") else _none()
            extra = F.array_except(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), known)
            out.append(F.when(kind == "object", F.transform(F.array_sort(extra), lambda k: F.concat(path, F.lit("."), k, F.lit(": additional")))).otherwise(_none()))
        if "items" in schema:
            each = F.transform(items, lambda v, i: self.found(schema["items"], v, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            out.append(F.when(kind == "array", F.flatten(each)).otherwise(_none()))
        holds = lambda inner: F.size(self._rules(self._resolve(inner), x, path)) == 0
        for part in schema.get("allOf", []):
            out.append(self._rules(self._resolve(part), x, path))
        if "anyOf" in schema:
            out.append(F.array_compact(F.array(_bad(~F.exists(F.array(*map(holds, schema["anyOf"])), lambda ok: ok), path, "anyOf"))))
        if "not" in schema:
            out.append(F.array_compact(F.array(_bad(holds(schema["not"]), path, "not"))))
        if "if" in schema:
            then, other = (self._rules(self._resolve(schema[k]), x, path) if k in schema else _none() for k in ("then", "else"))
            out.append(F.when(holds(schema["if"]), then).otherwise(other))
        return F.flatten(F.array(*out)) if out else _none()


def violations(value: Column, schema: Mapping[str, object]) -> Column:
    """What a VARIANT violates, as "path: rule" in the schema's order; paths begin with $. An empty array for a value that fits.

    type, enum, const, pattern, format (date-time, uri), minLength, minimum, maximum, required, properties, additionalProperties, items, minItems,
    allOf, anyOf, not, if / then / else and references within the schema are known; other keywords say nothing. A null column, as try_parse_json
    gives for null and broken texts, violates "$: json".
    """
    return _let(value, lambda v: F.when(v.isNull(), F.array(F.lit("$: json"))).otherwise(Compiler(schema).found(schema, v, F.lit("$"))))
