"""Projection of profiles to a shape that a config describes: paths become Columns when the plan is built."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field as attribute

from pyspark.sql import Column, DataFrame, functions as F, types as T

from weftline.functions.formats import normalize_country, normalize_phone
from weftline.functions.text import clean_string

POLICIES = ("null", "omit", "error")


class ProjectionError(ValueError):
    """A config cannot be satisfied."""


@dataclass
class Field:
    name: str
    path: str
    type: str
    nullable: bool = False
    on_missing: str = "null"
    normalize: str | None = None
    description: str | None = None


@dataclass
class Projection:
    fields: list[Field]
    include_confidence: bool = False
    include_provenance: bool = False
    normalizers: dict[str, tuple[Callable, set[str]]] = attribute(default_factory=lambda: dict(NORMALIZERS))

    @staticmethod
    def parse(config: dict | str | None) -> "Projection":
        """From a dict or JSON. Two vocabularies: (name, path), or (path for the name, from for the path, required).
        A field's own on_missing comes before required, and that before the config's."""
        if config is None:
            return default_projection()
        config = json.loads(config) if isinstance(config, str) else dict(config)
        if not isinstance(config.get("fields"), list):
            raise ProjectionError("a config needs a list of fields")
        out = []
        for f in config["fields"]:
            f = dict(f)
            if "name" not in f:
                f["name"] = f.get("path")
                f["path"] = f.pop("from", f.get("path"))
            required = f.pop("required", None)
            policy = f.get("on_missing") or ("error" if required else config.get("on_missing") or "null")
            kind = f.get("type", "")
            kind = "array" if kind.endswith("[]") else kind
            if policy not in POLICIES or kind not in _TYPES or not f.get("name") or not f.get("path"):
                raise ProjectionError(f"field {f.get('name')!r}: bad type, policy or path")
            out.append(Field(f["name"], f["path"], kind, bool(f.get("nullable", False)), policy, f.get("normalize"), f.get("description")))
        return Projection(out, bool(config.get("include_confidence")), bool(config.get("include_provenance")))

    def json_schema(self) -> dict:
        """JSON Schema of the output."""
        props: dict = {}
        for f in self.fields:
            props[f.name] = {"type": [f.type, "null"] if f.nullable else f.type} | ({"description": f.description} if f.description else {})
        if self.include_confidence:
            props["confidence"] = {"type": "object"}
        if self.include_provenance:
            props["provenance"] = {"type": "array"}
        need = sorted(f.name for f in self.fields if f.on_missing == "error")
        return {"type": "object", "properties": props, "additionalProperties": False} | ({"required": need} if need else {})


_TYPES = {"string": T.StringType, "number": T.NumericType, "integer": T.IntegralType, "boolean": T.BooleanType, "object": (T.StructType, T.MapType), "array": T.ArrayType}

#: Normalisers by name: a function of a Column, and the types of fields it applies to.
NORMALIZERS: dict[str, tuple[Callable, set[str]]] = {
    "E164": (lambda c: normalize_phone(c)["value"], {"string"}),
    "ISO3166": (lambda c: normalize_country(c)["value"], {"string"}),
    "canonical": (lambda c: clean_string(c), {"string", "array"}),
}

_STEP = re.compile(r"\.?([A-Za-z_]\w*)|\[(-?\d+)\]|\[\]|\.?\{([^{}]*)\}")


def compile_path(path: str, column: Column, kind: T.DataType) -> tuple[Column | None, T.DataType | None]:
    """Column of a path (names, [n], [], and {a: b} of a list's items) below a column of the given type; None where
    the type has no such thing. Items without a value fall out of a list; a {a: b} item keeps its nulls."""
    path = path.strip()
    if not path:
        return column, kind
    m = _STEP.match(path)
    if not m:
        raise ProjectionError(f"cannot read path at {path!r}")
    rest = path[m.end() :]
    if m.group(1):
        if not isinstance(kind, T.StructType) or m.group(1) not in kind.names:
            return None, None
        return compile_path(rest, column[m.group(1)], kind[m.group(1)].dataType)
    if m.group(2) is not None:
        if not isinstance(kind, T.ArrayType):
            return None, None
        i = int(m.group(2))
        at = F.get(column, F.lit(i)) if i >= 0 else F.get(column, F.size(column) + i)
        return compile_path(rest, at, kind.elementType)
    if m.group(0) == "[]":
        if not isinstance(kind, T.ArrayType):
            return None, None
        _, inner = compile_path(rest, F.lit(None), kind.elementType)
        if inner is None:
            return F.array().cast("array<string>"), T.ArrayType(T.StringType())
        items = F.transform(column, lambda x: compile_path(rest, x, kind.elementType)[0])
        return F.filter(items, lambda x: x.isNotNull()), T.ArrayType(inner)
    if not isinstance(kind, T.StructType):
        return None, None
    cols, types = [], []
    for pair in m.group(3).split(","):
        name, _, own = (p.strip() for p in pair.partition(":"))
        c, t = compile_path(own, column, kind)
        cols.append((F.lit(None).cast("string") if c is None else c).alias(name))
        types.append(T.StructField(name, t or T.StringType()))
    return F.struct(*cols), T.StructType(types)


def _plain(profiles: DataFrame) -> tuple[Column, T.StructType]:
    """The view that paths read: values of single fields, lists of values, entries with confidence and sources."""
    cols = []
    for name in ("candidate_id", "overall_confidence", "skills", "experience", "education", "projects"):
        cols.append(F.col(name).alias(name))
    for name in ("full_name", "location", "links", "headline", "years_experience"):
        cols.append(F.col(f"{name}.value").alias(name))
    for name in ("emails", "phones"):
        cols.append(F.transform(name, lambda x: x["value"]).alias(name))
    view = F.struct(*cols)
    return view, profiles.select(view.alias("v")).schema["v"].dataType


def _confidences(profiles: DataFrame) -> tuple[Column, T.StructType]:
    cols = [F.lit(1.0).alias("candidate_id"), F.col("overall_confidence")]
    cols += [F.col(f"{n}.confidence").alias(n) for n in ("full_name", "location", "links", "headline", "years_experience")]
    cols += [F.transform(n, lambda x: x["confidence"]).alias(n) for n in ("emails", "phones", "skills", "experience", "education", "projects")]
    view = F.struct(*cols)
    return view, profiles.select(view.alias("v")).schema["v"].dataType


def _json(value: Column) -> Column:
    """JSON text of any value."""
    text = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(text, 6, 1 << 30).substr(F.lit(1), F.length(text) - 6)


def project(profiles: DataFrame, config: dict | str | Projection | None = None, on_error: str = "fail") -> DataFrame:
    """(bundle_id, root, output, errors): the projected profile as JSON text with its keys in order.

    A missing value (null; not an empty list or text) is written as null, left out, or an error, as its field says. A
    null where the field is not nullable, or a type other than declared, is an error too. on_error: "fail" stops the
    job at the first error; "quarantine" gives such rows a null output and lists the errors.
    """
    p = config if isinstance(config, Projection) else Projection.parse(config)
    for f in p.fields:
        if f.normalize is not None and (f.normalize not in p.normalizers or f.type not in p.normalizers[f.normalize][1]):
            raise ProjectionError(f"field {f.name!r}: normalize {f.normalize!r} is unknown or does not apply to {f.type}")
    (view, kind), (side, side_kind) = _plain(profiles), _confidences(profiles)
    rows = profiles.select("bundle_id", "root", "provenance", view.alias("__v"), side.alias("__c"))
    fragments, confidence, errors = {}, {}, []
    for f in p.fields:
        value, t = compile_path(f.path, F.col("__v"), kind)
        if value is not None and not isinstance(t, _TYPES[f.type]):
            errors.append(F.when(value.isNotNull(), F.lit(f"{f.name}: {t.simpleString()} is not of type {f.type}")))
        value = F.lit(None).cast("string") if value is None else value
        missing = value.isNull()
        if f.normalize is not None:
            fn = p.normalizers[f.normalize][0]
            value = F.filter(F.transform(value, fn), lambda x: x.isNotNull()) if f.type == "array" else fn(value)
        if f.on_missing == "error":
            errors.append(F.when(missing, F.lit(f"{f.name}: missing at {f.path}")))
        if not f.nullable:
            bad = value.isNull() & ~missing if f.on_missing != "null" else value.isNull()
            errors.append(F.when(bad, F.lit(f"{f.name}: null is not of type {f.type}")))
        said = F.concat(F.lit(json.dumps(f.name) + ":"), F.when(value.isNull(), F.lit("null")).otherwise(_json(value)))
        fragments[f.name] = F.when(missing, None).otherwise(said) if f.on_missing == "omit" else said
        at = f.path.split(".", 1)[0] if "[]." in f.path else f.path
        c, _ = compile_path(at, F.col("__c"), side_kind)
        root, _ = compile_path(re.split(r"[.\[]", f.path, maxsplit=1)[0], F.col("__c"), side_kind)
        texts = [F.when(x.isNotNull(), _json(x)) for x in (c, root) if x is not None] + [F.lit("null")]
        own = F.concat(F.lit(json.dumps(f.name) + ":"), F.when(missing, F.lit("null")).otherwise(F.coalesce(*texts)))
        confidence[f.name] = F.when(missing, None).otherwise(own) if f.on_missing == "omit" else own
    obj = lambda parts: F.concat(F.lit("{"), F.array_join(F.filter(F.array(*[parts[k] for k in sorted(parts)]), lambda x: x.isNotNull()), ","), F.lit("}"))
    if p.include_confidence:
        fragments["confidence"] = F.concat(F.lit('"confidence":'), obj(confidence))
    if p.include_provenance:
        fragments["provenance"] = F.concat(F.lit('"provenance":'), F.to_json("provenance"))
    found = F.filter(F.array(*errors), lambda e: e.isNotNull()) if errors else F.array().cast("array<string>")
    out = rows.select("bundle_id", "root", obj(fragments).alias("output"), found.alias("errors"))
    bad = F.size("errors") > 0
    if on_error == "fail":
        return out.withColumn("output", F.when(bad, F.raise_error(F.concat(F.lit("projection: "), F.array_join("errors", "; ")))).otherwise(F.col("output")))
    return out.withColumn("output", F.when(~bad, F.col("output")))


def default_projection() -> Projection:
    """All families and provenance."""
    members = lambda *names: "[].{" + ", ".join(f"{n}: {n}" for n in names) + "}"
    rows = [
        Field("candidate_id", "candidate_id", "string", on_missing="error"),
        Field("full_name", "full_name", "string", on_missing="error"),
        *[Field(n, n, t) for n, t in (("emails", "array"), ("phones", "array"), ("location", "object"), ("links", "object"))],
        Field("headline", "headline", "string", True),
        Field("years_experience", "years_experience", "number", True),
        Field("skills", "skills" + members("name", "confidence", "sources"), "array"),
        Field("experience", "experience" + members("company", "title", "start", "end", "summary"), "array"),
        Field("education", "education" + members("institution", "degree", "field", "end_year"), "array"),
        Field("projects", "projects" + members("name", "description", "url", "primary_language"), "array"),
        Field("overall_confidence", "overall_confidence", "number", on_missing="error"),
    ]
    return Projection(rows, include_provenance=True)
