"""Canonical values as JSON text, and scalar measures on them; all JVM column expressions.

A canonical value is a tagged union such as ``{"kind":"int","value":5}``.
Members stand in alphabetical order and there is no white space, so equal
values are equal strings and can be compared, grouped and hashed.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_VALUE = '{"kind":"null"}'
SEP, FIELD = "\x1f", "\x1e"

#: Rounding steps of measures by unit type; ratios are exempt.
MEASURE_STEPS = {"LENGTHUNIT": 1e-6, "AREAUNIT": 1e-6, "VOLUMEUNIT": 1e-6, "PLANEANGLEUNIT": 1e-8}
OTHER_MEASURE_STEP = 1e-9
#: Scale of quantised reals, and of those of direction attributes.
REAL_SCALE, DIRECTION_SCALE = 1e6, 1e5
#: SI prefixes.
SI_PREFIXES = {"EXA": 1e18, "PETA": 1e15, "TERA": 1e12, "GIGA": 1e9, "MEGA": 1e6, "KILO": 1e3, "HECTO": 1e2, "DECA": 1e1, "DECI": 1e-1, "CENTI": 1e-2, "MILLI": 1e-3, "MICRO": 1e-6, "NANO": 1e-9, "PICO": 1e-12, "FEMTO": 1e-15, "ATTO": 1e-18}


def quoted(text: Column) -> Column:
    """A string as a JSON string. Other than by ASCII-only writers, non-ASCII characters stay as they are."""
    inner = F.to_json(F.array(text))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def _tagged(kind: str, payload: Column, null: Column) -> Column:
    return F.when(null, NULL_VALUE).otherwise(F.concat(F.lit(f'{{"kind":"{kind}","value":'), payload, F.lit("}")))


def canonical_string(text: Column) -> Column:
    return _tagged("string", quoted(text), text.isNull())


def canonical_int(number: Column) -> Column:
    return _tagged("int", number.cast("long").cast("string"), number.isNull())


def canonical_bool(flag: Column) -> Column:
    return _tagged("bool", F.when(flag, "true").otherwise("false"), flag.isNull())


def quantised(real: Column, scale: float = REAL_SCALE) -> Column:
    """Whole multiples of 1/scale, halves to even; non-finite values are 0."""
    finite = ~F.isnan(real) & (F.abs(real) != float("inf"))
    return F.when(finite, F.bround(real * scale)).when(real.isNotNull(), 0).cast("long")


def canonical_real(real: Column, scale: float = REAL_SCALE) -> Column:
    """A quantised real. Of the exact form see :func:`canonical_real_exact`."""
    return _tagged("real_q", quantised(real, scale).cast("string"), real.isNull())


def canonical_real_exact(real: Column) -> Column:
    """A real as its 17 significant digits; -0 is 0, and a non-finite value is an error.

    No JVM function formats ``%.17g`` as C does, so this is an Arrow function.
    """

    @F.arrow_udf("string")
    def text(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            if v is not None and not math.isfinite(v):
                raise ValueError(f"not a finite real: {v}")
            out.append(None if v is None else f"{v + 0.0:.17g}")
        return pa.array(out, pa.string())

    return _tagged("real", quoted(text(real.cast("double"))), real.isNull())


def canonical_items(kind: str, items: Column) -> Column:
    """list and array keep their order; set and bag are sorted by canonical text, repeats kept."""
    if kind not in ("list", "array", "set", "bag"):
        raise ValueError(f"Unknown aggregate kind: {kind}")
    ordered = F.array_sort(items) if kind in ("set", "bag") else items
    return F.concat(F.lit('{"items":['), F.array_join(ordered, ","), F.lit(f'],"kind":"{kind}"}}'))


def canonical_simple(type_name: Column, value: Column) -> Column:
    """A wrapped defined type, or with another kind the chosen branch of a select."""
    return F.concat(F.lit('{"kind":"simple","type":'), quoted(type_name), F.lit(',"value":'), value, F.lit("}"))


def canonical_select(branch: Column, value: Column) -> Column:
    return F.concat(F.lit('{"kind":"select","type":'), quoted(branch), F.lit(',"value":'), value, F.lit("}"))


def canonical_ref(step: Column) -> Column:
    return F.concat(F.lit('{"id":'), step.cast("string"), F.lit(',"kind":"ref"}'))


def strip_ref_ids(value: Column) -> Column:
    """Canonical text whose references no longer say which entity they mean."""
    return F.regexp_replace(value, r'\{"id":-?[0-9]+,"kind":"ref"\}', '{"kind":"ref"}')


def logical_text(text: Column) -> Column:
    """Canonical value of a text that may be a logical token (.T., .F., .U.), trimmed."""
    t = F.trim(text)
    token = F.upper(t)
    return F.when(token.isin(".T.", "T", "TRUE"), canonical_bool(F.lit(True))).when(token.isin(".F.", "F", "FALSE"), canonical_bool(F.lit(False))).otherwise(canonical_string(t))


def normalise_measure(value: Column, unit_factor: Column, step: float) -> Column:
    """The measure in SI units, rounded to whole steps, halves to even."""
    return F.bround(value * unit_factor / step) * step


def value_kind(value: Column) -> Column:
    return F.get_json_object(value, "$.kind")


def value_shape(value: Column) -> Column:
    """What is left of a flat value without its literals: its kind, for a wrapped one the type as well."""
    kind = value_kind(value)
    size = F.json_array_length(F.get_json_object(value, "$.items"))
    return F.when(kind.isin("list", "set", "bag"), F.concat(kind, F.lit("["), size.cast("string"), F.lit("]"))).when(kind.isin("simple", "select"), F.concat(kind, F.lit(":"), F.get_json_object(value, "$.type"))).otherwise(kind)


def literal_token(value: Column) -> Column:
    """``kind:value`` of a flat literal."""
    return F.concat(value_kind(value), F.lit(":"), F.coalesce(F.get_json_object(value, "$.value"), F.lit("")))


def type_family(entity_type: Column) -> Column:
    return F.regexp_replace(entity_type, "StandardCase$", "")


def canonical_class(entity_type: Column) -> Column:
    """The one class that counts as another."""
    return F.when(entity_type == "IfcWallStandardCase", "IfcWall").otherwise(entity_type)


def type_compatibility(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).when(type_family(a) == type_family(b), 0.75).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def degree_similarity(a: Column, b: Column) -> Column:
    return 1 - F.abs(a - b) / F.greatest(F.lit(1), a, b)


def provenance(path: Column) -> tuple[Column, Column]:
    """Attribute name of a reference path, and whether it lies in an aggregate."""
    parts = F.split(F.ltrim(path, F.lit("/")), "/")
    return F.split(parts[0], "@")[0], F.size(parts) > 1


def rewritten_target(entity_id: Column, step: Column) -> Column:
    """Identity of a reference's target, or its step where that has none."""
    return F.coalesce(entity_id, F.concat(F.lit("STEP:"), step.cast("string")))


def si_unit_factor(prefix: Column, unit_type: Column) -> Column:
    """Factor of a prefixed SI unit; areas square it and volumes cube it. Unknown prefixes count as none."""
    factors = F.create_map(*(F.lit(x) for kv in SI_PREFIXES.items() for x in kv))
    power = F.when(unit_type == "AREAUNIT", 2).when(unit_type == "VOLUMEUNIT", 3).otherwise(1)
    return F.pow(F.coalesce(factors[prefix], F.lit(1.0)), power)
