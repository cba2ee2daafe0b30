"""Reading drawing labels: diameters, materials and assets; size ladders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nominal bores in millimetres of sizes in inches.
INCHES = ((1.0, 25), (1.25, 32), (1.5, 40), (2.0, 50), (2.5, 65), (3.0, 75), (4.0, 100), (5.0, 125), (6.0, 150), (8.0, 200), (10.0, 250), (12.0, 300), (14.0, 350), (16.0, 400))
#: Patterns of materials and assets, the first that is found counts.
MATERIALS = (
    (r"\bC\.?\s*I\.?\b|CAST\s*IRON", "CI"), (r"\bG\.?\s*I\.?\b|GALV", "GI"), (r"\bD\.?\s*I\.?\b|DUCTILE", "DI"),
    (r"\bPVC\b|\bUPVC\b|\bCPVC\b", "PVC"), (r"\bHDPE\b|\bMDPE\b|\bPE\b", "HDPE"), (r"\bM\.?\s*S\.?\b|\bMILD\s*STEEL\b", "MS"),
)
ASSETS = (
    (r"\bA\.?\s*V\.?\b|AIR\s*VALVE", "AirValve"), (r"NON\s*RETURN|\bNRV\b", "NonReturnValve"), (r"\bW\.?\s*O\.?\b|WASH\s*OUT", "WashOut"),
    (r"\bF\.?\s*H\.?\b|FIRE\s*HYDRANT|HYDRANT", "FireHydrant"), (r"\bP\s*/?\s*H\b|PUMP\s*HOUSE|PUMPHOUSE", "PumpHouse"), (r"DEAD\s*END", "DeadEnd"),
    (r"\bSLUICE\b|\bS\.?\s*V\.?\b", "SluiceValve"), (r"\bTANK\b|\bESR\b|\bGSR\b|\bSUMP\b", "Tank"),
)
#: Kinds of material by code, and Hazen-Williams coefficients.
MATERIAL_NAMES = {"CI": "CastIron", "GI": "GalvanisedIron", "DI": "DuctileIron", "PVC": "PVC", "HDPE": "HDPE", "MS": "MildSteel"}
ROUGHNESS = {"CI": 100.0, "GI": 120.0, "DI": 130.0, "PVC": 145.0, "HDPE": 145.0, "MS": 120.0, "UNK": 110.0}

_MM, _FRACTION, _INCH, _BARE = r"(\d{2,4})\s*(?:MM|M\.M\.)", r"(\d+)?\s*(\d)\s*/\s*(\d)\s*[\"”]", r"(\d+(?:\.\d+)?)\s*[\"”]", r"^(\d{2,4})$"


def first_match(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for pattern, name in reversed(patterns):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def _closest(value: Column, steps: Sequence[tuple[float, float]]) -> Column:
    """The result of the step nearest to a value, the first of equals."""
    known = F.array(*[F.struct(F.lit(float(at)).alias("at"), F.lit(i).alias("i"), F.lit(float(out)).alias("out")) for i, (at, out) in enumerate(steps)])
    near = F.transform(known, lambda s: F.struct(F.abs(value - s["at"]).alias("d"), s["i"].alias("i"), s["out"].alias("out")))
    return F.when(value.isNotNull(), F.array_min(near)["out"])


def snap(value: Column, ladder: Sequence[float]) -> Column:
    """The nearest size of a ladder, the first of equals; null for null and NaN."""
    return F.when(~F.isnan(value), _closest(value, [(v, v) for v in ladder]))


def inch_to_mm(inch: Column, ladder: Sequence[float] | None = None) -> Column:
    mm = _closest(inch, INCHES)
    return snap(mm, ladder) if ladder else mm


def next_size(required: Column, current: Column, ladder: Sequence[float]) -> Column:
    """The smallest size that is at least required (the largest, if none is),
    never below the current one."""
    sizes = F.array(*[F.lit(float(v)) for v in ladder])
    return F.greatest(current, F.coalesce(F.array_min(F.filter(sizes, lambda v: v >= required)), F.lit(float(max(ladder)))))


def parse_labels(df: DataFrame, text: str, ladder: Sequence[float] | None = None) -> DataFrame:
    """Adds diameter_mm, material and asset of the labels in a column:
    millimetres, else a fraction of inches, else inches, else a bare number
    from 15 to 2000. Null labels have none of these."""
    t, kept = F.col("__t"), df.columns
    number = lambda pattern, group: F.nullif(F.regexp_extract(t, pattern, group), F.lit("")).cast("double")
    read = df.withColumn("__t", F.trim(F.upper(text))).withColumns({
        "__mm": number(_MM, 1), "__whole": number(_FRACTION, 1), "__part": number(_FRACTION, 2) / F.nullif(number(_FRACTION, 3), F.lit(0.0)),
        "__inch": number(_INCH, 1), "__bare": number(_BARE, 1), "material": first_match(t, MATERIALS), "asset": first_match(t, ASSETS),
    })
    whole, part = F.col("__whole"), F.col("__part")
    fraction = F.when(whole != 0, whole + part).when(whole.isNull() & (part < 1), 1 + part).otherwise(part)
    read = read.withColumn("__inch", F.coalesce(fraction, "__inch"))
    mm = F.coalesce("__mm", inch_to_mm(F.col("__inch"), ladder), F.when(F.col("__bare").between(15, 2000), F.col("__bare")))
    return read.withColumn("diameter_mm", mm).select(*kept, "diameter_mm", "material", "asset")


def material_name(code: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in MATERIAL_NAMES.items() for x in pair])
    return F.coalesce(named[F.upper(code)], F.lit("UnknownMaterial"))


def roughness(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROUGHNESS.items() for x in pair])
    return F.coalesce(known[code], F.lit(ROUGHNESS["UNK"]))
