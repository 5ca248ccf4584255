"""Material compositions: parsing and quality scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hemline.constants import (
    COMPOSITION_SEPARATORS,
    MATERIAL_BASES,
    MATERIAL_SCORES,
    MATERIAL_SYNONYM,
    NOT_MATERIAL,
    PERCENT_MATERIAL,
    UNKNOWN_MATERIAL_SCORE,
)
from hemline.functions.common import ColumnLike, col, let, strip


def composition_from_attrs(text: ColumnLike) -> Column:
    """The first ``Composition`` value in a bracketed list of one-key maps.

    The JSON reader takes the single quotes of the listing as they are; text it
    cannot read gives null.
    """
    text = strip(text)
    listed = F.when(text.startswith("[") & text.endswith("]"), text)
    maps = F.from_json(listed, "array<map<string,string>>")
    return F.get(F.filter(maps, lambda m: F.map_contains_key(m, "Composition")), F.lit(0))["Composition"]


def _read_part(part: Column) -> Column:
    """One part of a composition: its material and the share it states, if any."""
    stated = F.regexp_extract(part, PERCENT_MATERIAL, 1)
    return (
        F.when(
            stated != "",
            F.struct(
                strip(F.regexp_extract(part, PERCENT_MATERIAL, 2)).alias("material"),
                F.least(stated.try_cast("double") / 100.0, F.lit(1.0)).alias("frac"),
                F.lit(True).alias("kept"),
            ),
        )
        .otherwise(let(
            strip(F.regexp_replace(part, NOT_MATERIAL, "")),
            lambda name: F.struct(
                name.alias("material"), F.lit(0.0).alias("frac"), (name != "").alias("kept"),
            ),
        ))
    )


def parse_materials(composition: ColumnLike) -> Column:
    """``array<struct<material, frac>>`` whose fractions sum to 1; empty if nothing is read."""
    parts = F.filter(
        F.transform(F.split(F.lower(col(composition)), COMPOSITION_SEPARATORS), strip),
        lambda part: part != "",
    )
    readings = F.filter(F.transform(parts, _read_part), lambda r: r["kept"])

    def shares(read: Column) -> Column:
        stated = F.aggregate(read, F.lit(0.0), lambda total, r: total + r["frac"])
        return let(stated, lambda total: F.transform(read, lambda r: F.struct(
            r["material"].alias("material"),
            F.when(total > 0, r["frac"] / total).otherwise(F.lit(1.0) / F.size(read)).alias("frac"),
        )))

    empty = F.array().cast("array<struct<material:string,frac:double>>")
    return F.coalesce(let(readings, shares), empty)


def canonical_material(material: ColumnLike) -> Column:
    """Collapse variants of a material to the name its score is listed under."""
    named = F.replace(strip(material), *[F.lit(word) for word in MATERIAL_SYNONYM])
    return let(named, lambda m: F.coalesce(
        *[F.when(F.contains(m, F.lit(base)), F.lit(base)) for base in MATERIAL_BASES], m,
    ))


def material_score(material: ColumnLike, scores=MATERIAL_SCORES,
                   unknown: float = UNKNOWN_MATERIAL_SCORE) -> Column:
    """Score of the first listed key contained in the canonical name."""
    return let(canonical_material(material), lambda m: F.coalesce(
        *[F.when(F.contains(m, F.lit(key)), F.lit(score)) for key, score in scores], F.lit(unknown),
    ))


def material_quality_score(composition: ColumnLike, scores=MATERIAL_SCORES,
                           unknown: float = UNKNOWN_MATERIAL_SCORE) -> Column:
    """Sum of fraction times score; null if the composition names no material."""
    return let(parse_materials(composition), lambda parsed: F.when(
        F.size(parsed) > 0,
        F.aggregate(parsed, F.lit(0.0), lambda total, part:
                    total + part["frac"] * material_score(part["material"], scores, unknown)),
    ))
