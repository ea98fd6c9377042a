"""Names that mean one field, weighted letter groups of names, and texts inside nested records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# Endings that make no other field, and names of one test, the short one first.
ENDINGS = ["_abs", "_absolute", "_count", "_level", "_result"]
ALIASES = [
    ["wbc", "white_blood_cell_count", "white_blood_cells", "wbc_count", "leukocytes"],
    ["rbc", "red_blood_cell_count", "red_blood_cells", "rbc_count", "erythrocytes"],
    ["hgb", "hemoglobin", "hb"],
    ["hct", "hematocrit", "packed_cell_volume", "pcv"],
    ["mcv", "mean_corpuscular_volume", "mean_cell_volume"],
    ["mch", "mean_corpuscular_hemoglobin", "mean_cell_hemoglobin"],
    ["mchc", "mean_corpuscular_hemoglobin_concentration"],
    ["rdw", "red_cell_distribution_width", "rdw_cv", "rdw_sd"],
    ["plt", "platelets", "platelet_count", "thrombocytes"],
    ["mpv", "mean_platelet_volume"],
    ["neut", "neutrophils", "neutrophil_count", "neut_abs", "absolute_neutrophils"],
    ["lymph", "lymphocytes", "lymphocyte_count", "lymph_abs", "absolute_lymphocytes"],
    ["mono", "monocytes", "monocyte_count", "mono_abs", "absolute_monocytes"],
    ["eos", "eosinophils", "eosinophil_count", "eos_abs", "absolute_eosinophils"],
    ["baso", "basophils", "basophil_count", "baso_abs", "absolute_basophils"],
    ["glu", "glucose", "blood_glucose", "fasting_glucose"],
    ["bun", "blood_urea_nitrogen", "urea_nitrogen"],
    ["cr", "creatinine", "serum_creatinine"],
    ["na", "sodium", "serum_sodium"],
    ["k", "potassium", "serum_potassium"],
    ["cl", "chloride", "serum_chloride"],
    ["co2", "carbon_dioxide", "bicarbonate", "hco3"],
    ["ca", "calcium", "serum_calcium"],
    ["tp", "total_protein"],
    ["alb", "albumin", "serum_albumin"],
    ["ast", "aspartate_aminotransferase", "sgot"],
    ["alt", "alanine_aminotransferase", "sgpt"],
    ["alp", "alkaline_phosphatase"],
    ["tbil", "total_bilirubin", "bilirubin_total"],
    ["dbil", "direct_bilirubin", "bilirubin_direct"],
]


def field_name(name: Column) -> Column:
    return F.translate(F.lower(name), " -", "__")


def same_field(a: Column, b: Column, groups: Sequence[Sequence[str]] = ALIASES) -> Column:
    """Whether two names mean one field: equal, equal but for an ending, or both like names of one group.

    Like is: one holds the other, so short names of a group ("k", "na") are like many.
    """
    a, b = field_name(a), field_name(b)
    bare = lambda c: F.regexp_replace(c, "(" + "|".join(ENDINGS) + ")$", "")
    known = F.array(*[F.array(*map(F.lit, g)) for g in groups])
    like = lambda c, g: F.exists(g, lambda x: c.contains(x) | x.contains(c))
    return (a == b) | (bare(a) == bare(b)) | F.exists(known, lambda g: like(a, g) & like(b, g))


def letter_groups(text: Column, least: int = 2, most: int = 4) -> Column:
    """All runs of `least` to `most` characters of a text in lower case, repeats included."""
    low = F.lower(text)
    runs = lambda n: F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: low.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[runs(n) for n in range(least, most + 1)])


def weighted_groups(texts: DataFrame, text: str) -> DataFrame:
    """(text, gram, weight) of distinct texts: count of a letter group times ln((1 + texts) / (1 + texts with it)) + 1, length 1 in all."""
    d = texts.select(text).where(F.col(text).isNotNull()).distinct()
    g = d.select(text, F.explode(letter_groups(F.col(text))).alias("gram")).groupBy(text, "gram").agg(F.count("*").alias("n"))
    held = g.groupBy("gram").agg(F.count("*").alias("df"))
    total = d.agg(F.count("*").alias("total"))
    w = g.join(held, "gram").join(F.broadcast(total)).withColumn("w", F.col("n") * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1))
    size = w.groupBy(text).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return w.join(size, text).select(text, "gram", (F.col("w") / F.col("size")).alias("weight"))


def plain_nested(value: Column, kind: DataType, clean: Callable[[Column], Column], top: bool = True) -> Column:
    """A value of any type with `clean` applied to every text inside it, however deep: in structs, maps (their values) and arrays of either.

    The type's own shape is followed, so the result has the same type. An array of texts is left as it is where it stands at the top (a list of a section), and cleaned within a record.
    Other values, map keys and nulls stay.
    """
    if isinstance(kind, StringType):
        return clean(value)
    if isinstance(kind, StructType):
        fields = [plain_nested(value[f.name], f.dataType, clean, False).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda k, v: plain_nested(v, kind.valueType, clean, False))
    if isinstance(kind, ArrayType):
        if top and isinstance(kind.elementType, (StringType, ArrayType)):
            return value
        return F.transform(value, lambda x: plain_nested(x, kind.elementType, clean, False))
    return value


def plain_sections(rows: DataFrame, columns: Sequence[str], clean: Callable[[Column], Column]) -> DataFrame:
    """`rows` with the sections in `columns` cleaned by `plain_nested`."""
    return rows.withColumns({c: plain_nested(F.col(c), rows.schema[c].dataType, clean) for c in columns})
