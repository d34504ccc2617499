"""Vector arithmetic on ARRAY<FLOAT> columns, in DOUBLE, as built-in expressions; and their SQL names."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The sum of products, left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / F.nullif(both, F.lit(0.0))).otherwise(F.lit(0.0))


def let(value: Column, body) -> Column:
    """body(value), with value computed once: inside of a lambda it would be computed for every element."""
    return F.transform(F.array(value), body)[0]


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is.  Elements are doubles."""
    return let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / F.nullif(n, F.lit(0.0)))).otherwise(F.transform(a, lambda x: x.cast("double"))))


def q8_scale(a: Column) -> Column:
    """The largest magnitude / 127; 1 for a vector of zeros."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    return F.when(top > 1.1920928955078125e-07, top / 127).otherwise(F.lit(1.0))


def q8_codes(a: Column, scale: Column) -> Column:
    """Each element over the scale, rounded half away from zero, within -127 and 127."""
    return let(scale, lambda s: F.transform(a, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / s).cast("int"))).cast("tinyint")))


def q8_quantize(a: Column) -> Column:
    """STRUCT<scale: DOUBLE, data: ARRAY<TINYINT>>."""
    return let(q8_scale(a), lambda s: F.struct(s.alias("scale"), F.transform(a, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / s).cast("int"))).cast("tinyint")).alias("data")))


def q8_dot(a: Column, b: Column) -> Column:
    """Dot product of two quantised vectors."""
    whole = F.aggregate(F.zip_with(a["data"], b["data"], lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return whole * (a["scale"] * b["scale"])


def embed(text: Column, dim: int = 384) -> Column:
    """A stand-in for a text model.  ``TEST_VEC:1.0,0.5`` is that vector, if all parts are numbers; any other text gets ``dim``
    reproducible numbers in [0, 1) from its crc32, without meaning."""
    parts = F.split(F.substring(text, 10, 1 << 20), ",")
    numbers = F.transform(parts, lambda p: F.trim(p).try_cast("float"))
    literal = text.startswith("TEST_VEC:") & F.forall(numbers, lambda x: x.isNotNull())
    hashed = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.pmod(F.xxhash64(F.crc32(text.cast("binary")), i), F.lit(1 << 24)) / float(1 << 24)).cast("float"))
    return F.when(literal, numbers).otherwise(hashed)


#: SQL functions for query texts: name -> (parameters, result type, body).
_SQL = {
    "dot_product": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vector_norm": ("a ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "cosine_similarity": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        "coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))), 0D)",
    ),
    "l2_normalize": ("a ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(array(sqrt(aggregate(a, 0D, (s, y) -> s + y * y))), n -> transform(a, x -> coalesce(try_divide(x, n), x)))[0]"),
    "q8_scale": ("a ARRAY<DOUBLE>", "DOUBLE", "transform(array(array_max(transform(a, y -> abs(y)))), m -> if(m > 1.1920928955078125e-07, m / 127, 1D))[0]"),
    "q8_quantize": (
        "a ARRAY<DOUBLE>",
        "ARRAY<TINYINT>",
        "transform(array(array_max(transform(a, y -> abs(y)))), m -> transform(a, x -> cast(greatest(-127, least(127, cast(round(x / if(m > 1.1920928955078125e-07, m / 127, 1D)) as int))) as tinyint)))[0]",
    ),
    "q8_dot": ("a ARRAY<TINYINT>, a_scale DOUBLE, b ARRAY<TINYINT>, b_scale DOUBLE", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> cast(x as bigint) * cast(y as bigint)), 0L, (s, x) -> s + x) * (a_scale * b_scale)"),
}


def register(spark: SparkSession) -> None:
    """Make the functions available to SQL texts of this session."""
    for name, (parameters, result, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
