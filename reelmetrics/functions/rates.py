"""Frame-rate text and exact rational rates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelmetrics.functions.once import let

# Rate tolerance, float scale, NTSC rates, variable-rate ratio.
TOLERANCE = 0.01
FLOAT_SCALE = 100000
NTSC30 = (30000, 1001)
NTSC24 = (24000, 1001)
NTSC60 = (60000, 1001)
VARIABLE_RATIO = 1.05

_FRACTION = r"^\s*([+-]?[0-9]+)\s*/\s*([+-]?[0-9]+)\s*$"
_DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor; 48 Euclid steps settle any two 32-bit integers."""
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(
        F.struct(s["b"].alias("a"), F.coalesce(F.try_mod(s["a"], s["b"]), F.lit(0)).alias("b"))
    )
    start = F.struct(F.coalesce(a, F.lit(0)).alias("a"), F.coalesce(b, F.lit(0)).alias("b"))
    euclid = F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, step, lambda s: s["a"])
    return F.when(b == 1, F.lit(1)).when(F.try_mod(a, b) == 0, b).otherwise(euclid)


def rate(text: Column) -> Column:
    """`num/den` or decimal text to a reduced struct<num,den>; null when unusable."""
    read = F.struct(
        F.regexp_extract(text, _FRACTION, 1).try_cast("int").alias("num"),
        F.regexp_extract(text, _FRACTION, 2).try_cast("int").alias("den"),
        F.when(text.rlike(_DECIMAL), F.trim(text).try_cast("double")).alias("value"),
    )

    def chosen(r: Column) -> Column:
        whole = (r["num"] > 0) & (r["den"] > 0)
        n = F.when(whole, r["num"]).when(r["value"] > 0, F.rint(r["value"] * FLOAT_SCALE).try_cast("int"))
        d = F.when(whole, r["den"]).when(r["value"] > 0, F.lit(FLOAT_SCALE))
        return F.struct(n.alias("n"), d.alias("d"))

    def reduced(r: Column) -> Column:
        by = lambda g: F.struct(
            F.floor(r["n"] / g).cast("int").alias("num"), F.floor(r["d"] / g).cast("int").alias("den")
        )
        usable = r["n"].isNotNull() & r["d"].isNotNull()
        return F.when(usable, let(F.greatest(gcd(r["n"], r["d"]), F.lit(1)), by))

    return let(let(read, chosen), reduced)


def as_double(r: Column) -> Column:
    return F.try_divide(r["num"].cast("double"), r["den"].cast("double"))


def close_to(value: Column, pair: tuple[int, int], tolerance: float = TOLERANCE) -> Column:
    return F.abs(value - F.lit(pair[0] / pair[1])) < tolerance


def is_ntsc30(value: Column) -> Column:
    return F.coalesce(close_to(value, NTSC30), F.lit(False))


def is_ntsc_family(value: Column) -> Column:
    near = close_to(value, NTSC30) | close_to(value, NTSC24) | close_to(value, NTSC60)
    return F.coalesce(near, F.lit(False))


def is_constant(nominal: Column, average: Column) -> Column:
    """Constant unless both rates are known and the nominal one is 5 % above the mean."""
    return F.coalesce(F.try_divide(nominal, average) < VARIABLE_RATIO, F.lit(True))


def rate_text(r: Column) -> Column:
    return F.when(r["den"] == 1, r["num"].cast("string")).otherwise(
        F.concat_ws("/", r["num"].cast("string"), r["den"].cast("string"))
    )


def rate_columns(nominal: str = "r_frame_rate", average: str = "avg_frame_rate") -> dict[str, Column]:
    """Everything derived from a stream's two rate texts; apply in order with `add_rates`."""
    return {"nominal_rate": rate(F.col(nominal)), "average_rate": rate(F.col(average))}


def add_rates(rows, nominal: str = "r_frame_rate", average: str = "avg_frame_rate"):
    rows = rows.withColumns(rate_columns(nominal, average))
    rows = rows.withColumn("rate", F.coalesce("nominal_rate", "average_rate"))
    rows = rows.withColumn("fps", as_double(F.col("rate")))
    return rows.withColumns(
        {
            "rate_text": F.when(F.col("rate").isNotNull(), rate_text(F.col("rate"))),
            "is_ntsc": is_ntsc_family(F.col("fps")),
            "is_ntsc30": is_ntsc30(F.col("fps")),
            "is_cfr": is_constant(as_double(F.col("nominal_rate")), as_double(F.col("average_rate"))),
        }
    )
