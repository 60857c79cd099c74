"""Column profiles per load, and the loads in which a column departs from its ordinary state.

A profile row holds what merges: row, null and violation counts, the range and
exact power sums of a column in one load. Profiles of disjoint rows, made at
any time and without knowing of each other, merge by adding
(``merge_profiles``); only distinct counts and usual values need the values.

Power sums are exact. A number is a whole number ``k`` of a unit that its own
value sets, never the column: hundredths, if it has no more than two places;
else the unit of its 17th digit, which every double and text number fits.
Sums of ``k`` to ``k^4`` are kept by unit, each in limbs to the base 10^18, so
none can overflow and no value, however large, coarsens another.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import lenient_double
from ..session import written

WHOLE_NUMBER = r"^(?:0|[1-9][0-9]*)\z"


@dataclass(frozen=True)
class Limits:
    """From where a departure is clear.

    z: deviations from the median of the loads, in robust standard deviations
    that also hold the sampling error of a load of that size. The others are
    the least effects: rate (difference of shares), mean (in ordinary standard
    deviations), spread (log ratio of standard deviations), shape (difference
    of standardised third moments), distinct (ratio to what the rows let
    expect, each way), reach (how far, in ordinary ranges, a value lies outside
    the ordinary range), mix (share of rows that would have to change their
    value). rate, mean, spread, shape and mix hold for columns that vary; of
    others ``steady`` deviations between loads are enough, from ``part`` of the
    effect on. A value of ``usual`` share is gone below ``gone`` of it.

    Some kinds say nothing of few values and are left to the others there:
    a fall of distinct counts below ``least_distinct`` expected ones (what
    vanishes of a small domain shows in its shares), a spread of nothing below
    ``least_spread`` values, a shape below ``least_shape`` values, and
    everything in columns of fewer than ``least_loads`` loads, which have no
    ordinary state.
    """

    z: float = 6.0
    rate: float = 0.1
    mean: float = 0.35
    spread: float = 0.35
    shape: float = 1.0
    distinct: float = 0.65
    reach: float = 3.0
    mix: float = 0.2
    steady: float = 10.0
    part: float = 0.25
    usual: float = 0.025
    gone: float = 0.2
    least_distinct: int = 30
    least_spread: int = 30
    least_shape: int = 200
    least_loads: int = 4


#: Values of at least this share of a load's filled rows are kept in its profile: 200 at most.
COMMON = 0.005


def column_values(df: DataFrame, load: str, columns: list[str]) -> DataFrame:
    """(load_id, column_name, value, n): the distinct values of each column and load with their rows.

    One scan and one exchange, combined on the map side; null and empty values
    share the null row. A value that holds a third of all rows is one counter.
    """
    cols = [F.struct(F.lit(c).alias("c"), F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")).alias("v")) for c in columns]
    return df.select(F.col(load).alias("load_id"), F.explode(F.array(*cols)).alias("x")).groupBy("load_id", F.col("x.c").alias("column_name"), F.col("x.v").alias("value")).agg(F.count(F.lit(1)).alias("n"))


BASE = 10**18
#: The limbs of each power sum: ``s3_1`` counts 10^18 cubes of the unit.
LIMBS = ["s1_0", "s2_0", "s2_1", "s3_0", "s3_1", "s3_2", "s4_0", "s4_1", "s4_2", "s4_3"]


def _whole(value: Column, x: Column, exact: Column) -> tuple[Column, Column]:
    """(k, unit): a number as a whole number k below 10^18 of 10^unit.

    ``exact`` has it as a decimal of two places where its type is one of them;
    else ``value`` (its text) and the double ``x`` are read.
    """
    cents = (F.abs(x) < 1e13) & (F.round(x * 100) / 100 == x)
    digits = F.format_string("%.16e", x)
    mantissa = F.regexp_replace(F.substring_index(digits, "e", 1), "[.]", "").try_cast("decimal(18,0)")
    place = F.substring_index(digits, "e", -1).try_cast("int") - 16
    fixed = F.abs(exact) < F.lit(Decimal(BASE // 100))
    k = F.when(fixed, (exact * 100).cast("decimal(18,0)")).when(cents, F.round(x * 100).cast("decimal(18,0)")).otherwise(mantissa)
    return k, F.when(fixed | cents, F.lit(-2)).when(x.isNotNull(), place)


def _limbs(k: Column, n: Column) -> dict[str, Column]:
    """The limbs of n times k, k^2, k^3 and k^4. Each is below 4 * 10^18 for a value, so 10^19 rows can be summed."""
    base = F.lit(Decimal(BASE))

    def split(x: Column) -> tuple[Column, Column]:
        x = x.cast("decimal(38,0)")
        return (x % base).cast("decimal(19,0)"), F.call_function("div", x, base).cast("decimal(19,0)")

    low, high = split(k * k)
    a0, a1 = split(k.cast("decimal(19,0)") * low)
    b0, b1 = split(k.cast("decimal(19,0)") * high)
    c0, c1 = split(low * low)
    d0, d1 = split(F.lit(Decimal(2)) * low * high)
    e0, e1 = split(high * high)
    terms = dict(zip(LIMBS, (k, low, high, a0, a1 + b0, b1, c0, c1 + d0, d1 + e0, e1)))
    return {c: F.sum((t.cast("decimal(20,0)") * n.cast("decimal(17,0)")).cast("decimal(38,0)")).alias(c) for c, t in terms.items()}


def profile(df: DataFrame, load: str, columns: list[str] | None = None, patterns: dict[str, str] | None = None) -> DataFrame:
    """A row per load and column: counts, exact distincts, range, violations and power sums.

    Values are text, number or time; numbers are read from text where it is
    one, times as seconds. ``patterns`` gives the regular expression that the
    non-empty values of a column should match. Columns of nulls have zero
    distincts and null ranges; an empty table gives an empty profile; a null
    load is a load of its own. ``common`` has the values of at least ``COMMON``
    of a load's rows with their counts, ``sums`` the power sums by unit.

    The rows are read once for the values, once more for the load alone.
    Exact distincts need the exchange of each load's distinct values, combined
    on the map side. The power sums are made behind it, of each value once, and
    once more combined on the map side; per load a few numbers are exchanged.
    """
    columns = columns or [c for c in df.columns if c != load]
    values = column_values(df, load, columns)
    kinds = {c: df.schema[c].dataType for c in columns}
    name, v, n = F.col("column_name"), F.col("value"), F.col("n")

    def those(*types: type) -> Column:
        return name.isin([c for c in columns if isinstance(kinds[c], types)])

    num = F.coalesce(lenient_double(v), F.when(those(T.BooleanType), (v == "true").cast("double")))
    num = F.when(those(T.TimestampType, T.TimestampNTZType, T.DateType), F.unix_seconds(F.try_to_timestamp(v)).cast("double")).otherwise(num)
    num = F.when(F.abs(num) < float("inf"), num)
    places = [c for c in columns if isinstance(kinds[c], T.IntegralType) or isinstance(kinds[c], T.DecimalType) and kinds[c].scale <= 2]
    exact = F.when(name.isin(places), v.try_cast("decimal(38,2)"))
    bad = F.lit(0)
    for c, p in (patterns or {}).items():
        bad = F.when((name == c) & ~v.rlike(p), n).otherwise(bad)
    totals = df.groupBy(F.col(load).alias("__load")).agg(F.count(F.lit(1)).alias("__rows"))
    values = values.join(F.broadcast(totals), F.col("load_id").eqNullSafe(F.col("__load"))).drop("__load")
    d = values.withColumn("x", num)
    k, unit = _whole(v, F.col("x"), exact)
    d = d.withColumn("k", k).withColumn("unit", unit)
    units = d.groupBy("load_id", "column_name", "unit").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(v.isNull(), n).otherwise(0)).alias("n_null"),
        F.count(v).alias("n_distinct"),
        F.sum(F.when(v.isNotNull(), bad).otherwise(0)).alias("n_violations"),
        F.min(v).alias("min_text"),
        F.max(v).alias("max_text"),
        F.min("x").alias("min_value"),
        F.max("x").alias("max_value"),
        F.sum(F.when(F.col("k").isNotNull(), n).otherwise(0)).alias("s0"),
        *_limbs(F.col("k"), n).values(),
        F.collect_list(F.when(v.isNotNull() & (n >= COMMON * F.col("__rows")), F.struct(v.alias("value"), n.alias("n")))).alias("common"),
    )
    return units.groupBy("load_id", "column_name").agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "n_null", "n_distinct", "n_violations", "s0")],
        *[F.min(c).alias(c) for c in ("min_text", "min_value")],
        *[F.max(c).alias(c) for c in ("max_text", "max_value")],
        F.array_sort(F.collect_list(F.when(F.col("unit").isNotNull(), F.struct("unit", "s0", *LIMBS)))).alias("sums"),
        F.array_sort(F.flatten(F.collect_list("common"))).alias("common"),
    )


SUMS = ["n_rows", "n_null", "n_violations", "s0"]


def merge_profiles(*profiles: DataFrame) -> DataFrame:
    """Profiles of disjoint rows as one; distinct counts and common values can't be merged and come out null."""
    out = profiles[0]
    for p in profiles[1:]:
        out = out.unionByName(p)
    # a row per unit; what a profile has once counts at its first unit only
    out = out.select("*", F.posexplode_outer("sums").alias("__i", "__s")).withColumn("__i", F.coalesce("__i", F.lit(0)) == 0)
    once = [F.sum(F.when(F.col("__i"), F.col(c)).otherwise(0)).alias(c) for c in SUMS]
    ranges = [*[F.min(c).alias(c) for c in ("min_text", "min_value")], *[F.max(c).alias(c) for c in ("max_text", "max_value")]]
    units = out.groupBy("load_id", "column_name", F.col("__s.unit").alias("unit")).agg(*once, F.sum("__s.s0").alias("__s0"), *ranges, *[F.sum(f"__s.{c}").alias(c) for c in LIMBS])
    sums = F.array_sort(F.collect_list(F.when(F.col("unit").isNotNull(), F.struct("unit", F.col("__s0").alias("s0"), *LIMBS)))).alias("sums")
    merged = units.groupBy("load_id", "column_name").agg(*[F.sum(c).alias(c) for c in SUMS], *ranges, sums)
    return merged.withColumns({"n_distinct": F.lit(None).cast("long"), "common": F.lit(None).cast("array<struct<value:string,n:bigint>>")})


def _totals(sums: list[dict]) -> list[Fraction]:
    """The exact power sums 0 to 4 of the numbers of a row's ``sums``."""
    out = [Fraction(0)] * 5
    for x in sums:
        unit = Fraction(10) ** int(x["unit"])
        out[0] += int(x["s0"])
        for c in LIMBS:
            power, limb = int(c[1]), int(c[3])
            out[power] += int(x[c]) * BASE**limb * unit**power
    return out


def _plain(x: Fraction) -> str:
    """A fraction of a power of ten as decimal text."""
    places = 0
    while x.denominator > 1:
        x, places = x * 10, places + 1
    digits = str(abs(x.numerator)).rjust(places + 1, "0")
    return "-" * (x < 0) + (f"{digits[:-places]}.{digits[-places:]}" if places else digits)


def _root(x: Fraction) -> float:
    """The square root of a fraction that may lie beyond any double."""
    with localcontext(prec=40):
        return float((Decimal(x.numerator) / Decimal(x.denominator)).sqrt())


def power_sums(p: DataFrame) -> DataFrame:
    """Adds s1 to s4, the exact sums of the numbers and of their powers, as decimal text; null where there are none."""

    @F.pandas_udf("s1 string, s2 string, s3 string, s4 string")
    def text(sums: pd.Series) -> pd.DataFrame:
        rows = [[_plain(s) for s in _totals(x)[1:]] if x is not None and len(x) else [None] * 4 for x in sums]
        return pd.DataFrame(rows, columns=["s1", "s2", "s3", "s4"])

    return p.withColumn("__t", text("sums")).withColumns({f"s{i}": F.col(f"__t.s{i}") for i in range(1, 5)}).drop("__t")


def moments(p: DataFrame) -> DataFrame:
    """Adds mean, standard deviation and standardised third and fourth moments, from the power sums.

    They are exact up to the last rounding, whatever the distance of the
    numbers from zero: whole numbers of any size are reckoned with, of one row
    per load and column.
    """

    @F.pandas_udf("mean double, sd double, skew double, kurt double")
    def central(sums: pd.Series) -> pd.DataFrame:
        rows = []
        for x in sums:
            n, *s = _totals(x if x is not None else [])
            if not n:
                rows.append([None] * 4)
                continue
            m = s[0] / n
            var = s[1] / n - m * m
            third = s[2] / n - 3 * m * s[1] / n + 2 * m**3
            fourth = s[3] / n - 4 * m * s[2] / n + 6 * m * m * s[1] / n - 3 * m**4
            skew = _root(third * third / var**3) * (-1 if third < 0 else 1) if var else None
            rows.append([float(m), _root(var), skew, float(fourth / (var * var)) if var else None])
        return pd.DataFrame(rows, columns=["mean", "sd", "skew", "kurt"], dtype="float64")

    return p.withColumn("__m", central("sums")).withColumns({c: F.col(f"__m.{c}") for c in ("mean", "sd", "skew", "kurt")}).drop("__m")


def _mixes(p: DataFrame, keys: list[str], limits: Limits) -> DataFrame:
    """Adds mix (distance of the shares of usual values from their medians), mix_error and gone (some value all but missing).

    Shares are of the filled rows. A value is usual by its median share over
    the loads, so a column has 1/usual of them at most.
    """
    filled = (F.col("n_rows") - F.col("n_null")).cast("double")
    some = p.where(filled > 0)
    loads = some.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("__l"))
    seen = some.select(*keys, filled.alias("__f"), F.explode("common").alias("c")).groupBy(*keys, F.col("c.value").alias("value")).agg(F.collect_list(F.col("c.n") / F.col("__f")).alias("s")).join(loads, keys)
    half = (F.col("__l") / 2).cast("int")
    # loads without the value have the share 0
    seen = seen.withColumn("s", F.concat("s", F.array_repeat(F.lit(0.0), F.col("__l") - F.size("s"))))
    seen = seen.withColumn("q", F.get(F.array_sort("s"), half)).where(F.col("q") >= limits.usual)
    seen = seen.withColumn("mad", 1.4826 * F.get(F.array_sort(F.transform("s", lambda x: F.abs(x - F.col("q")))), half))
    usual = seen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("value", "q", "mad"))).alias("__u"))
    p = p.join(usual, keys, "left").withColumn("__c", F.map_from_entries("common"))
    p = p.withColumn("__s", F.when(filled > 0, F.transform("__u", lambda u: F.struct((F.coalesce(F.try_element_at("__c", u["value"]), F.lit(0)) / filled).alias("s"), u["q"].alias("q"), u["mad"].alias("mad")))))
    zero = F.lit(0.0)
    rest = F.abs(F.aggregate("__s", zero, lambda a, x: a + x["s"] - x["q"]))
    mix = (F.aggregate("__s", zero, lambda a, x: a + F.abs(x["s"] - x["q"])) + rest) / 2
    error = F.aggregate("__s", zero, lambda a, x: a + F.sqrt(x["q"] / filled)) / 2
    gone = F.exists("__s", lambda x: (x["s"] < limits.gone * x["q"]) & (x["q"] - x["s"] > limits.z * F.sqrt(x["mad"] * x["mad"] + x["q"] / filled)))
    return p.withColumns({"mix": mix, "mix_error": error, "gone": gone}).drop("__u", "__c", "__s")


def departures(profiles: DataFrame, limits: Limits = Limits(), by: list[str] | None = None) -> DataFrame:
    """Compare each load with the median of all loads of its column.

    Input: rows of ``profile`` (with a table_name, if several tables are
    together: ``by=["table_name"]``). Adds a score per kind of departure, the
    boolean ``departs`` and ``reasons``. Medians and median deviations are
    taken over the loads, so a few bad loads don't move them; a column with
    fewer than ``least_loads`` loads has no ordinary state and no departures. Per column
    there is one row per load, so the grouped percentiles stay small.
    """
    keys = [*(by or []), "column_name"]
    # read several times from here on
    p = _mixes(written(moments(profiles), "moments"), keys, limits)
    n, filled = F.col("n_rows").cast("double"), (F.col("n_rows") - F.col("n_null")).cast("double")
    p = p.withColumn("null_rate", F.col("n_null") / n).withColumn("violation_rate", F.when(filled > 0, F.col("n_violations") / filled))
    p = p.withColumn("log_sd", F.when(F.col("sd") > 0, F.log("sd")))
    w = Window.partitionBy(*keys)
    watched = ["null_rate", "violation_rate", "mean", "log_sd", "skew", "mix"]
    med = {c: F.expr(f"percentile({c}, 0.5)").over(w) for c in [*watched, "n_rows", "n_distinct", "min_value", "max_value", "sd"]}
    p = p.withColumns({f"med_{c}": e for c, e in med.items()}).withColumn("loads", F.count(F.lit(1)).over(w))
    p = p.withColumns({f"dev_{c}": F.abs(F.col(c) - F.col(f"med_{c}")) for c in watched})
    p = p.withColumns({f"mad_{c}": 1.4826 * F.expr(f"percentile(dev_{c}, 0.5)").over(w) for c in watched})
    size = F.greatest(F.col("s0").cast("double"), F.lit(1.0))

    def z(c: str, se2: Column) -> Column:
        return F.col(f"dev_{c}") / F.sqrt(F.pow(F.col(f"mad_{c}"), F.lit(2.0)) + se2 + F.lit(1e-24))

    def share_error(c: str, of: Column) -> Column:
        q = F.greatest(F.least(F.col(f"med_{c}"), 1 - F.col(f"med_{c}")), 1 / F.greatest(of, F.lit(1.0)))
        return q / F.greatest(of, F.lit(1.0))

    sd0 = F.col("med_sd")
    effect_mean = F.when(sd0 > 0, F.col("dev_mean") / sd0).otherwise(F.when(F.col("dev_mean") > 0, F.lit(1e9)).otherwise(0.0))
    reach0 = F.col("med_max_value") - F.col("med_min_value")
    reach0 = F.when(reach0 > 0, reach0).otherwise(F.greatest(F.abs(F.col("med_max_value")), F.lit(1e-9)))
    out_of_range = F.greatest(F.col("max_value") - F.col("med_max_value"), F.col("med_min_value") - F.col("min_value")) / reach0
    # distinct counts follow the rows at most in proportion and at least not at all
    d0, ratio = F.col("med_n_distinct"), n / F.col("med_n_rows")
    low, high = d0 * F.least(ratio, F.lit(1.0)), d0 * F.greatest(ratio, F.lit(1.0))
    slack = F.lit(limits.distinct) - F.lit(4.0) / F.sqrt(F.greatest(low, F.lit(1.0)))
    few = (low >= limits.least_distinct) & (F.col("n_distinct") < low * F.greatest(slack, F.lit(0.1)))
    many = F.col("n_distinct") > high / F.lit(limits.distinct) + 4 * F.sqrt(high) + 2
    p = p.withColumns(
        {
            "z_null": z("null_rate", share_error("null_rate", n)),
            "z_violation": z("violation_rate", share_error("violation_rate", filled)),
            "z_mean": z("mean", sd0 * sd0 / size),
            "z_spread": z("log_sd", 0.5 * F.greatest(F.col("kurt") - 1, F.lit(2.0)) / 2 / size),
            "z_shape": z("skew", 6 / size),
            "z_mix": z("mix", F.col("mix_error") * F.col("mix_error")),
            "effect_mean": effect_mean,
            "out_of_range": out_of_range,
        }
    )
    clear = F.lit(limits.z)

    def least(effect: float, c: str, unit: Column = F.lit(1.0)) -> Column:
        own = F.when(unit > 0, limits.steady * F.col(f"mad_{c}") / unit)
        return F.least(F.lit(effect), F.greatest(F.lit(limits.part * effect), own))

    kinds = {
        "null_rate": (F.col("z_null") > clear) & (F.col("dev_null_rate") > least(limits.rate, "null_rate")),
        "pattern": (F.col("z_violation") > clear) & (F.col("dev_violation_rate") > least(limits.rate, "violation_rate")),
        "mean": (F.col("z_mean") > clear) & (F.col("effect_mean") > least(limits.mean, "mean", sd0)),
        "spread": ((F.col("z_spread") > clear) & (F.col("dev_log_sd") > least(limits.spread, "log_sd"))) | ((F.col("sd") <= 0) & (sd0 > 0) & (size >= limits.least_spread)),
        "shape": (F.col("z_shape") > clear) & (F.col("dev_skew") > least(limits.shape, "skew")) & (size >= limits.least_shape),
        "range": F.col("out_of_range") > limits.reach,
        "distinct": few | many,
        "mix": F.col("gone") | ((F.col("z_mix") > clear) & (F.col("mix") > F.col("med_mix")) & (F.col("dev_mix") > least(limits.mix, "mix"))),
    }
    reasons = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]), lambda x: x.isNotNull())
    p = p.withColumn("reasons", F.when(F.col("loads") >= limits.least_loads, reasons).otherwise(F.array().cast("array<string>")))
    return p.withColumn("departs", F.size("reasons") > 0)
