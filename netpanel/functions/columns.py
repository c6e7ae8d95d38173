"""Scalar functions on columns: dates, returns, variances, industry codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: scale of the range-based variance.
RANGE_SCALE = 0.3607

# SIC divisions, first and last code.
SIC_DIVISIONS = [
    (100, 999, "Agriculture, Forestry and Fishing"),
    (1000, 1499, "Mining"),
    (1500, 1799, "Construction"),
    (2000, 3999, "Manufacturing"),
    (4000, 4999, "Transportation, Communications, Electric, Gas and Sanitary service"),
    (5000, 5199, "Wholesale Trade"),
    (5200, 5999, "Retail Trade"),
    (6000, 6799, "Finance, Insurance and Real Estate"),
    (7000, 8999, "Services"),
    (9100, 9729, "Public Administration"),
    (9900, 9999, "Nonclassifiable"),
]

# The twelve industry portfolios, ticker, name and SIC ranges (first and last code).
TWELVE_SECTORS = [
    ("NoDur", "Consumer Nondurables -- Food, Tobacco, Textiles, Apparel, Leather, Toys",
     [(100, 999), (2000, 2399), (2700, 2749), (2770, 2799), (3100, 3199), (3940, 3989)]),
    ("Durbl", "Consumer Durables -- Cars, TVs, Furniture, Household Appliances",
     [(2500, 2519), (2590, 2599), (3630, 3659), (3710, 3711), (3714, 3714), (3716, 3716), (3750, 3751), (3792, 3792), (3900, 3939), (3990, 3999)]),
    ("Manuf", "Manufacturing -- Machinery, Trucks, Planes, Off Furn, Paper, Com Printing",
     [(2520, 2589), (2600, 2699), (2750, 2769), (3000, 3099), (3200, 3569), (3580, 3629), (3700, 3709), (3712, 3713), (3715, 3715), (3717, 3749), (3752, 3791), (3793, 3799), (3830, 3839), (3860, 3899)]),
    ("Enrgy", "Oil, Gas, and Coal Extraction and Products", [(1200, 1399), (2900, 2999)]),
    ("Chems", "Chemicals and Allied Products", [(2800, 2829), (2840, 2899)]),
    ("BusEq", "Business Equipment -- Computers, Software, and Electronic Equipment",
     [(3570, 3579), (3660, 3692), (3694, 3699), (3810, 3829), (7370, 7379)]),
    ("Telcm", "Telephone and Television Transmission", [(4800, 4899)]),
    ("Utils", "Utilities", [(4900, 4949)]),
    ("Shops", "Wholesale, Retail, and Some Services (Laundries, Repair Shops)", [(5000, 5999), (7200, 7299), (7600, 7699)]),
    ("Hlth", "Healthcare, Medical Equipment, and Drugs", [(2830, 2839), (3693, 3693), (3840, 3859), (8000, 8099)]),
    ("Money", "Finance", [(6000, 6999)]),
]
OTHER_SECTOR = ("Other", "Other -- Mines, Constr, BldMt, Trans, Hotels, Bus Serv, Entertainment")


def range_variance(high: Column, low: Column, base10: bool = False) -> Column:
    """Range-based variance; zero prices give NULL. base10 follows the vendor's one-argument LOG."""
    log = F.log10 if base10 else F.ln
    zero = F.lit(0)
    return F.lit(RANGE_SCALE) * F.pow(log(F.nullif(high, zero)) - log(F.nullif(low, zero)), 2)


def delisting_adjusted(ret: Column, delisting: Column) -> Column:
    zero = F.lit(0.0)
    both = (1 + F.coalesce(ret, zero)) * (1 + F.coalesce(delisting, zero)) - 1
    return F.when(ret.isNotNull() | delisting.isNotNull(), both)


def month_end(date: Column, months: int = 0) -> Column:
    return F.last_day(F.add_months(date, months))


def months_between(start: Column, end: Column) -> Column:
    return 12 * (F.year(end) - F.year(start)) + F.month(end) - F.month(start)


def back_start(sampling_date: Column, months: int) -> Column:
    """First day of the window of so many months that ends on the sampling date."""
    return F.date_add(F.last_day(F.add_months(sampling_date, -months)), 1)


def ratio(a: Column, b: Column) -> Column:
    """NULL where b is zero, instead of an error or infinity."""
    return a / F.nullif(b, F.lit(0))


def ln(x: Column) -> Column:
    return F.ln(F.nullif(x, F.lit(0)))


def ieee_ln(x: Column) -> Column:
    """ln as floating-point arithmetic has it: minus infinity at zero, NaN below, where F.ln gives NULL."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


def round_scaled(x: Column, decimals: int) -> Column:
    """Rounds by scaling, as floating-point arithmetic has it; F.round goes by the shortest decimal digits, which above
    about 1e5 may end just below or above a half that the scaled value is at. x times the scale must be finite, or x is not."""
    scale = 10.0**decimals
    return F.round(x * scale) / scale


def sic_division(code: Column) -> Column:
    out = F.lit("N/A")
    for first, last, name in reversed(SIC_DIVISIONS):
        out = F.when(code.between(first, last), F.lit(name)).otherwise(out)
    return out


def twelve_sectors(spark: SparkSession) -> DataFrame:
    """first, last, ticker, name: under sixty rows, to be broadcast."""
    rows = [(a, b, t, n) for t, n, ranges in TWELVE_SECTORS for a, b in ranges]
    return spark.createDataFrame(rows, "first int, last int, ff_ticker string, ff_sector string")


def with_twelve_sectors(df: DataFrame, code: str) -> DataFrame:
    """Adds ff_ticker and ff_sector by a broadcast range join; codes in no range are Other."""
    lookup = F.broadcast(twelve_sectors(df.sparkSession))
    joined = df.join(lookup, F.col(code).between(F.col("first"), F.col("last")), "left").drop("first", "last")
    return joined.withColumn("ff_ticker", F.coalesce("ff_ticker", F.lit(OTHER_SECTOR[0]))).withColumn("ff_sector", F.coalesce("ff_sector", F.lit(OTHER_SECTOR[1])))


def title_case(x: Column) -> Column:
    """Each word's first letter upper, the rest lower, also after an ampersand."""
    return F.array_join(F.transform(F.split(F.initcap(F.lower(x)), "&"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), "&")


def initials(x: Column) -> Column:
    return F.array_join(F.transform(F.split(x, " "), lambda p: F.substring(p, 1, 1)), "")
