"""Label and flag expressions (F9-F25), as Column builders.

String comparisons that the source database made case-insensitively are
made with ``ci_eq`` (lower on both sides), so 'z Non-industrial' and
'z Non-Industrial' are the same label.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acrewise import params as P


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ci_eq(c: str | Column, value: str) -> Column:
    return F.lower(col(c)) == F.lit(value.lower())


def not_blank(c: str | Column) -> Column:
    """SQL ``c <> ''`` with trailing blanks ignored; NULL is not kept."""
    return F.rtrim(col(c)) != F.lit("")


def land_status_3(ind_type: str | Column = "ind_type") -> Column:
    """Industrial / Limited Industrial / Not Industrial."""
    t = col(ind_type)
    return (F.when((t != P.LIMITED) & t.isNotNull(), "Industrial")
            .when(t == P.LIMITED, P.LIMITED)
            .otherwise("Not Industrial"))


def land_status_2(ind_type: str | Column = "ind_type") -> Column:
    """Industrial / Limited or Not Industrial."""
    t = col(ind_type)
    return F.when((t != P.LIMITED) & t.isNotNull(), "Industrial").otherwise("Limited or Not Industrial")


def land_category(ind_type: str | Column = "ind_type", other: str | None = "Other") -> Column:
    """Aviation and Military fold into Core; NULL becomes ``other``."""
    t = col(ind_type)
    return (F.when(t.isin(*P.CORE_MEMBERS), P.CORE)
            .when(t.isNotNull(), t)
            .otherwise(F.lit(other).cast("string")))


def industrial_job(group: str | Column = "manuf_industrial_group") -> Column:
    """'Non-Industrial' for the non-industrial group, else 'Industrial'."""
    return F.when(ci_eq(group, P.NON_INDUSTRIAL_GROUP), "Non-Industrial").otherwise("Industrial")


def not_non_industrial(group: str | Column = "manuf_industrial_group") -> Column:
    """Filter ``group <> 'z Non-industrial'`` (NULL group is dropped)."""
    return F.lower(col(group)) != F.lit(P.NON_INDUSTRIAL_GROUP.lower())


def county_name_from_id(c: str | Column) -> Column:
    """33 -> King ... (numeric county id)."""
    x = col(c)
    out = None
    for cid, name in zip(P.COUNTY_IDS, P.COUNTY_NAMES):
        out = (F.when(x == cid, name) if out is None else out.when(x == cid, name))
    return out


def county_id_from_name(c: str | Column) -> Column:
    x = col(c)
    out = None
    for cid, name in zip(P.COUNTY_IDS, P.COUNTY_NAMES):
        out = (F.when(x == name, cid) if out is None else out.when(x == name, cid))
    return out


def county_name_clean(name: str | Column, code: str | Column) -> Column:
    """F8 + F9: fall back to the FLU code, then map '033' -> King etc.;
    anything else becomes NULL."""
    n = F.coalesce(col(name), col(code))
    out = F.when(n.isin(*P.COUNTY_NAMES), n)
    for fip, cname in zip(P.COUNTY_FIPS, P.COUNTY_NAMES):
        out = out.when(n == fip, cname)
    return out


def zone_class_for_parcel(ind_type: str | Column) -> Column:
    """drop-out inventory types map to ''."""
    t = col(ind_type)
    return F.when(t.isNull() | t.isin("Aviation Operations", "Military Industrial", P.LIMITED), "").otherwise(t)


def flag_preset_mysql(impval: str | Column, gross: str | Column, preset=P.PRESET_MYSQL) -> Column:
    """one-pass vacant / redevelopable flag."""
    i, g = col(impval), col(gross)
    ratio = F.try_divide(i, g)
    return (F.when(i.isNull() | (i == 0) | (g == 0), "v")
            .when(ratio < preset.vacant, "v")
            .when(ratio < preset.redevelopable, "r")
            .otherwise(""))


def flag_preset_tsql(flag: str | Column, impval: str | Column, gross: str | Column,
                     preset=P.PRESET_TSQL) -> Column:
    """three updates that only fill NULL flags, in order. The first
    reads ``impval IS NULL OR (impval < v AND flag IS NULL)`` (D13)."""
    f, i, g = col(flag), col(impval), col(gross)
    ratio = F.try_divide(i, g)
    step1 = F.when(i.isNull() | ((i < preset.vacant) & f.isNull()), F.lit("v")).otherwise(f)
    step2 = F.when((ratio < preset.vacant) & (g != 0) & step1.isNull(), F.lit("v")).otherwise(step1)
    step3 = F.when((ratio < preset.redevelopable) & (g != 0) & step2.isNull(), F.lit("r")).otherwise(step2)
    return step3


def development_flag_r(ratio: str | Column, preset=P.PRESET_R) -> Column:
    """Vacant / Redevelopable / Not Redevelopable (NULL ratio stays NULL)."""
    r = col(ratio)
    return (F.when(r < preset.vacant, "Vacant")
            .when(r < preset.redevelopable, "Redevelopable")
            .when(r >= preset.redevelopable, "Not Redevelopable"))


def urban_flag(class_desc: str | Column, juris: str | Column) -> Column:
    """Metro and not Bremerton -> 'Y', else 'N'."""
    return F.when((col(class_desc) == "Metro") & (col(juris) != "Bremerton"), "Y").otherwise("N")


def value_ratio(impval: str | Column, gross: str | Column) -> Column:
    """F16: improvement value per square foot, 0 without area, decimal(11,2)."""
    i, g = col(impval), col(gross)
    return F.when(g > 0, F.try_divide(i.cast("decimal(20,2)"), g.cast("decimal(18,2)"))) \
        .otherwise(F.lit(0)).cast("decimal(11,2)")


def ratio_r(num: str | Column, den: str | Column) -> Column:
    """R division: x/0 is Inf (x>0), NaN for 0/0 is kept out as NULL."""
    n, d = col(num), col(den)
    return (F.when(d == 0, F.when(n == 0, F.lit(None).cast("double"))
                   .otherwise(F.when(n > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))))
            .otherwise(n.cast("double") / d))


def income_bin(income: str | Column, raw_income: str | Column) -> Column:
    """income bins with an 'Else' class for present but unclassed."""
    x = col(income)
    e = P.INCOME_BIN_EDGES
    lab = P.INCOME_BIN_LABELS
    return (F.when(x < e[0], lab[0]).when(x < e[1], lab[1]).when(x < e[2], lab[2])
            .when(x < e[3], lab[3]).when(x >= e[3], lab[4])
            .when(col(raw_income).isNotNull(), lab[5]))


def label_order(c: str | Column, labels) -> Column:
    """O2: position of a label in a fixed order (0 when absent)."""
    return F.array_position(F.array(*[F.lit(v) for v in labels]), col(c))
