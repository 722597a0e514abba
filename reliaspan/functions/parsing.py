"""Text clean-up and lenient parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reliaspan.functions.reliability import as_col

# Terms that mark a healthy participant.
HEALTHY_TERMS = (
    "control", "healthy", "healthy control", "hc", "normal", "ctrl", "nor", "healthy_control", "con", "nc",
    "mc", "eb", "lb",
)


def parse_number(text) -> Column:
    """Number, or NULL when the trimmed text is not one."""
    return F.expr("try_cast(trim({}) as double)".format(text)) if isinstance(text, str) else F.trim(text).try_cast("double")


def parse_age(text) -> Column:
    """A number, or the midpoint of a range such as 20-25; NULL for blanks and other text."""
    s = F.trim(as_col(text))
    lo = F.regexp_extract(s, r"^([^-]+)-([^-]+)", 1).try_cast("double")
    hi = F.regexp_extract(s, r"^([^-]+)-([^-]+)", 2).try_cast("double")
    ranged = s.contains("-") & ~s.startswith("-")
    value = F.when(ranged, (lo + hi) / 2).otherwise(s.try_cast("double"))
    return F.when(s.isin("", "n/a", "nan"), None).otherwise(F.nanvl(value, F.lit(None).cast("double")))


def normalise_sex(text) -> Column:
    s = F.upper(F.trim(F.coalesce(as_col(text), F.lit(""))))
    return F.when(s.isin("M", "MALE"), "M").when(s.isin("F", "FEMALE"), "F").otherwise("U")


def is_healthy(text) -> Column:
    return F.coalesce(F.lower(F.trim(as_col(text))).isin(*HEALTHY_TERMS), F.lit(False))


def group_from_dx(dx) -> Column:
    """0 -> Control, 1/2/3 -> ADHD, anything else -> Unknown."""
    s = F.trim(as_col(dx).cast("string"))
    return F.when(s == "0", "Control").when(s.isin("1", "2", "3"), "ADHD").otherwise("Unknown")


def sex_from_code(code) -> Column:
    s = F.trim(as_col(code).cast("string"))
    return F.when(s == "1", "M").when(s == "0", "F").otherwise("Unknown")


def group_from_flags(dx, adhd, tdc) -> Column:
    """Diagnosis code first, then the patient flag, then the control flag."""
    dx, adhd, tdc = (F.trim(F.coalesce(as_col(c).cast("string"), F.lit(""))) for c in (dx, adhd, tdc))
    code = F.floor(dx.try_cast("double"))
    from_dx = F.when(code.isNull(), "Unknown").when(code == 0, "Control").otherwise("ADHD")
    return (
        F.when(dx != "", from_dx)
        .when(adhd != "", F.when(adhd == "1", "ADHD").otherwise("Control"))
        .when(tdc != "", F.when(tdc == "1", "Control").otherwise("ADHD"))
        .otherwise("Unknown")
    )


def strip_leading_zeros(text) -> Column:
    """Digits-only ids lose leading zeros; other ids stay as they are."""
    s = as_col(text).cast("string")
    return F.when(s.rlike(r"^\d+$"), F.regexp_replace(s, r"^0+(?=\d)", "")).otherwise(s)


def file_stem(path) -> Column:
    """Last path component without its extension."""
    return F.regexp_replace(F.element_at(F.split(as_col(path), "/"), -1), r"\.[^.]*$", "")


def strip_entities(name) -> Column:
    """Drop the space/res/desc entities so that a run and its confounds share a key."""
    return F.regexp_replace(as_col(name), r"_(space|res|desc)-[^_]+", "")


def safe_tag(text) -> Column:
    """Lower-case tag with anything but letters, digits, dot and dash replaced."""
    return F.regexp_replace(F.lower(F.trim(as_col(text))), r"[^a-z0-9.\-]+", "_")


def with_prefix(text, prefix: str = "sub-") -> Column:
    s = as_col(text).cast("string")
    return F.when(s.startswith(prefix), s).otherwise(F.concat(F.lit(prefix), s))


def cohort_from_prefix(sub_id, prefixes: dict[str, str], default: str = "UNK") -> Column:
    """First matching id prefix names the cohort."""
    out = F.lit(default)
    for prefix, cohort in reversed(list(prefixes.items())):
        out = F.when(as_col(sub_id).cast("string").startswith(prefix), cohort).otherwise(out)
    return out


def task_label(cohort, positive: list[str], negative: list[str]) -> Column:
    """1 / 0 for the two sides of a binary task, NULL outside it."""
    c = as_col(cohort)
    return F.when(c.isin(*positive), 1).when(c.isin(*negative), 0)
