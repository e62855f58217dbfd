"""Role-based column masking and row access as governed ``DataFrame`` views.

The role is an explicit argument, or the SQL session variable
``hexgiving_role``, or the session setting ``hexgiving.current_role``.
Because it is a literal in the plan, Catalyst folds every policy test: an
all-seeing role leaves no filter at all, a masked column becomes a
constant, and the intern's segment predicate is pushed into the parquet
scan.

This is a presentation rule, not a security boundary: whoever can read the
files can read them without it. Real enforcement belongs to the catalog.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexgiving.sources.tables import SEGMENT_ANNUAL

ROLE_SETTING = "hexgiving.current_role"

# The roles each policy lets through. Deployments pass their
# own lists; these are the defaults of the rebuilt policies.
PLATFORM_ADMIN_ROLE = "PLATFORM_INTELLIGENCE_ADMIN_ROLE"     # neutral name of the platform's own admin role
STRING_CLEAR_ROLES = ("DATASCI", "SYSADMIN", "ACCOUNTADMIN", PLATFORM_ADMIN_ROLE)
DATE_CLEAR_ROLES = ("ACCOUNTADMIN", "DATA_ANALYST", "SECURITY_ADMIN", PLATFORM_ADMIN_ROLE)
NUMBER_CLEAR_ROLES = ("DATASCI", "SYSADMIN", "ACCOUNTADMIN", PLATFORM_ADMIN_ROLE)
MASKED_TEXT = "**masked**"
MASKED_DATE = dt.date(9999, 12, 31)
INTERN_ROLE = "HE_ADVANCEMENT_INTERN_ROLE"
ALL_ROWS_ROLES = ("ACADEMIC_ADVISOR_MGR_ROLE", "ACCOUNTADMIN", PLATFORM_ADMIN_ROLE)

# Columns and the policy kind attached to each.
DONOR_MASKS = {"last_name": "string", "full_name": "string", "email": "string",
               "age": "number", "annual_donation_amount": "number",
               "cumulative_donation_amount": "number"}


ROLE_VARIABLE = "hexgiving_role"


def current_role(spark: SparkSession, role: str | None = None) -> str:
    """Explicit role; else the SQL session variable ``hexgiving_role``
    (``DECLARE VARIABLE hexgiving_role STRING DEFAULT '...'`` /
    ``SET VAR hexgiving_role = '...'``); else the session setting
    ``hexgiving.current_role``; else empty, which sees nothing."""
    if role is not None:
        return role
    try:
        value = spark.sql(f"SELECT session.{ROLE_VARIABLE}").first()[0]
        if value:
            return value
    except AnalysisException as e:
        if e.getCondition() not in ("UNRESOLVED_COLUMN.WITHOUT_SUGGESTION", "UNRESOLVED_COLUMN.WITH_SUGGESTION",
                                    "UNRESOLVED_VARIABLE", "VARIABLE_NOT_FOUND"):
            raise
    return spark.conf.get(ROLE_SETTING, "") or ""


def _clear(role: str, roles: Sequence[str]) -> Column:
    return F.lit(role).isin(list(roles))


def mask_string(c: Column, role: str, roles: Sequence[str] = STRING_CLEAR_ROLES) -> Column:
    """Text shown to listed roles, ``**masked**`` otherwise (nulls too)."""
    return F.when(_clear(role, roles), c).otherwise(F.lit(MASKED_TEXT))


def mask_date(c: Column, role: str, roles: Sequence[str] = DATE_CLEAR_ROLES) -> Column:
    """Date shown to listed roles, 9999-12-31 otherwise."""
    return F.when(_clear(role, roles), c).otherwise(F.lit(MASKED_DATE))


def mask_number(c: Column, role: str, roles: Sequence[str] = NUMBER_CLEAR_ROLES, dtype: str | None = None) -> Column:
    """Number shown to listed roles, 0 (same type) otherwise."""
    zero = F.lit(0).cast(dtype) if dtype else F.lit(0)
    return F.when(_clear(role, roles), c).otherwise(zero)


def row_access(segment: Column, role: str, intern_role: str = INTERN_ROLE,
               all_roles: Sequence[str] = ALL_ROWS_ROLES) -> Column:
    """Row predicate on the donor segment: intern sees annual donors only,
    listed roles see all, anyone else sees nothing."""
    if role == intern_role:
        return segment == F.lit(SEGMENT_ANNUAL)
    return F.lit(role in all_roles)


def masked(df: DataFrame, role: str, masks: Mapping[str, str] = DONOR_MASKS) -> DataFrame:
    """Apply the column masks that exist in ``df``."""
    dtypes = dict(df.dtypes)
    cols = {}
    for name, kind in masks.items():
        if name not in dtypes:
            continue
        c = F.col(name)
        if kind == "string":
            cols[name] = mask_string(c, role)
        elif kind == "date":
            cols[name] = mask_date(c, role)
        else:
            cols[name] = mask_number(c, role, dtype=dtypes[name])
    return df.withColumns(cols) if cols else df


def governed(df: DataFrame, role: str | None = None, masks: Mapping[str, str] = DONOR_MASKS,
             row_policy: bool = True) -> DataFrame:
    """Donor rows as the role may see them: row policy, then column masks."""
    r = current_role(df.sparkSession, role)
    out = df.where(row_access(F.col("donor_segment"), r)) if row_policy else df
    return masked(out, r, masks)
