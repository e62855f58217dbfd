"""Governed views for SQL readers: the role of the session decides which rows and values a query sees.

The policies are SQL functions without arguments (and one on the donor
segment) over the session variable ``hexgiving_role``. Spark inlines them:
``SET VAR hexgiving_role = '...'`` before a query makes every policy test a
constant, so an all-seeing role leaves no filter, a masked column is a
literal, and the intern's segment test reaches the parquet scan. The answers
are those of ``operators.governance.governed``.

As there, this is a presentation rule: whoever can read the files, or the
clear frame in the same session, can read them without it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from hexgiving.operators import governance as G
from hexgiving.sources import tables as T
from hexgiving.sources.tables import SEGMENT_ANNUAL

CLEAR_VIEW = "hexgiving_clear_donors"
DONORS_VIEW = "governed_donors"
ROLLUPS = {"governed_by_zip_code": "zip_code", "governed_by_graduation_year": "graduation_year", "governed_by_major": "major"}
POLICIES = {"hexgiving_reads_text": G.STRING_CLEAR_ROLES, "hexgiving_reads_dates": G.DATE_CLEAR_ROLES,
            "hexgiving_reads_numbers": G.NUMBER_CLEAR_ROLES}
KINDS = {"string": ("hexgiving_reads_text()", f"'{G.MASKED_TEXT}'"), "date": ("hexgiving_reads_dates()", f"DATE'{G.MASKED_DATE}'"),
         "number": ("hexgiving_reads_numbers()", "0")}


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _roles(roles) -> str:
    return ", ".join(map(_literal, roles))


def declare_role(spark: SparkSession, role: str | None = None) -> None:
    """The session variable of the role: declared (empty: sees nothing) unless it is there, set if ``role`` is given."""
    try:
        spark.sql(f"SELECT session.{G.ROLE_VARIABLE}").collect()
    except AnalysisException:
        spark.sql(f"DECLARE VARIABLE {G.ROLE_VARIABLE} STRING DEFAULT ''")
    if role is not None:
        spark.sql(f"SET VAR {G.ROLE_VARIABLE} = :role", {"role": role})


def create_policies(spark: SparkSession) -> None:
    """The policy functions of the session."""
    declare_role(spark)
    for name, roles in POLICIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}() RETURNS BOOLEAN RETURN session.{G.ROLE_VARIABLE} IN ({_roles(roles)})")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION hexgiving_sees_donor(segment STRING) RETURNS BOOLEAN RETURN "
              f"CASE WHEN session.{G.ROLE_VARIABLE} = {_literal(G.INTERN_ROLE)} THEN segment = {_literal(SEGMENT_ANNUAL)} "
              f"ELSE session.{G.ROLE_VARIABLE} IN ({_roles(G.ALL_ROWS_ROLES)}) END")


def governed_select(df: DataFrame, view: str, masks=G.DONOR_MASKS) -> str:
    """SQL text that reads ``view`` (the columns of ``df``) under the policies; a masked column keeps its type."""
    columns = []
    for name, kind in df.dtypes:
        if name in masks:
            test, other = KINDS[masks[name]]
            columns.append(f"CASE WHEN {test} THEN `{name}` ELSE CAST({other} AS {kind}) END AS `{name}`")
        else:
            columns.append(f"`{name}`")
    return f"SELECT {', '.join(columns)} FROM {view} WHERE hexgiving_sees_donor(donor_segment)"


def register_governed_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """Create the policies and the governed views (donors, and rollups over them); returns the views' names.

    The rollups read the governed donors, so a role that sees masked amounts
    sees totals of masked amounts.
    """
    create_policies(spark)
    donors = T.donor_table(spark, sf_dir)
    donors.createOrReplaceTempView(CLEAR_VIEW)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {DONORS_VIEW} AS {governed_select(donors, CLEAR_VIEW)}")
    for name, key in ROLLUPS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS SELECT {key}, count(*) AS donor_count, "
                  f"CAST(sum(annual_donation_amount) AS DOUBLE) AS total_annual_donations, "
                  f"CAST(sum(cumulative_donation_amount) AS DOUBLE) AS total_cumulative_donations FROM {DONORS_VIEW} GROUP BY {key}")
    return [DONORS_VIEW, *ROLLUPS]
