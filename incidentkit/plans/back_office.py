"""Customer tables: catalogue extension, leave exports, staffing weeks, direct debits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from incidentkit.functions import text as T
from incidentkit.operators.aggregates import rollup_totals
from incidentkit.operators.joins import anti_new_names, normal_name, snapshot_diff

# Sizes given to a name without a donor, and the sizes a donor is judged on, in order.
STANDARD_SIZES = (
    "14-16 draadkluit hoogstam",
    "14-16 wortelgoed hoogstam",
    "16-18 draadkluit hoogstam",
    "16-18 wortelgoed hoogstam",
    "18-20 draadkluit hoogstam",
    "18-20 wortelgoed hoogstam",
)
JUDGED_SIZES = ("16-18 draadkluit hoogstam", "14-16 draadkluit hoogstam")


def extend_catalog(
    names: DataFrame,
    catalog: DataFrame,
    judged: Sequence[str] = JUDGED_SIZES,
    standard: Sequence[str] = STANDARD_SIZES,
) -> DataFrame:
    """Catalogue plus the new names with sizes and prices of the dearest cultivar of their group.

    ``names``: group, latin_name, row_no. ``catalog``: group, latin_name,
    size_code, price, row_no. ``control`` names the donor; a null price is
    unknown. The donor of a group is one aggregate: first judged size that any
    cultivar has, then highest price, then first row.
    """
    new = anti_new_names(names, catalog, "latin_name")
    unique = new.groupBy(normal_name(F.col("latin_name")).alias("_name")).agg(
        F.min_by(F.struct("group", "latin_name", "row_no"), "row_no").alias("n")
    ).select("n.*")
    parts = T.name_parts(F.col("latin_name"))
    unique = unique.withColumns({"_key": normal_name(parts["group_name"]), "_exception": parts["is_exception"]})

    keyed = catalog.withColumns(
        {
            "_key": normal_name(T.name_parts(F.col("latin_name"))["group_name"]),
            "_size_rank": F.array_position(F.array(*[F.lit(s) for s in judged]), F.col("size_code")),
        }
    )
    rank = F.struct("_size_rank", F.col("price").isNull(), -F.coalesce("price", F.lit(0)), "row_no")
    donors = keyed.where(F.col("_size_rank") > 0).groupBy("_key").agg(
        F.min_by(F.struct(F.col("group").alias("donor_group"), F.col("latin_name").alias("donor")), rank).alias("d")
    ).select("_key", "d.*")

    chosen = unique.join(donors, "_key", "left").withColumn(
        "donor", F.when(~F.col("_exception"), F.col("donor"))
    )
    price_type = catalog.schema["price"].dataType
    stock = catalog.select(
        F.col("group").alias("donor_group"), F.col("latin_name").alias("donor"), "size_code", "price"
    )
    copied = chosen.where(F.col("donor").isNotNull()).join(stock, ["donor_group", "donor"]).select(
        F.col("donor_group").alias("group"), "latin_name", "size_code", "price", F.col("donor").alias("control")
    )
    unknown = chosen.where(F.col("donor").isNull()).select(
        "group",
        "latin_name",
        F.explode(F.array(*[F.lit(s) for s in standard])).alias("size_code"),
        F.lit(None).cast(price_type).alias("price"),
        F.lit(None).cast("string").alias("control"),
    )
    old = catalog.select("group", "latin_name", "size_code", "price", F.lit(None).cast("string").alias("control"))
    return old.unionByName(copied).unionByName(unknown).orderBy("group", "latin_name", "size_code")


# Component kinds of the salary export.
KIND_TVT = 10
KIND_LEAVE = 15


def tvt_export(
    new: DataFrame, old: DataFrame, keys: Sequence[str], columns: Sequence[str], year: int, kind: int = KIND_TVT
) -> DataFrame:
    """Balance of this week less last week per employee: positive units with factor 1 or -1, no zero rows.

    The balance is the sum of ``columns``.
    """
    balance = sum(F.coalesce(F.col(c), F.lit(0)) for c in columns)
    diff = snapshot_diff(
        new.select(*keys, balance.alias("saldo")), old.select(*keys, balance.alias("saldo")), keys, ["saldo"]
    )
    signed = T.sign_and_abs(F.col("saldo"))
    return diff.where(F.col("saldo") != 0).select(
        *keys,
        F.make_date(F.lit(year), F.lit(1), F.lit(1)).alias("start"),
        F.make_date(F.lit(year), F.lit(12), F.lit(31)).alias("end"),
        F.lit(kind).alias("kind"),
        signed["factor"].alias("factor"),
        signed["units"].alias("units"),
    )


def leave_export(
    leave: DataFrame, keys: Sequence[str], employees: DataFrame | None = None, kind: int = KIND_LEAVE
) -> DataFrame:
    """One row per employee and working week, Monday to Friday.

    ``leave``: keys, start, end, hours (per working day). With ``employees``
    everyone without leave gets a row with zero units and empty dates.
    """
    days = leave.where(F.col("start") <= F.col("end")).select(
        *keys, "hours", F.explode(F.sequence(F.col("start").cast("date"), F.col("end").cast("date"))).alias("day")
    )
    weeks = (
        days.where(F.weekday("day") < 5)
        .groupBy(*keys, F.trunc("day", "week").alias("start"))
        .agg(F.sum("hours").alias("units"))
        .select(*keys, "start", F.date_add("start", 4).alias("end"), "units")
    )
    if employees is not None:
        weeks = employees.select(*keys).distinct().join(weeks, list(keys), "left").withColumn(
            "units", F.coalesce("units", F.lit(0))
        )
    return weeks.select(
        *keys, "start", "end", F.lit(kind).alias("kind"), F.lit(-1).alias("factor"), "units"
    )


def export_diff(got: DataFrame, wanted: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows that differ between an export and its approved version, with the columns that do."""
    g = got.select(*keys, F.struct(*columns).alias("got"))
    w = wanted.select(*keys, F.struct(*columns).alias("wanted"))
    both = g.join(w, list(keys), "full_outer")
    changed = F.array_compact(
        F.array(*[F.when(~F.col(f"got.{c}").eqNullSafe(F.col(f"wanted.{c}")), F.lit(c)) for c in columns])
    )
    status = (
        F.when(F.col("wanted").isNull(), "extra")
        .when(F.col("got").isNull(), "missing")
        .when(F.size(changed) > 0, "changed")
        .otherwise("same")
    )
    return (
        both.withColumn("status", status)
        .where(F.col("status") != "same")
        .withColumn("fields", F.when(F.col("status") == "changed", F.array_join(changed, ",")))
    )


def weekly_margin(*departments: DataFrame) -> DataFrame:
    """Turnover, purchase, costs and margin per worker and week, over the departments together.

    Columns: department, week, worker, client, hours, buy_rate, sell_rate,
    recruiter_fee, material, travel, overtime_hours, overtime_pct, invoiced.
    Overtime is paid and invoiced at its percentage of the rate.
    """
    rows = departments[0]
    for more in departments[1:]:
        rows = rows.unionByName(more)
    zero = F.lit(0)
    amount = lambda c: F.coalesce(F.col(c), zero)
    paid = amount("hours") + amount("overtime_hours") * amount("overtime_pct") / 100
    worked = rows.withColumn("paid_hours", paid.cast("decimal(18,4)"))
    sums = worked.withColumns(
        {
            "sales": (F.col("paid_hours") * F.col("sell_rate")).cast("decimal(18,4)"),
            "purchase": (F.col("paid_hours") * F.col("buy_rate")).cast("decimal(18,4)"),
            "costs": (amount("recruiter_fee") + amount("material") + amount("travel")).cast("decimal(18,4)"),
        }
    )
    return sums.withColumns(
        {
            "margin": F.col("sales") - F.col("purchase") - F.col("costs"),
            "missing_hours": amount("hours") + amount("overtime_hours") == 0,
            "to_invoice": (F.col("sales") > 0) & ~F.coalesce(F.col("invoiced"), F.lit(False)),
        }
    )


def cumulative_margin(margins: DataFrame) -> DataFrame:
    """Totals per department and client, per department, and over all, up to each week.

    Rolled up per week first; the running sum then has one row per week and level.
    """
    measures = ["sales", "purchase", "costs", "margin"]
    per_week = margins.rollup("week", "department", "client").agg(
        *[F.sum(m).alias(m) for m in measures], F.grouping_id().alias("_g")
    ).where(F.col("week").isNotNull() & (F.col("_g") < 4))
    w = Window.partitionBy("_g", "department", "client").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    return per_week.select(
        "week", "department", "client", F.col("_g").cast("int").alias("level"), *[F.sum(m).over(w).alias(m) for m in measures]
    )


def margin_totals(margins: DataFrame) -> DataFrame:
    return rollup_totals(margins, ["department", "client"], ["sales", "purchase", "costs", "margin"])


def reconcile_debits(tx: DataFrame, header: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counted against announced number and sum; a gap is reported, not an error."""
    found = tx.groupBy(*keys).agg(F.count(F.lit(1)).alias("counted"), F.sum("amount").alias("summed"))
    if keys:
        both = header.join(found, list(keys), "left")
    else:
        both = header.withColumn("_f", found.select(F.struct("counted", "summed")).scalar()).select(
            *header.columns, "_f.counted", "_f.summed"
        )
    counted = F.coalesce("counted", F.lit(0))
    summed = F.coalesce("summed", F.lit(0))
    return both.withColumns(
        {
            "counted": counted,
            "summed": summed,
            "count_gap": counted - F.col("announced_count"),
            "sum_gap": summed - F.col("announced_sum"),
        }
    )


def remittance_week(c: Column) -> Column:
    """Week number of ``Adv-Wnn-...``, null without one."""
    return F.nullif(F.regexp_extract(c, r"Adv-W(\d+)-", 1), F.lit("")).cast("int")


def debits_per_mandate(tx: DataFrame) -> DataFrame:
    return tx.groupBy("mandate_id", remittance_week(F.col("remittance")).alias("week")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")
    )
