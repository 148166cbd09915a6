"""Checks that name what is wrong with a row, a file or a pair of rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benefica.fixed import MAX_UPLOAD_ROWS, REQUIRED_UPLOAD_COLUMNS
from benefica.scale import running


def upload_error(df: DataFrame, required: Sequence[str] = tuple(REQUIRED_UPLOAD_COLUMNS),
                 limit: int = MAX_UPLOAD_ROWS) -> DataFrame:
    """One row with the reason a scored upload is refused, or NULL.

    At most ``limit`` + 1 rows are counted: the limit is the check itself.
    """
    missing = sorted(set(required) - set(df.columns))
    n = df.select(F.lit(1).alias("one")).limit(limit + 1).agg(F.count("one").alias("n"))
    problem = F.when(F.col("n") == 0, "the file is empty")
    if missing:
        problem = problem.when(F.lit(True), "missing columns: " + ", ".join(missing))
    return n.select(problem.when(F.col("n") > limit, f"too many rows: more than {limit}").alias("error"))


def all_errors(checks: Mapping[str, Column]) -> Column:
    """Codes of every failing check, in order."""
    return F.filter(F.array(*[F.when(bad, F.lit(code)) for code, bad in checks.items()]), lambda x: x.isNotNull())


def first_error(checks: Mapping[str, Column]) -> Column:
    """Code of the first failing check, NULL when all hold."""
    return F.coalesce(*[F.when(bad, F.lit(code)) for code, bad in checks.items()])


def blank(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name).cast("string") == "")


def below(name: str, low) -> Column:
    return F.col(name).isNull() | (F.col(name) < low)


def payload_checks() -> dict[str, Column]:
    """Disbursement request: all failing codes are reported.  The codes are fixed values."""
    return {
        "INVALID_DISBURSEMENT_ENVELOPE_ID": F.col("envelope_id").isNull(),
        "INVALID_DISBURSEMENT_QUANTITY": F.coalesce(F.col("quantity") < 0, F.lit(False)),
        "INVALID_BENEFICIARY_ID": blank("beneficiary_id"),
        "INVALID_NARRATIVE": blank("narrative"),
    }


FREQUENCIES = ["Daily", "Weekly", "Fortnightly", "Monthly", "BiMonthly", "Quarterly", "SemiAnnually", "Annually",
               "OnDemand"]


def envelope_checks(frequencies: Sequence[str] = tuple(FREQUENCIES)) -> dict[str, Column]:
    """Envelope creation: the first failing code wins.  The codes are fixed values."""
    return {
        "INVALID_PROGRAM_ID": blank("program_id"),
        "INVALID_DISBURSEMENT_FREQUENCY": ~F.coalesce(F.col("frequency").isin(list(frequencies)), F.lit(False)),
        "INVALID_CYCLE_CODE_MNEMONIC": blank("cycle_code"),
        "INVALID_NO_OF_BENEFICIARIES": below("n_beneficiaries", 1),
        "INVALID_NO_OF_DISBURSEMENTS": below("n_disbursements", 1),
        "INVALID_DISBURSEMENT_QUANTITY": below("total_quantity", 0),
        "INVALID_BENEFIT_CODE_ID": blank("benefit_code"),
        "INVALID_TARGET_REGISTRY": blank("target_registry"),
    }


def amend_checks() -> dict[str, Column]:
    """Envelope amendment: the first failing code wins.  The codes are fixed values."""
    return {
        "INVALID_DISBURSEMENT_ENVELOPE_ID": blank("envelope_id"),
        "INVALID_PROGRAM_ID": blank("program_id"),
        "INVALID_PROGRAM_MNEMONIC": blank("program_mnemonic"),
        "INVALID_NO_OF_BENEFICIARIES": below("n_beneficiaries", 1),
        "INVALID_NO_OF_DISBURSEMENTS": below("n_disbursements", 1),
    }


# --- data-quality rules ---------------------------------------------------------------------------------------

def detect_exceptions(df: DataFrame, key: str, rules: Mapping[str, Column | Callable[[DataFrame], Column]]) -> DataFrame:
    """(key, rule) for every row that breaks a rule; a rule is a column or a function from the table to one."""
    columns = {n: (r(df) if callable(r) and not isinstance(r, Column) else r) for n, r in rules.items()}
    return df.select(key, F.explode(all_errors(columns)).alias("rule"))


def exception_changes(found: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """What to attach and what to detach so that the stored pairs equal the found ones."""
    on = [key, "rule"]
    add = found.join(stored, on, "left_anti").select(*on, F.lit("add").alias("change"))
    remove = stored.join(found, on, "left_anti").select(*on, F.lit("remove").alias("change"))
    return add.unionByName(remove)


def duplicates_of(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Key values held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def pattern_matches(value: Column, pattern: str | Column) -> Column:
    """The pattern must match at the start of the value, not necessarily to its end."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.regexp(value, F.concat(F.lit("^(?:"), pattern, F.lit(")")))


def illegal_transitions(changes: DataFrame, allowed: Sequence[tuple[str, str]], old: str = "old_state",
                        new: str = "new_state") -> DataFrame:
    """State changes that the transition list does not contain."""
    ok = None
    for a, b in allowed:
        one = (F.col(old) == a) & (F.col(new) == b)
        ok = one if ok is None else ok | one
    return changes.where(~F.coalesce(ok, F.lit(False)))


def overlapping_rows(df: DataFrame, keys: Sequence[str], key_id: str, start: str, end: str) -> DataFrame:
    """Rows whose closed validity range meets that of another row with the same keys; open ends allowed.

    Sorted by start, a row meets an earlier one exactly when the latest end so
    far reaches its start, and a later one exactly when the nearest later start
    is not after its end: two ordered passes instead of a join of all pairs.
    """
    day = lambda c, missing: F.coalesce(F.unix_date(F.col(c).cast("date")), F.lit(missing))
    placed = df.withColumns({"_lo": day(start, -1_000_000), "_hi": day(end, 10_000_000)}).withColumn(
        "_later", -F.col("_lo"))
    up = [F.col("_lo"), F.col("_hi"), F.col(key_id)]
    placed = running(placed, keys, up, maxes={"_reach": "_hi"}, position=None)
    down = [c.desc() for c in up]
    placed = running(placed, keys, down, maxes={"_next": "_later"}, position=None)
    meets = (F.col("_reach") >= F.col("_lo")) | (-F.col("_next") <= F.col("_hi"))
    return placed.where(F.coalesce(meets, F.lit(False))).select(*df.columns)
