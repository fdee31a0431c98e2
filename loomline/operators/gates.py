"""Quality gates: findings, accept lists, and checks that refuse to publish a result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GateError(AssertionError):
    """A post-condition failed; nothing was written."""


def findings(rows: DataFrame, checks: dict[str, str], keys: list[str]) -> DataFrame:
    """One row for each row and check whose SQL condition holds: keys and failed."""
    failed = F.array_compact(F.array(*(F.when(F.expr(condition), F.lit(name)) for name, condition in checks.items())))
    return rows.select(*keys, F.explode(failed).alias("failed"))


def accepted(found: DataFrame, accepts: list[dict], column: str) -> DataFrame:
    """Findings without those on the accept list. Every entry needs a phrase and a reason."""
    for entry in accepts:
        if not entry.get("phrase") or not entry.get("reason"):
            raise ValueError(f"an accepted phrase needs its reason: {entry}")
    return found.where(~F.col(column).isin([a["phrase"] for a in accepts])) if accepts else found


def report(rows: DataFrame, found: DataFrame) -> dict:
    """How many rows were measured and how often each check failed. Nothing measured is a failure of its own."""
    measured = rows.count()
    failed = {r["failed"]: r["n"] for r in found.groupBy("failed").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not measured:
        failed["measured nothing"] = 1
    return {"measured": measured, "failed": failed, "passed": not failed}


def passes(checks: dict, rows: DataFrame) -> dict[str, dict]:
    """Runs named checks, each rows -> findings (.., failed), and reports on each. A check that can't run has failed; it
    doesn't stop the others."""
    out = {}
    for name, check in checks.items():
        try:
            out[name] = report(rows, check(rows))
        except Exception as error:  # noqa: BLE001 a crash is a finding, whatever it is
            out[name] = {"measured": 0, "failed": {f"could not run: {type(error).__name__}": 1}, "passed": False}
    return out


def exit_status(reports: dict[str, dict]) -> int:
    """How many of the passes failed."""
    return sum(not r["passed"] for r in reports.values())


def publish(df: DataFrame, path: str, must_be_empty: dict[str, DataFrame], mode: str = "errorifexists") -> None:
    """Writes df unless one of the named tables has a row."""
    wrong = [name for name, bad in must_be_empty.items() if bad.limit(1).count()]
    if wrong:
        raise GateError(f"not written, because of {', '.join(wrong)}")
    df.write.mode(mode).parquet(path)


def all_of(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)
