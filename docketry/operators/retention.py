"""Table changes: retention, erasure, merge, log and snapshots. Stored tables change by a manifest, never in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.expiry import RULES, alive
from docketry.operators.windows import keep_recent, latest
from docketry.schemas import CASE_KEY, LOGGED
from docketry.sources.manifest import Manifest


def retain(df: DataFrame, kind: str, now: Column, ts: str = "ts", tie: str = "id", owner: str = "tenant") -> DataFrame:
    """Rows that a rule keeps, by owner: the age first, then the cap of most recent rows or cases."""
    rule = RULES[kind]
    df = df.filter(alive(F.col(ts), kind, now))
    if rule.cap is None:
        return df
    if not rule.per_case:
        return keep_recent(df, [owner], ts, tie, rule.cap)
    key = list(dict.fromkeys([owner, *CASE_KEY]))
    newest = df.groupBy(*key).agg(F.max(ts).alias("__ts")).withColumn("__tie", F.struct("case_no", "degree"))
    return df.join(keep_recent(newest, [owner], "__ts", "__tie", rule.cap).select(*key), key, "left_semi").select(*df.columns)


def forget_case(tables: dict[str, DataFrame], cases: DataFrame) -> dict[str, DataFrame]:
    """Each table without the given cases; a case of the same number in another court or degree stays."""
    gone = cases.select(*CASE_KEY).distinct()
    return {name: t.join(gone, CASE_KEY, "left_anti").select(*t.columns) for name, t in tables.items()}


def forget_all(tables: dict[str, DataFrame], tenant: int) -> dict[str, DataFrame]:
    """Each table without a tenant's rows; rows without a tenant stay."""
    return {name: t.filter(~F.col("tenant").eqNullSafe(F.lit(tenant))) for name, t in tables.items()}


def merge_notes(mine: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both tables' notes; of the same note of the same sender the later one stays. The code, not the name, is the sender."""
    return latest(mine.unionByName(incoming), [*CASE_KEY, "piece_id", "sender_code", "note_id"], "created_ts", "text")


def log_actions(changes: DataFrame, run_id: str, ts: Column, profile: Column) -> DataFrame:
    """Rows for the action log: one for each action, in the log's own fields and no others."""
    kept = [c for c in LOGGED if c in changes.columns and c not in ("run_id", "ts", "profile")]
    return changes.select(*kept).withColumns({"run_id": F.lit(run_id), "ts": ts, "profile": profile})


def retain_table(table: Manifest, kind: str, now: Column, **columns: str) -> None:
    """Applies a rule to a stored table: it holds the kept rows from one moment to the next, or all of them if the write fails."""
    table.replace(retain(table.read(), kind, now, **columns))


def replace_snapshot(cases: DataFrame, table: Manifest) -> None:
    """The last reading replaces its tenants' earlier ones, all at once; other tenants' parts stay as they are.

    A reading without a row of a tenant changes nothing of that tenant's.
    """
    new = table.write_by(cases, "tenant")
    owners = {p["owner"] for p in new}
    table.commit([*[p for p in table.parts() if p["owner"] not in owners], *new], cases.schema)
    table.clear()


def snapshot(readings: DataFrame) -> DataFrame:
    """Rows of each tenant's last reading (tenant, read_ts)."""
    newest = readings.groupBy("tenant").agg(F.max("read_ts").alias("read_ts"))
    return readings.join(newest, ["tenant", "read_ts"], "left_semi")


def discard(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """df without the given ids."""
    return df.join(ids.select(column).distinct(), column, "left_anti").select(*df.columns)
