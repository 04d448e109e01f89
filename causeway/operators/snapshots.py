"""Validated snapshots: content-addressed tables with a manifest that says what they may serve.

A snapshot's id holds its session and twelve digits of a hash over contract, configuration and the tables' content, so the
same content is the same snapshot and writing it again changes nothing. Other content of one session under the same run
parameters is a revision that names what it supersedes and which tables moved. Nothing is overwritten: a verdict that
changes on unchanged data is one more record, and the last one holds.

Layout: `validated/ID/TABLE` (Parquet), `manifests/` (JSON records, one folder for each record). Manifests are a few records
per session; tables are hashed, written and compared in Spark.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causeway.operators import lineage
from causeway.settings import PURPOSES

MANIFEST = (
    "snapshot_id string, session date, record int, revision int, view string, supersedes string, changed_tables array<string>, tables array<struct<name:string,rows:bigint,sha256:string>>, "
    "requests bigint, issues bigint, eligible_for array<string>, ineligibility map<string,string>, code_sha256 string, config_sha256 string, written_at string"
)


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, default=str, ensure_ascii=False)


def fingerprint(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def code_hash(root: str | Path) -> str:
    """Of the package's sources in order of their paths, so that a change of behaviour isn't taken for one of the data."""
    digest = hashlib.sha256()
    for path in sorted(Path(root).rglob("*.py")):
        digest.update(path.relative_to(root).as_posix().encode() + path.read_bytes())
    return digest.hexdigest()


def table_hashes(tables: Mapping[str, DataFrame]) -> list[dict[str, Any]]:
    """name, rows, sha256 of each table: a distributed aggregation for each, all of them in one job, a row of each to the driver."""
    each = [lineage.content_hash(tables[name].withColumn("_name", F.lit(name)), by="_name", ignore=lineage.VOLATILE) for name in sorted(tables)]
    found = {r["_name"]: r for r in reduce(DataFrame.unionByName, each).collect()} if each else {}
    out = []
    for name in sorted(tables):
        r = found.get(name)
        out.append({"name": name, "rows": int(r["rows"]) if r else 0, "sha256": r["sha256"] if r else fingerprint([name, tables[name].schema.simpleString()])})
    return out


def snapshot_id(session: str, hashes: Sequence[Mapping[str, Any]], config_sha256: str) -> str:
    """Blind to the clock: identical content has one id."""
    return f"{session}-{fingerprint([lineage.CONTRACT, session, config_sha256, [(t['name'], t['sha256']) for t in hashes]])[:12]}"


@dataclass(frozen=True)
class Snapshot:
    snapshot_id: str
    manifest: dict[str, Any]
    tables: Mapping[str, DataFrame]

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"{self.snapshot_id} has no table {name!r}, only {sorted(self.tables)}")
        return self.tables[name]

    def require(self, purpose: str) -> None:
        """Refuses a use that wasn't granted, with the reason on record."""
        if purpose not in PURPOSES:
            raise ValueError(f"{purpose!r} is none of {PURPOSES}")
        if purpose not in (self.manifest["eligible_for"] or ()):
            raise PermissionError(f"{self.snapshot_id} may not serve {purpose}: {(self.manifest['ineligibility'] or {}).get(purpose, 'no reason on record')}")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def records(spark: SparkSession, root: str) -> DataFrame:
    """All manifest records; none where nothing was written yet."""
    if not _exists(spark, f"{root}/manifests"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{root}/manifests")


def current(every: DataFrame) -> DataFrame:
    """One row per snapshot: its first record with the verdict of the last one, and the verdicts in between as `amendments`."""
    verdict = F.struct("record", "eligible_for", "ineligibility", "code_sha256", "written_at")
    g = every.groupBy("snapshot_id").agg(F.min_by(F.struct(*(c for c in every.columns if c != "snapshot_id")), "record").alias("x"), F.max_by(verdict, "record").alias("v"), F.array_sort(F.collect_list(verdict), lambda x, y: x["record"] - y["record"]).alias("all"))
    fixed = [c for c in every.columns if c not in ("snapshot_id", "record", "eligible_for", "ineligibility", "code_sha256")]
    return g.select("snapshot_id", *(F.col(f"x.{c}").alias(c) for c in fixed), "v.eligible_for", "v.ineligibility", "v.code_sha256", F.slice("all", 1, F.size("all") - 1).alias("amendments"))


def _append(spark: SparkSession, root: str, record: dict[str, Any]) -> None:
    row = spark.createDataFrame([tuple(record[f.split(" ")[0]] for f in _fields())], MANIFEST)
    row.coalesce(1).write.mode("errorifexists").json(f"{root}/manifests/{record['snapshot_id']}-{record['record']}")


def _fields() -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(MANIFEST).fieldNames()


def write_snapshot(
    spark: SparkSession,
    root: str,
    session: str,
    tables: Mapping[str, DataFrame],
    config: Mapping[str, Any],
    run_parameters: Mapping[str, Any] | None = None,
    eligible_for: Sequence[str] = (),
    ineligibility: Mapping[str, str] | None = None,
    requests: int = 0,
    issues: int = 0,
    code_sha256: str | None = None,
) -> Snapshot:
    """Writes new content with its manifest; of content that is there, only a changed verdict is recorded."""
    import datetime as dt

    hashes = table_hashes(tables)
    view = canonical(dict(run_parameters or {}))
    config_sha256 = fingerprint({"config": dict(config), "run": dict(run_parameters or {})})
    own = snapshot_id(session, hashes, config_sha256)
    known = current(records(spark, root)).where((F.col("session") == F.lit(session).cast("date")) & (F.col("view") == view)).orderBy("revision").collect()
    verdict = {"eligible_for": list(eligible_for), "ineligibility": dict(ineligibility or {}), "code_sha256": code_sha256, "written_at": dt.datetime.now(dt.UTC).isoformat()}
    if same := next((r for r in known if r["snapshot_id"] == own), None):
        manifest = same.asDict(recursive=True)
        if (manifest["eligible_for"] or [], manifest["ineligibility"] or {}) != (verdict["eligible_for"], verdict["ineligibility"]):
            manifest |= verdict
            _append(spark, root, manifest | {"record": len(manifest["amendments"]) + 1})
        return Snapshot(own, manifest, tables)
    last = known[-1].asDict(recursive=True) if known else None
    before = {t["name"]: t["sha256"] for t in last["tables"]} if last else {}
    after = {t["name"]: t["sha256"] for t in hashes}
    manifest = verdict | {
        "snapshot_id": own,
        "session": dt.date.fromisoformat(session),
        "record": 0,
        "revision": len(known) + 1,
        "view": view,
        "supersedes": last["snapshot_id"] if last else None,
        "changed_tables": sorted(n for n in before.keys() | after.keys() if before.get(n) != after.get(n)) if last else None,
        "tables": hashes,
        "requests": requests,
        "issues": issues,
        "config_sha256": config_sha256,
    }
    for name, df in tables.items():
        # A run that died before its manifest leaves tables without a record; they are written anew.
        df.write.mode("overwrite").parquet(f"{root}/validated/{own}/{name}")
    _append(spark, root, manifest)
    return Snapshot(own, manifest, tables)


def read_snapshot(spark: SparkSession, root: str, own: str) -> Snapshot:
    row = current(records(spark, root).where(F.col("snapshot_id") == own)).first()
    if row is None:
        raise FileNotFoundError(f"no manifest of {own} in {root}")
    manifest = row.asDict(recursive=True)
    return Snapshot(own, manifest, {t["name"]: spark.read.parquet(f"{root}/validated/{own}/{t['name']}") for t in manifest["tables"]})


def verify_snapshot(snapshot: Snapshot) -> list[str]:
    """All tables whose content isn't what the manifest says, that lack, or that it doesn't know."""
    claimed = {t["name"]: t["sha256"] for t in snapshot.manifest["tables"]}
    actual = {t["name"]: t["sha256"] for t in table_hashes(snapshot.tables)}
    lacking = [f"{n}: not loaded" for n in sorted(claimed.keys() - actual.keys())]
    unknown = [f"{n}: not in the manifest" for n in sorted(actual.keys() - claimed.keys())]
    return lacking + [f"{n}: content differs" for n in sorted(claimed.keys() & actual.keys()) if claimed[n] != actual[n]] + unknown


def list_snapshots(manifests: DataFrame) -> DataFrame:
    """One row per snapshot, the newest session first: what it holds, supersedes and may serve."""
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return manifests.select(
        "snapshot_id",
        "session",
        "revision",
        "view",
        "supersedes",
        joined("changed_tables").alias("changed_tables"),
        F.size("tables").alias("tables"),
        F.aggregate("tables", F.lit(0).cast("long"), lambda n, t: n + t["rows"]).alias("rows"),
        "requests",
        "issues",
        joined("eligible_for").alias("eligible_for"),
    ).orderBy(F.col("session").desc(), "revision")


def latest_sessions(listed: DataFrame) -> DataFrame:
    """The newest revision of each session and view, cell by cell the last that isn't null, and how many revisions there are."""
    w = W.partitionBy("session", "view").orderBy("revision").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = [c for c in listed.columns if c not in ("session", "view", "revision")]
    rows = listed.select("session", "view", F.max("revision").over(w).alias("last"), "revision", *(F.last(c, ignorenulls=True).over(w).alias(c) for c in rest), F.count(F.lit(1)).over(w).alias("revisions"))
    return rows.where("revision = last").drop("last")


def session_count(listed: DataFrame) -> DataFrame:
    return listed.agg(F.count_distinct("session").alias("sessions"))


def session_revisions(manifests: DataFrame, session: str, run_parameters: Mapping[str, Any] | None = None) -> DataFrame:
    """Earlier snapshots of a session under the same run parameters: another view is another question, not a correction."""
    return manifests.where((F.col("session") == F.lit(session).cast("date")) & (F.col("view") == canonical(dict(run_parameters or {})))).orderBy("revision")
