"""Records of earlier verdicts in JSON lines."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIOR_SCHEMA = "id string, claim string, verdict string, killed_by array<string>, evidence string, lesson string, applies_to array<string>, project string, date string, source string, withdrawn string, superseded_by string, withdrawn_date string"
PLACE = "GRISTMILL_PRIORS"


def default_path() -> str:
    return os.environ.get(PLACE, "priors")


def load(spark: SparkSession, path: str | None = None) -> DataFrame:
    """All records of a folder's *.jsonl files, blank lines and // comments skipped; missing texts empty, missing lists empty."""
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(path or default_path())
    record = (F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("//"))
    # the parser gets records only, whatever order the optimizer gives the filters
    rows = lines.where(record).select(F.from_json(F.when(record, F.col("value")), PRIOR_SCHEMA, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return rows.select(*[F.coalesce(c, F.array().cast(k) if k.startswith("array") else F.lit("")).alias(c) for c, k in rows.dtypes])


def append(spark: SparkSession, record: dict, path: str | None = None, dry_run: bool = False) -> dict:
    """Appends one record after validation; raises ValueError with every fault found.

    Returns its id, whether it was written, how many records and projects there are now (a dry run
    adds no record), the three commonest causes before and after, whether these changed, and whether the project is new.
    """
    from ..operators import retrieval, taxonomy

    place = Path(path or default_path())
    names = [f.split()[0] for f in PRIOR_SCHEMA.split(", ")]
    unknown = sorted(set(record) - set(names))
    lacking = [n for n in ("id", "claim", "verdict") if not record.get(n)]
    if unknown or lacking:
        raise ValueError(f"unknown fields {unknown}, missing fields {lacking}")
    empty = spark.createDataFrame([], PRIOR_SCHEMA)
    old = load(spark, str(place)) if place.is_dir() and any(place.glob("*.jsonl")) else empty
    lists = {"killed_by", "applies_to"}
    row = tuple(list(record.get(n, [])) if n in lists else str(record.get(n, "")) for n in names)
    new = spark.createDataFrame([row], PRIOR_SCHEMA)
    both = old.unionByName(new)
    faults = [f"{r.problem}: {r.what}" for r in retrieval.validate(both, taxonomy.modes(spark)).where(F.col("id") == record["id"]).collect()]
    if faults:
        raise ValueError("; ".join(faults))
    top = lambda d: [r.mode for r in retrieval.checklist(d, taxonomy.modes(spark)).limit(3).collect()]
    n, projects, seen = old.agg(F.count(F.lit(1)), F.count_distinct("project"), F.coalesce(F.bool_or(F.col("project") == record.get("project", "")), F.lit(False))).first()
    out = {"id": record["id"], "written": not dry_run, "records": n + (not dry_run), "projects": projects + (not seen), "before": top(old), "after": top(both), "new_project": not seen}
    out["changed"] = out["before"] != out["after"]
    if not dry_run:
        place.mkdir(parents=True, exist_ok=True)
        with (place / "records.jsonl").open("a") as f:
            f.write(json.dumps(dict(zip(names, row, strict=True)), ensure_ascii=False, sort_keys=True) + "\n")
    return out


def render_append(done: dict) -> str:
    """What append returned, as text."""
    out = [f"{done['id']}: " + ("written" if done["written"] else "valid, not written (dry run)")]
    out.append(f"    {done['records']} records of {done['projects']} projects" + (", the first of its project" if done["new_project"] else ""))
    out.append(f"    commonest causes: {', '.join(done['after']) or '-'}")
    if done["changed"]:
        out.append(f"    these were: {', '.join(done['before']) or '-'}; look at the new ones first in the next study")
    out.append("    a cause that no mode names deserves a mode of its own, not the nearest key")
    return "\n".join(out)


def render(hits: DataFrame) -> str:
    """Records as text; withdrawn ones are shown as such and give no advice."""
    out = []
    for r in hits.collect():  # the few hits of one search
        out.append(f"{r.id}  {r.verdict}  {r.claim}")
        if r.withdrawn:
            out.append(f"    withdrawn: {r.withdrawn}" + (f" (see {r.superseded_by})" if r.superseded_by else ""))
        else:
            out += [f"    cause: {', '.join(r.killed_by) or '-'}", f"    lesson: {r.lesson}"]
    return "\n".join(out)


def search(spark: SparkSession, query: str, path: str | None = None, top: int = 8) -> DataFrame:
    """The best records for a query, with rank and score."""
    from ..operators import retrieval

    priors = load(spark, path)
    best = retrieval.bm25(retrieval.prior_text(priors), query, top)
    return best.join(priors, "id").orderBy("rank")
