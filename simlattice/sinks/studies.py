"""Documents of studies over releases, of verified endings, of calibration, and the heat map of findings."""

from __future__ import annotations

import html
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import longitudinal as L
from ..operators import security
from . import store


def _markdown(rows: DataFrame, limit: int | None = None) -> Iterator[str]:
    """The rows as a Markdown table; with a limit only so many, as for a reader."""
    names = rows.columns
    yield "| " + " | ".join(names) + " |"
    yield "|" + "---|" * len(names)
    for r in (rows.limit(limit) if limit else rows).toLocalIterator():
        yield "| " + " | ".join(f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|") for v in r) + " |"


def study_tables(snapshots: DataFrame, releases: DataFrame, sizes: DataFrame) -> dict[str, DataFrame]:
    """The study's tables by file name. snapshots: longitudinal.KEY and so on; releases: (tag, idx, clusters, functions, thresholds);
    sizes: (tag, idx, shape_hash, size)."""
    near = snapshots.groupBy("tag").agg(F.count("*").alias("outliers"))
    knobs = [c for c in releases.columns if c not in ("tag", "idx", "ts", "clusters", "functions")]
    return {
        "releases": releases.join(near, "tag", "left").select("tag", "idx", "functions", "clusters", F.coalesce("outliers", F.lit(0)).alias("outliers")),
        "thresholds": releases.select("tag", "idx", *knobs), "cluster-tracking": L.cluster_tracking(sizes), "outlier-tracking": L.outlier_tracking(snapshots), "outlier-resolution": L.resolutions(snapshots, releases),
    }


def write_study(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV, quoted, under its name."""
    for name, rows in tables.items():
        store.write_csv(rows, os.path.join(folder, name))


def study_report(tables: dict[str, DataFrame], title: str, shown: int = 20) -> Iterator[str]:
    """What was seen in each release, how long clusters and near misses lasted, and how these ended."""
    releases = tables["releases"]
    n = releases.count()
    yield f"# Releases of {title}\n\n{n} releases\n\n## Releases\n"
    yield from _markdown(releases.orderBy("idx"))
    yield "\n## Thresholds\n"
    yield from _markdown(tables["thresholds"].orderBy("idx"))
    for name, rows, count in (("Clusters", tables["cluster-tracking"], "num_releases_present"), ("Near misses", tables["outlier-tracking"], "num_releases")):
        key = [c for c in ("shape_hash", "package", "func") if c in rows.columns]
        p = (L.cluster_persistence if name == "Clusters" else L.outlier_persistence)(rows, n).first()
        yield f"\n## {name} that last\n"
        if not p["total_unique"]:
            yield "None were tracked."
            continue
        yield from _markdown(rows.orderBy(F.desc(count), *key), shown)
        yield f"\n- seen at all: {p['total_unique']}\n- in half of the releases or more: {p['persistent']} ({p['persistence_ratio']:.0%}, {p['verdict']})\n- in all of them: {p['universal']}\n- brief: {p['brief']}"
    ended = tables["outlier-resolution"]
    c = L.resolution_counts(ended).first()
    yield "\n## How near misses end\n"
    if not c["total"]:
        yield "None ended."
        return
    yield from _markdown(ended.orderBy("outlier_in", "package", "func"), shown)
    yield f"\n- ended: {c['total']}\n- their cluster goes on (rejoined): {c['rejoined']} ({c['rejoined_share']:.0%}, {c['verdict']} evidence)\n- their file goes on: {c['fixed']}\n- neither: {c['deleted']}"
    yield "\nThat a cluster goes on doesn't prove that the function joined it; the verification looks at the code."


def analysis_report(tables: dict[str, DataFrame], title: str) -> Iterator[str]:
    """The statistics behind the study: drift of thresholds, growth, persistence, endings by transition."""
    releases, n = tables["releases"], tables["releases"].count()
    knobs = tuple(c for c in tables["thresholds"].columns if c not in ("tag", "idx"))
    yield f"# Analysis of {title}\n\n## Drift\n"
    if knobs:
        yield from _markdown(L.threshold_drift(tables["thresholds"], knobs).orderBy("field"))
    else:
        yield "No thresholds were recorded."
    g = L.growth(releases).first()
    yield f"\n## Growth\n\n{g['function_slope']:+.2f} functions and {g['cluster_slope']:+.2f} clusters a release; clusters for each function: {g['verdict']} ({g['ratio_slope']:+.5f})"
    for name, rows in (("Clusters", L.cluster_persistence(tables["cluster-tracking"], n)), ("Near misses", L.outlier_persistence(tables["outlier-tracking"], n)), ("Endings", L.resolution_counts(tables["outlier-resolution"])), ("Transitions", L.transitions(tables["outlier-resolution"]).orderBy("transition"))):
        yield f"\n## {name}\n"
        yield from _markdown(rows)


def verification_report(verified: DataFrame, title: str, order: str = "") -> Iterator[str]:
    """Endings (package, func, file, outlier_in, gone_by, cluster, verdict, evidence): how many are fixes, and each one's evidence."""
    counts = L.verdict_counts(verified).orderBy(F.desc("events"), "verdict").collect()
    total, of = sum(r["events"] for r in counts), lambda k: sum(r["events"] for r in counts if r["class"] == k)
    yield f"# Verified endings of {title}\n" + (f"\norder of releases: {order}\n" if order else "")
    yield from (f"- {r['verdict']}: {r['events']}" for r in counts)
    yield f"\n**Fixes: {of('fix')} of {total}. Artefacts of the corpus, which prove nothing: {of('artefact')}.**\n\nAmbiguous endings count neither way until someone has read them.\n"
    for r in verified.orderBy("outlier_in", "package", "func", "file").toLocalIterator():
        yield f"## {r['package']}/{r['func']} ({r['outlier_in']} → {r['gone_by']})\n\n- {r['file']}, cluster {r['cluster']}\n- **{r['verdict']}**: {r['evidence']}\n"


_SHADE = {"High": "#d33", "Medium": "#e93", "Low": "#ec5", "Info": "#9bd"}
_BAND = {"structural": "#06c", "semantic": "#b3a", "systemic": "#63b"}


def findings_page(findings: DataFrame, title: str) -> Iterator[str]:
    """The heat map as a page: a row for each cluster, a column for each weakness in its band's colour, each cell shaded by its worst
    severity and titled with that finding; then all findings, the worst first."""
    e = lambda x: html.escape("" if x is None else str(x))
    kinds = {r["cwe"]: r for r in security.weaknesses(findings).collect()}
    order = sorted(kinds, key=lambda c: (int("".join(x for x in c if x.isdigit()) or 10**9), c))
    yield f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{e(title)}</title><style>body{{font:14px sans-serif;margin:2em}}table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:4px 8px}}.f{{border-left:4px solid #ccc;padding-left:8px;margin:8px 0}}</style></head><body><h1>{e(title)}</h1><ul>"
    for r in security.counters(findings).orderBy("kind", F.desc("findings"), "value").collect():
        yield f"<li>{e(r['kind'])}: {e(r['value'])} {r['findings']}</li>"
    yield "</ul><table><tr><th>cluster</th>" + "".join(f"<th style='color:{_BAND.get(kinds[c]['band'], '#333')}' title='{e(kinds[c]['label'])}'>{e(c)}</th>" for c in order) + "</tr>"
    row, cells = None, {}
    close = lambda: "<tr><td>" + e(row) + "</td>" + "".join(cells.get(c, "<td></td>") for c in order) + "</tr>"
    for r in security.worst_cells(findings).orderBy("row", "cwe").toLocalIterator():
        if r["row"] != row:
            if row is not None:
                yield close()
            row, cells = r["row"], {}
        cells[r["cwe"]] = f"<td style='background:{_SHADE[r['worst']]}' title='{e(r['example'])}'>{r['findings']}</td>"
    if row is not None:
        yield close()
    yield "</table>"
    for r in security.ranked(security.report_gate(findings)).toLocalIterator():
        f = {k: v for k, v in r.asDict(True).items() if v not in (None, "", [])}
        lines = "".join(f"<div><b>{e(k)}</b> {e(v)}</div>" for k, v in f.items() if k not in ("id", "severity", "cwe"))
        yield f"<div class=f style='border-color:{_SHADE.get(r['severity'], '#ccc')}'><b>{e(r['severity'])}</b> {e(r['cwe'])} {e(r['id'])}{lines}</div>"
    yield "</body></html>"


def calibration_text(points: DataFrame, knee: DataFrame, by_sequence: DataFrame, eligible: int, rounds: int) -> Iterator[str]:
    """Both sweeps as text, with the knee of the first and how much the second's stability moves."""
    from ..functions import scalars as S

    yield f"{eligible} eligible functions, {rounds} resamples\n\nthreshold  clusters  coverage  coherence  calls   score  stability  stable  noise  mean/median/max size"
    for r in points.orderBy(F.desc("threshold")).collect():
        yield f"{r['threshold']:<9.2f}  {r['num_clusters']:>8}  {r['coverage']:>7.1%}  {r['mean_coherence']:>9.3f}  {r['mean_call_coherence']:>5.3f}  {r['mean_pairwise_score']:>6.3f}  {r['bootstrap_stability'] or 0:>8.1%}  {r['stable_clusters'] or 0:>6}  {r['noise_clusters'] or 0:>5}  {r['mean_cluster_size']:.1f}/{r['median_cluster_size']}/{r['max_cluster_size']}"
    k = knee.first()
    yield f"\nknee at {k['knee_threshold']:.2f}: stability drops by {k['max_drop']:.2f} there" if k else "\nno knee: stability falls without a break"
    yield "\nsequence threshold  clusters  coverage  coherence  stability"
    rows = by_sequence.orderBy("seq_threshold").collect()
    for r in rows:
        yield f"{r['seq_threshold']:<18.2f}  {r['num_clusters']:>8}  {r['coverage']:>7.1%}  {r['mean_coherence']:>9.3f}  {r['bootstrap_stability'] or 0:>8.1%}"
    if rows:
        low, high = min(r["bootstrap_stability"] or 0 for r in rows), max(r["bootstrap_stability"] or 0 for r in rows)
        word = by_sequence.sparkSession.range(1).select(S.sensitivity(F.lit(float(high - low))).alias("w")).first()["w"]
        yield f"sensitivity: {word}"
