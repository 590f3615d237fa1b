"""Documents for readers. They list what a person would read, so their rows are brought to the driver, streamed and in order."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import deltas, report, security
from ..operators import profile as P
from ..plans.analysis import Analysis


def json_lines(rows: DataFrame) -> Iterator[str]:
    return (r[0] for r in rows.select(F.to_json(F.struct("*"))).toLocalIterator())


def outlier_text(rows: DataFrame) -> Iterator[str]:
    """The near misses of operators.deltas.outliers() as text."""
    text = {s: S.delta_text(F.col(f"{s}_delta.added"), F.col(f"{s}_delta.removed")).alias(f"{s}_text") for s in ("token", "import", "call")}
    for i, r in enumerate(rows.select("*", *text.values(), S.signed(F.col("cyclo_delta")).alias("cyclo_text")).orderBy("package", "func", "file", "line").toLocalIterator()):
        if i:
            yield "─" * 72
        yield from (f"{k + ':':<9}{r[k]}" for k in ("func", "package", "file", "line"))
        if r["body"]:
            yield "body:"
            yield from ("  " + x for x in r["body"].rstrip("\n").split("\n"))
        yield "deviation:"
        yield from (f"  {s + ' delta:':<14} {r[s + '_text']}" for s in ("token", "import", "call", "cyclo"))
        yield "candidates:"
        yield from (f"  {c['rank']}. {c['cluster_id'][:6]}  score={c['score']:.3f}" + (f"  {c['idiom']}" if c["idiom"] else "") for c in r["candidates"])


def cluster_text(row) -> Iterator[str]:
    """One row of operators.deltas.cluster_shape() as text."""
    yield f"shape: {row['shape_hash']}  tier: {row['tier']}  size: {row['size']}  score: {row['mean_score']:.3f}"
    yield f"common: {row['common_shape']}"
    for m in row["members"]:
        yield f"  {m['package']}.{m['func']}  {m['file']}:{m['line']}"
        yield f"    tokens: {m['tokens']}"
        yield f"    imports: {', '.join(m['imports'])}"
        yield f"    calls: {', '.join(m['calls'])}"


def outlier_document(a: Analysis, title: str) -> Iterator[str]:
    """Two sections: the clusters that near misses are closest to, in the order in which these name them, with their members; then
    the near misses with what sets them apart. Nothing if there are no near misses."""
    found = deltas.outliers(a.near_misses, a.clusters, a.fns).orderBy("package", "func", "file", "line")
    rows = found.collect()
    if not rows:
        return
    order = list(dict.fromkeys(r["candidates"][0]["cluster_id"] for r in rows))
    yield f"# Outliers of {title}"
    yield f"outliers: {len(rows)}  clusters: {len(order)}"
    yield "\n=== Patterns ===\n"
    shapes = a.clusters.where(F.col("shape_hash").isin(order))
    members = deltas.member_details(a.members.join(shapes.select("cluster_id"), "cluster_id"), a.fns).join(shapes.select("cluster_id", "shape_hash"), "cluster_id")
    of = {r["shape_hash"]: r for r in shapes.select("shape_hash", "tier", "size", S.seq_string(F.col("common_seq")).alias("common")).collect()}
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("shape_hash"))
    last = None
    for m in members.orderBy(place, "member_pos").toLocalIterator():
        if m["shape_hash"] != last:
            last = m["shape_hash"]
            yield f"[{last}] tier: {of[last]['tier']}  size: {of[last]['size']}\n  common subsequence: {of[last]['common']}\n  peers:"
        yield f"    {m['package']}/{m['func']} ({m['file']}:{m['line']})"
        yield from ("      " + x for x in (m["body"].rstrip("\n").split("\n") if m["body"] else []))
    yield "\n=== Outliers ===\n"
    yield from outlier_text(found)


def pattern_index(a: Analysis, title: str) -> Iterator[str]:
    """Labelled clusters with their members, as Markdown."""
    labelled = a.clusters.where("label <> ''")
    rows = {r["cluster_id"]: r for r in labelled.select("cluster_id", "label", "shape_hash", "size", "coherence", S.seq_string(F.col("token_seq")).alias("shape")).collect()}
    yield f"# Patterns of {title}\n\n{len(rows)} patterns\n"
    last = None
    for m in deltas.member_details(a.members.join(labelled.select("cluster_id"), "cluster_id"), a.fns).orderBy("cluster_id", "member_pos").toLocalIterator():
        if m["cluster_id"] != last:
            last, c = m["cluster_id"], rows[m["cluster_id"]]
            yield f"\n## {c['label']}\nid:{c['shape_hash']}  size:{c['size']}  coherence:{c['coherence']:.2f}  shape:{c['shape']}\n"
        yield f"- {m['package']}.{m['func']}  {m['file']}:{m['line']}"


_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:3px 8px;text-align:left}.green{color:#080}.yellow{color:#a70}.red{color:#b00}.bar{background:#58a;height:8px}.card{border:1px solid #ccc;border-radius:6px;padding:8px 12px;margin:10px 0}.chip{display:inline-block;border:1px solid #aaa;border-radius:9px;padding:0 7px;margin:1px}.add{background:#efe}.lack{background:#fee}pre{background:#f6f6f6;padding:6px}"


def _cards(a: Analysis) -> Iterator[str]:
    """A card for each cluster, by tier and rank: badges, bar, common shape, packages, members with bodies, and who nearly belongs."""
    e = lambda x: html.escape(str(x))
    order = F.when(F.col("tier") == "high", 0).when(F.col("tier") == "medium", 1).otherwise(2)
    rows = report.cluster_rows(a.clusters, a.members, a.fns, a.near_misses)
    scores = P.member_scores(a.members, a.fns, "geo")
    members = deltas.member_details(a.members, a.fns).join(scores, ["cluster_id", "fn_id"]).join(a.clusters.select("cluster_id", "shape_hash"), "cluster_id")
    every = rows.select("shape_hash", order.alias("t"), *[c for c in rows.columns if c != "shape_hash"]).join(members.select("shape_hash", "func", "package", "file", "line", "body", "score"), "shape_hash")
    now = None
    for r in every.orderBy("t", "ordinal", F.desc("score"), "package", "func").toLocalIterator():
        if r["shape_hash"] != now:
            if now is not None:
                yield "</ul></div>"
            now = r["shape_hash"]
            chips = "".join(f"<span class=chip>{e(x)}</span>" for x in (r["imports"].split(", ") if r["imports"] else []))
            near = "".join(f"<span class=chip>{e(x)}</span>" for x in r["potentials"])
            yield (
                f'<div class=card><h3>{e(r["tier"])} {r["ordinal"]}: {e(r["label"])} <small class="shape">{e(now)}</small></h3><div class=bar style="width:{r["bar"]}%"></div>'
                f'<p>{r["size"]} members in {e(r["packages"])} · score <b class={r["score_badge"]}>{r["avg_score"]:.2f}</b> · coherence <b class={r["coherence_badge"]}>{r["coherence"]:.2f}</b> · calls {r["call_coherence"]:.2f} · complexity {r["cyclo_mean"]:.1f}</p>'
                f'<pre>{e(r["common_shape"])}</pre><p>{chips}</p>' + (f"<p>nearly: {near}</p>" if near else "") + "<ul>"
            )
        body = f"<details><summary>body</summary><pre>{e(r['body'])}</pre></details>" if r["body"] else ""
        yield f"<li>{e(r['package'])}.{e(r['func'])} <small>{e(r['file'])}:{r['line']}</small> {_percent(r['score'])}{body}</li>"
    if now is not None:
        yield "</ul></div>"


def _percent(score: float) -> str:
    return f"{int(score * 100)}%"


def _near_cards(a: Analysis) -> Iterator[str]:
    """A card for each cluster that near misses are closest to, with what each of them adds and lacks."""
    e = lambda x: html.escape(str(x))
    for g in deltas.outlier_groups(a.near_misses, a.clusters, a.fns).toLocalIterator():
        yield f'<div class=card><h3>near {e(g["cluster_label"] or g["cluster_id"])} ({e(g["tier"])})</h3><pre>{e(g["common_shape"])}</pre><ul>'
        for o in g["outliers"]:
            chips = "".join(f"<span class='chip {kind}'>{sign}{e(x)}</span>" for side in deltas.SIDES for kind, sign, what in (("add", "+", "added"), ("lack", "-", "removed")) for x in o[f"{side}_{what}"])
            yield f"<li>{e(o['package'])}.{e(o['name'])} <small>{e(o['file_path'])}:{o['line']}</small> complexity {o['cyclo_delta']:+.1f} {chips or '—'}</li>"
        yield "</ul></div>"


def _table(rows: DataFrame, title: str) -> Iterator[str]:
    names = rows.columns
    yield f"<h2>{html.escape(title)}</h2><table><tr>{''.join(f'<th>{html.escape(n)}</th>' for n in names)}</tr>"
    for r in rows.toLocalIterator():
        cell = lambda n, v: f'<td class="shape">{html.escape(str(v))}</td>' if n == "shape_hash" else f"<td>{html.escape(f'{v:.3f}' if isinstance(v, float) else str(v))}</td>"
        yield "<tr>" + "".join(cell(n, r[n]) for n in names) + "</tr>"
    yield "</table>"


def html_report(a: Analysis, title: str) -> Iterator[str]:
    """The whole report as a page, made also where there are no clusters or no near misses."""
    found = a.near_misses
    d = deltas.deltas(found, a.clusters, a.fns)
    scores, sizes = report.score_histogram(a.avg_scores), report.size_histogram(a.clusters)
    yield f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{html.escape(title)}</title><style>{_STYLE}</style></head><body><h1>{html.escape(title)}</h1>"
    yield from _table(report.means(a.clusters, a.avg_scores), "Summary")
    for hist, verdict, name in ((scores, report.explain_scores(scores), "Scores"), (sizes, report.explain_sizes(sizes), "Sizes")):
        yield from _table(hist.orderBy("bucket"), name)
        yield f"<p>{html.escape(verdict.first()['text'])}</p>"
    yield from _table(report.package_coverage(a.members, found, a.fns).orderBy(F.desc("total"), "package"), "Packages")
    yield from _table(report.delta_direction(d).orderBy("bucket"), "Directions")
    yield from _table(report.missing_tokens(d).orderBy(F.desc("count"), "token"), "Missing tokens")
    yield "<h2>Clusters</h2>"
    yield from _cards(a)
    yield "<h2>Near misses</h2>"
    yield from _near_cards(a)
    yield "</body></html>"


def security_markdown(findings: DataFrame, title: str) -> Iterator[str]:
    """The matrix of findings with its counters, and the findings from the worst on."""
    yield f"# Findings of {title}\n"
    last = None
    for r in security.counters(findings).orderBy("kind", F.desc("findings"), "value").collect():
        if r["kind"] != last:
            last = r["kind"]
            yield f"\n{last}: "
        yield f"- {r['value']}: {r['findings']}"
    m = security.severity_matrix(findings)
    yield "\n| cluster | " + " | ".join(c.removeprefix("CWE-") for c in m.columns[1:]) + " |\n|" + "---|" * len(m.columns)
    for r in m.toLocalIterator():
        yield "| `" + "` | ".join([r[0], " | ".join(r[1:])]) + " |"
    yield ""
    for r in security.weaknesses(findings).orderBy("cwe").collect():
        yield f"- {r['cwe']} = {r['label']} ({r['band']})"
    for r in security.ranked(security.report_gate(findings)).toLocalIterator():
        yield f"\n## {r['id']} ({r['severity']})\n" + json.dumps({k: v for k, v in r.asDict(True).items() if v is not None}, ensure_ascii=False)


def save(lines: Iterator[str], path: str) -> int:
    """Writes the lines; returns how many there were."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        for n, line in enumerate(lines, 1):  # noqa: B007
            f.write(line + "\n")
    return n
