"""Reports of one run, for reading. Only a run's findings come to the driver."""
from __future__ import annotations

import html
import json
import textwrap
from datetime import datetime, timezone

from ..schema import FAILURES, INCONCLUSIVE, VERDICTS

ORDER = ("mismatch", "not_found", "malformed", "unreachable", "unverifiable", "verified")
MARKS = "▁▂▃▄▅▆▇█"


def counts(findings: list[dict]) -> dict:
    """Verdict counts, conclusive checks, score and coverage, as in the summary of a table."""
    n = {v: sum(f["verdict"] == v for f in findings) for v in VERDICTS}
    total, open_ = len(findings), sum(n[v] for v in INCONCLUSIVE)
    share = lambda a, b: a / b if b else None
    return n | {
        "total": total, "conclusive": total - open_, "check_coverage": share(total - open_, total),
        "integrity_score": share(n["verified"], total - open_), "pass_low": share(n["verified"], total), "pass_high": share(n["verified"] + open_, total),
    }


def _what(f: dict) -> str:
    return f.get("claimed_title") or f.get("identifier") or f.get("raw") or ""


def terminal(findings: list[dict], show_verified: bool = False, width: int = 68, quotes: list[dict] = ()) -> str:
    c = counts(findings)
    out = [f"{c['total']} citations, {c['conclusive']} concluded" + (f", score {c['integrity_score']:.3f}" if c["conclusive"] else ", no score")]
    for verdict in ORDER:
        some = sorted((f for f in findings if f["verdict"] == verdict), key=lambda f: (f["line"], f.get("raw") or ""))
        if some and (verdict != "verified" or show_verified):
            out.append(f"\n{verdict} ({len(some)})")
            out += ["\n".join(textwrap.wrap(f"line {f['line']}: {_what(f)} {f.get('detail') or ''}", width, initial_indent="  ", subsequent_indent="    ")) for f in some]
    if quotes:
        q = quote_counts(quotes)
        out.append(f"\n{q['total']} quotations, {q['checked']} checked: " + ", ".join(f"{n} {v}" for v, n in q["verdicts"].items()))
    return "\n".join(out) + "\n"


def quote_counts(quotes: list[dict]) -> dict:
    """Verdict counts of quotations, and the share that could be checked at all."""
    n: dict[str, int] = {}
    for q in quotes:
        n[q["verdict"]] = n.get(q["verdict"], 0) + 1
    checked = n.get("found", 0) + n.get("not_found", 0)
    return {"total": len(quotes), "checked": checked, "coverage": checked / len(quotes) if quotes else None, "verdicts": dict(sorted(n.items()))}


def as_json(document: str, findings: list[dict], quotes: list[dict] = ()) -> str:
    made = datetime.now(timezone.utc).isoformat(timespec="seconds")
    return json.dumps({"document": document, "generated_at": made, "summary": counts(findings), "findings": findings, "quotes": {"summary": quote_counts(quotes), "findings": list(quotes)}}, indent=2, default=str)


def markdown(document: str, findings: list[dict], quotes: list[dict] = ()) -> str:
    c = counts(findings)
    cell = lambda x, n: str(x or "").replace("|", "\\|").replace("\n", " ")[:n]
    out = [f"# {document}", "", "| verdict | n |", "|---|---:|", *(f"| {v} | {c[v]} |" for v in ORDER), ""]
    failed = [f for f in findings if f["verdict"] in FAILURES]
    if failed:
        out += ["| line | reference | verdict | detail |", "|---:|---|---|---|", *(f"| {f['line']} | {cell(_what(f), 70)} | {f['verdict']} | {cell(f.get('detail'), 180)} |" for f in failed), ""]
    rest = [f for f in findings if f["verdict"] in INCONCLUSIVE]
    if rest:
        out += ["<details><summary>Not concluded</summary>", "", *(f"- line {f['line']}: {cell(_what(f), 70)} ({f['verdict']}): {cell(f.get('detail'), 180)}" for f in rest), "", "</details>"]
    if quotes:
        out += ["", "| line | quotation | verdict |", "|---:|---|---|", *(f"| {q.get('line')} | {cell(q.get('text'), 70)} | {q['verdict']} |" for q in quotes), ""]
    return "\n".join(out) + "\n"


def as_html(document: str, findings: list[dict], quotes: list[dict] = ()) -> str:
    e = lambda x: html.escape(str(x if x is not None else ""))
    link = lambda url: f" <a href='{e(url)}'>evidence</a>" if (url or "").startswith(("http://", "https://")) else ""
    c = counts(findings)
    rows = "".join(f"<tr class='{e(f['verdict'])}'><td>{e(f['line'])}</td><td>{e(_what(f))}</td><td>{e(f['verdict'])}</td><td>{e(f.get('detail'))}{link(f.get('evidence_url'))}</td></tr>" for f in findings)
    quoted = "".join(f"<tr><td>{e(q.get('line'))}</td><td>{e(q.get('text'))}</td><td>{e(q['verdict'])}</td></tr>" for q in quotes)
    quoted = f"<h2>Quotations</h2><table><tr><th>line</th><th>quotation</th><th>verdict</th></tr>{quoted}</table>" if quotes else ""
    score = "none" if c["integrity_score"] is None else f"{c['integrity_score']:.3f}"
    return (
        f"<!doctype html><html><head><meta charset='utf-8'><title>{e(document)}</title><style>td{{padding:2px 8px}}</style></head><body><h1>{e(document)}</h1>"
        f"<p>{c['total']} citations, {c['conclusive']} concluded, score {score}</p><table><tr><th>line</th><th>reference</th><th>verdict</th><th>detail</th></tr>{rows}</table>{quoted}</body></html>\n"
    )


def outputs(findings: list[dict]) -> dict[str, str]:
    """What a build job reports: total, failures and the score in percent."""
    c = counts(findings)
    score = "" if c["integrity_score"] is None else str(round(100 * c["integrity_score"], 1))
    return {"total": str(c["total"]), "failures": str(sum(c[v] for v in FAILURES)), "score": score}


def sparkline(values: list[float | None], width: int = 46) -> str:
    """Shares from 0 to 1 as one line of bars."""
    if not values:
        return ""
    picked = [values[i * len(values) // width] for i in range(width)] if len(values) > width else values
    return "".join(" " if v is None else MARKS[min(7, int(8 * max(0.0, v)))] for v in picked)


def exit_code(findings: list[dict], strict: bool = False, fail_under: float | None = None, quotes: list[dict] = ()) -> int:
    """1 for failures (strict: and for checks not concluded), for quotations that a full text lacks, or for a score below fail_under percent; a missing score isn't below it."""
    c = counts(findings)
    bad = sum(c[v] for v in FAILURES) + (sum(c[v] for v in INCONCLUSIVE) if strict else 0) + sum(q["verdict"] == "not_found" for q in quotes)
    low = fail_under is not None and c["integrity_score"] is not None and 100 * c["integrity_score"] < fail_under
    return int(bool(bad) or low)
