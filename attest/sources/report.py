"""The audit of a probe suite as one HTML page without outside references."""

from collections.abc import Iterable, Iterator
from datetime import date
from html import escape
from pathlib import Path

from pyspark.sql import Row

from ..operators.probes import ProbeReport

_STYLE = "body{font:16px/1.5 sans-serif;max-width:46rem;margin:2rem auto;padding:0 1rem}table{border-collapse:collapse;width:100%}td,th{border-bottom:1px solid #ccc;padding:.3rem;text-align:left}.big{font-size:3rem}"


def _table(probes: Iterable[Row]) -> Iterator[str]:
    yield "<table><tr><th>Kind</th><th>Question</th><th>Statement</th></tr>"
    for p in probes:
        yield f"<tr><td>{escape(p['kind'])}</td><td>{escape(p['question'])}</td><td>{escape(p['candidate'])}</td></tr>"
    yield "</table>"


def html_parts(report: ProbeReport, *, client: str = "", knowledge_base: str = "", prepared_by: str = "", today: date | None = None) -> Iterator[str]:
    """Leak rate, tallies by kind, what leaked and, if any, what was wrongly blocked, piece by piece."""
    rows = "".join(f"<tr><td>{escape(kind)}</td><td>{c}/{n}</td><td>{c / n if n else 0:.0%}</td></tr>" for kind, (c, n) in sorted(report.by_kind.items()))
    about = "".join(f"<p>{name}: {escape(value)}</p>" for name, value in (("Client", client), ("Knowledge base", knowledge_base), ("Prepared by", prepared_by)) if value)
    yield f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Gate audit</title><style>{_STYLE}</style></head><body><h1>Gate audit</h1>{about}<p>{today or date.today()}</p>'
    yield f'<p class="big">{report.leak_rate:.0%}</p><p>{report.leaked} of {report.attacks} attacks leaked; accuracy {report.accuracy:.0%} over {report.total} probes.</p>'
    yield f"<h2>By kind</h2><table><tr><th>Kind</th><th>Right</th><th>Share</th></tr>{rows}</table><h2>What leaked</h2>"
    yield from _table(report.false_deliveries()) if report.leaked else ("<p>Nothing leaked.</p>",)
    if report.blocked:
        yield "<h2>Right answers blocked</h2>"
        yield from _table(report.false_blocks())
    yield "</body></html>"


def render_html_report(report: ProbeReport, **about: object) -> str:
    return "".join(html_parts(report, **about))


def write_html_report(report: ProbeReport, path: str, **about: object) -> None:
    with Path(path).open("w", encoding="utf-8") as out:
        out.writelines(html_parts(report, **about))
