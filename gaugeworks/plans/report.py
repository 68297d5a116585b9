"""Reports as text: markdown of grades, findings and tasks, from small result tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Row

#: Longest part of a comment in characters; least number of parts.
PART, LEAST_PARTS = 60_000, 3


def _table(rows: list[Row], columns: list[str]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(str(r[c]).replace("|", "\\|").replace("\n", " ") for c in columns) + " |" for r in rows)])


def plain(parts: dict[str, DataFrame]) -> str:
    """Markdown: a heading and a table for each result, as they come; their sizes are those
    of a report (grades, top findings)."""
    out = []
    for title, df in parts.items():
        rows = df.collect()
        out += [f"## {title}", _table(rows, df.columns) if rows else "Nothing found."]
    return "\n\n".join(out) + "\n"


def bar(score: int, width: int = 20) -> str:
    full = round(max(0, min(100, score)) / 100 * width)
    return "█" * full + "░" * (width - full)


def github(overall: Row, grades: list[Row], findings: list[Row]) -> str:
    """Markdown with folded sections: the overall grade, a bar for each category, and the
    findings with their source."""
    out = [f"# {overall['overall_grade']} ({overall['overall_score']}/100)", ""]
    out += [f"`{bar(g['score'])}` **{g['category']}** {g['grade']} ({g['score']})  " for g in grades]
    for f in findings:
        out += ["", "<details>", f"<summary>{f['path']}:{f['start_line']}-{f['end_line']} ({f['findings']})</summary>", "", "```", str(f["source"]), "```", "</details>"]
    return "\n".join(out) + "\n"


def agent(tasks: list[Row]) -> str:
    """Numbered tasks, the critical ones first."""
    lines = [f"{k}. [{t['severity']}] {t['path']}:{t['start_line']}-{t['end_line']} {t['category']}.{t['behavior']}: {t['hint'] or 'see the behaviour'}" for k, t in enumerate(tasks, 1)]
    return "\n".join(lines) + "\n" if lines else "No tasks.\n"


def parts(text: str, most: int = PART, least: int = LEAST_PARTS) -> list[str]:
    """A text in parts of at most `most` characters, cut at line ends where there are some,
    and empty ones up to the least number."""
    out, rest = [], text
    while rest:
        cut = len(rest) if len(rest) <= most else rest.rfind("\n", 0, most) + 1 or most
        out.append(rest[:cut])
        rest = rest[cut:]
    return out + [""] * (least - len(out))


def write_parts(text: str, folder: str) -> list[str]:
    """The parts as numbered files on the driver, and a file with their number."""
    os.makedirs(folder, exist_ok=True)
    paths = []
    pieces = parts(text)
    for k, piece in enumerate(pieces, 1):
        paths.append(os.path.join(folder, f"part-{k}.md"))
        with open(paths[-1], "w", encoding="utf-8") as f:
            f.write(piece)
    with open(os.path.join(folder, "count"), "w", encoding="utf-8") as f:
        f.write(f"{len(pieces)}\n")
    return paths
