"""Markdown straight to blocks: headings, lists, fences, tables, quotes, display maths."""

from __future__ import annotations

import re

_ITEM = re.compile(r"^(\s*)(?:[-*+]|\d{1,9}[.)])\s+(.*)$")


def _cells(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]


def blocks_of(text: str | None) -> list[dict]:
    """Ordered blocks; a table needs its separator row to lose a line."""
    out: list[dict] = []
    para: list[str] = []

    def add(kind: str, body: str | None, level: int | None = None, grid=None, depth: int | None = None) -> None:
        out.append({"ordinal": len(out), "type": kind, "text": body, "text_level": level, "grid": grid, "depth": depth})

    def flush() -> None:
        if para:
            add("text", inline(" ".join(" ".join(para).split())))
            para.clear()

    lines, i = (text or "").replace("\r\n", "\n").split("\n"), 0
    while i < len(lines):
        line = lines[i]
        fence = re.match(r"^\s{0,3}(```+|~~~+)", line)
        if fence:
            flush()
            j = i + 1
            while j < len(lines) and not lines[j].strip().startswith(fence.group(1)):
                j += 1
            add("code", "\n".join(lines[i + 1 : j]))
            i = j + 1
            continue
        if line.strip().startswith("$$"):
            flush()
            j, body = i, line.strip()[2:]
            while not body.rstrip().endswith("$$") and j + 1 < len(lines):
                j += 1
                body += "\n" + lines[j]
            add("equation", body.rstrip().removesuffix("$$").strip())
            i = j + 1
            continue
        head = re.match(r"^\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if head:
            flush()
            add("title", inline(head.group(2)), len(head.group(1)))
        elif para and re.match(r"^\s{0,3}(=+|-+)\s*$", line):
            level = 1 if "=" in line else 2
            body = inline(" ".join(para))
            para.clear()
            add("title", body, level)
        elif "|" in line and (line.strip().startswith("|") or (i + 1 < len(lines) and re.fullmatch(r"[\s|:-]*-[\s|:-]*", lines[i + 1]) and "|" in lines[i + 1])):
            flush()
            rows = []
            while i < len(lines) and "|" in lines[i]:
                if not re.fullmatch(r"[\s|:-]+", lines[i]):
                    rows.append(_cells(lines[i]))
                i += 1
            add("table", None, grid=rows)
            continue
        elif (item := _ITEM.match(line)) and not re.fullmatch(r"\s{0,3}([-*_]\s*){3,}", line):
            flush()
            add("list", inline(item.group(2)), depth=len(item.group(1).expandtabs(4)) // 2)
        elif re.fullmatch(r"\s{0,3}([-*_]\s*){3,}", line) or not line.strip():
            flush()
        else:
            para.append(re.sub(r"^\s{0,3}>\s?", "", line))
        i += 1
    flush()
    return out


def inline(text: str) -> str:
    """Inline marks away; links keep their address as HTML's do; inline maths as ``\\( \\)``."""
    text = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"\[([^\]]+)\]\(([^)\s]+)[^)]*\)", lambda m: m.group(1) if m.group(2).startswith("#") or m.group(1) == m.group(2) else f"{m.group(1)} ({m.group(2)})", text)
    text = re.sub(r"(?<![\\$])\$([^$\s](?:[^$]*[^$\s])?)\$(?!\d)", r"\\(\1\\)", text)
    text = re.sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"\2", text)
    text = re.sub(r"(?<!\w)([*_])(?=\S)(.+?)(?<=\S)\1(?!\w)", r"\2", text)
    return re.sub(r"`([^`]+)`", r"\1", text).strip()
