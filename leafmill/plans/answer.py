"""Questions as SQL over typed views: registering, guarding, labelling, rendering, auditing.

Everything a language model would do is behind a callable; the defaults are
deterministic, so an answer can be reproduced.
"""

from __future__ import annotations

import re
import threading
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions import dtypes
from . import dialect

#: Seconds a statement may run, rows a result shows.
TIMEOUT, SHOWN = 3.0, 50


@dataclass
class TableInfo:
    """What is known of one table: its label, headers, types and the rows' frame."""

    label: str
    headers: list[str]
    columns: list[tuple[str, int]]
    n_rows: int | None = None
    samples: list[list[str]] = field(default_factory=list)


@dataclass
class SqlResult:
    """Rows of one query with where they came from."""

    sql: str
    columns: list[str]
    rows: list[tuple]
    total: int
    sources: list[str]


def register(spark: SparkSession, stores: list[DataFrame], header_rows: tuple[int, ...] = (0,)) -> list[list[tuple[str, int]]]:
    """Views ``t0..tN`` over positional row stores; a view is a projection, nothing is copied."""
    kinds = []
    for i, rows in enumerate(stores):
        columns = dtypes.table_columns(rows)
        dtypes.typed_view(rows, columns, header_rows).createOrReplaceTempView(f"t{i}")
        kinds.append(columns)
    return kinds


def run(spark: SparkSession, sql: str) -> DataFrame:
    """A guarded, translated query."""
    return dialect.run(spark, sql)


def execute(spark: SparkSession, sql: str, labels: list[str] | None = None, timeout: float = TIMEOUT, cap: int = SHOWN) -> SqlResult:
    """Run with a time limit; a job beyond it is cancelled by its tag."""
    df = run(spark, sql)
    tag = f"ask-{threading.get_ident()}-{abs(hash(sql)) % 10**8}"
    spark.addTag(tag)
    timer = threading.Timer(timeout, lambda: spark.interruptTag(tag))
    timer.start()
    try:
        df = df.persist()  # what the first rows were made of isn't made again to be counted
        rows = [tuple(r) for r in df.limit(cap + 1).collect()]
        total = len(rows) if len(rows) <= cap else df.count()
    finally:
        df.unpersist()
        timer.cancel()
        spark.removeTag(tag)
    return SqlResult(sql, df.columns, rows[:cap], total, sources(sql, labels or [], df.columns, rows[:cap]))


def answer_all(spark: SparkSession, queries: list[str], labels: list[str] | None = None) -> list[SqlResult]:
    """Every query that runs; one that fails is left out and the others go on."""
    out = []
    for sql in dict.fromkeys(queries):
        try:
            out.append(execute(spark, sql, labels))
        except Exception:  # noqa: BLE001, S112 - a bad query must not take the others with it
            continue
    return out


def sources(sql: str, labels: list[str], columns: list[str] = (), rows: list[tuple] = ()) -> list[str]:
    """Labels of the tables a query names, each once, in order; of a query that names none, what its ``file`` and ``sheet`` columns hold; else all labels."""
    named = [labels[int(n)] for n in re.findall(r"\bt(\d+)\b", sql) if int(n) < len(labels)]
    if named:
        return list(dict.fromkeys(named))
    at = [i for i, c in enumerate(columns) if c.lower() in ("file", "sheet")]
    held = [str(r[i]) for r in rows for i in at if r[i] is not None]
    return list(dict.fromkeys(held or labels))


def labels_of(names: list[tuple[str, str | None]]) -> list[str]:
    """``file (place)`` for each table; repeats are numbered in order."""
    plain = [f"{f} ({p})" if p else f for f, p in names]
    times = Counter(plain)
    seen: dict[str, int] = {}
    out = []
    for label in plain:
        seen[label] = seen.get(label, 0) + 1
        out.append(f"{label} #{seen[label]}" if times[label] > 1 else label)
    return out


def schema_block(tables: list[TableInfo]) -> str:
    """What a query writer is shown of the tables."""
    out = []
    for i, t in enumerate(tables):
        out.append(f"t{i} ({t.label}) rows={t.n_rows if t.n_rows is not None else '?'}")
        for j, (header, (kind, _)) in enumerate(zip(t.headers, t.columns, strict=True)):
            examples = [s[j] for s in t.samples if j < len(s) and s[j]][:3]
            out.append(f"  c{j}: {header} ({kind})" + (f"  e.g. {', '.join(examples)}" if examples else ""))
    return "\n".join(out)


def readable(sql: str, tables: list[TableInfo]) -> str:
    """The query with headers and labels in place of ``tN.cM`` and ``tN``."""

    def name(m: re.Match) -> str:
        t, c = int(m.group(1)), m.group(2)
        if t >= len(tables):
            return m.group()
        if c is None:
            return f'"{tables[t].label}"'
        return f'"{tables[t].headers[int(c)]}"' if int(c) < len(tables[t].headers) else m.group()

    return re.sub(r"\bt(\d+)(?:\.c(\d+))?\b", name, sql)


def render(result: SqlResult, label: str = "") -> str:
    """A result as text: label, how much of it is shown, the query, header and rows."""
    head = [label] if label else []
    if result.total > len(result.rows):
        head.append(f"showing {len(result.rows)} of {result.total}")
    head.append(f"computed by {result.sql}")
    lines = [" | ".join(result.columns), *(" | ".join("" if v is None else str(v) for v in r) for r in result.rows)]
    return "\n".join([*head, *lines])


def fabricated(answer: str, known: list[str]) -> list[str]:
    """Bracketed citations of an answer that name no known source; a page suffix is no part of a name."""
    cited = [re.sub(r"\s+p\.?\d+$", "", c.strip()) for c in re.findall(r"\[([^\]\n]+)\]", answer)]
    return [c for c in dict.fromkeys(cited) if c not in known]


def walk(windows: list, judge: Callable, patience: int = 2) -> list:
    """Judge windows in order; stop after ``patience`` windows in a row yield nothing."""
    out, empty = [], 0
    for w in windows:
        got = judge(w)
        out.extend(got)
        empty = 0 if got else empty + 1
        if empty >= patience:
            break
    return out


def last_object(text: str):
    """The last balanced JSON object in a text, parsed, or None."""
    import json

    best, depth, start = None, 0, None
    quoted = escaped = False
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
            continue
        if c == '"' and depth:
            quoted = True
        elif c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                try:
                    best = json.loads(text[start : i + 1])
                except ValueError:
                    continue
    return best


def inline_refs(schema: dict) -> dict:
    """A JSON schema with its local ``$ref``s replaced by what they name."""
    defs = schema.get("$defs", {})

    def put(node, trail: tuple = ()):
        if isinstance(node, dict):
            ref = node.get("$ref")
            if isinstance(ref, str) and ref.startswith("#/$defs/"):
                name = ref.rsplit("/", 1)[1]
                return {} if name in trail else put(defs.get(name, {}), (*trail, name))
            return {k: put(v, trail) for k, v in node.items() if k != "$defs"}
        return [put(x, trail) for x in node] if isinstance(node, list) else node

    return put(schema)
