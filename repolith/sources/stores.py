"""Readings, decisions and rules as text files: parsed, and written so that they read back."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grades import GRADES
from ..plans.rules import Amendment, format_line, parse_line

READING = "reading_id string, predicted string, documented string, legible string, trap boolean, derivable boolean, surprised boolean, model string, position long, hash string, spec long, note string"
VERDICTS = ("false-positive", "fine-for-now", "fine-always", "flag")


def parse_readings(text: str) -> Iterator[dict]:
    """Readings of one shard: a heading is a key, a bullet its segments. Segments it does not know are skipped."""
    row: dict | None = None
    for line in text.split("\n"):
        if line.startswith("## "):
            if row:
                yield row
            row = {"reading_id": line[3:].strip().strip("`"), "trap": False, "surprised": False}
        elif row is not None and line.startswith("- "):
            for segment in line[2:].split(" · "):
                name, _, value = segment.strip().partition(" ")
                if name in ("predicted", "documented", "legible") and value in GRADES:
                    row[name] = value
                elif name in ("trap", "surprised"):
                    row[name] = True
                elif name == "derivable" and value in ("yes", "no"):
                    row[name] = value == "yes"
                elif name in ("model", "hash"):
                    row[name] = value
                elif name in ("position", "spec") and value.isdigit():
                    row[name] = int(value)
                elif name == "note":
                    row[name] = value
    if row:
        yield row


def format_reading(r: dict) -> str:
    parts = [f"{a} {r[a]}" for a in ("predicted", "documented", "legible") if r.get(a)]
    parts += [a for a in ("trap", "surprised") if r.get(a)]
    if r.get("derivable") is not None:
        parts.append("derivable " + ("yes" if r["derivable"] else "no"))
    parts += [f"{a} {r[a]}" for a in ("model", "hash", "position", "spec") if r.get(a) is not None]
    out = f"## `{r['reading_id']}`\n- " + " · ".join(parts)
    return out + (f"\n- note {' '.join(r['note'].split())}" if r.get("note") else "")


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """Every shard under a path; of several readings of a key the last in a shard holds."""
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in READING.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows = {r["reading_id"]: r for r in parse_readings(text or "")}
                yield pa.RecordBatch.from_pylist(list(rows.values()), schema)

    return spark.read.text(path, wholetext=True).select("value").mapInArrow(run, READING)


def write_readings(readings: DataFrame, path: str) -> None:
    """One Markdown shard a top directory: file entries first, then by line and name. Rows keep their order in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["shard"] for r in rows], pa.string()), pa.array(map(format_reading, rows), pa.string())], ["shard", "value"])

    key = F.col("reading_id")
    r = readings.withColumn("shard", F.when(F.instr(key, "/") > 0, F.substring_index(key, "/", 1)).otherwise("root"))
    is_file = F.instr(key, "#") == 0
    line = [F.col("line")] if "line" in readings.columns else []
    ordered = r.repartition("shard").sortWithinPartitions("shard", F.substring_index(key, "#", 1), ~is_file, *line, key)
    ordered.mapInArrow(run, "shard string, value string").write.mode("overwrite").partitionBy("shard").text(path)


def parse_decisions(lines: list[str]) -> list[dict]:
    """``key · rule · verdict · pin`` bullets. A line with a verdict that is not known is skipped alone."""
    out = []
    for k, line in enumerate(lines):
        m = re.match(r"^- `(.+?)` · `(.+?)` · ([a-z-]+) · `(.*)`(?: — (.*))?$", line.strip())
        if m and m[3] in VERDICTS:
            out.append({"key": m[1], "rule": m[2], "verdict": m[3], "pin": m[4], "reason": m[5] or "", "seq": k})
    return out


def format_decision(d: dict) -> str:
    return f"- `{d['key']}` · `{d['rule']}` · {d['verdict']} · `{d['pin']}`" + (f" — {d['reason']}" if d.get("reason") else "")


def decisions(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_decisions(text.split("\n")), "key string, rule string, verdict string, pin string, reason string, seq long")


def load_rules(text: str) -> list[Amendment]:
    return [a for line in text.split("\n") if (a := parse_line(line))]


def dump_rules(saved: list[Amendment]) -> str:
    return "".join(format_line(a) + "\n" for a in saved)


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    """Every table as JSON lines in a folder of its own, with a list of them beside."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")
    spark = next(iter(tables.values())).sparkSession
    listed = [(json.dumps({"table": n, "columns": df.columns}),) for n, df in tables.items()]
    spark.createDataFrame(listed, "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/tables")
