"""Grades, readings' bits and staleness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the grade scale, best first.
GRADES = ("full", "most", "some", "none")
SURPRISE = {"full": 0.08, "most": 0.30, "some": 0.62, "none": 0.92}
DOCUMENTED = {"full": 0.95, "most": 0.70, "some": 0.35, "none": 0.0}
DOC_GAP = {"full": 0.05, "most": 0.3, "some": 0.65, "none": 1.0}
#: Bits of a packed reading: three of each grade (0 null, 1 none .. 4 full), a trap bit, two of derivable.
CODES = {"none": 1, "some": 2, "most": 3, "full": 4}
TRAP_BIT, DERIVABLE_BIT = 9, 10
PAGE_BYTES, MOST_BYTES = 32_000, 524_288
LEGIBLE_SPEC, TRAP_SPEC = 2, 3


def _lookup(grade: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(grade == k, F.lit(v)).otherwise(out)
    return out


def surprise(grade: Column) -> Column:
    return _lookup(grade, SURPRISE).cast("double")


def documented(grade: Column) -> Column:
    return _lookup(grade, DOCUMENTED).cast("double")


def doc_gap(grade: Column) -> Column:
    return _lookup(grade, DOC_GAP).cast("double")


def effective_predicted(predicted: Column, surprised: Column) -> Column:
    """The predictability grade; one that was not given is none for a surprised reader and full otherwise."""
    return F.coalesce(predicted, F.when(surprised, "none").otherwise("full"))


def effective_documented(documented: Column, derivable: Column) -> Column:
    """What is derivable from the rest counts as not documented."""
    return F.when(derivable, F.lit("none")).otherwise(documented)


def pack(predicted: Column, documented: Column, legible: Column, trap: Column, derivable: Column) -> Column:
    code = lambda g: F.coalesce(_lookup(g, CODES), F.lit(0)).cast("int")
    derived = F.when(derivable.isNull(), 0).when(derivable, 2).otherwise(1)
    return (
        code(predicted)
        .bitwiseOR(F.shiftleft(code(documented), 3))
        .bitwiseOR(F.shiftleft(code(legible), 6))
        .bitwiseOR(F.shiftleft(F.coalesce(trap, F.lit(False)).cast("int"), TRAP_BIT))
        .bitwiseOR(F.shiftleft(derived.cast("int"), DERIVABLE_BIT))
    )


def unpack(packed: Column) -> dict[str, Column]:
    grade = lambda by: _lookup(F.shiftright(packed, by).bitwiseAND(F.lit(7)), {v: k for k, v in CODES.items()})
    derived = F.shiftright(packed, DERIVABLE_BIT).bitwiseAND(F.lit(3))
    return {
        "predicted": grade(0),
        "documented": grade(3),
        "legible": grade(6),
        "trap": F.shiftright(packed, TRAP_BIT).bitwiseAND(F.lit(1)) == 1,
        "derivable": F.when(derived == 2, True).when(derived == 1, False),
    }


def is_stale(recorded: Column, current: Column, size: Column, paged: Column) -> Column:
    """A reading of another body, or of a long one that was never paged."""
    return ((size > PAGE_BYTES) & ~F.coalesce(paged, F.lit(False))) | ((recorded != "") & (recorded != current))


def dated(spec: Column, axis: str) -> Column:
    """Whether a reading was made before its axis existed."""
    return F.coalesce(spec, F.lit(0)) < {"legible": LEGIBLE_SPEC, "trap": TRAP_SPEC}[axis]


def body_pin(body: Column) -> Column:
    """Twelve hexadecimal digits that white space does not change."""
    return F.substring(F.sha2(F.regexp_replace(body, r"\s+", ""), 256), 1, 12)
