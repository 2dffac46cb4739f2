"""Column expressions that normalise label, attack and condition fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from detlake import fixed_values as fv


def _trim(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def label_to_int(col: Column, strict: bool = True) -> Column:
    """``spoof`` -> 1, ``bonafide`` -> 0 after trim and lower-casing.

    Anything else stops the job, or becomes NULL with ``strict=False`` so that
    the caller can quarantine the row.
    """
    word = F.lower(_trim(col))
    out = F.lit(None).cast("long")
    if strict:
        out = F.raise_error(
            F.concat(F.lit("unknown label "), F.coalesce(col, F.lit("NULL")))
        ).cast("long")
    for name, value in fv.LABEL_WORDS.items():
        out = F.when(word == name, F.lit(value).cast("long")).otherwise(out)
    return out


def _without(col: Column, sentinels: list[str]) -> Column:
    value = _trim(F.coalesce(col, F.lit("")))
    return F.when(F.lower(value).isin(sentinels), None).otherwise(value)


def norm_attack(attack: Column, label: Column) -> Column:
    """Attack name of a spoof row; NULL for bonafide rows and placeholders."""
    return F.when(label == fv.LABEL_BONAFIDE, None).otherwise(
        _without(attack, fv.ATTACK_SENTINELS)
    )


def norm_vocoder(vocoder: Column, label: Column) -> Column:
    """Vocoder of a spoof row, by the same rule as the attack name."""
    return norm_attack(vocoder, label)


def norm_condition(condition: Column) -> Column:
    """Recording condition of any row; ``none`` and ``nocodec`` are real values."""
    return _without(condition, fv.CONDITION_SENTINELS)


def lookup(col: Column, table: dict) -> Column:
    """Value of ``table`` for ``col``, NULL where it has no entry."""
    out = F.lit(None)
    for name, value in table.items():
        out = F.when(col == name, F.lit(value)).otherwise(out)
    return out


def native_split(col: Column) -> Column:
    """Native split word to ``train``/``dev``/``test``."""
    return lookup(F.lower(col), fv.NATIVE_SPLITS)
