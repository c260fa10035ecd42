"""Column expressions over record fields and sequence text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alternate raw field names, tried in this order.
FIELD_CANDIDATES = {
    "species": ("species", "species_name"),
    "genus": ("genus",),
    "family": ("family",),
    "order": ("order",),
    "sequence": ("nuc", "nucleotides", "sequence"),
    "process_id": ("processid", "process_id"),
    "bin_uri": ("bin_uri", "bin"),
}
MARKER_CANDIDATES = ("marker_code", "marker")
VALID_BASES = "ACGTN"

_LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
_EDGE_SPACE = r"(?U)^\s+|\s+$"


def first_present(*names: str) -> Column:
    """First field that is neither null nor the empty string (blanks do count)."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def field(name: str) -> Column:
    return first_present(*FIELD_CANDIDATES[name])


def coordinates(coord: str = "coord", lat: str = "lat", lon: str = "lon") -> tuple[Column, Column]:
    """A two-element array wins even when it holds nulls; otherwise the scalar pair."""
    paired = F.size(coord) == 2
    return (
        F.when(paired, F.col(coord)[0]).otherwise(F.col(lat)),
        F.when(paired, F.col(coord)[1]).otherwise(F.col(lon)),
    )


def marker() -> Column:
    return first_present(*MARKER_CANDIDATES)


def normalise_sequence(seq: Column) -> Column:
    return F.upper(F.regexp_replace(seq, _EDGE_SPACE, ""))


def ambiguous_fraction(seq: Column) -> Column:
    """Share of characters outside ACGT (any case); an empty sequence is fully ambiguous."""
    clean = F.length(F.regexp_replace(seq, "[^ACGTacgt]", ""))
    return F.when(F.length(seq) == 0, F.lit(1.0)).otherwise(
        (F.length(seq) - clean).cast("double") / F.length(seq)
    )


def pasted_sequence(raw: Column) -> Column:
    """FASTA or bare text to one upper-case string: header lines and whitespace go."""
    lines = F.transform(F.split(raw, _LINE_BREAK), lambda x: F.regexp_replace(x, _EDGE_SPACE, ""))
    kept = F.filter(lines, lambda x: (x != "") & ~x.startswith(">"))
    return F.regexp_replace(F.upper(F.array_join(kept, "")), r"(?U)\s", "")


def invalid_bases(seq: Column) -> Column:
    """Sorted distinct characters outside ACGTN, joined."""
    bad = F.regexp_replace(seq, f"[{VALID_BASES}]", "")
    return F.array_join(F.array_sort(F.array_distinct(F.split(bad, ""))), "")


def paste_error(seq: Column) -> Column:
    return F.when(seq == "", F.lit("empty")).when(invalid_bases(seq) != "", F.lit("invalid_chars"))


def all_true(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
