"""Column functions on bases, codons and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The amino acids of the 64 codons, first, second and third base in the order TCAG; * is a stop.
BASES, AMINO = "TCAG", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: The bases that each ambiguity code stands for.
CODES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT",
    "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
#: A base's bit: purines are the two low ones, and a transition swaps neighbours.
_BIT = {"A": 1, "G": 2, "C": 4, "T": 8}


def translate_codon(codon: Column) -> Column:
    """The amino acid of three bases in either case; X for anything else, null for null."""
    c = F.upper(codon)
    at = [F.instr(F.lit(BASES), F.substring(c, k, 1)) for k in (1, 2, 3)]
    known = c.rlike("^[TCAG]{3}$")
    letter = F.substring(F.lit(AMINO), 16 * at[0] + 4 * at[1] + at[2] - F.lit(20), F.lit(1))
    return F.when(codon.isNotNull(), F.when(known, letter).otherwise(F.lit("X")))


def translate(bases: Column) -> Column:
    """The amino acids of the codons from the first base on; one or two bases that are left over are passed over."""
    return F.array_join(F.transform(F.regexp_extract_all(bases, F.lit("(?s)..."), F.lit(0)), translate_codon), "")


def decimal_year(day: Column) -> Column:
    """The year with twelfths for months and 365.25ths for days, as dates of collection are regressed on."""
    return F.year(day) + (F.month(day) - 1) / F.lit(12.0) + (F.dayofmonth(day) - 1) / F.lit(365.25)


def _mask(base: Column) -> Column:
    table = F.create_map(*[F.lit(x) for code, of in CODES.items() for x in (code, sum(_BIT[b] for b in of))])
    return F.coalesce(F.element_at(table, F.upper(base)), F.lit(0))


def site_class(one: Column, other: Column) -> Column:
    """same, transition or transversion for two bases or ambiguity codes; null where one is a gap or unknown.

    Ambiguous pairs count as a transition if only transitions are among their pairs of bases, as a transversion if any is.
    """
    a, b = _mask(one), _mask(other)
    swapped = F.shiftleft(b.bitwiseAND(5), 1).bitwiseOR(F.shiftright(b.bitwiseAND(10), 1))
    purine, pyrimidine = (lambda m: m.bitwiseAND(3) != 0), (lambda m: m.bitwiseAND(12) != 0)
    across = (purine(a) & pyrimidine(b)) | (pyrimidine(a) & purine(b))
    return (
        F.when((a == 0) | (b == 0), F.lit(None).cast("string"))
        .when((a == b) & (F.bit_count(a) == 1), "same")
        .when(across, "transversion")
        .when(a.bitwiseAND(swapped) != 0, "transition")
    )
