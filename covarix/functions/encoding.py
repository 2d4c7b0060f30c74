"""Alphabets and scalar expressions: codes, Gray codes, distances, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two residue orders; a letter's code is its place.
BASE20 = "AILVMFYWEDQNHKRSTCPG"
GROUPED = "AVLIFYWMCPGSTNQDEHKR"
GAP = 20
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def code_of(letter: Column, alphabet: str = BASE20) -> Column:
    """Code of one upper-case letter; ``GAP`` for anything else."""
    at = F.position(letter, F.lit(alphabet))
    return F.when((F.length(letter) == 1) & (at > 0), at - 1).otherwise(F.lit(GAP))


def letter_of(code: Column, alphabet: str = BASE20) -> Column:
    """Letter of a code; ``-`` for the gap."""
    return F.when((code >= 0) & (code < GAP), F.substr(F.lit(alphabet), code + 1, F.lit(1))).otherwise(F.lit("-"))


def codes_of(sequence: Column, alphabet: str = BASE20) -> Column:
    """Array of codes of a whole sequence, in either case; empty for null or empty."""
    upper = F.translate(F.coalesce(sequence, F.lit("")), LOWER, UPPER)
    chars = F.when(F.length(upper) > 0, F.split(upper, "")).otherwise(F.array().cast("array<string>"))
    return F.transform(chars, lambda c: code_of(c, alphabet))


def valid(code: Column) -> Column:
    return (code >= 0) & (code < GAP)


def gray(code: Column) -> Column:
    """Binary-reflected Gray code."""
    return code.bitwiseXOR(F.shiftright(code, 1))


def gray_distance(a: Column, b: Column) -> Column:
    return F.bit_count(gray(a).bitwiseXOR(gray(b)))


def distances(a: Column, b: Column) -> Column:
    """Gray distances position by position, over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), gray_distance)


def kmer_cell(*codes: Column) -> Column:
    """Index of a k-mer in base 20, first code most significant."""
    out = F.lit(0).cast("long")
    for c in codes:
        out = out * 20 + c
    return out


def signature_cell(a: Column, b: Column) -> Column:
    """A pair as one number; base 21, so that the gap does not collide."""
    return a * 21 + b


def bit(cell: Column, k: int, width: int = 10) -> Column:
    """Bit k of a cell index, most significant first."""
    return F.shiftright(cell, width - 1 - k).bitwiseAND(F.lit(1))


def perplexity(entropy: Column) -> Column:
    return F.pow(F.lit(2.0), entropy)


def sigmoid(x: Column) -> Column:
    """Logistic function of x clipped to [-10, 10]."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-10.0), F.least(F.lit(10.0), x))))


def variability(pp: Column) -> Column:
    return F.when(pp < 1.5, "conserved").when(pp > 5, "variable").otherwise("moderate")


# Half-open column ranges of the named regions.
REGIONS = [("SP", 0, 13), ("NTD", 13, 301), ("RBD", 301, 551), ("CTD", 551, 686), ("S2", 686, 1276)]


def region(pos: Column) -> Column:
    out = F.lit("other")
    for name, low, high in reversed(REGIONS):
        out = F.when((pos >= low) & (pos < high), name).otherwise(out)
    return out


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(x.cast("double"), digits) + F.lit(0.0)
