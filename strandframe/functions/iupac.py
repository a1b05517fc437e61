"""The nucleotide alphabet as expressions and as small DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A match rule: "iupac", "exact", or for each pattern symbol the symbols that it matches.
Alphabet = str | dict[str, str]

#: Symbols in code order (code 0 ends a sequence), and the bases each stands for.
SYMBOLS = "$ACGTNRYSWKMBDHV"
BASES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "N": "ACGT", "R": "AG", "Y": "CT", "S": "CG", "W": "AT",
    "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG",
}
HEX = "0123456789ABCDEF"  # the n-th symbol as the n-th digit keeps code order under binary collation


class SequenceError(ValueError):
    """An empty sequence set, an empty sequence, or a character outside the alphabet."""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalise(text: Column) -> Column:
    """Upper case, U read as T."""
    return F.translate(F.upper(text), "U", "T")


def first_invalid(text: Column) -> Column:
    """0-based offset of the first character that is no nucleotide code, null if there is none."""
    rest = F.regexp_extract(text, "^[ACGTUNRYSWKMBDHVacgtunryswkmbdhv]*", 0)
    return F.when(F.length(rest) < F.length(text), F.length(rest)).cast("int")


def coded(seq: Column) -> Column:
    """One hexadecimal digit for each symbol, in code order."""
    return F.translate(seq, SYMBOLS, HEX)


def decoded(digits: Column) -> Column:
    return F.translate(digits, HEX, SYMBOLS)


def code_of(symbol: Column) -> Column:
    """Code 0 to 15 of one symbol; null for any other character."""
    return F.when(F.instr(F.lit(SYMBOLS), symbol) > 0, F.instr(F.lit(SYMBOLS), symbol) - 1).cast("int")


def mask(symbol: str) -> int:
    return sum(1 << "ACGT".index(b) for b in BASES.get(symbol, ""))


def alphabet_table(spark: SparkSession) -> DataFrame:
    """(sym, code, mask): 16 rows."""
    return spark.createDataFrame([(s, i, mask(s)) for i, s in enumerate(SYMBOLS)], "sym string, code int, mask int")


def compatible(symbol: str, alphabet: Alphabet = "iupac") -> str:
    """Symbols that a pattern symbol matches, in code order; none for $ or an unknown one."""
    if isinstance(alphabet, dict):
        return "".join(s for s in SYMBOLS[1:] if s in alphabet.get(symbol, ""))
    if alphabet == "exact":
        return symbol if symbol in "ACGT" else ""
    return "".join(s for s in SYMBOLS if mask(s) & mask(symbol))


def rule(pairs: DataFrame) -> dict[str, str]:
    """The match rule that a table (q_sym, r_sym) states, of at most 225 rows."""
    found: dict[str, str] = {}
    for q, r in pairs.select("q_sym", "r_sym").distinct().collect():
        found[q] = found.get(q, "") + r
    return found


def compat_pairs(spark: SparkSession, alphabet: Alphabet = "iupac") -> DataFrame:
    """(q_sym, r_sym) for all pairs that match."""
    rows = [(q, r) for q in SYMBOLS for r in compatible(q, alphabet)]
    return spark.createDataFrame(rows, "q_sym string, r_sym string")


def pattern_regex(pattern: str, alphabet: Alphabet = "iupac") -> str | None:
    """Regular expression of what a pattern matches; None if some symbol matches nothing."""
    sets = [compatible(c, alphabet) for c in pattern.upper().replace("U", "T")]
    if not all(sets):
        return None
    return "".join(s if len(s) == 1 else f"[{s}]" for s in sets)
