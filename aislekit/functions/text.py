"""Scalar text functions as built-in Column expressions.

Everything here returns a ``Column`` and stays inside whole-stage codegen; no
Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results:
# - training normaliser keeps only these letters: a-z ç ğ ı ö ş ü and whitespace
# - serving fold maps ç Ç ğ Ğ ı İ ö Ö ş Ş ü Ü to c C g G i I o O s S u U
# - word tokens are runs of at least two letters, digits or underscores
# - receipt id format is "Siparis_" followed by the 1-based number, zero-padded to 2
TRAIN_KEEP_LETTERS = "a-zçğıöşü"
FOLD_FROM = "çÇğĞıİöÖşŞüÜ"
FOLD_TO = "cCgGiIoOsSuU"
TOKEN_PATTERN = "[\\p{L}\\p{N}_]{2,}"
RECEIPT_ID_FORMAT = "Siparis_%02d"

# Python's str.isspace() set, spelled out so Spark (Java regex) and DuckDB (RE2)
# read the same class.
_WS = ("\\t\\n\\x{0b}\\x{0c}\\r \\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
       "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}")
WS_CLASS = f"[{_WS}]"
# str.splitlines() boundaries
LINE_BREAK = "\\r\\n|[\\n\\r\\x{0b}\\x{0c}\\x{1c}\\x{1d}\\x{1e}\\x{85}\\x{2028}\\x{2029}]"
ITEM_SEPARATOR = f",{WS_CLASS}*"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_train(col) -> Column:
    """Lower, keep Turkish letters and whitespace, collapse blanks, trim.

    The reference's three substitutions (other characters -> space, digits ->
    space, whitespace runs -> one space) amount to replacing every run of
    characters outside the kept letters by one space; one regex pass does that.
    """
    c = F.lower(_c(col).cast("string"))
    return F.trim(F.regexp_replace(c, f"[^{TRAIN_KEEP_LETTERS}]+", " "))


def train_tokens(normalized) -> Column:
    """M1 on X1 output: it holds only kept letters and single spaces, so the
    word tokens are the space-separated pieces of two or more characters."""
    return F.filter(F.split(_c(normalized), " "), lambda x: F.length(x) >= 2)


def fold_ascii(col) -> Column:
    """Fold Turkish letters to ASCII; NULL and '' pass through."""
    return F.translate(_c(col), FOLD_FROM, FOLD_TO)


def strip_ws(col) -> Column:
    """Python ``str.strip()`` (Unicode whitespace, not only spaces)."""
    return F.regexp_replace(_c(col), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def split_items(col) -> Column:
    """X4 + X3 + F4: split a receipt line on ``,\\s*``, strip items, drop blanks."""
    parts = F.split(_c(col), ITEM_SEPARATOR)
    return F.filter(F.transform(parts, strip_ws), lambda x: x != F.lit(""))


def has_item(line) -> Column:
    """Whether :func:`split_items` of a line gives any item: a character other than commas and white space."""
    return _c(line).rlike(f"[^,{_WS}]")


def split_lines(col) -> Column:
    """``str.splitlines()`` boundaries."""
    return F.split(_c(col), LINE_BREAK)


def strip_bom(col) -> Column:
    """Leading byte-order marks (of a file's first row)."""
    return F.regexp_replace(_c(col), "^\\x{feff}+", "")


def receipt_id(n) -> Column:
    """``Siparis_NN``."""
    return F.format_string(RECEIPT_ID_FORMAT, _c(n))


def receipt_display(col) -> Column:
    """``Siparis_07`` -> ``#07``."""
    return F.replace(_c(col), F.lit("Siparis_"), F.lit("#"))


def title_case(col) -> Column:
    """Upper first letter of each space-separated word."""
    return F.initcap(_c(col))


def fixed(col, digits: int) -> Column:
    """``toFixed(n)``: text with n decimals, from the exact binary value of the double.

    |x| = m / 2^k with a BIGINT m, so m * 10^n and 2^k are compared as exact decimals; halves go
    away from zero.  Values under 2^-60 are zero; from 2^60 on a double has no decimals to round.
    """
    x = _c(col).cast("double")
    size = F.abs(x)
    k = F.greatest(F.least(F.lit(60) - F.floor(F.log2(size)), F.lit(120)), F.lit(0)).cast("int")

    def power(n: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), n)

    low, high = F.least(k, F.lit(60)), F.greatest(k - 60, F.lit(0))
    scaled = (size * power(low).cast("double") * power(high).cast("double")).cast("long").cast("decimal(19,0)")
    one = power(low).cast("decimal(19,0)") * power(high).cast("decimal(19,0)")
    units = F.call_function("div", scaled * F.lit(2 * 10 ** digits).cast("decimal(8,0)") + one, one * F.lit(2).cast("decimal(1,0)"))
    units = F.when(size < 2.0 ** -60, F.lit(0).cast("long")).otherwise(units)
    whole = F.call_function("div", units, F.lit(10 ** digits).cast("long")).cast("string")
    rest = F.lpad((units % F.lit(10 ** digits)).cast("string"), digits, "0")
    text = F.concat(whole, F.lit("."), rest) if digits else whole
    return F.when(x < 0, F.concat(F.lit("-"), text)).otherwise(text)


def word_tokens(col) -> Column:
    """M1: lower-case word tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(TOKEN_PATTERN), 0)


def word_ngrams_1_2(tokens) -> Column:
    """M2: unigrams followed by adjacent bigrams ``'w1 w2'``.

    Pass a column *reference* (tokens already materialised): the bigrams zip two
    slices of it in one linear pass.
    """
    t = _c(tokens)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(t, 1, n).alias("a"), F.slice(t, 2, n).alias("b"))
    bigrams = F.transform(pairs, lambda p: F.concat(p["a"], F.lit(" "), p["b"]))
    return F.concat(t, bigrams)


def sorted_key(arr, sep: str = "|") -> Column:
    """Canonical text of an array: sorted, ``|``-joined (for output and hashing)."""
    return F.concat_ws(sep, F.array_sort(_c(arr)))
