"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value (fixed values).
SENTINELS = ["NO DEFINIDO", "NO PROVISTO", "NO APLICA", "NO ADJUDICADO", "SIN DESCRIPCION", "SIN DESCRIPCIÓN", "NO INFORMADO", "N/A", "NA", "-"]
#: Legal forms at the end of a company name, one of which is removed (fixed values).
LEGAL_FORMS = [
    "S A S", "SAS", "S A", "SA", "LTDA", "LTD", "E U", "EU", "S C A", "SCA", "S EN C", "CIA", "Y CIA", "E S P", "ESP", "E I C E", "EICE",
    "E S E", "ESE", "S A E S P", "EMPRESA UNIPERSONAL", "SUCURSAL COLOMBIA", "EN LIQUIDACION",
]
#: Document numbers that are no document (fixed values).
NO_DOCUMENT = ["123456789", "1234567890", "12345678", "987654321", "999999999"]
#: Letters with accents, and the plain letters at the same places (fixed values).
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unaccented(c: Column | str) -> Column:
    return F.translate(_col(c), ACCENTED, PLAIN)


def cleaned(c: Column | str) -> Column:
    """Trimmed text; null where it is empty or stands for a missing value."""
    t = F.trim(_col(c))
    return F.when((t != "") & ~F.upper(t).isin(SENTINELS), t)


def normalised(c: Column | str) -> Column:
    """Upper case without accents, single blanks; null when nothing is left."""
    t = F.regexp_replace(F.upper(unaccented(c)), r"\s+", " ")
    return F.nullif(F.trim(t), F.lit(""))


def canonical_name(c: Column | str) -> Column:
    """A company name without accents, punctuation and its last legal form."""
    t = F.regexp_replace(F.upper(unaccented(c)), "[^A-Z0-9 ]", " ")
    t = F.regexp_replace(t, r"\s+(" + "|".join(LEGAL_FORMS) + r")\s*$", "")
    return F.nullif(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(""))


def digits(c: Column | str) -> Column:
    return F.nullif(F.regexp_replace(_col(c), "[^0-9]", ""), F.lit(""))


def valid_document(c: Column | str) -> Column:
    """The digits of a document number; null below six, when all are equal, or when it is a known placeholder."""
    d = digits(c)
    bad = (F.length(d) < 6) | (d == F.repeat(F.substring(d, 1, 1), F.length(d))) | d.isin(NO_DOCUMENT)
    return F.when(~bad, d)


def without_check_digit(c: Column | str) -> Column:
    c = _col(c)
    return F.substring(c, F.lit(1), F.length(c) - 1)


def title_case(c: Column | str) -> Column:
    """Each word with a capital, split at blanks only."""
    words = F.split(F.lower(_col(c)), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def first_rule(c: Column | str, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The label of the first regular expression that is found in the text."""
    c, out = _col(c), F.lit(otherwise)
    for pattern, label in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def bucketed(c: Column | str, bounds: list[int]) -> Column:
    """Name of the range that a number falls in: ``0``, ``1``, ``2-5``, ``>5`` for bounds ``[0, 1, 5]``."""
    c, out, low = _col(c), F.lit(f">{bounds[-1]}"), 0
    cases = []
    for b in bounds:
        cases.append((c <= b, str(b) if low >= b else f"{low}-{b}"))
        low = b + 1
    for test, label in reversed(cases):
        out = F.when(test, F.lit(label)).otherwise(out)
    return F.when(c.isNotNull(), out)
