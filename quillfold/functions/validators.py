"""Checks of identifiers, as Column predicates: true, false, or null for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digits_of(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "[^0-9]", "")


def _digit_array(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: x.cast("int"))


def luhn(c: Column | str) -> Column:
    """Luhn checksum over the digits; false without digits."""
    d = digits_of(c)
    return F.when(F.length(d) > 0, F.call_function("luhn_check", d)).when(d.isNotNull(), F.lit(False))


def card(c: Column | str) -> Column:
    d = digits_of(c)
    return F.length(d).between(13, 19) & luhn(c)


def npi(c: Column | str) -> Column:
    """Ten digits whose Luhn checksum holds with the health prefix before them."""
    d = digits_of(c)
    return (F.length(d) == 10) & F.call_function("luhn_check", F.concat(F.lit("80840"), F.when(F.length(d) > 0, d).otherwise("1")))


def ssn(c: Column | str) -> Column:
    """Nine digits; area not 000, 666 or 9xx, group not 00, serial not 0000."""
    d = digits_of(c)
    return (F.length(d) == 9) & ~F.substring(d, 1, 3).isin("000", "666") & (F.substring(d, 1, 1) != "9") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def us_phone(c: Column | str) -> Column:
    """Ten digits, or eleven after a 1; area and exchange begin with 2 to 9."""
    d = digits_of(c)
    n = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return n.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")


def ipv4(c: Column | str) -> Column:
    parts = F.split(_col(c), r"\.")
    return _col(c).rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & F.coalesce(F.forall(parts, lambda x: F.expr("true") & (F.coalesce(x.try_cast("int"), F.lit(999)) <= 255)), F.lit(False))


def iban(c: Column | str) -> Column:
    """ISO 13616: moved and spelled as digits, the number is 1 modulo 97."""
    s = F.upper(F.regexp_replace(_col(c), "[ -]", ""))
    moved = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    ok = s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$")
    value = lambda x: F.when(x.rlike("[0-9]"), x.cast("string")).otherwise((F.ascii(x) - 55).cast("string"))
    chars = F.filter(F.split(F.when(ok, moved).otherwise("0"), ""), lambda x: x != "")
    spelled = F.filter(F.split(F.array_join(F.transform(chars, value), ""), ""), lambda x: x != "")
    return ok & (F.aggregate(spelled, F.lit(0), lambda acc, x: (acc * 10 + x.cast("int")) % 97) == 1)


#: The Verhoeff multiplication and permutation tables.
VERHOEFF_D = ["0123456789", "1234067895", "2340178956", "3401289567", "4012395678", "5987604321", "6598710432", "7659821043", "8765932104", "9876543210"]
VERHOEFF_P = ["0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258"]


def verhoeff(c: Column | str) -> Column:
    """Verhoeff checksum over the digits, as 12-digit national identities use it."""
    d = digits_of(c)
    ds = _digit_array(F.reverse(d))
    table = lambda rows: F.array(*(F.array(*(F.lit(int(x)) for x in r)) for r in rows))
    mul, perm = table(VERHOEFF_D), table(VERHOEFF_P)
    step = F.aggregate(ds, F.struct(F.lit(0).alias("c"), F.lit(0).alias("i")), lambda acc, x: F.struct(F.get(F.get(mul, acc["c"]), F.get(F.get(perm, acc["i"] % 8), x)).alias("c"), (acc["i"] + 1).alias("i")))
    return (F.length(d) > 0) & (step["c"] == 0)


def weighted(c: Column | str, weights: list[int]) -> Column:
    """The sum of the digits, each times its weight; digits beyond the weights don't count."""
    return sum((F.coalesce(F.substring(digits_of(c), i + 1, 1).try_cast("int"), F.lit(0)) * w for i, w in enumerate(weights) if w), F.lit(0))


def _digit(c: Column | str, i: int) -> Column:
    return F.coalesce(F.substring(digits_of(c), i, 1).try_cast("int"), F.lit(-1))


def _long(c: Column) -> Column:
    return c.try_cast("long")


def nhs(c: Column | str) -> Column:
    """United Kingdom, NHS number: ten digits, modulo 11."""
    check = (11 - weighted(c, list(range(10, 1, -1))) % 11) % 11
    return (F.length(digits_of(c)) == 10) & (check != 10) & (check == _digit(c, 10))


def pesel(c: Column | str) -> Column:
    """Poland: eleven digits, the last from the others by weights 1, 3, 7, 9."""
    return (F.length(digits_of(c)) == 11) & ((10 - weighted(c, [1, 3, 7, 9, 1, 3, 7, 9, 1, 3]) % 10) % 10 == _digit(c, 11))


def bsn(c: Column | str) -> Column:
    """Netherlands: nine digits, the eleven test."""
    s = weighted(c, [9, 8, 7, 6, 5, 4, 3, 2, -1])
    return (F.length(digits_of(c)) == 9) & (s % 11 == 0) & (s > 0)


#: Check letters.
DNI_LETTERS, HETU_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE", "0123456789ABCDEFHJKLMNPRSTUVWXY"


def dni(c: Column | str) -> Column:
    """Spain, DNI and NIE: eight digits, or X, Y, Z and seven, and a letter, modulo 23."""
    s = F.upper(F.regexp_replace(_col(c), "[ -]", ""))
    n = _long(F.translate(F.substring(s, 1, 8), "XYZ", "012"))
    return s.rlike("^[0-9XYZ][0-9]{7}[A-Z]$") & (F.substring(F.lit(DNI_LETTERS), (F.coalesce(n, F.lit(0)) % 23 + 1).cast("int"), F.lit(1)) == F.substring(s, 9, 1))


def nir(c: Column | str) -> Column:
    """France: thirteen digits (2A and 2B count as 19 and 18) and a key, modulo 97."""
    s = F.regexp_replace(F.upper(F.regexp_replace(_col(c), "[ .-]", "")), "^(.{5})2A", "$119")
    s = F.regexp_replace(s, "^(.{5})2B", "$118")
    return s.rlike("^[12][0-9]{14}$") & (97 - F.coalesce(_long(F.substring(s, 1, 13)), F.lit(0)) % 97 == F.coalesce(_long(F.substring(s, 14, 2)), F.lit(-1)))


def cpf(c: Column | str) -> Column:
    """Brazil: eleven digits, not all alike, the last two modulo 11."""
    check = lambda w: weighted(c, w) * 10 % 11 % 10
    return (F.length(digits_of(c)) == 11) & ~digits_of(c).rlike("^([0-9])\\1*$") & (check(list(range(10, 1, -1))) == _digit(c, 10)) & (check(list(range(11, 1, -1))) == _digit(c, 11))


def sin(c: Column | str) -> Column:
    """Canada: nine digits, Luhn."""
    return (F.length(digits_of(c)) == 9) & luhn(c)


def tfn(c: Column | str) -> Column:
    """Australia: nine digits, weighted sum modulo 11."""
    return (F.length(digits_of(c)) == 9) & (weighted(c, [1, 4, 3, 7, 5, 8, 6, 9, 10]) % 11 == 0)


def steuer_id(c: Column | str) -> Column:
    """Germany: eleven digits, the first not 0, modulo 11 and 10 by turns."""
    p = F.lit(10)
    for i in range(1, 11):
        s = (p + _digit(c, i)) % 10
        p = F.when(s == 0, 10).otherwise(s) * 2 % 11
    return (F.length(digits_of(c)) == 11) & (_digit(c, 1) != 0) & ((11 - p) % 10 == _digit(c, 11))


def hetu(c: Column | str) -> Column:
    """Finland: a birth date, a century sign, three digits and a check character, modulo 31."""
    s = F.upper(F.trim(_col(c)))
    n = F.coalesce(_long(F.concat(F.substring(s, 1, 6), F.substring(s, 8, 3))), F.lit(0))
    return s.rlike("^[0-9]{6}[-+A][0-9]{3}[0-9A-Y]$") & (F.substring(F.lit(HETU_LETTERS), (n % 31 + 1).cast("int"), F.lit(1)) == F.substring(s, 11, 1))


def aadhaar(c: Column | str) -> Column:
    """India: twelve digits, the first 2 to 9, Verhoeff."""
    return digits_of(c).rlike("^[2-9][0-9]{11}$") & verhoeff(c)


def pan(c: Column | str) -> Column:
    """India, tax account: five letters, of which the fourth tells the holder's kind, four digits, a letter."""
    return F.upper(F.trim(_col(c))).rlike("^[A-Z]{3}[ABCFGHJLPT][A-Z][0-9]{4}[A-Z]$")


def gstin(c: Column | str) -> Column:
    """India, goods and services tax: state, tax account, entity, Z and a check character in base 36."""
    s = F.upper(F.trim(_col(c)))
    value = lambda i: F.coalesce(_long(F.conv(F.substring(s, i, 1), 36, 10)), F.lit(0))
    total = F.lit(0)
    for i in range(1, 15):
        x = value(i) * (2 if i % 2 == 0 else 1)
        total = total + F.floor(x / 36) + x % 36
    return s.rlike("^(0[1-9]|[12][0-9]|3[0-8])[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$") & pan(F.substring(s, 3, 10)) & ((36 - total % 36) % 36 == value(15))


#: National identifiers: name, country, what they look like (group 1 is what stands before), and their check.
NATIONAL = {
    "NHS": ("GB", r"(^|[^0-9A-Za-z])([0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{4})", nhs),
    "PESEL": ("PL", r"(^|[^0-9A-Za-z])([0-9]{11})", pesel),
    "BSN": ("NL", r"(^|[^0-9A-Za-z])([0-9]{9})", bsn),
    "DNI": ("ES", r"(^|[^0-9A-Za-z])([0-9XYZ][0-9]{7}-?[A-Z])", dni),
    "NIR": ("FR", r"(^|[^0-9A-Za-z])([12][ ]?[0-9]{2}[ ]?[0-9]{2}[ ]?[0-9AB]{2}[ ]?[0-9]{3}[ ]?[0-9]{3}[ ]?[0-9]{2})", nir),
    "CPF": ("BR", r"(^|[^0-9A-Za-z])([0-9]{3}[.]?[0-9]{3}[.]?[0-9]{3}-?[0-9]{2})", cpf),
    "SIN": ("CA", r"(^|[^0-9A-Za-z])([0-9]{3}[ -][0-9]{3}[ -][0-9]{3})", sin),
    "TFN": ("AU", r"(^|[^0-9A-Za-z])([0-9]{3}[ ]?[0-9]{3}[ ]?[0-9]{3})", tfn),
    "STEUER_ID": ("DE", r"(^|[^0-9A-Za-z])([1-9][0-9]{10})", steuer_id),
    "HETU": ("FI", r"(^|[^0-9A-Za-z])([0-9]{6}[-+A][0-9]{3}[0-9A-Y])", hetu),
    "AADHAAR": ("IN", r"(^|[^0-9A-Za-z])([2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4})", aadhaar),
    "PAN": ("IN", r"(^|[^0-9A-Za-z])([A-Z]{5}[0-9]{4}[A-Z])", pan),
    "GSTIN": ("IN", r"(^|[^0-9A-Za-z])([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z])", gstin),
}
