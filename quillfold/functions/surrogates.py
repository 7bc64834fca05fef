"""Surrogates of identifiers: values of the same kind that name nobody, made from a keyed digest.

Equal surfaces of one scope (a subject, say) have equal surrogates wherever they stand; without the key nothing leads back.
Numbers, addresses and hosts are from ranges that are never given out, so that no surrogate is somebody's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import hmac_sha256
from .places import bound
from .validators import digits_of

#: Names to draw from, by language.
NAMES = {
    "en": (("Alex", "Casey", "Jamie", "Jordan", "Morgan", "Riley", "Robin", "Taylor"), ("Baker", "Carter", "Cooper", "Foster", "Mason", "Parker", "Turner", "Walker")),
    "de": (("Anke", "Bernd", "Frauke", "Heiko", "Imke", "Jürgen", "Silke", "Uwe"), ("Bauer", "Fischer", "Koch", "Krüger", "Schäfer", "Schulz", "Vogel", "Weber")),
    "es": (("Alba", "Carlos", "Elena", "Íñigo", "Lucía", "Mateo", "Nuria", "Pablo"), ("Castro", "Domínguez", "Flores", "Herrera", "Molina", "Ortega", "Ríos", "Vega")),
    "fr": (("Aline", "Bruno", "Chloé", "Denis", "Élise", "Hugo", "Margot", "Rémi"), ("Bernard", "Blanc", "Dubois", "Garnier", "Lefèvre", "Moreau", "Renard", "Roux")),
}
ADDRESS = ("12 Sample Road", "3 Example Lane", "48 Model Street", "7 Placeholder Way")


def byte_at(digest: Column, i: Column | int) -> Column:
    """The digest's byte i, counted around its 32."""
    at = (i % 32) * 2 + 1 if isinstance(i, Column) else F.lit((i % 32) * 2 + 1)
    return F.conv(F.substring(digest, at, F.lit(2)), 16, 10).cast("int")


def drawn_digits(digest: Column, n: int) -> Column:
    """n decimal digits, at most 32 of them independent."""
    return F.concat(*((byte_at(digest, i) % 10).cast("string") for i in range(n)))


def refill(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced, in order, by those given; others stay where there are no more."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    state = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        own = c.rlike("^[0-9]$")
        new = F.coalesce(F.nullif(F.substring(digits, acc["i"] + 1, F.lit(1)), F.lit("")), c)
        return F.struct((acc["i"] + F.when(own, 1).otherwise(0)).alias("i"), F.concat(acc["out"], F.when(own, new).otherwise(c)).alias("out"))

    return F.aggregate(chars, state, step, lambda acc: acc["out"])


def same_shape(surface: Column, digest: Column) -> Column:
    """Digits for digits, letters for letters of the same case, all else as it is."""
    chars = F.filter(F.split(surface, ""), lambda c: c != "")

    def draw(c: Column, i: Column) -> Column:
        letter = F.char((byte_at(digest, i) % 26 + F.lit(97)).cast("long"))
        return F.when(c.rlike("^[0-9]$"), (byte_at(digest, i) % 10).cast("string")).when(c.rlike("^[a-z]$"), letter).when(c.rlike("^[A-Z]$"), F.upper(letter)).otherwise(c)

    return F.array_join(F.transform(chars, draw), "")


def with_check_digit(body: Column) -> Column:
    """The digits with the one that makes their Luhn sum a multiple of ten."""
    places = F.filter(F.split(F.reverse(body), ""), lambda c: c != "")
    worth = F.transform(places, lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.concat(body, ((10 - F.aggregate(worth, F.lit(0), lambda a, b: a + b) % 10) % 10).cast("string"))


def _pick(values: tuple[str, ...], digest: Column, i: int) -> Column:
    return F.get(F.array(*map(F.lit, values)), byte_at(digest, i) % len(values))


def person(digest: Column, lang: Column | None = None) -> Column:
    """A first and a last name in the language, English where it isn't known."""
    full = lambda tables: F.concat(_pick(tables[0], digest, 0), F.lit(" "), _pick(tables[1], digest, 1))
    out = full(NAMES["en"])
    for code, tables in NAMES.items():
        out = out if lang is None else F.when(F.lower(F.substring(lang, 1, 2)) == code, full(tables)).otherwise(out)
    return out


def surrogate(label: Column, surface: Column, secret: bytes, scope: Column, lang: Column | None = None) -> Column:
    """Another value of the label's kind, fixed by the key, the label, the scope and the surface. Labels without a kind
    of their own keep the surface's shape."""
    n = F.char_length(digits_of(surface))

    def made(d: Column) -> Column:
        card = with_check_digit(F.substring(F.concat(F.lit("4000"), drawn_digits(d, 16)), F.lit(1), n - 1))
        phone = F.concat(F.when(n > 10, "1").otherwise(""), (byte_at(d, 0) % 8 + 2).cast("string"), drawn_digits(F.substring(d, 3, 64), 2), F.lit("55501"), drawn_digits(F.substring(d, 9, 64), 2))
        return (
            F.when(label == "EMAIL", F.concat(F.lit("user."), F.substring(d, 1, 10), F.lit("@example.org")))
            .when(label == "URL", F.concat(F.lit("https://example.org/"), F.substring(d, 1, 12)))
            .when(label == "IPV4", F.concat_ws(".", F.lit("198"), (byte_at(d, 0) % 2 + 18).cast("string"), byte_at(d, 1).cast("string"), byte_at(d, 2).cast("string")))
            .when(label == "MAC", F.concat_ws(":", F.lit("02"), *(F.substring(d, 2 * i + 1, 2) for i in range(5))))
            .when(label == "SSN", refill(surface, F.concat(F.lit("9"), drawn_digits(d, 8))))
            .when(label == "PHONE", refill(surface, phone))
            .when((label == "CARD") & n.between(13, 19), refill(surface, card))
            .when(label.isin("NAME", "PERSON"), person(d, lang))
            .when(label == "ADDRESS", _pick(ADDRESS, d, 0))
            .otherwise(same_shape(surface, d))
        )

    return bound(hmac_sha256(secret, F.concat_ws("\x1f", label, scope, surface)), made)
