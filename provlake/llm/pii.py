"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Everything is Column expressions: no shuffle, no Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, find_spans, running, stretch, unused

#: Characters before a span that are searched for context words.
CONTEXT = 48


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    prior: float
    words: str  # context words as an alternation, lower case


# Possessive forms of the contract's patterns: they match the same text without a deep stack or quadratic retries. Of an
# IBAN the pattern takes the first four characters alone and looks ahead at up to 31 more (one past the longest), so that
# what follows an account is neither swallowed nor kept from being one; iban_spans() finds the end.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|email|contact|write|address|kontakt|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|host|server|login|from|client|adresse|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){15,}+", 0.8, "card|visa|credit|payment|amex|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "phone|tel|call|mobile|fax|telefon|llame|portable"),
    Kind("iban", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,31}+))", 0.5, "iban|bank|account|konto|cuenta|compte|sepa"),
)
BASE = ("email", "ip", "card", "phone")
#: Characters of an IBAN by country, where its registry gives them.
IBAN_CHARS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if a string of at most 19 digits passes the Luhn check."""
    n = F.length(number)

    def value(i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if an IBAN without blanks passes the ISO 7064 mod-97 check."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(a: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v >= 65, (a * 100 + v - 55) % 97).otherwise((a * 10 + v - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits(hit)).between(16, 19), luhn(digits(hit))).otherwise(False)
    if kind == "phone":
        return F.length(digits(hit)).between(8, 15)
    return F.lit(True)


def iban_spans(spans: Column) -> Column:
    """The accounts that start at the spans (hit: four characters, part: what follows), from left to right without overlap.

    Of the beginnings of 15 to 34 characters that end at a word's edge and pass mod-97 the one with its country's length
    counts, else the longest.
    """

    def longest(s: Column) -> Column:
        whole = F.concat(s.hit, s.part)
        country = F.substring(s.hit, 1, 2)
        usual = F.coalesce(*(F.when(country.isin(*names.split()), F.lit(n)) for n, names in IBAN_CHARS.items()), F.lit(0))

        def prefix(i: Column) -> Column:
            piece = F.substring(whole, F.lit(1), i)
            bare = F.regexp_replace(piece, " ", "")
            return F.struct((F.length(bare) == usual).alias("usual"), i.cast("long").alias("n"), bare.alias("bare"))

        # An edge is where a blank or nothing follows.
        edges = F.filter(F.sequence(F.lit(15), F.length(whole)), lambda i: F.substring(whole, i + 1, F.lit(1)).isin("", " ") & (F.substring(whole, i, F.lit(1)) != " "))
        fit = F.filter(F.transform(edges, prefix), lambda p: F.length(p.bare).between(15, 34) & mod97(p.bare))
        return F.struct(s.start.alias("start"), (s.start + F.array_max(fit).n).alias("end"))

    found = F.filter(F.transform(spans, longest), lambda s: s.end.isNotNull())
    zero = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.aggregate(found, zero, lambda a, s: F.when((F.size(a) == 0) | (F.get(a, F.size(a) - 1).end <= s.start), F.concat(a, F.array(s))).otherwise(a))


def find_pii(docs: DataFrame, text: str = "text", threshold: float = 0.5, out: str = "pii") -> DataFrame:
    """docs with one more column, `out`: array<struct<kind,start,end,score>> ordered by kind as listed, then start.

    Spans of the base kinds (email, ip, card, phone) that their check confirms are always there; spans of other kinds
    (iban) need a score of `threshold` or more; at 0.5, iban's prior, the checksum alone decides, so that no valid account is
    lost for want of a context word, and a higher threshold asks for one. The score is the kind's prior, raised by half of what
    is missing to 1 if a context word stands in the 48 characters before the span. Null and empty texts have no spans. Other
    columns pass through; a column that is called `out` already is an error.
    """
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {out}")
    whole, cut, *names = unused(docs, "pii_text", "pii_cut", *(f"pii_{k.name}" for k in KINDS))
    work = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    for k, name in zip(KINDS, names):
        work = find_spans(work, whole, k.pattern, name, group=int(k.name == "iban"))

    def kept(k: Kind, name: str) -> Column:
        found = iban_spans(F.col(name)) if k.name == "iban" else F.filter(name, lambda s: confirmed(k.name, s.hit))
        return F.transform(found, lambda s: F.struct(F.lit(k.name).alias("kind"), s.start.alias("start"), s.end.alias("end")))

    work = work.withColumn(out, F.concat(*map(kept, KINDS, names))).drop(*names)
    work = work.withColumn(cut, F.when(F.size(out) > 0, chunks(whole)))

    def scored(s: Column) -> Column:
        before = F.lower(stretch(cut, F.greatest(s.start - CONTEXT, F.lit(0)), s.start))
        score = F.lit(None).cast("double")
        for k in KINDS:
            score = F.when(s.kind == k.name, F.when(before.rlike(near(k)), F.lit(0.5 + k.prior / 2)).otherwise(F.lit(k.prior))).otherwise(score)
        return F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), score.alias("score"))

    spans = F.filter(F.transform(out, scored), lambda s: s.kind.isin(*BASE) | (s.score >= threshold))
    return work.withColumn(out, F.when(F.col(cut).isNull(), F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")).otherwise(spans)).drop(whole, cut)


def near(k: Kind) -> str:
    """Pattern of a context word in lower-case text."""
    return f"(?:^|[^a-z])(?:{k.words})(?:[^a-z]|$)"


def redact(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with every span of personal data in `text` replaced by its kind in brackets, such as [EMAIL].

    Overlapping spans become one, named by the one that starts first. Rows, columns and null texts stay as they are.
    """
    pii, cut, new = unused(docs, "pii", "pii_cut", "pii_new")
    found = find_pii(docs, text, threshold, pii)
    found = found.withColumn(pii, F.array_sort(F.transform(pii, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))))
    found = found.withColumn(cut, chunks(text))
    # Where all spans before one end, at most at its start, a new stretch begins; what lies between is kept.
    reach = running(F.transform(pii, lambda s: s.end), lambda a, x: F.greatest(a, x))
    heads = F.filter(F.zip_with(pii, reach, lambda s, r: F.struct(r.alias("reach"), s.start.alias("start"), s.kind.alias("kind"))), lambda s: s.start >= s.reach)
    parts = F.transform(heads, lambda s: F.concat(stretch(cut, s.reach, s.start), F.lit("["), F.upper(s.kind), F.lit("]")))
    tail = stretch(cut, F.array_max(F.transform(pii, lambda s: s.end)), F.length(text).cast("long"))
    found = found.withColumn(new, F.when(F.size(pii) > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(F.col(text)))
    return found.select(*(F.col(new).alias(c) if c == text else F.col(c) for c in docs.columns))
