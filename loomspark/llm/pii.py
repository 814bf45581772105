"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Column expressions only. For each kind, the text's matches and the pieces between them give the positions (code points,
end exclusive), as running sums over blocks of RUN matches and within each; what is near a span is read from the text's
pieces of PIECE characters. So the work grows with the text and its matches, not with their product. The patterns below are possessive and anchored at the start of a run, which finds the same leftmost
non-overlapping matches as the plain ones in time linear in the text. Cards need a Luhn sum, IBANs the mod-97 rest 1;
parts of an IP address are 255 at most; a phone has 9 to 15 digits. An ``ssn`` span counts only with a context word.

Defined results: null text counts as empty, with no spans; every row gets a row, repeated ones too, with its id (of any
type, or null) as it is; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: What a text must have before its matches are sought: cheap to test, and true wherever the pattern matches.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": None, "phone": "+", "iban": r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Score without and, added to it, with a context word in the BEFORE characters before or the AFTER ones behind a span.
SCORES = {"email": (70, 20), "ip": (50, 30), "card": (70, 25), "phone": (50, 30), "iban": (80, 15), "ssn": (30, 50)}
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "address|host|server|login|adresse",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|telefon",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social|security",
}
BEFORE, AFTER = 40, 20
LEAST = 50
#: Matches whose places are summed one by one before the next block, and characters of a piece (more than BEFORE, AFTER).
RUN = 64
PIECE = 1024


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = _digits(v)
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = x * 2
        return total + F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(x)

    return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def _mod97(v: Column) -> Column:
    flat = F.replace(v, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, F.lit(1), F.lit(4)))

    def rest(r: Column, c: Column) -> Column:
        letter = c >= "A"
        value = F.when(letter, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return (r * F.when(letter, 100).otherwise(10) + value) % 97

    chars = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.substring(turned, i, F.lit(1)))
    return F.length(flat).between(15, 34) & (F.aggregate(chars, F.lit(0), rest) == 1)


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return _luhn(v)
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return _mod97(v) if kind == "iban" else F.lit(True)


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE characters; a short text is one piece."""
    return F.when(F.length(text) <= PIECE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0)))


def _at(held: Column, start: Column, length: Column | int) -> Column:
    """``length`` characters, at most PIECE, of a text in pieces from a place (from 0)."""
    k = F.floor(start / PIECE).cast("int")
    two = F.concat(F.coalesce(F.get(held, k), F.lit("")), F.coalesce(F.get(held, k + 1), F.lit("")))
    return F.substring(two, start - k * PIECE + 1, length if isinstance(length, Column) else F.lit(length))


def _placed(found: Column, between: Column) -> Column:
    """array<struct<s, e, v>> of matches and the pieces before them: two levels of running sums."""
    zipped = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, p: F.struct(m.alias("m"), F.length(p).alias("p"), F.length(m).alias("n")))
    last = F.floor((F.size(found) - 1) / RUN).cast("int")
    # The matches are in one array argument, so that the lambda over block numbers doesn't form it anew.
    blocks = F.flatten(F.transform(F.array(zipped), lambda z: F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(z, k * RUN + 1, F.lit(RUN)))))
    sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["p"] + x["n"]))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    empty = F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)")

    def place(held: Column, x: Column) -> Column:
        s = held["at"] + x["p"]
        e = s + x["n"]
        return F.struct(e.alias("at"), F.concat(held["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("v")))).alias("out"))

    def within(b: Column, start: Column) -> Column:
        return F.when(b.isNotNull(), F.aggregate(b, F.struct(start.alias("at"), empty.alias("out")), place, lambda held: held["out"])).otherwise(empty)

    return F.flatten(F.zip_with(blocks, starts, within))


def spans(text: Column, kind: str, held: Column | None = None) -> Column:
    """array<struct<kind, s, e, score>> of the kind's confirmed spans, in order; held: the text in pieces."""
    held = pieces(text) if held is None else held
    none = F.expr("cast(array() as array<struct<kind:string,s:int,e:int,score:int>>)")
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    least, more = SCORES[kind]

    def scored(x: Column) -> Column:
        at = F.greatest(x["s"] - BEFORE, F.lit(0))
        near = F.concat(_at(held, at, x["s"] - at), F.lit(" "), _at(held, x["e"], AFTER))
        score = F.lit(least) + F.when(F.lower(near).rlike(CONTEXT[kind]), more).otherwise(0)
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), score.alias("score"))

    kept = F.transform(F.filter(_placed(found, F.split(text, PATTERNS[kind], -1)), lambda x: _valid(kind, x["v"])), scored)
    if kind not in BASE:
        kept = F.filter(kept, lambda x: x["score"] >= LEAST)
    hint = HINTS[kind]
    worth = text.rlike(PATTERNS[kind]) if hint is None else F.contains(text, F.lit(hint)) if len(hint) == 1 else text.rlike(hint)
    return F.when(worth & (F.size(found) > 0), kept).otherwise(none)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, and for each kind its spans) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    # Whatever matches has a digit or an @; other texts need no pieces.
    rows = rows.withColumn("p", F.when(F.col("t").rlike("[0-9@]"), pieces(F.col("t"))).otherwise(F.expr("cast(array() as array<string>)")))
    return rows.select("doc_id", *(spans(F.col("t"), k, F.col("p")).alias(k) for k in KINDS))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the sum over their spans, all spans and their scores as text."""

    def said(kinds: tuple[str, ...], score: bool = False) -> Column:
        every = F.flatten(F.array(*(F.col(k) for k in kinds)))
        return F.array_join(F.transform(every, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"], *([x["score"]] if score else []))), ",")

    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(said(BASE), 256).alias("base_sha256"), said(KINDS).alias("spans"), said(KINDS, True).alias("scores"))
