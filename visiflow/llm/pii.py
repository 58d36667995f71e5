"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only.  Spans are in code points, end exclusive; matches
are leftmost and non-overlapping per kind, and a proposal that fails its
validator is dropped without another try.  The base kinds (email, ip, card,
phone) stay whatever their score; an added kind stays at ``min_score`` or more.

The patterns below accept the same matches as their plain forms (given beside
them) but start a run of characters only once and never back up, so that their
time is linear in the text and the regex stack does not grow with it.

Defined results: a null or empty text has no spans; rows are independent, so
repeated rows give repeated results; extra columns are kept, and one named
like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<kind_no:int,start:int,end:int,kind:string,score:double,base:boolean>"


@dataclass(frozen=True)
class Kind:
    """One kind of personal data; ``hint`` is a character without which a text cannot hold it."""

    name: str
    pattern: str
    hint: str
    score: float
    context: str
    base: bool
    valid: Callable[[Column], Column]


def _chars(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.substr(s, i, F.lit(1)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    doubled = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(_chars(F.reverse(digits)), doubled), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(s: Column) -> Column:
    """The remainder of an account number's check: first four characters last, letters as 10 to 35."""
    bare = F.regexp_replace(s, " ", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(_chars(turned), value), F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)


def _ip_parts(s: Column) -> Column:
    bare = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(s, "\\."), lambda p: F.when(F.length(bare(p)) < 3, F.lit(True)).when(F.length(bare(p)) > 3, F.lit(False))
                    .otherwise(bare(p) <= "255"))


def _card(s: Column) -> Column:
    return F.when(F.length(_digits(s)).between(16, 19), luhn(_digits(s))).otherwise(False)


KINDS = (
    # plain: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9,
         "e-?mail|contact|mailto|write", True, lambda s: F.lit(True)),
    # plain: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "address|server|host|client|login", True, _ip_parts),
    # plain: [0-9]([\x20-]?[0-9])+
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", "", 0.8, "card|visa|payment|credit|debit", True, _card),
    # plain: \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, "phone|tel|call|mobile|fax", True,
         lambda s: F.length(_digits(s)).between(8, 15)),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", "", 0.8, "iban|account|bank|konto|transfer", False,
         lambda s: mod97(s) == 1),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", 0.3, "ssn|social security|tax id", False, lambda s: F.lit(True)),
)


def located(text: Column, kind: Kind) -> Column:
    """array<struct<start, end>> of the confirmed proposals of one kind."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    steps = F.zip_with(F.regexp_extract_all(text, F.lit(kind.pattern), 0), F.split(text, kind.pattern, -1),
                       lambda hit, gap: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(hit), F.lit(0)).alias("len"),
                                                 F.coalesce(kind.valid(hit), F.lit(False)).alias("ok")))
    walk = lambda a, x: F.struct(
        (a.pos + x.gap + x.len).alias("pos"),
        F.when(x.ok & (x.len > 0), F.concat(a.found, F.array(F.struct((a.pos + x.gap).alias("start"), (a.pos + x.gap + x.len).alias("end")))))
        .otherwise(a.found).alias("found"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("pos"), none.alias("found")), walk, lambda a: a.found)


def scored(text: Column, spans: Column, no: int, kind: Kind, reach: int, boost: float, min_score: float) -> Column:
    """Spans with score; an added kind must stand alone (no letter or digit beside it) and reach ``min_score``."""
    before = lambda s: F.substr(text, F.greatest(s.start - reach, F.lit(0)) + 1, F.least(s.start, F.lit(reach)))
    after = lambda s: F.substr(text, s.end + 1, F.lit(reach))
    near = lambda s: F.lower(F.concat_ws(" ", before(s), after(s))).rlike(kind.context)
    out = F.transform(spans, lambda s: F.struct(
        F.lit(no).alias("kind_no"), s.start.alias("start"), s.end.alias("end"), F.lit(kind.name).alias("kind"),
        F.round(F.lit(kind.score) + F.when(near(s), boost).otherwise(0.0), 3).alias("score"), F.lit(kind.base).alias("base")))
    if kind.base:
        return out
    alone = lambda s: ~F.concat(F.substr(text, s.start, F.when(s.start > 0, 1).otherwise(0)), F.lit(" "), F.substr(text, s.end + 1, F.lit(1))).rlike("[A-Za-z0-9]")
    return F.filter(out, lambda s: (s.score >= min_score) & alone(s))


def find_pii(df: DataFrame, text_col: str = "text", out: str = "pii", reach: int = 40, boost: float = 0.2,
             min_score: float = 0.5, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Add ``out``: array of spans (kind_no, start, end, kind, score, base), by kind as listed, then start."""
    text, none = F.coalesce(text_col, F.lit("")), F.array().cast("array<struct<start:int,end:int>>")
    digit = text.rlike("[0-9]")
    df = df.withColumns({f"__{k.name}": F.when((digit if k.name != "email" else F.lit(True)) & text.contains(k.hint), located(text, k)).otherwise(none)
                         for k in kinds})
    df = df.withColumn(out, F.sort_array(F.concat(*(
        F.when(F.size(f"__{k.name}") > 0, scored(text, F.col(f"__{k.name}"), no, k, reach, boost, min_score)).otherwise(F.array())
        .cast(f"array<{SPAN}>") for no, k in enumerate(kinds)))))
    return df.drop(*(f"__{k.name}" for k in kinds))


def redact(df: DataFrame, text_col: str = "text", spans: str = "pii") -> DataFrame:
    """Replace every span by its kind in brackets; overlapping spans become one, named after the first."""
    text = F.coalesce(text_col, F.lit(""))
    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.kind_no.alias("no"), s.end.alias("end"), s.kind.alias("kind"))))
    step = lambda a, s: F.when(s.start >= a.pos, F.struct(
        s.end.alias("pos"), F.concat(a.out, F.substr(text, a.pos + 1, s.start - a.pos), F.lit("["), F.upper(s.kind), F.lit("]")).alias("out")))\
        .otherwise(F.struct(F.greatest(a.pos, s.end).alias("pos"), a.out.alias("out")))
    done = F.aggregate(by_start, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step,
                       lambda a: F.concat(a.out, F.substr(text, a.pos + 1)))
    return df.withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(F.col(text_col)))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
