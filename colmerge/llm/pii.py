"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score. DataFrame functions only.

Spark's functions return matches without places. So every match is put between two markers, the text is split at the markers,
and a running sum of the pieces' lengths gives each match's start and end in code points. Running sums go over ``STEPS`` items at a time, so
that no array grows with the number of matches: a text of many thousand matches takes time in proportion.

Patterns repeat single characters only, never groups: a separator between two digits, or a dot between two label characters, is
first replaced by one sign of the same length. So runs of any length are matched in a loop, without deep recursion. A match may
begin only where a run begins (or where the last match ended), which finds the same leftmost matches in linear time.

Base kinds (``email``, ``ip``, ``card``, ``phone``) are kept whenever their own check holds (parts up to 255; 13 to 19 digits that pass
Luhn; 9 to 15 digits). The added kind ``iban`` is proposed at every start of a word, with its country's length where that is known and ends
a word, else to the end of the run of capitals and digits; it is kept if mod-97 confirms it, so its spans may overlap. ``score`` starts at the kind's prior and rises by
``CONTEXT_BONUS``, to 1 at most, if one of the kind's words begins in the ``CONTEXT`` characters before the span or behind it (as far as the next match of the kind).

Cases: a null or empty text has no spans; texts are searched whole; repeated rows stay; other columns pass through, whatever their names (an input
column named like the output is replaced); an empty table gives an empty result. Code points U+E000 and U+E002 in a text match nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colmerge.llm.common import unused

#: Items of a running sum that share an array while it grows.
STEPS = 128
MARK, OTHER, JOIN = "\ue000", "\ue001", "\ue002"
KINDS = ["email", "ip", "card", "phone", "iban"]
BASE_KINDS = KINDS[:4]
CONTEXT, CONTEXT_BONUS = 40, 0.2
#: The score of a confirmed span without context, and the words that raise it (in the languages of the corpus).
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.8}
WORDS = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse|direcci",
    "card": "card|visa|mastercard|credit|carte|karte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|portable|m.vil",
    "iban": "iban|account|bank|konto|compte|cuenta",
}

_LOCAL = f"A-Za-z0-9._%+{JOIN}-"
_LABEL = "A-Za-z0-9-"
#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBANS = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:{JOIN}?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++{JOIN}[{_LABEL}{JOIN}]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"(?<![0-9{JOIN}])[0-9][0-9{JOIN}]{{12,}}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # takes no room, so that a number that isn't confirmed hides none that begins inside it
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=({_IBANS}|[A-Z0-9{JOIN}]{{15,42}}+(?![A-Za-z0-9])))",
}
#: Where the pattern reads a text in which single separators are replaced.
JOINED = {"email": rf"(?<=[{_LABEL}])\.(?=[{_LABEL}])", "card": r"(?<=[0-9])[\x20-](?=[0-9])", "iban": "(?<=[A-Z0-9]) (?=[A-Z0-9])"}
SPAN = "start:int,end:int,value:string,around:string"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where a string of digits, not null, has a valid Luhn sum."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """True where an account number (letters and digits, four characters first moved to the end) leaves 1 modulo 97."""
    plain = F.regexp_replace(value, "[^A-Z0-9]", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.between("0", "9"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + letter) % 97

    return F.length(plain).between(15, 34) & (F.aggregate(F.split(moved, ""), F.lit(0), add) == 1)


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return mod97(value) if kind == "iban" else F.lit(True)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """What ``step`` makes of each item: it takes the state so far and the item, and returns (state, made); ``kind`` is the type of what is made."""

    def one(state: Column, item: Column) -> Column:
        new = step(state["state"], item)
        return F.struct(new["state"].alias("state"), F.concat(state["made"], F.array(new["made"])).alias("made"))

    def whole(items: Column) -> Column:
        def block(state: Column, k: Column) -> Column:
            begun = F.struct(state["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("made"))
            done = F.aggregate(F.slice(items, k * STEPS + 1, F.lit(STEPS)), begun, one)
            return F.struct(done["state"].alias("state"), F.concat(state["made"], F.array(done["made"])).alias("made"))

        begun = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("made"))
        blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / STEPS).cast("int"))
        return F.flatten(F.aggregate(blocks, begun, block, lambda state: state["made"]))

    return _let(items, whole)


def _proposed(text: Column, kind: str) -> Column:
    """All matches of the kind's pattern with their places and what stands around them."""
    if kind in JOINED:
        text = F.regexp_replace(text, JOINED[kind], JOIN)
    copied = kind == "iban"  # the piece between the marks is a copy of what follows them
    pieces = F.split(F.regexp_replace(text, PATTERNS[kind], f"{MARK}${int(copied)}{MARK}"), MARK, -1)

    def match(pieces: Column) -> Column:
        def near(k: Column) -> Column:
            value, behind = pieces[2 * k + 1], pieces[2 * k + 2]
            after = F.substring(behind, F.length(value) + 1, F.lit(CONTEXT)) if copied else F.left(behind, F.lit(CONTEXT))
            around = F.concat(F.right(pieces[2 * k], F.lit(CONTEXT)), F.lit("\n"), after)
            return F.struct(F.length(pieces[2 * k]).alias("gap"), value.alias("value"), around.alias("around"))

        matches = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 3) / 2).cast("int")), near)

        def step(at: Column, m: Column) -> Column:
            begin = at + m["gap"]
            end = begin + F.length(m["value"])
            span = F.struct(begin.alias("start"), end.alias("end"), m["value"].alias("value"), m["around"].alias("around"))
            return F.struct((begin if copied else end).alias("state"), span.alias("made"))

        return _running(matches, F.lit(0), step, f"struct<{SPAN}>")

    none = F.array().cast(f"array<struct<{SPAN}>>")
    return _let(pieces, lambda p: F.when(F.size(p) > 1, match(p)).otherwise(none))


def _kind_spans(text: Column, kind: str) -> Column:
    spans = _proposed(text, kind)
    kept = F.filter(spans, lambda s: _confirmed(kind, s["value"]))

    def scored(s: Column) -> Column:
        near = F.lower(s["around"]).rlike(rf"\b({WORDS[kind]})")
        score = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(near, CONTEXT_BONUS).otherwise(0.0))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    return F.transform(kept, scored)


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: an array of (kind, start, end, score), by kind as in ``KINDS``, then start."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    body = F.col(text).cast("string")
    clean = F.translate(F.coalesce(body, F.lit("")), MARK + JOIN, OTHER * 2)
    given = [c for c in docs.columns if c != out]
    names = dict(zip(["text", "digit", *KINDS], unused(docs.columns, "text_", "digit_", *[f"{kind}_" for kind in KINDS]), strict=True))
    row = docs.select(*given, F.when(body.rlike(f"[{MARK}{JOIN}]"), clean).otherwise(F.coalesce(body, F.lit(""))).alias(names["text"]))
    row = row.withColumn(names["digit"], F.col(names["text"]).rlike("[0-9]"))
    t, digit = F.col(names["text"]), F.col(names["digit"])
    need = {"email": F.contains(t, F.lit("@")), "ip": digit, "card": digit, "phone": digit & F.contains(t, F.lit("+")), "iban": digit}
    for kind in KINDS:
        row = row.withColumn(names[kind], F.when(need[kind], _kind_spans(t, kind)).otherwise(none))
    return row.select(*given, F.concat(*[F.col(names[kind]) for kind in KINDS]).alias(out))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; of overlapping spans the first names them all."""
    ordered = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(at: Column, s: Column) -> Column:
        """The gap before a span and its name, for a span that begins behind those before it; else null."""
        made = F.when(s["start"] >= at, F.struct(at.alias("start"), s["start"].alias("end"), s["kind"].alias("kind")))
        return F.struct(F.greatest(at, s["end"]).alias("state"), made.alias("made"))

    cuts = _running(ordered, F.lit(0), step, "struct<start:int,end:int,kind:string>")

    def replaced(wide: Column) -> Column:
        """The text, given in four bytes for each code point: a place is found without reading what lies before it."""

        def cut(start: Column, end: Column) -> Column:
            # the mark in front keeps a mark at the start of the part
            return F.decode(F.concat(F.unhex(F.lit("0000FEFF")), F.substring(wide, start * 4 + 1, (end - start) * 4)), "UTF-32")

        heads = F.transform(F.filter(cuts, lambda c: c.isNotNull()), lambda c: F.concat(cut(c["start"], c["end"]), F.lit("["), F.upper(c["kind"]), F.lit("]")))
        rest = cut(F.array_max(F.transform(F.col(spans), lambda s: s["end"])), F.length(text))
        return F.concat(F.array_join(heads, ""), rest)

    return docs.withColumn(text, F.when(F.size(spans) > 0, _let(F.encode(F.col(text), "UTF-32"), replaced)).otherwise(F.col(text)))
