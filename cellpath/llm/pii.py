"""Personal data in whole texts with DataFrame functions only.

Regular expressions propose spans, checksums confirm them, and words nearby adjust a score:

======  =====================================================  ==============================
kind    proposed by                                            confirmed by
======  =====================================================  ==============================
email   local part, ``@``, dotted domain                       its form
ip      four dotted numbers                                    each at most 255
card    digits with single spaces or hyphens between           16 to 19 digits, Luhn
phone   ``+``, digits, spaces, dots, brackets, hyphens         8 to 15 digits
iban    start, and as many characters as its country has       mod 97, and score
card15  as card                                                12 to 15 digits, Luhn, and score
secret  20 letters, digits or ``_/+-`` at least                 letters, digits, variety, and score
======  =====================================================  ==============================

The first four are found leftmost and without overlap per kind, and a match that fails is dropped. The last three
need a score of ``NEEDED``: the checksum alone gives iban ``NEEDED``, and card15, which a tenth of all digit runs pass, less; a
word of its context within ``NEAR`` characters before it adds to that, a word that names other
numbers takes away. A secret, which no checksum confirms, needs such a word or the beginning of a key that a known service issues. An IBAN is proposed at every place where one may start, also inside another proposal, and ends after the fixed
length of its country whatever follows; countries without an entry in ``IBAN_LENGTHS`` take the whole run of up to 34 letters and digits.

Positions are code points, ends exclusive. The patterns match what their plain forms match, but never try a
run of characters twice (iban: at most 34 letters and digits from each start), so that long runs cost time in proportion. Sums over matches are taken in
groups of ``_STEP`` and over the groups, and arrays that lambdas read are stored first, for the same reason.

Null and empty texts have no spans. Repeated rows are handled each. Empty tables give empty results. Existing columns are kept where
a function adds spans; a column of the added name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("iban", "card15", "secret")

# Letters and digits of an IBAN by country, of the registry and of countries that use the form without being in it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_AHEAD = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}+" for n, c in IBAN_LENGTHS.items())
_OTHER = rf"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+"

# The patterns of the kinds.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{_AHEAD}|{_OTHER})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+={0,2}+",
}
#: A byte or more that every match of the kind has.
SIGNS = {"email": "@", "ip": ".", "phone": "+"}
#: Characters that a match takes from the text, of kinds whose group 1 looks further ahead.
TAKEN = {"iban": 4}

NEEDED = 60
NEAR = 40
BASE_SCORE = {"iban": 60, "card15": 40, "secret": 30}
#: Distinct characters that a secret has at least.
VARIED = 10
# Words that make a number more or less likely to be of its kind.
CONTEXT = {
    "iban": r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b",
    "card15": r"(?i)\b(?:card|visa|amex|credit|karte|carte|tarjeta|diners)\b",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|passphrase|credential|bearer|api[ _-]?key|access[ _-]?key|auth[ _-]?key|private[ _-]?key)",
}
# How keys of well-known services begin.
ISSUED = r"^(?:AKIA|ASIA|gh[opsu]_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk-)"
AGAINST = r"(?i)\b(?:order|invoice|isbn|sku|ticket|serial|version)\b"

_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_STEP = 256


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _settled(df: DataFrame, kept: list[str], columns: list[Column]) -> DataFrame:
    """``columns`` as stored values beside the ``kept`` ones.

    Through a generator, which the planner does not merge with what follows: a lambda that reads a stored array reads it, one
    that reads an expression would make the array anew for every element.
    """
    return df.select(*kept, F.inline(F.array(F.struct(*columns))))


def _groups(values: Column, step: int = _STEP) -> Column:
    """Elements in groups of ``step``; no group for none."""
    last = F.floor((F.size(values) - 1) / step).cast("int")
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), last), lambda g: F.slice(values, g * step + 1, F.lit(step)))).otherwise(
        F.array().cast("array<array<int>>")
    )


def _ahead(groups: Column, totals: Column) -> Column:
    """Sum of what stands before each element: of groups before, and within its group. ``totals`` are the sums of the groups."""
    before = F.transform(groups, lambda g, i: _sum(F.slice(totals, F.lit(1), i)))
    return F.flatten(F.zip_with(groups, before, lambda g, b: F.transform(g, lambda _, k: b + _sum(F.slice(g, F.lit(1), k)))))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod_97(match: Column) -> Column:
    """Whether the letters and digits, the first four moved to the end and letters as 10 to 35, leave 1."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    left = F.aggregate(
        F.filter(turned, lambda c: c != ""), F.lit(0), lambda a, c: F.when(c.between("0", "9"), a * 10 + value(c)).otherwise(a * 100 + value(c)) % 97
    )
    return left == 1


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(match, ""))) >= VARIED)
    if kind == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & _mod_97(match)
    count = F.length(_digits(match))
    least, most = (16, 19) if kind == "card" else (12, 15)
    return count.between(least, most) & F.call_function("luhn_check", _digits(match))


def _proposed(text: Column, pattern: str, sign: str | None, group: int = 0) -> tuple[Column, Column]:
    """All matches, and the pieces of text between them."""
    here = text.contains(sign) if sign else text.rlike("[0-9]")
    none = F.array().cast("array<string>")
    return (
        F.when(here, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none),
        F.when(here, F.split(text, pattern, -1)).otherwise(none),
    )


def with_spans(docs: DataFrame, text_col: str = "text", name: str = "spans") -> DataFrame:
    """Add ``spans``: an array of (rank of kind, kind, start, end, score), ordered by kind and start.

    Every array is made once and walked a bounded number of times for each of its elements, so time grows with the text and its matches.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in docs.columns if c != name]

    def each(*makers) -> list[Column]:
        return [make(F.col(_column(kind)), kind).alias(f"{_column(kind)}{suffix}") for kind in PATTERNS for make, suffix in makers]

    out = _settled(docs, kept, [_pair(text, kind) for kind in PATTERNS])
    out = _settled(out, kept, each((_stepped, "")))
    out = _settled(out, kept, each((lambda c, kind: c, ""), (lambda c, kind: _groups(c["steps"]), "_groups")))
    both = [*[_column(kind) for kind in PATTERNS], *[f"{_column(kind)}_groups" for kind in PATTERNS]]
    totals = [F.transform(f"{_column(kind)}_groups", _sum).alias(f"{_column(kind)}_totals") for kind in PATTERNS]
    out = _settled(out, kept + both, totals)
    out = _settled(out, kept, [_placed(kind) for kind in PATTERNS])
    found = [_spans(rank, kind) for rank, kind in enumerate((*KINDS, *EXTRA))]
    return out.select(*kept, F.concat(*found).alias(name))


def _column(kind: str) -> str:
    return f"_pii_{'card' if kind == 'card15' else kind}"


def _pair(text: Column, kind: str) -> Column:
    matches, pieces = _proposed(text, PATTERNS[kind], SIGNS.get(kind), int(kind in TAKEN))
    return F.struct(matches.alias("matches"), pieces.alias("pieces")).alias(_column(kind))


def _stepped(found: Column, kind: str) -> Column:
    """Matches, the pieces before them, and how far each pair reaches."""
    pieces = F.slice(found["pieces"], F.lit(1), F.size(found["matches"]))
    steps = F.zip_with(found["matches"], pieces, lambda m, p: (F.lit(TAKEN[kind]) if kind in TAKEN else F.length(m)) + F.length(p))
    return F.struct(found["matches"].alias("matches"), pieces.alias("pieces"), steps.alias("steps"))


def _placed(kind: str) -> Column:
    """Of each match: itself, what stands before it, and its start, which is the length of all pieces up to it and of what all
    matches before it take. Arrays are walked side by side; a lookup by index could make an array anew for every element."""
    found = F.col(_column(kind))
    ahead = _ahead(F.col(f"{_column(kind)}_groups"), F.col(f"{_column(kind)}_totals"))
    starts = F.zip_with(ahead, found["pieces"], lambda a, p: a + F.length(p))
    before = F.transform(found["pieces"], lambda p: F.right(p, F.lit(NEAR)))
    return F.arrays_zip(found["matches"].alias("match"), before.alias("before"), starts.alias("start")).alias(_column(kind))


def _spans(rank: int, kind: str) -> Column:
    def span(found: Column) -> Column:
        match, start = found["match"], found["start"]
        if kind in EXTRA:
            score = (
                F.lit(BASE_SCORE[kind])
                + F.when(found["before"].rlike(CONTEXT[kind]), 40).otherwise(0)
                - F.when(found["before"].rlike(AGAINST), 30).otherwise(0)
            )
            if kind == "secret":
                score = score + F.when(match.rlike(ISSUED), 40).otherwise(0)
            ok = F.when(_confirmed(kind, match), score).otherwise(0) >= NEEDED
        else:
            score = F.lit(100)
            ok = _confirmed(kind, match)
        return F.when(
            ok,
            F.struct(
                F.lit(rank).alias("rank"),
                F.lit(kind).alias("kind"),
                start.alias("start"),
                (start + F.length(match)).alias("end"),
                score.alias("score"),
            ),
        )

    return F.filter(F.transform(_column(kind), span), lambda s: s.isNotNull())


def _named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, the hash of base spans, and all spans as text."""
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        id_col,
        *(count(kind) for kind in KINDS),
        F.sha2(_named(F.filter(spans, lambda s: s["rank"] < len(KINDS))), 256).alias("base_sha256"),
        _named(spans).alias("spans"),
        F.size(spans).cast("long").alias("n_spans"),
    )


def masked(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """The rows with every span replaced by its kind in angle brackets, and the count of characters made to fit.

    Spans that overlap become one, named by the one that starts first. Null texts stay null.
    """
    columns = docs.columns
    found = with_spans(docs, text_col, "_pii_all")
    ordered = F.array_sort(F.transform("_pii_all", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    found = _settled(found, columns, [ordered.alias("_pii_all")])
    ends = _groups(F.transform("_pii_all", lambda s: s["end"]))
    found = _settled(found, [*columns, "_pii_all"], [ends.alias("_pii_ends")])
    most = F.transform("_pii_ends", lambda g: F.array_max(g))
    found = _settled(found, [*columns, "_pii_all", "_pii_ends"], [most.alias("_pii_most")])
    # How far spans before each one reach: of groups before, and within its group.
    before = F.transform("_pii_ends", lambda g, i: F.coalesce(F.array_max(F.slice("_pii_most", F.lit(1), i)), F.lit(0)))
    reached = F.flatten(
        F.zip_with("_pii_ends", before, lambda g, b: F.transform(g, lambda _, k: F.greatest(b, F.coalesce(F.array_max(F.slice(g, F.lit(1), k)), F.lit(0)))))
    )
    firsts = F.filter(F.arrays_zip(F.col("_pii_all").alias("span"), reached.alias("reached")), lambda z: z["span"]["start"] >= z["reached"])
    # The text in blocks, so that a place in it is found in the time of a block.
    blocks = F.when(F.size("_pii_all") > 0, F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{_STEP}}}"), F.lit(0)))
    found = _settled(found, [*columns, "_pii_most"], [firsts.alias("_pii_firsts"), blocks.alias("_pii_blocks")])
    # What a first span finds reached is the end of the one before it.
    reached = F.transform("_pii_firsts", lambda f: f["reached"])
    last = F.concat(F.slice(reached, F.lit(2), F.greatest(F.size(reached) - 1, F.lit(0))), F.array(F.array_max("_pii_most")))
    starts = F.transform("_pii_firsts", lambda f: f["span"]["start"])
    names = F.transform("_pii_firsts", lambda f: F.concat(F.lit("<"), F.upper(f["span"]["kind"]), F.lit(">")))
    found = _settled(found, [*columns, "_pii_blocks"], [starts.alias("_pii_starts"), last.alias("_pii_last"), names.alias("_pii_names")])
    since = F.concat(F.array(F.lit(0)), "_pii_last")
    until = F.concat("_pii_starts", F.array(F.lit(_FAR)))
    parts = F.transform(F.arrays_zip(since.alias("a"), until.alias("b"), F.concat("_pii_names", F.array(F.lit(""))).alias("name")), _part)
    text = F.when(F.col("_pii_blocks").isNotNull(), F.array_join(parts, "")).otherwise(F.col(text_col))
    found = _settled(found, [c for c in columns if c != text_col], [text.alias(text_col), F.col("_pii_blocks").isNotNull().alias("_pii_any")])
    if count_col in columns:
        found = found.withColumn(count_col, F.when(F.col("_pii_any"), F.length(text_col)).otherwise(F.col(count_col)).cast(docs.schema[count_col].dataType))
    return found.select(*columns)


#: Beyond the end of any text.
_FAR = (1 << 31) - 1 - _STEP


def _part(z: Column) -> Column:
    """Text from ``a`` to ``b``, out of its blocks, and the name of what follows."""
    first, last = F.floor(z["a"] / _STEP).cast("int"), F.floor(z["b"] / _STEP).cast("int")
    block = lambda k: F.coalesce(F.get("_pii_blocks", k), F.lit(""))
    within = F.substring(block(first), z["a"] % _STEP + 1, z["b"] - z["a"])
    across = F.concat(
        F.substring(block(first), z["a"] % _STEP + 1, F.lit(_STEP)),
        F.array_join(F.slice("_pii_blocks", first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.substring(block(last), F.lit(1), z["b"] % _STEP),
    )
    return F.concat(F.when(first == last, within).otherwise(across), z["name"])
