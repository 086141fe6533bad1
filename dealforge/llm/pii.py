"""Personal data in texts: patterns propose spans, checksums confirm, context words score.

DataFrame operations only. A span is ``struct(kind, start, end, score)``; positions are code points,
end exclusive. Matches are leftmost and do not overlap within a kind; one that fails its check is
dropped and its characters are not tried again.

Every pattern begins where a run of its first characters begins or where the last match ended, and
repeats possessively: the matches are those of the plain pattern, found in linear time and without
deep recursion on very long runs.

Positions come from the texts between matches, whose lengths are summed in blocks, so a text with
very many matches costs no square of their number.

Cases: a null or empty text has no spans; an empty table gives an empty result; repeated rows stay; columns that have the name of a new
one are replaced; a text is searched whole whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import without

LOCAL, HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Characters of an account number, by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22,
    "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}


def _iban() -> str:
    """Countries of one length together: check digits, then groups of four with blanks between or none."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    rest = lambda r: rf"\x20?[A-Z0-9]{{{r}}}" if r else ""
    forms = [rf"(?:{'|'.join(c)})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}{rest(n % 4)}" for n, c in sorted(by_length.items())]
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(forms)})(?![A-Za-z0-9])"


#: Kind -> pattern, in the order in which spans are listed.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{HOST}++(?:\.{HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban(),
}
#: The kinds whose valid spans always stay.
BASE = ("email", "ip", "card", "phone")
#: A text without this has no match of the kind.
HINT = {"email": "@", "phone": "+"}
#: Score of a span that passed its check, before its context.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.7}
#: Words near before a span, and near after it for kinds that need them, that raise its score; words that lower it.
RAISE = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|reach|write)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login|from)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|payment|pay)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|contact)\b",
    "iban": r"(?i)\b(?:iban|account|bank|transfer|konto|compte|cuenta)\b",
}
LOWERS = r"(?i)\b(?:version|example|sample|order|serial|isbn)\b"
NEAR = 40
LEAST_SCORE = 0.5
BLOCK = 128


def _lengths(text: Column, kind: str) -> Column:
    """For each match: characters before it since the last one, its own, its text, what is near before."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), m.alias("m"), F.right(g, F.lit(NEAR)).alias("near")))
    if kind not in BASE:
        after = F.slice(between, F.lit(2), F.size(found))
        pairs = F.zip_with(pairs, after, lambda x, g: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), x["m"].alias("m"), F.concat_ws("\n", x["near"], F.left(g, F.lit(NEAR))).alias("near")))
    hint = text.contains(HINT[kind]) if kind in HINT else F.lit(True)
    nothing = F.expr("cast(array() as array<struct<gap:int,len:int,m:string,near:string>>)")
    return F.when(hint & F.regexp_like(text, pattern), pairs).otherwise(nothing)


def _placed(pairs: Column) -> Column:
    """``pairs`` with the start of each match."""
    none = F.expr("cast(array() as array<struct<start:int,len:int,m:string,near:string>>)")
    state = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(a, x):
        start = a["at"] + x["gap"]
        row = F.struct(start.alias("start"), x["len"].alias("len"), x["m"].alias("m"), x["near"].alias("near"))
        return F.struct((start + x["len"]).alias("at"), F.concat(a["out"], F.array(row)).alias("out"))

    def block(lo):
        return F.slice(pairs, lo, F.lit(BLOCK))

    firsts = F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(BLOCK))
    sums = F.transform(firsts, lambda lo: F.aggregate(block(lo), F.lit(0), lambda a, x: a + x["gap"] + x["len"]))
    begins = F.transform(firsts, lambda lo, k: F.struct(lo.alias("lo"), F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0), lambda a, x: a + x).alias("at")))
    blocks = F.transform(begins, lambda b: F.aggregate(block(b["lo"]), F.struct(b["at"].alias("at"), none.alias("out")), step, lambda a: a["out"]))
    return F.when(F.size(pairs) == 0, none).when(F.size(pairs) <= BLOCK, F.aggregate(pairs, state, step, lambda a: a["out"])).otherwise(F.flatten(blocks))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total, i):
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number, first four characters last and letters as numbers, leaves 1 mod 97."""
    plain = F.replace(iban, F.lit(" "))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def add(a, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 65, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(m, F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return mod97(m)
    return F.lit(True)


def _score(kind: str, near: Column) -> Column:
    up = F.when(F.regexp_like(near, F.lit(RAISE[kind])), 0.2).otherwise(0.0)
    down = F.when(F.regexp_like(near, F.lit(LOWERS)), 0.3).otherwise(0.0)
    return F.round(F.lit(PRIOR[kind]) + up - down, 2)


def _checked(kind: str, placed: str) -> Column:
    good = F.filter(placed, lambda x: _valid(kind, x["m"]))
    rows = F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + x["len"]).alias("end"), _score(kind, x["near"]).alias("score")))
    return rows if kind in BASE else F.filter(rows, lambda x: x["score"] >= LEAST_SCORE)


def detect(df: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """Add ``out_col``: all spans, by kind as listed in ``PATTERNS`` and then by start.

    Base kinds keep every valid span; others need ``LEAST_SCORE`` after their context.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    steps = without(df, out_col)
    names = {k: f"_pii_{k}" for k in PATTERNS}
    for kind, name in names.items():
        placed = f"{name}_at"
        steps = steps.withColumn(name, _lengths(text, kind)).withColumn(placed, _placed(F.col(name)))
        steps = steps.withColumn(name, _checked(kind, placed)).drop(placed)
    return steps.withColumn(out_col, F.concat(*names.values())).drop(*names.values())


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with every span replaced by its kind in brackets; spans that overlap become one.

    The columns and their order stay; a null text stays null.
    """
    found = detect(df, text_col, "_pii").withColumn("_pii", F.array_sort(F.transform("_pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    text = F.col(f"`{text_col}`")
    state = F.expr("named_struct('at', 0, 'parts', cast(array() as array<string>))")

    def step(a, s):
        tag = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        fresh = F.struct(s["end"].alias("at"), F.concat(a["parts"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), tag)).alias("parts"))
        more = F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["parts"].alias("parts"))
        return F.when(s["start"] >= a["at"], fresh).otherwise(more)

    parts = F.aggregate("_pii", state, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(text, a["at"] + 1)))
    clean = F.when(text.isNull() | (F.size("_pii") == 0), text).otherwise(parts)
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])


def listed(spans: Column) -> Column:
    """Spans as comma-joined ``kind:start:end``."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
