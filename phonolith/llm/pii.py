"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Everything is a column expression over one row, so a scan is the whole job. Places of matches come from the pieces
between them: a match starts after all pieces and matches before it. A pattern may need to know where the last match
ended, which is what \\G is for; possessive repeats keep each pattern linear in the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Country codes by the length of their account numbers (IBAN registry).
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}

#: Code points looked at on either side of a span.
NEAR = 40
#: Spans that are not of a base kind are kept from this score on.
KEEP = 0.7
#: Matches whose places are summed in one go; longer lists are summed chunk by chunk.
CHUNK = 256


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A text without it has no match.
    needs: str
    base: bool
    prior: float
    #: Raise and lower the score by 0.2 when found nearby; \x00 stands for the span.
    raises: str
    lowers: str


_DIGIT_RUN = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){%s}+(?![\x20-]?[0-9])"
_IBAN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_COUNTRIES.items())
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.8, r"e-?mail|contact|write|correo|courriel", r"example|invalid"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", True, 0.6, r"\bip\b|address|host|server|client", r"version|release|build|\bv\x00"),
    Kind("card", _DIGIT_RUN % "15,18", "", True, 0.7, r"card|visa|master|credit|debit|karte|tarjeta|carte", r"order|isbn|serial|tracking"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True, 0.7, r"phone|call|tel|mobile|fax|whatsapp", r"score|total|offset"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])", "", False, 0.8, r"iban|account|konto|cuenta|compte|bank", r"token|key|hash"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", False, 0.5, r"ssn|social\s+security", r"part|order|model"),
)


def _mod97(account: Column) -> Column:
    """Remainder of an account number: its first four characters go last, letters count from 10."""
    compact = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(compact, 5, 60), F.substring(compact, 1, 4))
    add = lambda r, c: F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(add(r, c)))


def _valid(kind: Kind, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind.name == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    if kind.name == "card":
        return F.call_function("luhn_check", digits)
    if kind.name == "phone":
        return F.length(digits).between(8, 15)
    if kind.name == "iban":
        return _mod97(match) == 1
    return F.lit(True)


def _starts(before: Column, matches: Column) -> Column:
    """Code-point starts of matches, each after its piece of text in `before`."""
    pairs = F.zip_with(before, matches, lambda b, m: F.struct(F.length(b).cast("long").alias("b"), F.length(m).cast("long").alias("m")))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / CHUNK).cast("int")), lambda c: F.slice(pairs, c * CHUNK + 1, CHUNK))
    none = F.array().cast("array<bigint>")

    def within(chunk: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), none.alias("out"))
        return F.aggregate(chunk, zero, lambda s, x: F.struct((s["at"] + x["b"] + x["m"]).alias("at"), F.concat(s["out"], F.array(s["at"] + x["b"])).alias("out")))

    total = lambda chunk: F.aggregate(chunk, F.lit(0).cast("bigint"), lambda s, x: s + x["b"] + x["m"])
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
    done = F.aggregate(chunks, zero, lambda s, c: F.struct((s["at"] + total(c)).alias("at"), F.concat(s["out"], F.array(within(c, s["at"])["out"])).alias("out")))
    return F.flatten(done["out"])


_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _spans(text: Column, kind: Kind) -> Column:
    """Valid spans of one kind in order of their start."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.split(text, kind.pattern, -1)

    def score(before: Column, after: Column) -> Column:
        near = F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit("\0"), F.left(after, F.lit(NEAR))))
        bonus = F.when(near.rlike(kind.raises), 0.2).otherwise(0.0) - F.when(near.rlike(kind.lowers), 0.2).otherwise(0.0)
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), kind.prior + bonus)), 2)

    def made(all_pieces: Column, found: Column) -> Column:
        n = F.size(found)
        rows = F.arrays_zip(found.alias("m"), F.slice(all_pieces, 1, n).alias("b"), F.slice(all_pieces, 2, n).alias("a"), _starts(F.slice(all_pieces, 1, n), found).alias("s"))
        good = F.filter(rows, lambda x: _valid(kind, x["m"]))
        spans = F.transform(
            good,
            lambda x: F.struct(F.lit(kind.name).alias("kind"), x["s"].alias("start"), (x["s"] + F.length(x["m"])).alias("end"), score(x["b"], x["a"]).alias("score")),
        )
        return spans if kind.base else F.filter(spans, lambda x: x["score"] >= KEEP)

    return matches, pieces, made


def personal_data(docs: DataFrame) -> DataFrame:
    """docs' doc_id with `spans`: kind, start, end (code points, end exclusive) and score, by kind as in KINDS, then start.

    Base kinds (email, ip, card, phone) keep every span that passes its check, whatever its score; the others are kept
    from a score of 0.7 on. A null or empty text has no spans. Rows are independent: nulls, repeated rows and other
    columns change nothing, and an empty table gives an empty result.
    """
    out = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for kind in KINDS:
        matches, _, _ = _spans(F.col("text"), kind)
        none = F.array().cast("array<string>")
        guarded = F.when(F.col("text").contains(kind.needs), matches).otherwise(none) if kind.needs else matches
        out = out.withColumn(f"m_{kind.name}", guarded)
    for kind in KINDS:
        _, pieces, made = _spans(F.col("text"), kind)
        found = F.col(f"m_{kind.name}")
        cut = F.when(F.size(found) > 0, pieces).otherwise(F.array().cast("array<string>"))
        out = out.withColumn(f"p_{kind.name}", cut)
    spans = [F.when(F.size(f"m_{k.name}") > 0, _spans(F.col("text"), k)[2](F.col(f"p_{k.name}"), F.col(f"m_{k.name}"))).otherwise(F.array().cast(_SPAN)).cast(_SPAN) for k in KINDS]
    return out.select("doc_id", F.concat(*spans).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of the text replaced by [KIND]; of spans that overlap, the one that starts first, then the longest."""
    found = F.array_sort("spans", lambda x, y: F.when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).otherwise(F.when(x["end"] > y["end"], -1).when(x["end"] < y["end"], 1).otherwise(0)))
    text = F.coalesce(F.col("whole.text").cast("string"), F.lit(""))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(s: Column, x: Column) -> Column:
        added = F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.when(x["start"] >= s["at"], F.struct(added.alias("out"), x["end"].alias("at"))).otherwise(s)

    whole = docs.select(F.struct(*docs.columns).alias("whole"), "text")  # so no column of docs meets one of ours
    spans = personal_data(whole.select(F.col("whole").alias("doc_id"), "text")).withColumnRenamed("doc_id", "whole")
    done = F.aggregate(found, zero, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    redacted = F.when(F.col("whole.text").isNotNull(), done)
    return spans.select(*[redacted.alias(c) if c == "text" else F.col("whole").getField(c).alias(c) for c in docs.columns])


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts and texts of spans as the query op3 returns them, with each span's score."""
    of = lambda kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = [k.name for k in KINDS if k.base]
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in base]
    scores = F.array_join(F.transform("spans", lambda x: x["score"].cast("string")), ",").alias("scores")
    return found.select("doc_id", *counts, F.sha2(said(of(base)), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), scores)
