"""Personal data: patterns propose spans, checksums confirm them, context adjusts scores.

Only DataFrame functions. Positions are code points. Matches and the text between
them are cut apart by the same pattern, and a span's start is the length of all
that lies before it (a two-level prefix sum, so long lists stay cheap).

Base kinds: email, ip (parts up to 255), card (14 to 19 digits, Luhn), phone (10 to
15 digits). The method adds iban (mod 97) and phone numbers without a plus that
follow a context word. Scores start at a level per kind and rise with a context
word in the 40 code points before the span.

Patterns are written so that no start is tried twice: a run of characters is
entered at its start or where the last match ended, and inner loops give nothing
back, which changes no match but keeps very long texts linear.

Defined results: NULL text counts as empty (no spans, digest of the empty string);
repeated rows give a row each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: The patterns of the four base kinds, in the order of kinds.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Added kinds: IBANs, and phone numbers introduced by a word instead of a plus.
ADDED = {
    "iban": r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone_word": r"[0-9(](?<=(?i:tel|phone|fax|mobile|telefon|teléfono)[.:]{0,2}\x20{0,2}[0-9(])[\x20().0-9-]{5,20}[0-9]",
}
KINDS = [*BASE, *ADDED]
LEVEL = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "phone_word": 0.6}
CONTEXT = {
    "email": r"(?i)\b(?:mail|e-mail|email|contact|write|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|telefon|téléphone|teléfono)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "phone_word": r"(?i)\b(?:call|reach|contact|office|home)\b",
}
CONTEXT_WIDTH = 40
CONTEXT_GAIN = 0.1
_BLOCK = 256


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if every second digit from the right, doubled, makes a sum divisible by ten."""
    reverse = F.split(F.reverse(digits), "")
    values = F.transform(
        F.filter(reverse, lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
        ),
    )
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(match: Column) -> Column:
    """True for an account number whose moved and spelled-out digits leave 1 modulo 97."""
    plain = F.regexp_replace(match, " ", "")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    codes = F.transform(
        F.filter(F.split(moved, ""), lambda c: c != ""),
        lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55),
    )
    rest = F.aggregate(
        codes, F.lit(0),
        lambda a, v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97),
    )
    return F.length(plain).between(15, 34) & (rest == 1)


_PART = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike(_PART))
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "phone_word":
        return F.length(_digits(match)).between(7, 15)
    return F.lit(True)


def _spans(kind: str, order: int, matches: Column, pieces: Column, whole: Column) -> Column:
    """Structs (start, order, stop, kind, score) of the valid matches.

    ``pieces`` holds the text around the matches, one more than these.
    """
    lengths = F.transform(
        matches, lambda m, i: F.length(F.get(pieces, i)) + F.length(m)
    )
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / _BLOCK).cast("int")),
        lambda b: F.aggregate(
            F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda a, v: a + v
        ),
    )

    def before(i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        add = lambda a, v: a + v
        return F.aggregate(F.slice(blocks, F.lit(1), block), F.lit(0), add) + F.aggregate(
            F.slice(lengths, block * _BLOCK + 1, i - block * _BLOCK), F.lit(0), add
        )

    good = F.filter(
        F.transform(matches, lambda m, i: F.struct(m.alias("m"), i.alias("i"))),
        lambda x: valid(kind, x["m"]),
    )
    placed = F.transform(
        good,
        lambda x: F.struct(
            (before(x["i"]) + F.length(F.get(pieces, x["i"]))).alias("start"), x["m"].alias("m")
        ),
    )
    return F.transform(
        placed,
        lambda x: F.struct(
            x["start"].alias("start"),
            F.lit(order).alias("order"),
            (x["start"] + F.length(x["m"])).alias("stop"),
            F.lit(kind).alias("kind"),
            (
                F.lit(LEVEL[kind])
                + F.when(
                    F.substring(
                        whole,
                        F.greatest(F.lit(1), x["start"] - CONTEXT_WIDTH + 1),
                        F.least(F.lit(CONTEXT_WIDTH), x["start"]),
                    ).rlike(CONTEXT[kind]),
                    F.lit(CONTEXT_GAIN),
                ).otherwise(F.lit(0.0))
            ).alias("score"),
        ),
    )


def _joined(spans: Column, with_score: bool = False) -> Column:
    def shown(s: Column) -> Column:
        parts = [s["kind"], s["start"].cast("string"), s["stop"].cast("string")]
        if with_score:
            parts.append(F.format_number(s["score"], 2))
        return F.concat_ws(":", *parts)

    return F.array_join(F.transform(spans, shown), ",")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base spans, all spans) as arrays of structs, one row per document."""
    rows = docs.select(F.col(key).alias(key), text_or_empty(text).alias("__text"))
    whole = F.col("__text")
    # A pattern is tried only where its marks occur at all.
    gate = {"email": whole.contains("@"), "phone": whole.contains("+")}
    every = {**BASE, **ADDED}
    rows = rows.withColumns({
        f"__m_{k}": F.when(
            gate.get(k, F.lit(True)), F.regexp_extract_all(whole, F.lit(p), F.lit(0))
        ).otherwise(F.array().cast("array<string>"))
        for k, p in every.items()
    })
    # The text is cut apart only where a match is valid.
    rows = rows.withColumns({
        f"__p_{k}": F.when(F.exists(f"__m_{k}", partial(valid, k)), F.split(whole, p))
        for k, p in every.items()
    })
    none = F.array().cast("array<struct<start:int,`order`:int,stop:int,kind:string,score:double>>")
    rows = rows.select(
        key,
        *[
            F.when(
                F.col(f"__p_{k}").isNotNull(),
                _spans(k, n, F.col(f"__m_{k}"), F.col(f"__p_{k}"), whole),
            ).otherwise(none).alias(f"__s_{k}")
            for n, k in enumerate(KINDS)
        ],
    )
    base = F.array_sort(F.concat(*[F.col(f"__s_{k}") for k in BASE]))
    return rows.select(
        key,
        *[F.size(f"__s_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        base.alias("base"),
        F.array_sort(F.concat(*[F.col(f"__s_{k}") for k in KINDS])).alias("all"),
    )


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, digest of the base spans, and all spans as text."""
    return found.select(
        key, "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"),
        _joined(F.col("all"), with_score=True).alias("scored_spans"),
        "n_iban", "n_phone_word",
    )
