"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only. Every span has a score: what its validator gives, more or less by the words up to CONTEXT code points before it
and AFTER behind it (as far as the next spans of its kind). The kinds ``email``, ``ip``, ``card`` and ``phone`` are the base and
stay whatever their score; ``iban`` (mod-97), ``ssn`` and ``secret`` (both need a context word, but for keys whose form says what
they are) are added when it reaches ``ACCEPT``. Offsets are code points, end exclusive.

Defined results: a null text counts as empty and has no spans; repeated rows are judged alike, row by row; an empty table gives no
rows; further columns stay as they are, but for those that have the name of a new one, which go. The patterns are written so that a search is linear in the text: a
start is tried once per run of characters, and loops are possessive where nothing after them could need a character back.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelens.llm.common import let, table, text_or_empty

#: kind -> (pattern, cheap test that must hold for the pattern to be searched)
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"
#: Keys that are known by their form: cloud access keys, tokens of code hosts and chat services, API keys, signed web tokens.
KNOWN_SECRET = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abpr]-[A-Za-z0-9-]{10,}|sk[-_][A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{16,})$"

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")

#: Context words that raise or lower the score of a span when they stand close before or behind it.
CONTEXT, AFTER = 48, 24
RAISE = {
    "email": r"(?i)\b(e-?mail|mail|contact|correo|courriel)\b",
    "ip": r"(?i)\b(ip|host|server|address|adresse|dirección)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|karte|tarjeta|carte|cvv)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax|telefon|teléfono|téléphone)\b",
    "iban": r"(?i)\b(iban|account|bank|konto|cuenta|compte|swift|bic)\b",
    "ssn": r"(?i)\b(ssn|social security|security number|tax id|taxpayer)\b",
    "secret": r"(?i)(\b|_)(token|secret|password|passwd|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|bearer|credential|auth)s?\b",
}
LOWER = r"(?i)\b(isbn|issn|order no|invoice no|part no|serial|version|sku)\b"
#: Score of a span that its validator confirms, by kind; what context adds or takes; the least score that is accepted.
CONFIRMED = {"email": 0.9, "ip": 0.7, "card": 0.7, "phone": 0.7, "iban": 0.7, "ssn": 0.3, "secret": 0.4}
RAISED, LOWERED, ACCEPT = 0.3, 0.5, 0.6
#: Code points of the blocks in which a text is cut when spans are replaced.
BLOCK = 4096

_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"


def _running(steps: Column, merge: Callable[[Column, Column], Column] = operator.add) -> Column:
    """What merge (sum, or greatest) gives of 0 and all earlier elements, for each element. Folds blocks of about the square root of the count, so no array is rebuilt once per element of a long text."""

    def fold(block: Column) -> Column:
        zero = F.struct(F.lit(0).alias("so_far"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, zero, lambda acc, x: F.struct(merge(acc["so_far"], x).alias("so_far"), F.concat(acc["out"], F.array(acc["so_far"])).alias("out")))["out"]

    def whole(values: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(values))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / width).cast("int")), lambda k: F.slice(values, k * width + 1, width))
        return let(blocks, lambda found: let(fold(F.transform(found, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: merge(acc, x)))), lambda offset: F.flatten(F.transform(found, lambda b, k: F.transform(fold(b), lambda x: merge(x, offset[k]))))))

    return F.when(F.size(steps) == 0, F.array().cast("array<int>")).otherwise(whole(steps))


SPANS = "array<struct<start:int,end:int,match:string,score:double>>"


def _found(text: Column, kind: str, pattern: str, possible: Column, confirmed: Callable[[Column], Column]) -> Column:
    """Confirmed matches of a pattern in order: array of (start, end, match, score). Context is read from the pieces between the matches."""
    pieces_and_matches = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def placed(both: Column) -> Column:
        lengths = F.transform(both["pieces"], F.length)

        def at(gaps: Column) -> Column:
            return let(_running(F.transform(both["found"], lambda m, i: gaps[i] + F.length(m))), lambda before: F.transform(both["found"], lambda m, i: span(m, i, before[i] + gaps[i])))

        def span(m: Column, i: Column, start: Column) -> Column:
            near = F.concat(F.right(both["pieces"][i], F.lit(CONTEXT)), F.lit(" \n "), F.left(both["pieces"][i + 1], F.lit(AFTER)))
            score = F.lit(CONFIRMED[kind]) + F.when(near.rlike(RAISE[kind]), RAISED).otherwise(0.0) - F.when(near.rlike(LOWER), LOWERED).otherwise(0.0)
            if kind == "secret":
                score = F.when(m.rlike(KNOWN_SECRET), 1.0).otherwise(score)
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"))

        return let(lengths, at)

    kept = lambda s: confirmed(s["match"]) if kind in BASE_KINDS else confirmed(s["match"]) & (s["score"] >= ACCEPT - 1e-9)
    return F.coalesce(F.when(possible, F.filter(let(pieces_and_matches, placed), kept)), F.array().cast(SPANS))


def luhn(digits: Column) -> Column:
    """Luhn's check of a string of at most 19 digits."""
    padded = F.lpad(digits, 19, "0")
    total = F.lit(0)
    for i in range(19):
        digit = F.substring(padded, i + 1, 1).cast("int")
        doubled = digit * 2
        total = total + (F.when(doubled > 9, doubled - 9).otherwise(doubled) if (18 - i) % 2 else digit)
    return total % 10 == 0


def mod97(match: Column) -> Column:
    """ISO 7064 mod 97-10 as account numbers use it."""
    bare = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))
    return (rest == 1) & F.length(bare).between(15, 34)


def _mixed(match: Column) -> Column:
    """Whether a run looks random: letters and digits, at least eight different characters, and no long run of letters alone."""
    return match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(match, ""))) >= 8) & (F.length(F.regexp_replace(match, "[^0-9]", "")) * 8 >= F.length(match))


def find_pii(docs: DataFrame, text: str = "text", prefix: str = "pii_") -> DataFrame:
    """docs with one more column for each kind: ``pii_<kind>``, an array of (start, end, match, score)."""
    t = text_or_empty(text)
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    # kind: pattern, cheap test that must hold for it to be searched, validator
    kinds = {
        "email": (EMAIL, F.instr(t, "@") > 0, lambda m: F.lit(True)),
        "ip": (IP, t.rlike(IP), lambda m: m.rlike(_OCTETS)),
        "card": (CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), lambda m: let(digits(m), lambda d: F.length(d).between(13, 19) & luhn(d))),
        "phone": (PHONE, t.rlike(r"\+[0-9]"), lambda m: F.length(digits(m)).between(9, 15)),
        "iban": (IBAN, t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), mod97),
        "ssn": (SSN, t.rlike(SSN), lambda m: ~m.rlike(r"^(000|666|9)|-00-|-0000$")),
        "secret": (SECRET, t.rlike(r"[A-Za-z0-9+/_-]{16}"), lambda m: m.rlike(KNOWN_SECRET) | _mixed(m)),
    }
    return docs.withColumns({f"{prefix}{kind}": _found(t, kind, *how) for kind, how in kinds.items()})


def span_list(kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end``, comma-joined, by kind as listed, then start."""

    def named(kind: str) -> Column:
        return F.transform(f"pii_{kind}", lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.concat_ws(",", *[named(k) for k in kinds])


def _unused(columns: list[str], name: str) -> str:
    while any(c.lower().startswith(name) for c in columns):
        name = f"_{name}"
    return name


def redact(docs: DataFrame) -> DataFrame:
    """Replace every span in ``text`` by its kind in angle brackets and set ``n_chars`` anew; other columns stay.

    Where spans overlap, the one that starts first (then the longer) stands for all that it touches. A null text stays null.
    The text is cut into blocks once, so a piece is taken from its own blocks and the work is linear in the text.
    """
    columns = docs.columns
    prefix = _unused(columns, "pii_found_")
    spans, blocks, redacted = (f"{prefix}{n}" for n in ("all", "blocks", "text"))

    def marked(kind: str) -> Column:
        return F.transform(f"{prefix}{kind}", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), F.lit(f"<{kind.upper()}>").alias("mark")))

    found = find_pii(docs, prefix=prefix).withColumn(spans, F.array_sort(F.concat(*[marked(k) for k in KINDS])))
    found = found.withColumn(blocks, F.when(F.size(spans) > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))

    def piece(start: Column, end: Column) -> Column:
        """Code points from start to end."""
        first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
        within = F.substr(F.get(F.col(blocks), first), start - first * BLOCK + 1, end - start)
        across = F.concat(F.substr(F.get(F.col(blocks), first), start - first * BLOCK + 1), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.left(F.get(F.col(blocks), last), end - last * BLOCK))
        return F.when(end <= start, "").when(first == last, within).otherwise(across)

    def joined(reached: Column) -> Column:
        # a span opens a new mark where all before it have ended
        each = F.transform(spans, lambda s, i: F.when(s["start"] >= reached[i], F.concat(piece(reached[i], s["start"]), s["mark"])).otherwise(""))
        end = F.greatest(reached[F.size(spans) - 1], -F.col(spans)[F.size(spans) - 1]["less"])
        return F.concat(F.array_join(each, ""), piece(end, F.length("text")))

    text = F.when(F.size(spans) == 0, F.col("text")).otherwise(let(_running(F.transform(spans, lambda s: -s["less"]), lambda a, b: F.greatest(a, b)), joined))
    changed = found.withColumn(redacted, text)
    out = {"text": F.col(redacted)} | ({"n_chars": F.when(F.size(spans) == 0, F.col("n_chars")).otherwise(F.length(redacted).cast("long"))} if "n_chars" in columns else {})
    return changed.select(*[out[c].alias(c) if c in out else F.col(c) for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS], F.sha2(span_list(BASE_KINDS), 256).alias("base_sha256"), span_list().alias("spans"))
