"""Personal data by weak supervision, with DataFrame operations only.

Base spans are matches of four patterns that pass their checks. Further candidates (masked addresses, local telephone numbers,
account and insurance numbers, secrets, titled names) come from one wider pattern. Labelers vote on every span, or abstain:
strict format, gazetteer, context before it, misleading context, and shape. The votes are counted by pattern over the whole
corpus (a bounded table); on the driver, expectation-maximisation estimates each labeler's reliability and each pattern's
probability, and a logistic regression over the spans' discrete features is fitted to them. Its coefficients go back into
the plan as an expression, which decides which candidates are spans. Base spans always stay.

A text is read once. What is kept of it are its spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import cut, table

#: In Java's dialect. Possessive repeats and the look behind change no match: they keep long runs from being tried again.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: Kinds that the method adds. The first group that matches names the kind.
MORE = {
    "masked_email": r"[A-Za-z0-9._-]{1,64}\s?[\[(](?:at|AT)[\])]\s?[A-Za-z0-9-]{1,64}(?:\s?(?:[\[(](?:dot|DOT)[\])]|\.)\s?[A-Za-z0-9-]{1,64}){1,4}",
    "secret": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?:password|passwd|pwd|secret|token|api_key|apikey)\s?[=:]\s?\S{6,}+",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?:\([0-9]{3}\)\s?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
    "person": r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?",
}
CANDIDATE = r"(?:\G|(?<![\p{L}0-9_+]))(?:" + "|".join(MORE.values()) + ")"
KINDS = [*BASE, *MORE]
CUES = r"(?i)(?:e-?mails?|mail|contact|kontakt|correo|courriel|write to|tel|phone|telefon|téléphone|teléfono|call|mobile|fax|ip|address|adresse|host|login|card|visa|mastercard|karte|carte|tarjeta|account|konto|iban|ssn|social security|password|passwort|key|credentials|name|signed|from)\W{0,3}(?:\w{1,12}\W{1,3}){0,2}$"
MISLEADING = r"(?i)(?:version|v|isbn|page|pages|fig|figure|chapter|section|table|no|nr|vol|€|\$|£|order|example|e\.g)\W{0,3}$"
GAZETTEER = r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$|^\+?\(?(?:1|33|34|44|49|800|888|555)\b|^(?:AKIA|password|passwd|secret|api_?key|token)|^(?:DE|FR|ES|GB|IT|NL|AT|CH)[0-9]{2}|^(?:Mr|Mrs|Dr|Herr|Frau|Mme)\b|^(?:10|127|172|192)\.|^[45][0-9]{3}"
VOTES = ["strict", "gazetteer", "context", "misleading", "shape"]
FEATURES = ["kind", "size", "digits", "cue", "warned"]


def spans_of(text: Column, pattern: str) -> Column:
    """(start, end, match, left, right) of the matches of a pattern, in code points; left and right: the text beside them."""
    pieces = F.split(text, pattern, -1)
    rows = F.arrays_zip(pieces.alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("then"))
    kind = "array<struct<start:int,end:int,match:string,left:string,right:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, row: Column) -> Column:
        piece, found = row["piece"], row["found"]
        begin = acc["at"] + F.length(piece)
        end = begin + F.coalesce(F.length(found), F.lit(0))
        one = F.struct(begin.alias("start"), end.alias("end"), found.alias("match"), F.right(piece, F.lit(40)).alias("left"), F.left(row["then"], F.lit(20)).alias("right"))
        return F.struct(end.alias("at"), F.when(found.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], one)).alias("out"))

    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""

    def one(d: Column, i: Column) -> Column:
        d = d.cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.split(F.reverse(number), ""), one), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """The check of a base kind."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(match, r"\."), lambda p: F.right(p, F.lit(9)).cast("int") <= 255)
    n = F.length(digits(match))
    if kind == "card":
        return n.between(16, 19) & luhn(digits(match))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


#: A text without these has no span of the kind; they are cheaper than the pattern.
HINTS = {"email": r"@[A-Za-z0-9-]+\.", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}


def base_spans(kind: str) -> Column:
    none = F.array().cast("array<struct<start:int,end:int,match:string,left:string,right:string>>")
    text = F.col("text")
    hint = text.rlike(HINTS[kind])
    if kind in ("email", "phone"):
        hint = text.contains("@" if kind == "email" else "+") & hint
    return F.when(hint, F.filter(spans_of(text, BASE[kind]), lambda s: passes(kind, s["match"]))).otherwise(none)


def judged(kind: Column, span: Column, strict: Column) -> Column:
    """A span with its votes (1, 0 or null) and features."""
    match, left = span["match"], span["left"]
    number = F.length(digits(match))
    size = F.length(match)
    cue, warned = left.rlike(CUES), left.rlike(MISLEADING)
    part = number / size
    return F.struct(
        span["start"].alias("start"),
        span["end"].alias("end"),
        kind.alias("kind"),
        F.when(strict, 1).otherwise(0).alias("strict"),
        F.when(match.rlike(GAZETTEER), 1).alias("gazetteer"),
        F.when(cue, 1).alias("context"),
        F.when(warned, 0).alias("misleading"),
        F.when(F.col("text").isNull(), 0).when(span["right"].rlike(r"^[\p{L}0-9_]"), 0).when(size >= 8, 1).alias("shape"),
        F.least(F.floor(F.log2(size.cast("double"))), F.lit(7)).cast("int").alias("size"),
        F.floor(part * 3).cast("int").alias("digits"),
        cue.cast("int").alias("cue"),
        warned.cast("int").alias("warned"),
    )


def judged_base(kind: str) -> Column:
    return F.transform(base_spans(kind), lambda s: judged(F.lit(kind), s, F.lit(True)))


def candidate_kind(match: Column) -> Column:
    out = F.lit("other")
    for kind, pattern in reversed(MORE.items()):
        out = F.when(match.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def strict_more(match: Column) -> Column:
    """Format checks of the added kinds."""
    ssn = match.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    secret = match.rlike(r"^AKIA") | match.rlike(r"(?i)^(?:password|passwd|pwd|secret|token|api_?key)\s?[=:]\s?(?=\S*[0-9])(?=\S*[A-Za-z])\S{8,}$")
    return ssn | secret | match.rlike(r"[\[(](?:at|AT)[\])]") | match.rlike(r"^\([0-9]{3}\)\s?[2-9][0-9]{2}-[0-9]{4}$") | match.rlike(r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,}") | match.rlike(r"^(?:Mr|Mrs|Dr|Herr|Frau)\.?\x20\p{Lu}\p{Ll}+\x20\p{Lu}")


def found_in(docs: DataFrame) -> DataFrame:
    """docs without text, with base (spans by kind, in order) and more (candidates clear of base spans), each with votes and features."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    spans = F.concat(*(judged_base(k) for k in BASE))
    wide = F.when(F.col("text").rlike(CANDIDATE), spans_of(F.col("text"), CANDIDATE)).otherwise(F.array().cast("array<struct<start:int,end:int,match:string,left:string,right:string>>"))
    more = F.transform(wide, lambda s: judged(candidate_kind(s["match"]), s, strict_more(s["match"])))
    both = cut(docs.select("*", spans.alias("base"), more.alias("more")).drop("text"))
    clear = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return both.withColumn("more", F.when(F.size("more") > 0, clear).otherwise(F.col("more")))


def estimate(counts: list[tuple[dict, int]], rounds: int = 60) -> list[float]:
    """Probability of each pattern by expectation-maximisation; counts: votes and kind of a pattern, and how many spans have it.

    Each labeler that votes has a chance of voting 1 for either truth, with a prior in its favour; that it abstains tells
    nothing. Each kind has a share of true spans. Base spans, which have passed their checks, are known to be true.
    """
    p = []
    for row, _ in counts:
        votes = [row[v] for v in VOTES if row[v] is not None]
        p.append((sum(votes) + 1) / (len(votes) + 2))
    for _ in range(rounds):
        chance = {}
        for v in VOTES:
            for truth in (0, 1):
                n = {1: 0.5 + 2 * truth, 0: 2.5 - 2 * truth}
                for (row, c), q in zip(counts, p, strict=True):
                    if row[v] is not None:
                        n[row[v]] += c * (q if truth else 1 - q)
                total = sum(n.values())
                chance[v, truth] = {k: x / total for k, x in n.items()}
        share = {}
        for (row, c), q in zip(counts, p, strict=True):
            a, b = share.get(row["kind"], (1.0, 1.0))
            share[row["kind"]] = (a + c * q, b + c * (1 - q))
        for i, (row, _) in enumerate(counts):
            if row["kind"] in BASE:
                p[i] = 1.0
                continue
            a, b = share[row["kind"]]
            z = math.log(a / b) + sum(math.log(chance[v, 1][row[v]] / chance[v, 0][row[v]]) for v in VOTES if row[v] is not None)
            p[i] = 1 / (1 + math.exp(-max(-30, min(30, z))))
    return p


def classifier(counts: list[tuple[dict, int]], p: list[float], rounds: int = 400) -> dict[tuple[str, object], float]:
    """Weights of a logistic regression from the features (one weight for each value) to the probabilities."""
    weights: dict[tuple[str, object], float] = {("bias", 1): 0.0}
    seen: dict[tuple[str, object], float] = {}
    total = sum(c for _, c in counts) or 1
    names = [[("bias", 1), *((f, row[f]) for f in FEATURES), *((v, row[v]) for v in VOTES)] for row, _ in counts]
    for _ in range(rounds):
        grad: dict[tuple[str, object], float] = {}
        for (_, c), q, own in zip(counts, p, names, strict=True):
            z = sum(weights.get(k, 0.0) for k in own)
            d = c / total * (q - 1 / (1 + math.exp(-max(-30, min(30, z)))))
            for k in own:
                grad[k] = grad.get(k, 0.0) + d
        for k, g in grad.items():
            g -= 1e-4 * weights.get(k, 0.0)
            seen[k] = seen.get(k, 1e-8) + g * g
            weights[k] = weights.get(k, 0.0) + 0.3 * g / math.sqrt(seen[k])
    return weights


def score(span: Column, weights: dict[tuple[str, object], float]) -> Column:
    """The classifier as an expression."""
    out = F.lit(weights[("bias", 1)])
    for name in (*FEATURES, *VOTES):
        term = F.lit(0.0)
        for (k, value), w in sorted(weights.items(), key=str):
            if k == name:
                term = F.when(span[name].isNull() if value is None else span[name] == F.lit(value), F.lit(w)).otherwise(term)
        out = out + term
    return 1 / (1 + F.exp(-out))


def personal_data(docs: DataFrame) -> DataFrame:
    """docs without text, with base and spans: (kind, start, end) in order of kind, then start; spans holds base and what the method adds.

    Null text is empty. The other columns stay; those named base, more or spans are replaced.
    """
    found = found_in(docs.drop("base", "more", "spans"))
    patterns = found.select(F.explode(F.concat("base", "more")).alias("s")).select("s.*").groupBy(*FEATURES, *VOTES).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = sorted(((r.asDict(), r["n"]) for r in patterns), key=lambda x: str(sorted(x[0].items(), key=str)))
    weights = classifier(counts, estimate(counts))
    more = F.filter("more", lambda s: score(s, weights) >= 0.5)
    place = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    all_spans = F.array_sort(F.transform(F.concat("base", more), lambda s: F.struct(F.element_at(place, s["kind"]).alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    plain = lambda x: F.transform(x, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.withColumn("spans", plain(all_spans)).withColumn("base", plain("base")).drop("more")


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(of_kind("base", k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
