"""Column expressions on DNA strings. All are built-in expressions; none runs Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Filter

#: Fixed order of the codes: A 0, T 1, G 2, C 3.
BASES = "ATGC"
WORD = 31  # bases in a signed 64-bit word
GC_REASON, RUN_REASON, PASSES = "GC content outside range", "Homopolymer run too long", "Passes all filters"


def code(seq: Column) -> Column:
    """Two bits a base in one LONG, for at most 31 bases."""
    return F.conv(F.translate(seq, BASES, "0123"), 4, 10).cast("bigint")


def codes(seq: Column) -> Column:
    """Words of 31 bases, for any length."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(seq) - 1) / WORD).cast("int")), lambda i: code(F.substring(seq, i * WORD + 1, F.lit(WORD))))


def word(seq: Column) -> Column:
    """The code below a leading 1, which tells lengths apart, in one LONG; for at most 31 bases."""
    return F.conv(F.concat(F.lit("1"), F.translate(seq, BASES, "0123")), 4, 10).cast("bigint")


def without(word: Column, place: Column | int) -> Column:
    """A word with one base, counted from the last, taken out."""
    n = (2 * place if isinstance(place, Column) else F.lit(2 * place)).cast("int")
    head = F.call_function("shiftleft", F.call_function("shiftright", word, n + 2), n)
    return head.bitwiseOR(word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), n) - 1))


def encode(seq: Column) -> Column:
    """Array of base codes."""
    return F.transform(F.split(seq, ""), lambda x: (F.instr(F.lit(BASES), x) - 1).cast("tinyint"))


def decode(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda x: F.substring(F.lit(BASES), x.cast("int") + 1, F.lit(1))), "")


def decode_word(word: Column, length: Column) -> Column:
    return F.translate(F.lpad(F.conv(word.cast("string"), 10, 4), length, "0"), "0123", BASES)


def gc_fraction(seq: Column) -> Column:
    return (F.length(seq) - F.length(F.translate(seq, "GC", ""))).cast("double") / F.length(seq)


def gc_ok(seq: Column, low: float, high: float) -> Column:
    """Both ends belong to the range."""
    return gc_fraction(seq).between(F.lit(float(low)), F.lit(float(high)))


def longest_run(seq: Column) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(seq, F.lit("(A+|T+|G+|C+)"), F.lit(1)), lambda x: F.length(x)))


def run_ok(seq: Column, most: int) -> Column:
    m = most + 1
    return ~seq.rlike("|".join(f"{b}{{{m},}}" for b in BASES))


def passes(seq: Column, f: Filter) -> Column:
    return gc_ok(seq, f.gc_min, f.gc_max) & run_ok(seq, f.homopolymer_max)


def reasons(seq: Column, f: Filter) -> Column:
    """All checks that fail, or the text for none."""
    found = F.concat_ws("; ", F.when(~gc_ok(seq, f.gc_min, f.gc_max), GC_REASON), F.when(~run_ok(seq, f.homopolymer_max), RUN_REASON))
    return F.when(found == "", PASSES).otherwise(found)


def differing(a: Column, b: Column) -> Column:
    """Bases in which two codes, or two words of one length, differ."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def hamming(a: Column, b: Column) -> Column:
    """Hamming distance of strings of one length: a population count for up to 31 bases, word by word beyond."""
    long = F.aggregate(F.zip_with(codes(a), codes(b), differing), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) <= WORD, differing(code(a), code(b))).otherwise(long).cast("int")


def distance(a: Column, b: Column) -> Column:
    """Hamming distance between equal lengths, Levenshtein distance between others."""
    return F.when(F.length(a) == F.length(b), hamming(a, b)).otherwise(F.levenshtein(a, b))


def closer(a: Column, b: Column, d: int) -> Column:
    """Whether the distance is below d; Levenshtein stops early."""
    return F.when(F.length(a) == F.length(b), hamming(a, b) < d).otherwise(F.levenshtein(a, b, d - 1) >= 0)


def derive(text: Column, length: int) -> Column:
    """A string of bases that depends on a text alone: hexadecimal digits of MD5 digests, two bits of each."""
    blocks = [F.md5(text.cast("binary"))] + [F.md5(F.concat(text, F.lit(f"#{i}")).cast("binary")) for i in range(1, -(-length // 32))]
    return F.substring(F.translate(F.concat(*blocks), "0123456789abcdef", BASES * 4), 1, length)


def hamming_ball(df: DataFrame, radius: int, seq: str = "seq") -> DataFrame:
    """df with a row for each distinct string within the radius of seq, itself included (column neighbor). radius: at most 2."""
    if not 0 <= radius <= 2:
        raise ValueError("hamming_ball takes a radius of 0, 1 or 2; use a similarity join beyond")
    out = df.withColumn("neighbor", F.col(seq))
    for _ in range(radius):
        step = F.flatten(
            F.transform(F.sequence(F.lit(1), F.length("neighbor")), lambda i: F.transform(F.split(F.lit(BASES), ""), lambda b: F.concat(F.substring("neighbor", F.lit(1), i - 1), b, F.substring(F.col("neighbor"), i + 1, F.length("neighbor")))))
        )
        out = out.withColumn("neighbor", F.explode(F.array_distinct(step)))
    return out.distinct()
