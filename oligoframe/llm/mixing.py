"""Mixing sources to target weights by Pareto order sampling.

Each document of a source is expected in c copies: c grows with the document's size class (its size's power of two, to the
``LEAN``), is 2 at most, and is scaled so that all expected words of the source are its target. floor(c) copies are certain;
the rest, p = c - floor(c), is the document's inclusion probability, which differs by size class. Documents are ranked by
their random odds u / (1 - u) over their inclusion odds p / (1 - p): those of the smallest ranks are taken until the words
that the certain copies leave open are reached. u comes from a digest of a seed and the id, so that reruns agree.

The scale is found from one row for each source and size class. How far down the ranking a source goes is found without
sorting a source in one task: words are summed by source and the first 16 bits of the rank's place, and only the bin where
the target falls is looked at rank by rank. The outcome is a row for each source and size class with the largest rank taken;
documents are compared with it by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import cut, fresh, table

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2.0, "mix-1"
LEAN = 0.25
BINS = 1 << 16
_UNIT = float(1 << 48)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_odds(ident: Column, seed: str = SEED) -> Column:
    """u / (1 - u) for a u in (0, 1) that depends on the seed and the id alone."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary")), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / _UNIT
    return u / (1 - u)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): share of all sizes, split by weights that repeat along the sources.

    A target stops at ``most`` times its source's size and the excess goes to the others by weight: sources sorted by size
    over weight are capped while the level that the rest would get lies above their cap. One row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", "place")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") - 1) % len(weights) + 1))
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("room", F.col("cap") / F.col("weight"))
    )
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("level", level)
    free = F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "place", "level"))).over(everything)["level"]
    return leveled.withColumn("free", free).select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("free")), F.col("cap")).cast("double").alias("target"))


def rank(odds: Column, p: Column) -> Column:
    """Pareto rank mapped to [0, 1), in the same order."""
    q = odds * (1 - p) / p
    return q / (1 + q)


def size_class(size: Column) -> Column:
    """The power of two in a size; null for none."""
    return F.when(size > 0, F.length(F.bin(size)) - 1)


def expected(classes: DataFrame, most: float, lean: float) -> DataFrame:
    """classes (source, class, words, target) with the copies that each document of a class is expected in.

    Copies are weight times one level for a source, ``most`` at most: classes sorted by weight are capped while the level that
    the rest would get lies above their cap. A row for each source and class, of which a source has 64 at most.
    """
    weight = F.pow(F.lit(2.0), F.col("class") * lean)
    everything = Window.partitionBy("source")
    before = everything.orderBy(F.col("class").desc()).rowsBetween(Window.unboundedPreceding, -1)
    weighed = F.col("words") * F.col("weight")
    left = F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0))
    level = left / (F.sum(weighed).over(everything) - F.coalesce(F.sum(weighed).over(before), F.lit(0.0)))
    leveled = classes.withColumn("weight", weight).withColumn("level", level)
    free = F.max(F.when(F.col("level") * F.col("weight") <= most, F.struct("class", "level"))).over(everything)["level"]
    return leveled.withColumn("copies", F.round(F.coalesce(F.least(F.lit(most), F.col("weight") * free), F.lit(most)), 9)).drop("weight", "level")


def plan(sized: DataFrame, lean: float = LEAN, most: float = MOST, **shares) -> DataFrame:
    """A row for each source and size class: source_size, target, certain copies, p, and the source's largest rank taken (null: none).

    sized: source, size, odds.
    """
    classes = cut(sized.groupBy("source", size_class(F.col("size")).alias("class")).agg(F.sum("size").cast("long").alias("words")))
    by_source = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), most=most, **shares).withColumnRenamed("source", "_source")
    known = classes.join(by_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    some = expected(known.filter("class is not null"), most, lean).withColumn("certain", F.floor("copies")).withColumn("p", F.col("copies") - F.col("certain"))
    some = some.withColumn("open", F.col("target") - F.sum(F.col("certain") * F.col("words")).over(Window.partitionBy("source")))
    none = known.filter("class is null").select("*", *(F.lit(0.0).alias(c) for c in ("copies", "certain", "p", "open")))
    by_class = cut(some.select(none.columns).union(none))
    of = by_class.select(F.col("source").alias("_source"), F.col("class").alias("_class"), "p", "open")
    ranked = (
        sized.join(of, F.col("source").eqNullSafe(F.col("_source")) & (size_class(F.col("size")) == F.col("_class")))
        .filter("p > 0 and size > 0")
        .select("source", "size", "open", rank(F.col("odds"), F.col("p")).alias("rank"))
        .withColumn("bin", F.floor(F.col("rank") * BINS).cast("int"))
    )
    bins = ranked.groupBy("source", "open", "bin").agg(F.sum("size").alias("size"))
    down = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    # The bin where the running sum reaches what is open; where rounding leaves it short, the last bin.
    last = Window.partitionBy("source").orderBy(F.col("reached").desc(), F.when(F.col("reached"), F.col("bin")).otherwise(-F.col("bin")))
    edge = (
        bins.withColumn("to", F.sum("size").over(down))
        .withColumn("reached", F.col("to") >= F.col("open"))
        .withColumn("n", F.row_number().over(last))
        .filter("n = 1")
        .select(F.col("source").alias("_source"), F.col("bin").alias("_bin"), (F.col("to") - F.col("size")).alias("base"))
    )
    inside = ranked.join(edge, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bin") == F.col("_bin"))).groupBy("source", "open", "base", "bin", "rank").agg(F.sum("size").alias("size"))
    here = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    taken = F.col("base") + F.sum("size").over(here) - F.col("size") / 2 <= F.col("open")  # the nearer of with and without it
    cuts = (
        inside.withColumn("taken", taken)
        .groupBy("source", "bin")
        .agg(F.max(F.when(F.col("taken"), F.col("rank"))).alias("within"))
        .select(F.col("source").alias("_source"), F.coalesce("within", F.col("bin") / F.lit(float(BINS)) - 1e-18).alias("last_rank"))
    )
    return by_class.join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source", "open", "copies", "words")


def mix(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """docs with size (words), source_size, target, copies and taken (size times copies).

    Null texts and texts without words have size 0 and are never taken. A null source is a source, the last one. Rows that
    share an id share its random odds, and each counts. Texts of any length are counted whole. Columns of docs named like a
    new one are replaced; others may have any name.
    """
    new = ("size", "source_size", "target", "copies", "taken")
    docs = docs.drop(*new)
    sized = docs.withColumn("size", words(F.col("text")))
    narrow = cut(sized.select("doc_id", "source", "size"))
    origin, kind, found = fresh(sized, "origin", "kind", "found")
    chosen = plan(narrow.withColumn("odds", random_odds(F.col("doc_id"), seed)), **shares)
    chosen = cut(chosen.select(F.col("source").alias(origin), F.col("class").alias(kind), F.struct("source_size", "target", "certain", "p", "last_rank").alias(found)))
    base = narrow if {c.lower() for c in docs.columns} <= {"doc_id", "source", "text"} else sized
    of = lambda name: F.col(found)[name]
    extra = F.when((of("p") > 0) & (rank(random_odds(F.col("doc_id"), seed), of("p")) <= of("last_rank")), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, of("certain") + extra).otherwise(0).cast("long")
    same = F.col("source").eqNullSafe(F.col(origin)) & size_class(F.col("size")).eqNullSafe(F.col(kind))
    joined = base.join(chosen, same, "left").select("*", of("source_size").alias("source_size"), of("target").alias("target"), copies.alias("copies"))
    return joined.withColumn("taken", F.col("size") * F.col("copies")).select(*base.columns, *(x for x in new if x not in base.columns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the mix takes, with their copies."""
    return mix(docs).filter("copies > 0")


OP6_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    (('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint::double + 0.5) / 281474976710656.0 as u
  from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select *, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight,
    row_number() over (order by source nulls last) as place, 2.0::double * source_size as cap
  from s
), l as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0)) as level
  from w
), f as (
  select *, (select arg_min(level, cap / weight) from l where level <= cap / weight) as free from l
), t as (
  select source, source_size, coalesce(least(cap, weight * free), cap)::double as target from f
), k as (
  select source, length(bin(size)) - 1 as class, sum(size)::bigint as words from d where size > 0 group by all
), m as (
  select k.*, t.target, pow(2.0::double, class * 0.25::double) as weight from k join t on k.source is not distinct from t.source
), v as (
  select *, (target - 2.0::double * coalesce(sum(words) over (partition by source order by class desc rows between unbounded preceding and 1 preceding), 0))
    / (sum(words * weight) over (partition by source)
      - coalesce(sum(words * weight) over (partition by source order by class desc rows between unbounded preceding and 1 preceding), 0)) as level
  from m
), e as (
  select *, round(coalesce(least(2.0::double, weight * arg_max(level, class) filter (level * weight <= 2) over (partition by source)), 2), 9) as c from v
), c as (
  select *, c - floor(c) as p, floor(c) as certain, target - sum(floor(c) * words) over (partition by source) as open from e
), q as (
  select d.*, t.source_size, t.target, c.certain, c.p, c.open, u / (1 - u) * (1 - c.p) / nullif(c.p, 0) as q
  from d join t on d.source is not distinct from t.source
    left join c on d.source is not distinct from c.source and d.size > 0 and length(bin(d.size)) - 1 = c.class
), r as (
  select *, sum(case when p > 0 then size else 0 end) over (partition by source order by q / (1 + q) nulls last rows between unbounded preceding and current row) as upto from q
), x as (
  select *, case when size > 0 then certain + (case when p > 0 and upto - size / 2.0 <= open then 1 else 0 end) else 0 end as n from r
)
select doc_id, source, size, source_size, target, n::bigint as copies, (size * n)::bigint as taken from x
"""
