"""Operators of the engine on hand-made cases, and regression tests of known pitfalls."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from oligoframe import Filter, generate, validate
from oligoframe.config import batch_size, check_paired, distance_method
from oligoframe.functions import bounds
from oligoframe.functions import sequence as S
from oligoframe.operators.selection import greedy_select, rejected
from oligoframe.operators.similarity import anti_join, first_violation, self_join
from oligoframe.plans.generate import check_arguments, split_pairs
from oligoframe.plans.report import render
from oligoframe.sources.random import random_list
from oligoframe.sources.text import check_paired as check_sides
from oligoframe.sources.text import from_dataframe, read_paired_seeds, read_sequences, write_list

F0 = Filter()


def rows(spark, seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id long, seq string")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def dist(a, b):
    return sum(x != y for x, y in zip(a, b)) if len(a) == len(b) else levenshtein(a, b)


def greedy(seqs, d):
    out = []
    for s in seqs:
        if all(dist(s, t) >= d for t in out):
            out.append(s)
    return out


def some(n, lengths, seed, letters="ATGC"):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.choice(lengths))) for _ in range(n)]


def test_reading(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ATGC\r\n  GGCC \n\nxyz\nATTA")
    (tmp_path / "b.txt").write_bytes(b"TTTT\nCC\tA\natgc\nATGN\n")
    (tmp_path / "c.txt").write_bytes(b"")
    paths = [str(tmp_path / f) for f in ("a.txt", "b.txt", "c.txt")]
    found = read_sequences(spark, paths)
    assert [(r["id"], r["seq"]) for r in found.sequences.orderBy("id").collect()] == [(0, "ATGC"), (1, "GGCC"), (2, "ATTA"), (3, "TTTT")]
    assert sorted((r["file"][-5], r["line"], r["value"]) for r in found.rejects.collect()) == [("a", 4, "xyz"), ("b", 2, "CC\tA"), ("b", 3, "atgc"), ("b", 4, "ATGN")]
    assert [tuple(r) for r in found.length_histogram().collect()] == [(4, 4)]
    assert not found.has_mixed_lengths()
    with pytest.raises(ValueError):
        read_sequences(spark, paths[2])
    with pytest.raises(ValueError):
        read_sequences(spark, [*paths, str(tmp_path / "none.txt")])
    write_list(found.sequences, str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["ATGC", "GGCC", "ATTA", "TTTT"]
    assert from_dataframe(found.rejects.union(found.rejects), "value").sequences.count() == 0


def test_composition(spark):
    cases = {
        "ATGCATGCATGC": S.PASSES,
        "AATTAATTGGCC": S.GC_REASON,
        "AAATGCGCATGC": S.RUN_REASON,
        "AAAATTTTAAAA": f"{S.GC_REASON}; {S.RUN_REASON}",
        "GCGCATATAT": S.PASSES,
        "GCGCGCATAT": S.PASSES,
        "GCGCGCGATA": S.GC_REASON,
    }
    got = rows(spark, list(cases)).select("seq", S.reasons(F.col("seq"), F0).alias("r"), S.longest_run(F.col("seq")).alias("run"))
    assert {r["seq"]: r["r"] for r in got.collect()} == cases


def test_distances_and_codes(spark):
    cases = [("ATGCATGC", "TGCATGCA", 8), ("ATGCATGC", "ATGCATG", 1), ("ATGCATGC", "ATGCAT", 2), ("ATGCATGC", "ATGCA", 3), ("AAAA", "CCCCC", 5), ("AAAAAA", "AAATTT", 3), ("ATGCATGC", "ATGCATGC", 0)]
    long = ("ATGC" * 20, "ATGC" * 19 + "TTGC", 1)
    df = spark.createDataFrame([*cases, long], "a string, b string, d int")
    got = df.select("d", S.distance(F.col("a"), F.col("b")).alias("x"), S.closer(F.col("a"), F.col("b"), 3).alias("near"), S.decode(S.encode(F.col("a"))).alias("back"), "a").collect()
    assert all(r["d"] == r["x"] and r["near"] == (r["d"] < 3) and r["back"] == r["a"] for r in got)


@pytest.mark.parametrize(("lengths", "d", "letters"), [([8], 3, "ATGC"), ([6, 7, 8], 3, "ATGC"), ([5, 9], 2, "ATGC"), ([1, 2, 3, 6], 4, "ATGC"), ([7], 1, "AT"), ([9, 10, 11], 5, "ATGC"), ([33, 34], 4, "AT")])
@pytest.mark.parametrize("strategy", ["blocks", "nested", "auto"])
def test_joins_equal_brute_force(spark, lengths, d, letters, strategy):
    if strategy == "blocks" and min(lengths) < d:
        pytest.skip("strings shorter than d have no d segments")
    seqs = some(90, lengths, 5, letters) + ["ATATATATA"[: lengths[0]]] * 2
    pairs = {(i, j): dist(a, b) for (i, a), (j, b) in itertools.combinations(enumerate(seqs), 2) if dist(a, b) < d}
    got = self_join(rows(spark, seqs), d, strategy).collect()
    assert len(got) == len(pairs) and {(r["i"], r["j"]): r["distance"] for r in got} == pairs
    pool = some(60, lengths, 9, letters)
    left = anti_join(rows(spark, seqs), rows(spark, pool), d, strategy)
    assert sorted(r["id"] for r in left.collect()) == [i for i, s in enumerate(seqs) if all(dist(s, t) >= d for t in pool)]


def test_first_violation_counts_pairs(spark):
    seqs = ["AAAAAA", "TTTTTT", "GGGGGG", "TTTTTA"]
    row = first_violation(self_join(rows(spark, seqs), 3), 4).first()
    assert (row["i"], row["j"], row["distance"], row["pairs_checked"]) == (1, 3, 1, 5)


@pytest.mark.parametrize("residue", [0, 5, 100_000])
def test_greedy_equals_scan(spark, residue):
    seqs = some(150, [6], 3)
    df = rows(spark, seqs)
    gone = {r["id"] for r in rejected(self_join(df, 3), residue).collect()}
    assert [s for i, s in enumerate(seqs) if i not in gone] == greedy(seqs, 3)
    assert [r["seq"] for r in greedy_select(rows(spark, ["AAAAAA", "AAAAAT", "AAATTT"]), 3).orderBy("id").collect()] == ["AAAAAA", "AAATTT"]
    assert [r["seq"] for r in greedy_select(rows(spark, ["AAAAAT", "AAAAAA", "AAATTT"]), 3).collect()] == ["AAAAAT"]
    assert greedy_select(df, 3, 4).count() == 4


def test_generate(spark):
    whole = [r["seq"] for r in generate(spark, 60, 8, F0, "x").sequences.orderBy("id").collect()]
    parts = [r["seq"] for r in generate(spark, 60, 8, F0, "x", chunk=150).sequences.orderBy("id").collect()]
    assert whole == parts and len(whole) == 60
    assert validate(spark.createDataFrame([(s,) for s in whole], "seq string"), F0).overall_valid
    seeds = rows(spark, ["ATGCATGC", "ATGCATGA", "ATGCAT"])
    grown = generate(spark, 20, 8, F0, "x", seeds).sequences.orderBy("id").collect()
    assert [r["seq"] for r in grown[:3]] == ["ATGCATGC", "ATGCATGA", "ATGCAT"] and len(grown) == 23
    assert all(dist(r["seq"], s["seq"]) >= 3 for r in grown[3:] for s in grown if s["id"] != r["id"])


def test_generate_stops_when_full(spark):
    made = generate(spark, 1000, 4, F0, "x")
    assert not made.complete and 0 < made.sequences.count() < 30


def test_repeats_are_violations_whatever_the_size(spark):
    result = validate(spark.createDataFrame([("ATGCATGC",), ("ATGCATGC",)], "seq string"), Filter(min_distance=1))
    assert not result.overall_valid and result.distance_violation == (1, 2, "ATGCATGC", "ATGCATGC", 0)


def test_validate_and_report(spark):
    result = validate(rows(spark, ["ATGCATGC", "AAAAAAAA", "ATGCATGG"]), F0)
    assert (result.total_sequences, result.biological_passed, result.biological_failed) == (3, 2, 1)
    assert result.distance_violation == (1, 2, "ATGCATGC", "ATGCATGG", 1) and result.validation_method == "pairwise_sequential"
    text = render(result, F0, ["x"])
    assert "Line 2: AAAAAAAA - GC content outside range; Homopolymer run too long" in text and "VALIDATION FAILED!" in text
    skipped = validate(rows(spark, ["ATGCATGC", "ATGCATGG"]), F0, skip_distance=True)
    assert skipped.overall_valid and skipped.validation_method == "skipped" and "All barcodes are valid!" in render(skipped, F0, ["x"])


def test_empty_list(spark):
    empty = spark.createDataFrame([], "id long, seq string")
    assert self_join(empty, 3).count() == 0 and greedy_select(empty, 3).count() == 0 and anti_join(empty, empty, 3).count() == 0
    assert validate(empty, F0).total_sequences == 0


def test_pairs(spark):
    out = split_pairs(rows(spark, some(10, [8], 1))).collect()
    assert sorted((r["pair_id"], r["side"]) for r in out) == [(i, k) for i in range(5) for k in (1, 2)]


def test_paired_seed_files(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    a, b, c, e = put("a", "ATGC\nGGCC\n"), put("b", "TTTT\nAAAA\n"), put("c", "TTTT\n"), put("e", "TTTTA\nAAAAA\n")
    assert [(r["id"], r["side"]) for r in read_paired_seeds(spark, a, b).orderBy("id").collect()] == [(0, 1), (1, 1), (2, 2), (3, 2)]
    for other in (c, e, put("f", "TTTT\nAAA\n")):
        with pytest.raises(ValueError):
            read_paired_seeds(spark, a, other)
    check_sides(spark.createDataFrame([], "side int, seq string"))


def test_settings():
    for bad in ({"gc_min": 0.6, "gc_max": 0.6}, {"gc_min": -0.1}, {"gc_max": 1.1}, {"homopolymer_max": 0}, {"min_distance": 0}):
        with pytest.raises(ValueError):
            Filter(**bad)
    for n, d, mixed, method in ((9999, 3, False, "pairwise_sequential"), (9999, 9, True, "pairwise_sequential"), (10000, 3, True, "pairwise"), (10000, 5, False, "pairwise"), (10000, 4, False, "neighbor_enumeration")):
        assert distance_method(n, d, mixed) == method
    assert [batch_size(n) for n in (100, 1000, 10_000, 10_001)] == [50, 100, 1000, 10_000]
    assert [(bounds.gv_bound(n, 3), bounds.hamming_bound(n, 3)) for n in (6, 8, 10, 12, 16)] == [(26, 215), (236, 2621), (2404, 33825), (26588, 453438), (3804222, 87652393)]
    for args in ((1, 0), (0, 8), (1, 2), (216, 6)):
        with pytest.raises(ValueError):
            check_arguments(*args, F0)
    with pytest.raises(ValueError):
        check_arguments(1, 8, Filter(homopolymer_max=8))
    assert check_arguments(1, 8, Filter(homopolymer_max=8), strict=False) == []
    with pytest.raises(ValueError):
        check_arguments(1, 3, F0)
    with pytest.raises(ValueError):
        check_arguments(120, 6, F0, paired=True)  # 240 are made
    for bad in ((True, None, "a", None), (True, ["s"], None, None), (False, None, "a", "b")):
        with pytest.raises(ValueError):
            check_paired(*bad)


def test_random_list(spark):
    got = random_list(spark, 200, [8, 12], "1").collect()
    assert len(got) == 200 and {len(r["seq"]) for r in got} == {8, 12}
    for bad in ((0, [8]), (5, [0]), (100, [2])):
        with pytest.raises(ValueError):
            random_list(spark, *bad)


def test_ball(spark):
    got = S.hamming_ball(rows(spark, ["ATGCAT"]), 1)
    assert got.count() == 19 and S.hamming_ball(rows(spark, ["ATGCAT"]), 0).count() == 1
    with pytest.raises(ValueError):
        S.hamming_ball(rows(spark, ["ATGCAT"]), 3)


def test_command_line(spark, tmp_path, capsys):
    from oligoframe.cli import main

    out = str(tmp_path / "out")
    assert main(["generate", "--count", "30", "--length", "8", "--output-dir", out]) == 0
    assert len((tmp_path / "out" / "barcodes.txt").read_text().split()) == 30
    assert main(["validate", "--input", f"{out}/barcodes.txt", "--output-dir", out]) == 0
    assert main(["generate", "--count", "10", "--length", "8", "--paired", "--output-dir", out]) == 0
    assert [len((tmp_path / "out" / f"barcodes_paired{k}.txt").read_text().split()) for k in (1, 2)] == [10, 10]
    (tmp_path / "bad.txt").write_text("ATGCATGC\nATGCATGC\n")
    assert main(["validate", "--input", str(tmp_path / "bad.txt"), "--output-dir", out]) == 1
    assert main(["--version"]) == 0 and main([]) == 0 and main(["x"]) == 2


def test_streaming_screen(spark, tmp_path):
    from oligoframe.streaming.screen import screen

    rows(spark, ["ATGCATGC", "GCATGCAT", "AAAAAAAA"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, seq string").parquet(str(tmp_path / "in"))
    screen(stream, rows(spark, ["ATGCATGA"]), F0, str(tmp_path / "sink"), str(tmp_path / "cp")).awaitTermination(60)
    assert [r["seq"] for r in spark.read.parquet(str(tmp_path / "sink")).collect()] == ["GCATGCAT"]


def test_blocks_are_an_equi_join(spark):
    plan = self_join(rows(spark, some(50, [12], 2)), 3, "blocks")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Python" not in plan
