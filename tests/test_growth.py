"""Work that must not grow with copies, heavy keys or whole groups: the larger tables' findings."""

import pytest
from pyspark.sql import functions as F

from millrace.plans import QUERIES
from millrace.sources.sequence import batch_size


def test_a_heavy_key_is_dealt_to_shares(spark, monkeypatch):
    from millrace.operators import lookups

    monkeypatch.setattr(lookups, "PAIRS", 100)
    monkeypatch.setattr(lookups, "SHARE", 10)
    rows = spark.range(300).select("id", F.when(F.col("id") < 200, 7).when(F.col("id") < 290, F.col("id") % 30 + 100).cast("long").alias("k"))
    entries = spark.range(60).select(F.when(F.col("id") < 50, 7).otherwise(F.col("id") + 50).cast("long").alias("k"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"))
    got = lookups.enum_lookup_spread(rows, entries, "k", {"v": -1})
    want = lookups.enum_lookup(rows, entries, "k", {"v": -1})
    assert got.columns == ["id", "k", "v"] and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select("id", "k", "v").collect()), key=repr)
    heavy = got.where("k = 7").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in heavy) == 10_000 and "__share" in got._jdf.queryExecution().optimizedPlan().toString()


def shuffled(spark):
    """Rows that all stages so far have shuffled."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_entries_of_a_heavy_key_are_repeated_in_proportion(spark, monkeypatch):
    from millrace.operators import lookups

    for name, value in (("PAIRS", 100), ("SHARE", 1), ("REPEATS", 4)):
        monkeypatch.setattr(lookups, name, value, raising=False)
    for n in (200, 800):
        rows, entries = spark.range(n).select("id", F.lit(7).alias("k")), spark.range(n).select(F.lit(7).alias("k"), F.col("id").alias("v"))
        before = shuffled(spark)
        got = lookups.enum_lookup_spread(rows, entries, "k", {"v": -1}).agg(F.count("*"), F.countDistinct(F.struct("id", "v"))).first()
        assert tuple(got) == (n * n, n * n)
        assert shuffled(spark) - before - n * n <= 10 * 2 * n  # n * n of them are those of countDistinct


def test_pairs_of_a_heavy_key_are_written_packed(spark, monkeypatch, tmp_path):
    from millrace.operators import lookups

    monkeypatch.setattr(lookups, "PAIRS", 400_000)
    monkeypatch.setattr(lookups, "SHARE", 100)
    rows = spark.range(200).select("id", F.lit(7).alias("k"))
    entries = spark.range(20_000).select(F.lit(7).alias("k"), (F.col("id") * 7_919 % 1_000_003).alias("v"))
    lookups.enum_lookup_spread(rows, entries, "k", {"v": -1}).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4_000_000
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 4_000_000


@pytest.mark.parametrize("listed", [10_000, 0])
def test_elements_at_one_point_are_one(spark, monkeypatch, listed):
    from millrace.operators import lookups

    monkeypatch.setattr(lookups, "LISTED", listed)
    met, rings = [], lookups._nearest_in_rings
    monkeypatch.setattr(lookups, "_nearest_in_rings", lambda p, k, e, n: met.append((p.count(), e.count())) or rings(p, k, e, n))
    elements = spark.range(5_000).select((5_000 - F.col("id")).alias("e"), (F.col("id") % 5 * 30).alias("x"), F.when(F.col("id") % 7 > 0, F.lit(3)).cast("long").alias("y"))
    places = spark.range(2_000).select(F.col("id").alias("p"), F.when(F.col("id") != 9, F.col("id") % 4 * 40).alias("x"), F.lit(0).cast("long").alias("y"))
    got = {r.p: (r.e, r.d2) for r in lookups.nearest(places, "p", elements, "e").collect()}
    all_e = [(5_000 - i, i % 5 * 30) for i in range(5_000) if i % 7]
    best = {k: min(((x - 40 * k) ** 2 + 9, e) for e, x in all_e) for k in range(4)}
    assert got == {p: (1, None) if p == 9 else best[p % 4][::-1] for p in range(2_000)}
    assert met == ([] if listed else [(4, 5)])


def test_plain_texts_compare_as_their_keys_do(spark):
    import itertools
    import time

    from millrace.functions import text

    few = ["", "a", "A", "aa", "aA", "Aa", "b", "ß", "ss", "SS", "é", "É", "e", "E", "æ", "Æ", "ae", "µ", "μ", "ÿ", "Ÿ", "y", "Þ", "þ", "×", "÷", "a\n", "a–b", "A–b", "İ", "ı", "ſ", "Σ", "ς", "K", "日本", "😀a", "😀A"]
    pairs = spark.createDataFrame([*itertools.product([*few, None], repeat=2)], "a string, b string")
    for lang in (0, 2):
        x, y = text.locale_key(F.col("a"), lang), text.locale_key(F.col("b"), lang)
        by_key = F.when(x < y, -1).when(x > y, 1).when(x == y, 0)
        assert pairs.select("a", "b", text.compare_folded(F.col("a"), F.col("b"), lang).alias("got"), by_key.alias("want")).where("NOT got <=> want").collect() == []
    long = spark.range(200).select(F.repeat(F.lit("Größe und Ähre "), 3_000).alias("a")).select("a", F.translate("a", "GÄ", "gä").alias("b"))
    start = time.time()
    assert [tuple(r) for r in long.select(text.compare_folded(F.col("a"), F.col("b")).alias("c")).groupBy("c").count().collect()] == [(1, 200)]
    assert time.time() - start < 15


def test_requests_of_one_start_and_target_are_one_search(spark, monkeypatch):
    from millrace.operators import searches

    sizes, cut = [], searches.cut
    monkeypatch.setattr(searches, "cut", lambda df: sizes.append(cut(df)) or sizes[-1])
    requests = spark.createDataFrame([(i if i else None, 0, 0, 3, i % 2) for i in range(200)], "request long, sx long, sy long, tx long, ty long")
    got = {r.request: (r.x, r.y, r.cost, r.found) for r in searches.grid_searches(requests, spark.createDataFrame([], "x long, y long"), 4).collect()}
    assert got == {i if i else None: (3, i % 2, 3, True) if i else (None, None, None, False) for i in range(200)}
    assert max(f.count() for f in sizes if "cost" in f.columns) <= 2 * 81


def test_a_ring_goes_on_over_bounded_batches(spark, sf_dir, monkeypatch):
    from compare import agree

    from millrace.plans import ORACLES, stateful
    from millrace.streaming import state

    sizes, run = [], state.dedupe_recent
    monkeypatch.setattr(stateful, "_HELD", 150)
    monkeypatch.setattr(stateful, "batch_size", lambda n, least, most, batches: batch_size(n, 1, most, batches))
    read = stateful.read_sequence
    monkeypatch.setattr(stateful, "read_sequence", lambda s, folder, schema: sizes.extend(r["count"] for r in s.read.parquet(folder).groupBy(F.input_file_name()).count().collect()) or read(s, folder, schema))
    agree(spark, sf_dir, QUERIES["stream_dedupe"], ORACLES["stream_dedupe"])
    assert len(sizes) > 3 and max(sizes) <= 150
