from pyspark.sql import functions as F

from vecflow.sources.generate import generate_vectors, uniform_draws


def test_block_structure_inclusive(spark):
    # blocks=2 gives ids 0..2 (three blocks), as the reference's `0 to blocks`.
    df = generate_vectors(spark, blocks=2, block_size=3, multiplier=5, nodes=1, cores=2, nparts=2)
    assert df.count() == 3 * 3 * 5
    per = {(r.block_id, r.matrix_id): r.n for r in df.groupBy("block_id", "matrix_id").agg(
        F.count("*").alias("n")).collect()}
    assert set(per) == {(b, m) for b in range(3) for m in range(3)}
    assert set(per.values()) == {5}
    assert df.rdd.getNumPartitions() == 4  # nodes * cores * nparts


def test_exclusive_blocks(spark):
    df = generate_vectors(spark, blocks=2, block_size=1, multiplier=4, inclusive=False)
    assert df.select("block_id").distinct().count() == 2


def test_wrapped_block_dims(spark):
    # reference test: generate(1, 10, 16384) -> 10 matrices of 16384 x 3
    df = generate_vectors(spark, blocks=0, block_size=10, multiplier=16384, num_partitions=8)
    counts = df.groupBy("matrix_id").count().collect()
    assert len(counts) == 10 and all(r["count"] == 16384 for r in counts)
    assert [c for c in df.columns if c in ("x", "y", "z")] == ["x", "y", "z"]


def test_values_in_range_and_repeatable_across_partitioning(spark):
    a = generate_vectors(spark, blocks=1, block_size=2, multiplier=500, num_partitions=3)
    b = generate_vectors(spark, blocks=1, block_size=2, multiplier=500, num_partitions=7)
    assert sorted(a.collect()) == sorted(b.collect())
    stats = a.agg(*[F.min(c).alias(f"lo_{c}") for c in "xyz"], *[F.max(c).alias(f"hi_{c}") for c in "xyz"]).first()
    for c in "xyz":
        assert -1000.0 <= stats[f"lo_{c}"] and stats[f"hi_{c}"] < 1000.0
    other_seed = generate_vectors(spark, blocks=1, block_size=2, multiplier=500, num_partitions=3, seed=7)
    assert sorted(a.collect()) != sorted(other_seed.collect())


def test_distribution_hits_every_bucket(spark):
    # reference test: 10,000 draws in [-3, 3); every truncated bucket -2..2 is hit
    draws = uniform_draws(spark.range(10000), "id", -3.0, 3.0)
    buckets = {r.b for r in draws.select(F.col("u").cast("int").alias("b")).distinct().collect()}
    assert buckets == {-2, -1, 0, 1, 2}
    mean = draws.agg(F.avg("u")).first()[0]
    assert abs(mean) < 0.1


def test_exact_row_count(spark):
    df = generate_vectors(spark, blocks=1, block_size=3, multiplier=4, rows=22)
    per = {(r.block_id, r.matrix_id): r["count"] for r in df.groupBy("block_id", "matrix_id").count().collect()}
    assert per == {(0, 0): 4, (0, 1): 4, (0, 2): 4, (1, 0): 4, (1, 1): 4, (1, 2): 2}
    assert generate_vectors(spark, blocks=1, block_size=3, multiplier=1, rows=2).count() == 2
