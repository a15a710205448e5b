import collections
import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from chromalyne.functions import distances, naming
from chromalyne.operators import lloyd, points, quality, seeding
from chromalyne.operators.lloyd import KMeansParams
from chromalyne.operators.paint import as_image, paint

VECTORS = [(0, 0, 0), (255, 255, 255), (1, 2, 3), (3, 2, 1), (0, 255, 7), (200, 13, 99)]


def frame(spark, cells):
    d = len(cells[0])
    return spark.createDataFrame([(i, *map(int, c)) for i, c in enumerate(cells)], "idx long, " + ", ".join(f"c{i} int" for i in range(d)))


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[20, 30, 200], [220, 40, 30], [90, 200, 90]])
    cells = np.clip(centres[rng.integers(0, 3, 240)] + rng.integers(-25, 26, (240, 3)), 0, 255)
    return frame(spark, cells.tolist()).cache(), cells.tolist()


SEEDS = [[103, 198, 105], [115, 81, 255], [74, 236, 41]]


@pytest.mark.parametrize("name", list(distances.METRICS))
def test_distances_agree_bit_for_bit(spark, name):
    pairs = list(itertools.product(VECTORS, VECTORS))
    df = spark.createDataFrame([(*a, *b, list(a), list(b)) for a, b in pairs], "a0 int, a1 int, a2 int, b0 int, b1 int, b2 int, a array<int>, b array<int>")
    columns = distances.metric(name)([F.col(f"a{i}") for i in range(3)], [F.col(f"b{i}") for i in range(3)], 1.5)
    arrays = distances.metric(name)(F.col("a"), F.col("b"), 1.5)
    got = df.select(columns.alias("x"), arrays.alias("y")).collect()
    wide = distances.ARRAYS[name](np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), 1.5)
    for (a, b), row, z in zip(pairs, got, wide):
        want = oracle.distance(name, a, b)
        assert np.float32(row["x"]) == np.float32(row["y"]) == z == want, (a, b)


def test_zero_vectors_are_far_from_themselves_under_cosine(spark):
    assert distances.ARRAYS["cosine"](np.zeros((1, 3), int), np.zeros((1, 3), int), 0)[0] == 1.0


def test_unknown_metric_and_bad_exponent():
    with pytest.raises(ValueError):
        distances.metric("nope")
    with pytest.raises(ValueError):
        distances.exponent(0)


def test_single_precision_mean_of_columns(spark):
    n = 65_795
    df = spark.createDataFrame([(255 * n, n), (10, 3)], "s long, n long")
    assert [r["m"] for r in df.select(distances.single_mean(F.col("s"), F.col("n")).alias("m")).collect()] == [254, 3]
    assert distances.single_mean_array(np.array([[255 * n]]), np.array([n])).tolist() == [[254]]


def test_constant_image_drifts_as_single_precision_does(spark):
    hist = spark.createDataFrame([(255, 255, 255, 65_795, 0)], "c0 int, c1 int, c2 int, n long, first_idx long")
    for strategy in ("local", "groupby", "conditional"):
        assert lloyd.fit_histogram(hist, [[255, 255, 255]], KMeansParams(1, 0.0, 1), strategy).prototypes == [[254, 254, 254]]


@pytest.mark.parametrize("name", list(distances.METRICS))
@pytest.mark.parametrize("strategy", ["local", "groupby", "conditional"])
def test_lloyd_matches_the_oracle(spark, cloud, name, strategy):
    df, cells = cloud
    want, old, iterations = oracle.lloyd(cells, SEEDS, name)
    got = lloyd.fit_histogram(points.histogram(df), SEEDS, KMeansParams(3, metric=name), strategy)
    assert (got.prototypes, got.label_prototypes, got.iterations) == (want, old, iterations)


def test_variants_with_equal_seeds_agree(spark, cloud):
    df, _ = cloud
    same = [lloyd.kmeans(df, KMeansParams(3), v).prototypes for v in ("k-means", "k-means old", "k-means tiled")]
    assert same[0] == same[1] == same[2]
    assert lloyd.kmeans(df, KMeansParams(3), "k-means++").prototypes == lloyd.kmeans(df, KMeansParams(3), "k-means++ reduce").prototypes
    given = lloyd.kmeans(df, KMeansParams(3), "k-means custom centroids", init_prototypes=SEEDS)
    assert given.prototypes == lloyd.fit_histogram(points.histogram(df), SEEDS, KMeansParams(3)).prototypes
    assert lloyd.kmeans(df, KMeansParams(3), "k-means pixel centroids").converged


def test_convergence_is_tested_every_few_iterations(spark, cloud):
    df, cells = cloud
    want, _, iterations = oracle.lloyd(cells, SEEDS, every=3)
    got = lloyd.fit_histogram(points.histogram(df), SEEDS, KMeansParams(3, check_every=3))
    assert (got.prototypes, got.iterations) == (want, iterations) and iterations % 3 == 0


def test_ties_go_to_the_lowest_cluster(spark):
    got = lloyd.assign(frame(spark, [(10, 0, 0)]), [[0, 0, 0], [20, 0, 0]]).first()["cid"]
    assert got == 0 == lloyd.labels_array(np.array([[10, 0, 0]]), [[0, 0, 0], [20, 0, 0]], "euclidean", 0)[0]


def test_empty_and_doubled_clusters_keep_their_prototype(spark):
    hist = points.histogram(frame(spark, [(0, 0, 0), (4, 4, 4)]))
    got = lloyd.fit_histogram(hist, [[1, 1, 1], [1, 1, 1], [255, 255, 255]], KMeansParams(3, max_iterations=1))
    assert got.prototypes == [[2, 2, 2], [1, 1, 1], [255, 255, 255]]


def test_labels_lag_colours(spark):
    cells = [(0, 0, 0), (100, 0, 0), (110, 0, 0)]
    df = frame(spark, cells)
    model = lloyd.fit_histogram(points.histogram(df), [[0, 0, 0], [255, 0, 0]], KMeansParams(2, 0.0, 1))
    rows = paint(df, model).orderBy("idx").collect()
    assert [r["cid"] for r in rows] == [0, 0, 0] and [r["r0"] for r in rows] == [70, 70, 70]
    assert as_image(paint(df, model)).columns == ["idx", "c0", "c1", "c2"]


def test_many_clusters_and_many_channels(spark):
    rng = np.random.default_rng(1)
    cells = rng.integers(0, 256, (60, 20)).tolist()
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "idx long, c array<int>")
    want, _, _ = oracle.lloyd(cells, cells[:4])
    for strategy in ("local", "groupby"):
        assert lloyd.fit_histogram(points.histogram(df), cells[:4], KMeansParams(4), strategy).prototypes == want
    grey = frame(spark, [(i, i, i) for i in range(256)])
    many = [[i % 256, i % 256, i % 256] for i in range(300)]
    assert lloyd.assign(grey, many).agg(F.max("cid")).first()[0] == 255
    assert seeding.farthest_points(points.histogram(df), 2, [0] * 20) == seeding.farthest_points_array(np.array(cells), np.arange(60), 2, [0] * 20)


def test_parameters_are_checked():
    for bad in ({"k": 0}, {"k": -1}, {"k": 1, "stab_error": -1}, {"k": 1, "max_iterations": 0}, {"k": 1, "check_every": 0}):
        with pytest.raises(ValueError):
            KMeansParams(**bad)


def test_no_points_is_an_error(spark, cloud):
    none = points.histogram(cloud[0].where("false"))
    for strategy in ("local", "groupby", "conditional"):
        with pytest.raises(ValueError):
            lloyd.fit_histogram(none, SEEDS, KMeansParams(3), strategy)


def test_generator_replays_the_known_draws():
    draw = seeding.Rand(0)
    assert [draw() % 256 for _ in range(12)] == [103, 198, 105, 115, 81, 255, 74, 236, 41, 205, 186, 171]
    assert seeding.random_colours(3, 3, seeding.Rand(0)) == SEEDS


def test_farthest_points_take_the_first_of_equals(spark):
    df = frame(spark, [(10, 0, 0), (0, 10, 0), (10, 0, 0), (0, 0, 1)])
    assert seeding.farthest_points(points.histogram(df), 3, [0, 0, 0]) == [[0, 0, 0], [10, 0, 0], [0, 10, 0]]
    assert seeding.points_at(df, [2, 2, 3]) == [[10, 0, 0], [10, 0, 0], [0, 0, 1]]
    with pytest.raises(ValueError):
        seeding.points_at(df, [99])


def test_elbow_cuts_distances(spark):
    df = spark.createDataFrame([(0, 0, 0, 1, 1, 1), (0, 0, 0, 3, 4, 0)], "c0 int, c1 int, c2 int, r0 int, r1 int, r2 int")
    assert quality.elbow_error(df).first()["elbow"] == 1 + 25


def test_extracted_labels_merge_equal_colours(spark):
    painted = spark.createDataFrame([(0, 9, 0, 0, 5, 0, 0), (1, 200, 0, 0, 5, 0, 0), (2, 210, 0, 0, 190, 0, 0)], "idx long, c0 int, c1 int, c2 int, r0 int, r1 int, r2 int")
    labelled, centroids = quality.extract_assignments(painted, 3)
    assert centroids == [[5, 0, 0], [190, 0, 0]]
    assert [r["cid"] for r in labelled.orderBy("idx").collect()] == [0, 1, 1]


@pytest.mark.parametrize("name", ["euclidean", "cosine", "manhattan"])
def test_silhouette_matches_brute_force(spark, name):
    rng = np.random.default_rng(5)
    cells = [*rng.integers(0, 6, (50, 3)).tolist(), [0, 0, 0], [0, 0, 0], [250, 250, 250]]
    labels = [0 if sum(c) < 6 else 1 for c in cells]
    labels[-1] = 2
    df = spark.createDataFrame([(i, *c, y) for i, (c, y) in enumerate(zip(cells, labels))], "idx long, c0 int, c1 int, c2 int, cid int")
    hist = df.groupBy("cid", "c0", "c1", "c2").agg(F.count("*").alias("n"))
    want = oracle.silhouette(cells, labels, name)
    assert quality.silhouette(hist, name).first()["silhouette"] == pytest.approx(want, abs=1e-9)
    assert quality.silhouette_sampled(df, 1000, name).first()["silhouette"] == pytest.approx(want, abs=1e-9)


def test_silhouette_of_one_cluster_is_zero(spark):
    df = spark.createDataFrame([(0, 1, 1, 1, 0), (1, 1, 1, 1, 0)], "idx long, c0 int, c1 int, c2 int, cid int")
    assert quality.silhouette_sampled(df, 10).first()["silhouette"] == 0.0


def test_stratified_sample_has_its_quotas(spark):
    df = spark.range(1000).select(F.col("id").alias("idx"), (F.col("id") < 10).cast("int").alias("cid"), *[F.lit(0).alias(f"c{i}") for i in range(3)])
    got = {r["cid"]: r["count"] for r in quality.stratified_sample(df, 50).groupBy("cid").count().collect()}
    assert got == {0: 49, 1: 1}
    assert quality.stratified_sample(df, 50).exceptAll(quality.stratified_sample(df.repartition(7), 50)).count() == 0


def test_stratified_sample_of_small_and_large_clusters_is_the_ranked_one(spark):
    cid = F.when(F.col("id") < 1, 0).when(F.col("id") < 3, 1).when(F.col("id") < 40, 2).when(F.col("id") < 2000, 3).otherwise(4)
    df = spark.range(20_000).select(F.col("id").alias("idx"), cid.alias("cid"), (F.col("id") % 7).cast("int").alias("c0"))
    rows = sorted((hashlib.md5(str(r["idx"]).encode()).hexdigest(), r["idx"], r["cid"]) for r in df.collect())
    sizes = collections.Counter(y for _, _, y in rows)
    for most in (1, 30, 300, 15_000, 30_000):
        want = {i for y, n in sizes.items() for _, i, _ in [r for r in rows if r[2] == y][: max(1, most * n // len(rows))]}
        got = quality.stratified_sample(df, most)
        assert got.columns == ["cid", "idx", "c0"] and {r["idx"] for r in got.collect()} == want and got.count() == len(want)


def test_sweep_orders_every_point_once_for_all_k(spark, monkeypatch):
    ordered = spark.sparkContext.accumulator(0)

    def order(i):
        ordered.add(1)
        return hashlib.md5(str(i).encode()).hexdigest()

    monkeypatch.setattr(quality, "sample_order", F.udf(order, "string"))
    df = spark.range(20_000).select(F.col("id").alias("idx"), *[((F.col("id") * (31 + i)) % 200).cast("int").alias(f"c{i}") for i in range(3)])
    assert quality.k_sweep(df, range(2, 6), max_samples=50).count() == 4
    assert 20_000 <= ordered.value < 30_000


def test_few_colours_meet_the_anchors_in_several_tasks(spark):
    hist = spark.range(0, 50, 1, 1).select((F.col("id") % 2).cast("int").alias("cid"), F.col("id").cast("int").alias("c0"), F.lit(2).cast("bigint").alias("n"))
    plan = quality.silhouette(hist)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_sweep_has_a_row_for_each_k(spark, cloud):
    rows = quality.k_sweep(cloud[0], range(2, 5), max_samples=100).orderBy("k").collect()
    assert [r["k"] for r in rows] == [2, 3, 4] and all(-1 <= r["silhouette"] <= 1 for r in rows)


def test_custom_metric(spark, cloud):
    distances.register("first channel", lambda a, b, p=0: F.abs(a[0] - b[0]).cast("float"), lambda a, b, p: np.abs(a[..., 0] - b[..., 0]).astype(np.float32))
    try:
        df, _ = cloud
        hist = points.histogram(df)
        fits = [lloyd.fit_histogram(hist, SEEDS, KMeansParams(3, metric="first channel"), s).prototypes for s in ("local", "groupby")]
        assert fits[0] == fits[1]
    finally:
        del distances.METRICS["first channel"], distances.ARRAYS["first channel"]


def test_names():
    assert naming.image_output("a/b.c/pic.png", 2) == "a/b.c/output_pic_clustered_2.png"
    assert naming.image_output("a/b.c/pic") == "a/b.c/output_pic_clustered"
    assert naming.image_output("pic.png") == "./output_pic_clustered"
    assert naming.image_output("a\\pic.x.png") == "a\\output_pic.x_clustered"
    assert naming.video_output("v/w.mov") == "v/output_w_clustered.mp4"
    assert naming.timing_output("video", 1920, 1080) == "results/video_1080.csv"


def test_a_metric_without_a_numpy_form_works_on_small_histograms(spark):
    from chromalyne.functions import distances

    distances.register("mine", lambda a, b, p: distances.manhattan(a, b))
    try:
        df = spark.createDataFrame([(i, i % 7, (i * 5) % 11, i % 3) for i in range(60)], "idx long, c0 int, c1 int, c2 int")
        first = [[0, 0, 0], [5, 5, 1], [6, 10, 2]]
        own = lloyd.kmeans(df, lloyd.KMeansParams(3, metric="mine"), "k-means (any distance)", init_prototypes=first)
        assert own.prototypes == lloyd.kmeans(df, lloyd.KMeansParams(3, metric="manhattan"), "k-means (any distance)", init_prototypes=first).prototypes
        with pytest.raises(ValueError):
            lloyd.fit_histogram(points.histogram(df), first, lloyd.KMeansParams(3, metric="mine"), "local")
    finally:
        del distances.METRICS["mine"]


def test_wide_and_negative_channels(spark):
    rows = [(0, -70_000, 5, 0), (1, -70_001, 6, 0), (2, 70_000, -5, 1), (3, 70_002, -8, 1), (4, -69_995, 5, 0)]
    df = spark.createDataFrame(rows, "idx long, c0 int, c1 int, c2 int")
    hist, first = points.histogram(df), [[-60_000, 0, 0], [60_000, 0, 0]]
    models = [lloyd.fit_histogram(hist, first, lloyd.KMeansParams(2), s).prototypes for s in ("local", "groupby", "conditional")]
    assert models[0] == models[1] == models[2] == [[-69998, 5, 0], [70001, -6, 1]]
    moved = {r["cid"]: [r["c0"], r["c1"], r["c2"]] for r in lloyd.updated(hist, first).collect()}
    assert moved == {0: [-69998, 5, 0], 1: [70001, -6, 1]}


def test_farthest_points_agree_on_driver_and_cluster(spark):
    df = spark.createDataFrame([(i, (i * 37) % 91, (i * 53) % 67, (i * 11) % 29) for i in range(400)], "idx long, c0 int, c1 int, c2 int")
    hist = points.histogram(df)
    assert seeding.farthest_points(hist, 6, [1, 2, 3]) == seeding.farthest_points(hist, 6, [1, 2, 3], most_cells=30)
