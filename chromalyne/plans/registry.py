"""Queries over the driver tables and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chromalyne.functions.distances import MINKOWSKI_P, metric
from chromalyne.operators import lloyd, points, quality, seeding
from chromalyne.operators.lloyd import KMeansModel, KMeansParams, Prototypes
from chromalyne.operators.paint import paint
from chromalyne.plans import analytics, inputs, sql
from chromalyne.plans.inputs import FRAMES, HIST, PX3, VEC64
from chromalyne.sources import images, tables
from chromalyne.sources.storage import scratch, written
from chromalyne.streaming import video

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The first nine draws of the replayed generator modulo 256, three prototypes of three channels.
SEEDS: Prototypes = [[103, 198, 105], [115, 81, 255], [74, 236, 41]]
PARAMS = KMeansParams(3)
SAMPLES = 5000
SWEEP = range(2, 11)
#: Places of the points that seed the pixel-centroid query; one occurs twice.
PLACES = [17, 4711, 17, 300]


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.histogram(inputs.px3(spark, sf_dir))


def _prototypes(spark: SparkSession, model: KMeansModel) -> DataFrame:
    rows = [(cid, model.iterations, *q) for cid, q in enumerate(model.prototypes)]
    return spark.createDataFrame(rows, "cid int, it int, c0 int, c1 int, c2 int")


# distances: every line item's colour against a fixed one

TARGET = [25, 40, 60]


def _distance_query(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hist = points.histogram(inputs.px3_unordered(spark, sf_dir))
        own = points.channels(hist)
        return hist.select(*points.channel_names(hist), "n", metric(name)(own, points.literal(TARGET, False), MINKOWSKI_P).alias("dist"))

    run.__name__ = f"dist_{name}"
    query(f"with {PX3}, {HIST} select c0, c1, c2, n, {sql.distance(name, sql.C, [str(x) for x in TARGET])} dist from h")(run)


def _assign_query(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        assigned = lloyd.assign(inputs.px3_unordered(spark, sf_dir), SEEDS, name)
        return assigned.groupBy("cid").agg(F.count("*").alias("n"))

    run.__name__ = f"assign_{name}"
    query(f"with {PX3} select {sql.nearest(name, sql.literal_cells(SEEDS))} cid, count(*) n from px group by 1")(run)


for _name in ("squared_euclidean", "euclidean", "manhattan", "chebyshev", "minkowski", "cosine"):
    _distance_query(_name)
    _assign_query(_name)


@query(f"with {VEC64}, p as (select idx, c q from v where idx < 4) select v.idx, arg_min(p.idx, (d, p.idx))::int cid from (select v.idx, p.idx pid, 0 from v, p) z join v on v.idx = z.idx join p on p.idx = z.pid, lateral (select list_sum([(v.c[i]-p.q[i])*(v.c[i]-p.q[i]) for i in range(1, 65)])::bigint d) t group by v.idx")
def assign_many_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 channels: distances over array columns."""
    vec = inputs.vec64(spark, sf_dir)
    return lloyd.assign(vec, seeding.points_at(vec, [0, 1, 2, 3])).select("idx", "cid")


# histogram, update, the loop


@query(f"with {PX3}, {HIST} select c0, c1, c2, n, first_idx from h")
def colour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hist(spark, sf_dir)


def _update_oracle() -> str:
    cid = sql.nearest("euclidean", sql.literal_cells(SEEDS))
    old = " union all ".join(f"select {i} cid, {q[0]} o0, {q[1]} o1, {q[2]} o2" for i, q in enumerate(SEEDS))
    means = ", ".join(f"coalesce({sql.mean(f's{i}', 's.n')}, o{i})::int c{i}" for i in range(3))
    return f"""with {PX3}, a as (select {cid} cid, c0, c1, c2 from px),
s as (select cid, count(*) n, sum(c0) s0, sum(c1) s1, sum(c2) s2 from a group by cid), o as ({old})
select o.cid::int cid, coalesce(s.n, 0)::bigint n, {means} from o left join s using (cid)"""


@query(_update_oracle())
def update_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.updated(points.histogram(inputs.px3_unordered(spark, sf_dir)), SEEDS)


def _lloyd_oracle(seeds: Prototypes, **how) -> str:
    k = len(seeds)
    loop = sql.lloyd("l", k, f"select {sql.prototypes_literal(seeds)} p", **how)
    return f"with recursive {PX3}, {HIST}, {loop} select cid::int cid, it::int it, c0, c1, c2 from ({sql.spread('l', k)}) z"


@query(_lloyd_oracle(SEEDS))
def lloyd_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prototypes(spark, lloyd.fit_histogram(points.histogram(inputs.px3_unordered(spark, sf_dir)), SEEDS, PARAMS))


@query(_lloyd_oracle(SEEDS))
def lloyd_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a grouped aggregate per iteration, as for histograms that don't fit the driver."""
    return _prototypes(spark, lloyd.fit_histogram(points.histogram(inputs.px3_unordered(spark, sf_dir)), SEEDS, PARAMS, "groupby"))


@query(_lloyd_oracle(SEEDS))
def lloyd_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with conditional aggregates."""
    return _prototypes(spark, lloyd.fit_histogram(points.histogram(inputs.px3_unordered(spark, sf_dir)), SEEDS, PARAMS, "conditional"))


@query(_lloyd_oracle(SEEDS, check_every=3))
def lloyd_check_every3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prototypes(spark, lloyd.kmeans(inputs.px3_unordered(spark, sf_dir), PARAMS, "k-means skip convergence check"))


def _metric_query(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _prototypes(spark, lloyd.kmeans(inputs.px3_unordered(spark, sf_dir), KMeansParams(3, metric=name), "k-means (any distance)"))

    run.__name__ = f"lloyd_{name}"
    query(_lloyd_oracle(SEEDS, metric=name))(run)


for _name in ("squared_euclidean", "manhattan", "chebyshev", "minkowski", "cosine"):
    _metric_query(_name)


# seeding


def _farthest_parts(k: int) -> str:
    parts = [f"f1 as (select {sql.prototypes_literal([SEEDS[0]])}[1] c)"]
    for j in range(2, k + 1):
        d = [sql.total([f"({c} - f{i}.c[{x + 1}])*({c} - f{i}.c[{x + 1}])" for x, c in enumerate(sql.C)]) for i in range(1, j)]
        far = f"least({', '.join(d)})" if len(d) > 1 else d[0]
        parts.append(f"f{j} as (select [c0, c1, c2] c from h, {', '.join(f'f{i}' for i in range(1, j))} order by {far} desc, first_idx limit 1)")
    return ", ".join(parts)


def _farthest_oracle(k: int) -> str:
    rows = " union all ".join(f"select {j - 1} cid, c[1] c0, c[2] c1, c[3] c2 from f{j}" for j in range(1, k + 1))
    return f"with {PX3}, {HIST}, {_farthest_parts(k)} {rows}"


def _farthest_fit_oracle(k: int) -> str:
    first = f"select [{', '.join(f'f{j}.c' for j in range(1, k + 1))}] p from {', '.join(f'f{j}' for j in range(1, k + 1))}"
    return f"with recursive {PX3}, {HIST}, {_farthest_parts(k)}, {sql.lloyd('l', k, first)} select cid::int cid, it::int it, c0, c1, c2 from ({sql.spread('l', k)}) z"


@query(_farthest_oracle(4))
def farthest_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = seeding.farthest_points(_hist(spark, sf_dir), 4, SEEDS[0])
    return spark.createDataFrame([(i, *q) for i, q in enumerate(found)], "cid int, c0 int, c1 int, c2 int")


def _fit_query(name: str, variant: str, oracle: str) -> None:
    """A named variant with its own seeds and its own way of summing."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _prototypes(spark, lloyd.kmeans(inputs.px3(spark, sf_dir) if "++" in variant else inputs.px3_unordered(spark, sf_dir), PARAMS, variant, seeding.Rand(0)))

    run.__name__ = name
    query(oracle)(run)


_fit_query("kmeans_old", "k-means old", _lloyd_oracle(SEEDS))
_fit_query("kmeans_tiled", "k-means tiled", _lloyd_oracle(SEEDS))
_fit_query("kmeanspp", "k-means++", _farthest_fit_oracle(3))
_fit_query("kmeanspp_reduce", "k-means++ reduce", _farthest_fit_oracle(3))


_at = ", ".join(f"(select [c0, c1, c2] from px where idx = {i})" for i in PLACES)


@query(f"with recursive {PX3}, {HIST}, {sql.lloyd('l', len(PLACES), f'select [{_at}] p')} select cid::int cid, it::int it, c0, c1, c2 from ({sql.spread('l', len(PLACES))}) z")
def pixel_init_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds are points drawn with replacement; the second of two equal seeds stays an empty cluster."""
    px = inputs.px3(spark, sf_dir)
    first = seeding.points_at(px, PLACES)
    return _prototypes(spark, lloyd.fit_histogram(points.histogram(px), first, KMeansParams(len(PLACES))))


# painting and quality

_ONE = "with recursive {px}, {h}, {loop}, m as (select p, old from l)".format(px=PX3, h=HIST, loop=sql.lloyd("l", 3, f"select {sql.prototypes_literal(SEEDS)} p"))
_OLD, _NEW = sql.state_cells(3, "old"), sql.state_cells(3, "p")
_PICK = [f"[{', '.join(q[i] for q in _NEW)}][cid + 1]" for i in range(3)]


def _painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = written(_hist(spark, sf_dir), "histogram")
    return paint(hist, lloyd.fit_histogram(hist, SEEDS, PARAMS))


@query(f"{_ONE} select r0, r1, r2, sum(n)::bigint n from (select {_PICK[0]} r0, {_PICK[1]} r1, {_PICK[2]} r2, n from (select h.*, p, old, {sql.nearest('euclidean', _OLD)} cid from h, m) x) y group by all")
def paint_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _painted(spark, sf_dir).groupBy("r0", "r1", "r2").agg(F.sum("n").alias("n"))


@query(f"{_ONE} select {sql.elbow('euclidean', _OLD, _NEW)}::double elbow from h, m")
def elbow_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.elbow_error(_painted(spark, sf_dir))


_LABELLED = f"""{_ONE},
pt as (select c0, c1, c2, n, first_idx, {_PICK[0]} r0, {_PICK[1]} r1, {_PICK[2]} r2 from (select h.*, p, old, {sql.nearest('euclidean', _OLD)} cid from h, m) x),
u as (select r0, r1, r2, row_number() over (order by min(first_idx)) - 1 cid from pt group by r0, r1, r2),
lab as (select c0, c1, c2, n, first_idx, (select u.cid from u order by sqrt(((c0-u.r0)*(c0-u.r0)+(c1-u.r1)*(c1-u.r1)+(c2-u.r2)*(c2-u.r2))::double)::float, u.cid limit 1) cid from pt)"""


@query(f"{_LABELLED} select cid::int cid, sum(n)::bigint n, count(*) colours from lab group by cid")
def extract_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled, _ = quality.extract_assignments(_painted(spark, sf_dir), 3)
    return labelled.groupBy("cid").agg(F.sum("n").alias("n"), F.count("*").alias("colours"))


def _silhouette_sql(anchors: str, tag: str = "") -> str:
    """CTEs up to si{tag} (silhouette); anchors: SQL for rows (cid, c0, c1, c2, w) over lab{tag}."""
    return f"""sz{tag} as (select cid, sum(n) size from lab{tag} group by cid),
an{tag} as (select row_number() over () id, * from ({anchors}) x),
pr{tag} as (select a.id, a.cid own, a.w, b.cid,
  sum(sqrt(((a.c0-b.c0)*(a.c0-b.c0)+(a.c1-b.c1)*(a.c1-b.c1)+(a.c2-b.c2)*(a.c2-b.c2))::double)::float::double * (b.n - (case when a.cid = b.cid and a.c0 = b.c0 and a.c1 = b.c1 and a.c2 = b.c2 then 1 else 0 end))) total,
  sum(b.n - (case when a.cid = b.cid and a.c0 = b.c0 and a.c1 = b.c1 and a.c2 = b.c2 then 1 else 0 end)) cnt
  from an{tag} a join sz{tag} z on z.cid = a.cid and z.size > 1, lab{tag} b group by a.id, a.cid, a.w, b.cid),
ab{tag} as (select id, w, max(case when cid = own then case when cnt > 0 then total/cnt else 0 end end) i, min(case when cid <> own then total/cnt end) o from pr{tag} group by id, w),
si{tag} as (select round(coalesce(sum((o - i)/greatest(o, i)*w)/sum(w), 0), 6) silhouette from ab{tag} where o is not null and (i > 0 or o > 0))"""


@query(f"{_LABELLED}, {_silhouette_sql('select cid, c0, c1, c2, n w from lab')} select silhouette from si")
def silhouette_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled, _ = quality.extract_assignments(_painted(spark, sf_dir), 3)
    return quality.silhouette(labelled).select(F.round("silhouette", 6).alias("silhouette"))


def _sample(tag: str = "") -> str:
    return f"""select cid, c0, c1, c2, count(*) w from (
  select x.*, row_number() over (partition by cid order by md5(cast(idx as varchar)), idx) place, count(*) over (partition by cid) size, count(*) over () total
  from (select px.idx, px.c0, px.c1, px.c2, lab{tag}.cid from px join lab{tag} using (c0, c1, c2)) x) y
  where place <= greatest(1, floor({SAMPLES}*size/total)) or total <= {SAMPLES} group by cid, c0, c1, c2"""


@query(f"{_LABELLED}, {_silhouette_sql(_sample())} select silhouette from si")
def silhouette_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = written(inputs.px3(spark, sf_dir), "points")
    hist = written(points.histogram(px), "histogram")
    centroids = quality.painted_centroids(paint(hist, lloyd.fit_histogram(hist, SEEDS, PARAMS)), 3)
    label = lloyd.nearest(points.channels(px), centroids, "euclidean", MINKOWSKI_P)
    return quality.silhouette_sampled(px.withColumn("cid", label), SAMPLES, everyone=hist.withColumn("cid", label)).select(F.round("silhouette", 6).alias("silhouette"))


def _sweep_oracle() -> str:
    loops, rows = [], []
    for k in SWEEP:
        first = seeding.random_colours(k, 3, seeding.Rand(0))
        loops.append(sql.lloyd(f"l{k}", k, f"select {sql.prototypes_literal(first)} p"))
        rows.append(f"select {k}::int k, {sql.elbow('euclidean', sql.state_cells(k, 'old'), sql.state_cells(k, 'p'))}::double elbow from h, l{k}")
    return f"with recursive {PX3}, {HIST}, {', '.join(loops)} {' union all '.join(rows)}"


@query(_sweep_oracle())
def k_sweep_elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.k_sweep(inputs.px3_unordered(spark, sf_dir), SWEEP, with_silhouette=False)


def _metrics_oracle(ks: range) -> str:
    parts, rows = [], []
    for k in ks:
        old, new = sql.state_cells(k, "old"), sql.state_cells(k, "p")
        pick = [f"[{', '.join(q[i] for q in new)}][cid + 1]" for i in range(3)]
        parts.append(sql.lloyd(f"l{k}", k, f"select {sql.prototypes_literal(seeding.random_colours(k, 3, seeding.Rand(0)))} p"))
        parts.append(f"""pt{k} as (select c0, c1, c2, n, first_idx, {pick[0]} r0, {pick[1]} r1, {pick[2]} r2 from (select h.*, p, old, {sql.nearest('euclidean', old)} cid from h, l{k}) x),
u{k} as (select r0, r1, r2, row_number() over (order by min(first_idx)) - 1 cid from pt{k} group by r0, r1, r2),
lab{k} as (select c0, c1, c2, any_value(n) n, arg_min(u.cid, (sqrt(((c0-u.r0)*(c0-u.r0)+(c1-u.r1)*(c1-u.r1)+(c2-u.r2)*(c2-u.r2))::double)::float, u.cid)) cid from pt{k} p, u{k} u group by c0, c1, c2)""")
        parts.append(_silhouette_sql(_sample(str(k)), str(k)))
        rows.append(f"select {k}::int k, (select {sql.elbow('euclidean', old, new)}::double from h, l{k}) elbow, silhouette from si{k}")
    return f"with recursive {PX3}, {HIST}, {', '.join(parts)}, sweep as ({' union all '.join(rows)})"


def _sweep(spark: SparkSession, sf_dir: str, ks: range) -> DataFrame:
    swept = quality.k_sweep(inputs.px3(spark, sf_dir), ks, max_samples=SAMPLES)
    return swept.select("k", "elbow", F.round("silhouette", 6).alias("silhouette"))


@query(f"{_metrics_oracle(SWEEP)} select * from sweep")
def k_sweep_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elbow and sampled silhouette for each k, as the metrics command writes them."""
    return _sweep(spark, sf_dir, SWEEP)


# frames

CALIBRATION = 10


@query(f"with recursive {FRAMES}, {sql.lloyd('l', 3, f'select distinct frame_id, {sql.prototypes_literal(SEEDS)} p from fh', hist='fh', keys=['frame_id'])} select frame_id, it::int iterations, cid::int cid, c0, c1, c2 from ({sql.spread('l', 3, ['frame_id'])}) z")
def per_frame_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.per_frame(inputs.frames(spark, sf_dir), PARAMS, lambda frame, d: SEEDS)


def _track_oracle() -> str:
    draw = seeding.Rand(0)
    first = " union all ".join(f"select {f}::bigint frame_id, {sql.prototypes_literal(seeding.random_colours(3, 3, draw))} p" for f in range(CALIBRATION))
    cells = sql.state_cells(3)
    new = []
    for j in range(3):
        values = [f"case when coalesce(sum(n) filter (cid = {j}), 0) = 0 then any_value({cells[j][i]}) else {sql.mean(f'sum({c}*n) filter (cid = {j})', f'sum(n) filter (cid = {j})')} end" for i, c in enumerate(sql.C)]
        new.append("[" + ", ".join(values) + "]")
    shift = "greatest(" + ", ".join(sql.total([f"(q[{j + 1}][{i + 1}] - p[{j + 1}][{i + 1}])*(q[{j + 1}][{i + 1}] - p[{j + 1}][{i + 1}])" for i in range(3)]) for j in range(3)) + ")"
    return f"""with recursive {FRAMES},
{sql.lloyd('l', 3, first, hist='fh', keys=['frame_id'])},
err as (select fh.frame_id, any_value(it) it, any_value(p) p, {sql.elbow('euclidean', _OLD, _NEW)} error from fh join l using (frame_id) group by fh.frame_id),
best as (select p from err order by error, frame_id limit 1),
w as (
  select {CALIBRATION}::bigint frame_id, 0 it, p, null::bigint out_frame, 0 out_it from best
  union all
  select case when fin then frame_id + 1 else frame_id end, case when fin then 0 else it + 1 end, q, case when fin then frame_id end, it + 1 from (
    select *, {shift} <= 1 or it + 1 >= 100 fin from (
      select frame_id, it, p, [{', '.join(new)}] q from (
        select s.frame_id, s.it, s.p, c0, c1, c2, n, {sql.nearest('euclidean', cells)} cid from w s join fh on fh.frame_id = s.frame_id) x
      group by frame_id, it, p) y) z),
done as (select frame_id, 'calibration' phase, it, p from err union all select out_frame, 'tracking', out_it, p from w where out_frame is not null)
select frame_id, phase, it::int iterations, cid::int cid, c0, c1, c2 from (
  {' union all '.join(f'select frame_id, phase, it, {j} cid, p[{j + 1}][1] c0, p[{j + 1}][2] c1, p[{j + 1}][3] c2 from done' for j in range(3))}) t"""


_TRACKED = ["frame_id", "phase", "iterations", "cid", "c0", "c1", "c2"]


@query(_track_oracle())
def calibrate_warm_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.track(inputs.frames(spark, sf_dir), PARAMS, CALIBRATION).select(*_TRACKED)


@query(_track_oracle())
def calibrate_warm_start_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state machine for many videos side by side; here one."""
    tracked = video.track_many(inputs.frames(spark, sf_dir).withColumn("video_id", F.lit(1).cast("bigint")), PARAMS, CALIBRATION)
    phase = F.when(F.col("frame_id") < CALIBRATION, "calibration").otherwise("tracking")
    return tracked.withColumn("phase", phase).select(*_TRACKED)


@query(_track_oracle())
def calibrate_warm_start_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream that sees a file of six frames per trigger and is stopped and started again half-way."""
    source, out, progress = (scratch(spark, x) for x in ("frames", "tracked", "progress"))
    frames = written(inputs.frames(spark, sf_dir), "events")

    def run() -> None:
        stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(source)
        writer = video.track_stream(stream, PARAMS, lambda rows: rows.write.mode("append").parquet(out), progress, CALIBRATION)
        writer.trigger(availableNow=True).start().awaitTermination()

    for first in range(0, 30, 6):
        video.frames_between(frames, first, first + 6).coalesce(1).write.mode("append").parquet(source)
        if first == 12:
            run()
    run()
    return spark.read.parquet(out).select(*_TRACKED)


@query(f"with {FRAMES} select count(distinct frame_id) frames, count(*) filter (frame_id between 5 and 34) measured from fr")
def frame_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = inputs.frames(spark, sf_dir).select("frame_id")
    kept = F.count(F.when(F.col("frame_id").between(video.WARM_UP_FRAMES, video.WARM_UP_FRAMES + video.MEASURED_FRAMES - 1), 1))
    return frames.agg(F.count_distinct("frame_id").alias("frames"), kept.alias("measured"))


@query(f"with {FRAMES} select frame_id, count(*) pixels, sum(c0)::bigint s0, sum(c1)::bigint s1, sum(c2)::bigint s2, max(c0) m0 from fr group by frame_id")
def image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written as PNG files, one pixel wide, read back by the image source and taken apart into pixels."""
    path = scratch(spark, "png")
    images.write_png(inputs.frames(spark, sf_dir), None, 1, path)
    px = images.pixels(images.read_images(spark, path))
    return px.groupBy("frame_id").agg(F.count("*").alias("pixels"), *[F.sum(f"c{i}").alias(f"s{i}") for i in range(3)], F.max("c0").alias("m0"))


RAW = 4  # a raw frame has RAW x RAW pixels


@query(
    f"with {FRAMES}, px as (select frame_id, c0, c1, c2, row_number() over (partition by frame_id order by event_id) - 1 idx from fr where frame_id < 30) "
    f"select frame_id, count(*) pixels, sum(c0)::bigint s0, sum(idx*c1)::bigint s1, max(c2) m2 from px where idx < {RAW * RAW} group by frame_id"
)
def raw_video_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pixels of every frame written as one file of raw frames, read back a range of frames per task."""
    place = Window.partitionBy("frame_id").orderBy("idx")
    few = inputs.frames(spark, sf_dir).where("frame_id < 30").withColumn("at", F.row_number().over(place)).where(F.col("at") <= RAW * RAW)
    path = scratch(spark, "raw")
    images.write_raw(few.select("frame_id", (F.col("at") - 1).alias("idx"), "c0", "c1", "c2"), RAW, RAW, path)
    images.register(spark)
    px = images.pixels(images.as_images(spark.read.format("raw_video").option("height", RAW).option("width", RAW).option("framesPerTask", 8).load(path)))
    return px.groupBy("frame_id").agg(F.count("*").alias("pixels"), F.sum("c0").alias("s0"), F.sum(F.col("idx") * F.col("c1")).alias("s1"), F.max("c2").alias("m2"))


# analytics over timing tables: events give each weekday (a resolution) and type (a variant) its timings

_KIND = "case event_type {} end".format(" ".join(f"when '{t}' then {i}" for i, t in enumerate(("click", "error", "purchase", "signup", "view"))))


def _timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inputs.table(spark, sf_dir, "events")
    return e.select(F.hour("ts").cast("string").alias("resolution"), F.col("event_type").alias("variant"), F.coalesce(F.expr(_KIND), F.lit(9)).alias("position"), (F.floor(F.col("value") * 64) / 64).alias("seconds"))


_TIMINGS = f"t as (select cast(extract(hour from ts) as varchar) resolution, event_type variant, coalesce({_KIND}, 9) position, floor(value*64)/64 as seconds from events), mm as (select resolution, variant, position, avg(seconds) mean_seconds from t group by all)"
_BEST = "b as (select * from (select *, row_number() over (partition by resolution order by mean_seconds, position, variant) r from mm) where r = 1)"


@query(f"with {_TIMINGS} select resolution, variant, round(mean_seconds, 9) mean_seconds from mm")
def bench_unpivot_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.means(_timings(spark, sf_dir)).select("resolution", "variant", F.round("mean_seconds", 9).alias("mean_seconds"))


@query(f"with {_TIMINGS}, {_BEST}, f as (select resolution, mean_seconds base from mm where position = 0) select resolution, variant, round(mean_seconds, 9) mean_seconds, round(case when mean_seconds > 0 then 1/mean_seconds else 'inf'::double end, 9) fps, round(base/mean_seconds, 9) speedup from b join f using (resolution)")
def bench_best_fps_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _timings(spark, sf_dir)
    found = analytics.against_baseline(t, t)
    return found.select("resolution", "variant", *[F.round(c, 9).alias(c) for c in ("mean_seconds", "fps", "speedup")])


@query(
    f"with {_TIMINGS}, c as (select resolution, max(case when position = 0 then mean_seconds end) cpu, max(case when position = 5 then mean_seconds end) gpu0, max(case when position = 1 then mean_seconds end) gpu, max(case when position = 2 then mean_seconds end) calibrated from mm group by resolution) "
    "select resolution, case when cpu <= gpu and cpu <= calibrated then 'CPU baseline' when gpu <= calibrated then 'GPU reduce' else 'GPU calibration' end best, round(1/least(cpu, gpu, calibrated), 9) fps, round(cpu/least(cpu, gpu, calibrated), 9) speedup from c where cpu is not null and gpu is not null and calibrated is not null"
)
def bench_three_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _timings(spark, sf_dir)
    moved = lambda old, new: t.where(F.col("position") == old).withColumn("position", F.lit(new))
    return analytics.three_ways(t, moved(1, 5), moved(2, 0)).select("resolution", "best", F.round("fps", 9).alias("fps"), F.round("speedup", 9).alias("speedup"))


CURVES = range(2, 5)


@query(f"{_metrics_oracle(CURVES)} select k::bigint k, 'elbow' curve, elbow as value from sweep union all select k::bigint, 'silhouette', silhouette from sweep")
def bench_metric_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep written as the metrics file, read back and turned into curves."""
    path = scratch(spark, "metrics")
    tables.write_metrics(_sweep(spark, sf_dir, CURVES), path)
    back = tables.read_timings(spark, path)
    return analytics.metric_curves(back.select(F.col("k").cast("bigint").alias("k"), F.col(f"`{tables.METRICS[0]}`").alias("elbow"), F.col(f"`{tables.METRICS[1]}`").alias("silhouette")))


_FILES = {"baseline": tables.BASELINE, "video": tables.VIDEO, "calibration": tables.CALIBRATION}


def _files_oracle() -> str:
    rows = []
    for n, (name, columns) in enumerate(_FILES.items()):
        rows += [f"select '{name}' resolution, '{c.strip()}' variant, {i} as position, avg(s * {i + 1} + {n}) m from r" for i, c in enumerate(columns)]
    return f"with r as (select extract(day from ts) d, floor(avg(value) * 64) / 64 s from events group by 1) select resolution, variant, position, round(m, 9) mean_seconds from ({' union all '.join(rows)}) z"


@query(_files_oracle())
def timing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three kinds of timing files, a run per day of the events, written by their writer, read back with one that is missing."""
    runs = inputs.table(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").alias("d")).agg((F.floor(F.avg("value") * 64) / 64).alias("s")).collect()  # 31 rows
    paths = {name: scratch(spark, name) for name in _FILES}
    for n, (name, columns) in enumerate(_FILES.items()):
        tables.write_timings(spark, [[r["s"] * (i + 1) + n for i in range(len(columns))] for r in runs], columns, paths[name])
    found = tables.read_present(spark, paths | {"multicore": scratch(spark, "missing")}, warn=lambda text: None)
    return analytics.means(found).select("resolution", "variant", "position", F.round("mean_seconds", 9).alias("mean_seconds"))


@query(f"with {PX3}, hh as (select c0, c1, c2 from px), t as (select (idx % 30) run, c0::double/8 a, c1::double/8 b from px) select variant, round(avg(seconds), 9) mean_seconds from (select 'Squared euclidean distance' variant, a as seconds from t union all select 'Manhattan distance', b from t) z group by variant")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timings written as CSV with blanks in the header, read back, stripped and averaged."""
    path = scratch(spark, "timings")
    px = inputs.px3_unordered(spark, sf_dir)
    px.select((F.col("c0").cast("double") / 8).alias(tables.BASELINE[0]), (F.col("c1").cast("double") / 8).alias(f" {tables.BASELINE[1]}")).write.option("header", True).csv(path)
    means = analytics.means(tables.long_timings(tables.read_timings(spark, path), "all"))
    return means.select("variant", F.round("mean_seconds", 9).alias("mean_seconds"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converged k-means over the line items with the size of each cluster."""
    hist = written(points.histogram(inputs.px3_unordered(spark, sf_dir)), "histogram")
    model = lloyd.fit_histogram(hist, SEEDS, PARAMS)
    sizes = lloyd.assign(hist, model.label_prototypes).groupBy("cid").agg(F.sum("n").alias("size"))
    return _prototypes(spark, model).join(sizes, "cid", "left")
