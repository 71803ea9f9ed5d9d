"""Hand-made masks, round trips and streams."""

import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacut.operators import bridges, components, compose, export, neighborhood, palette, vector, workloads
from stratacut.sources import fixtures, png, raster_io
from stratacut.streaming import live

RING = ["#####", "#...#", "#...#", "#...#", "#####"]
CORNERS = ["##..", "##..", "..##", "..##"]
TALL = ["##.##"] * 9 + ["#####"] * 3


def table(spark, *pictures):
    """Masks (image_id, layer_id, x, y) and images of ASCII pictures."""
    ink = [(k, 0, x, y) for k, p in enumerate(pictures) for y, row in enumerate(p) for x, c in enumerate(row) if c == "#"]
    return spark.createDataFrame(ink, "image_id long, layer_id int, x int, y int"), spark.createDataFrame([(k, len(p[0]), len(p)) for k, p in enumerate(pictures)], "image_id long, width int, height int")


@pytest.mark.parametrize("strip", [512, 2, 1])
def test_components_in_strips(spark, strip):
    mask, images = table(spark, RING, CORNERS, TALL, ["#"], ["#."])
    out = components.facts(components.label(neighborhood.runs(mask), images, strip), images).collect()
    assert sorted((r.image_id, r.comp_id, r.area, r.touches_border) for r in out) == [(0, 0, 16, True), (1, 0, 4, True), (1, 10, 4, True), (2, 0, 51, True), (3, 0, 1, True), (4, 0, 1, True)]


def test_cleaning_and_bridging(spark):
    speck = ["......", ".#....", "......", "...###", "...#.#", "...###"]
    mask, images = table(spark, speck)
    done = neighborhood.pixels_of(components.clean(neighborhood.runs(mask), images, 2)).collect()
    assert {(r.x, r.y) for r in done} == {(x, y) for x in (3, 4, 5) for y in (3, 4, 5)}
    big = ["......."] + [".#####.", ".#...#.", ".#...#.", ".#...#.", ".#####."] + ["......."]
    mask, images = table(spark, big)
    cut, listed = bridges.smart_bridges(mask, images, None, 2, bridges=3, each=20)
    assert listed.where("selected").count() == 3
    empty = components.label(components.complement(neighborhood.runs(cut), images, mask.select("image_id", "layer_id").distinct()), images)
    assert components.facts(empty, images).count() == 1
    plan = bridges.simple_bridges(mask, images).collect()
    assert len(plan) >= 1 and all(r.target is None for r in plan)


def test_blur_of_a_constant_and_dilation(spark):
    flat = spark.createDataFrame([(1, x, y, 77) for x in range(6) for y in range(5)], "image_id long, x int, y int, luma int")
    assert {r.luma for r in neighborhood.blur(flat, 3).collect()} == {77}
    mask, images = table(spark, RING)
    assert neighborhood.dilate(neighborhood.runs(mask), images, 0).count() == neighborhood.runs(mask).count()
    assert neighborhood.pixels_of(neighborhood.dilate(neighborhood.runs(mask), images, 1)).count() == 24


def test_outlines(spark):
    mask, _ = table(spark, RING, CORNERS)
    rings = vector.edges(export.outlines(mask).withColumnRenamed("image_id", "doc_id"))
    area = rings.groupBy("doc_id", "contour_id").agg((F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2).alias("a"), F.count("*").alias("n")).collect()
    assert sorted((r.doc_id, r.a, r.n) for r in area) == [(0, -9.0, 4), (0, 25.0, 4), (1, 4.0, 4), (1, 4.0, 4)]


def test_png_round_trip(spark, tmp_path):
    pixels = [(1, 0, x, y, x * 20, y * 30, 200 - x, 255 if (x + y) % 3 else 128) for x in range(9) for y in range(7)]
    rows = spark.createDataFrame(pixels, "image_id long, layer_id int, x int, y int, r int, g int, b int, a int")
    images = spark.createDataFrame([(1, 9, 7)], "image_id long, width int, height int")
    (tmp_path / "a.png").write_bytes(raster_io.to_png(rows, images).first().png)
    (tmp_path / "b.txt").write_text("no picture")
    back = raster_io.pixels(raster_io.read_images(spark, str(tmp_path))).collect()
    assert sorted((r.x, r.y, r.r, r.g, r.b, r.a) for r in back) == sorted(p[2:] for p in pixels)
    url = raster_io.to_png(rows, images).select(raster_io.encode_url(F.col("png")).alias("u")).select(raster_io.decode_url(F.col("u")).alias("d")).first().d
    assert url.mime == "image/png" and bytes(url.bytes) == (tmp_path / "a.png").read_bytes()
    raster_io.save_layers(rows, f"{tmp_path}/layers")
    assert spark.read.parquet(f"{tmp_path}/layers").count() == 63


def test_saved_documents(spark, tmp_path):
    found = spark.createDataFrame([("a.svg", "<svg/>"), ("b.svg", "<svg><path/></svg>")], "file string, svg string")
    export.save_documents(found, f"{tmp_path}/out")
    assert {(r.file, r.value) for r in spark.read.text(f"{tmp_path}/out").collect()} == {tuple(r) for r in found.collect()}


def test_paths():
    assert vector.rings_of("M 0 0 L 4 0 L 4 4 Z M 1 1 H 2 V 2") == [[(0, 0), (4, 0), (4, 4)], [(1, 1), (2, 1), (2, 2)]]
    ring = vector.rings_of("M0,0C0,8 8,8 8,0Z")[0]
    assert len(ring) == 9 and ring[4] == (4.0, 6.0)
    assert vector.rings_of("M 0 0 L 1 1 Z") == []


def test_simplification():
    x, y = np.array([0, 1, 2, 3, 4.0]), np.array([0, 0.5, 3, 0.5, 0])
    assert vector.kept_points(x, y, 1.5).tolist() == [True, False, True, False, True]
    assert vector.kept_points(x, y, 3).tolist() == [True, False, False, False, True]


def test_palette_never_gets_worse(spark, sf):
    pixels = fixtures.thumbs(spark, sf).where("image_id < 20")
    cost = lambda p: palette.assign(pixels.where("a >= 10"), p).join(p.withColumnsRenamed({"r": "pr", "g": "pg", "b": "pb"}), ["image_id", "k"]).agg(F.sum((F.col("r") - F.col("pr")) ** 2 + (F.col("g") - F.col("pg")) ** 2 + (F.col("b") - F.col("pb")) ** 2)).first()[0]
    assert cost(palette.quantize(pixels, 3, 6)) <= cost(palette.quantize(pixels, 3, 1)) * 1.001


def test_streams(spark, sf, tmp_path):
    edits = fixtures.edit_events(spark, sf)
    edits.repartition(3).write.parquet(f"{tmp_path}/edits")
    stream = spark.readStream.schema(edits.schema).parquet(f"{tmp_path}/edits").withWatermark("ts", "1 day")
    live.bursts(stream, "6 hours").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination()
    got, every = {tuple(r) for r in spark.table("bursts").collect()}, live.bursts(edits, "6 hours").collect()
    last = edits.agg(F.max("ts")).first()[0]
    over = {tuple(r) for r in every if r.last_ts + timedelta(hours=6) <= last - timedelta(days=1)}  # those that the watermark has passed
    assert got == over and over
    state = spark.readStream.schema(edits.schema).parquet(f"{tmp_path}/edits").where("setting <> 'reset'")
    live.streamed_state(state).writeStream.format("memory").queryName("state").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("state").collect()} == {tuple(r) for r in live.folded(edits.where("setting <> 'reset'")).collect()}
    pixels = fixtures.thumbs(spark, sf).where("image_id < 12")
    pixels.repartition(2, "image_id").write.parquet(f"{tmp_path}/pixels")
    arriving = spark.readStream.schema(pixels.schema).parquet(f"{tmp_path}/pixels")
    live.arriving(arriving, palette.estimate_count, f"{tmp_path}/counts", f"{tmp_path}/c3").awaitTermination()
    assert {(r.image_id, r.n_colors) for r in spark.read.parquet(f"{tmp_path}/counts").collect()} == {tuple(r) for r in palette.estimate_count(pixels).collect()}


EDIT = "session_id long, event_id long, ts timestamp, setting string, layer_id int, value int"


def in_turn(spark, folder, schema, make, mode, *parts):
    """Rows that a stream over ``parts``, one a batch, gives: (batch, row)."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
    out = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    make(stream).writeStream.outputMode(mode).foreachBatch(lambda df, k: out.extend((k, r) for r in df.collect())).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    return [r for _, r in sorted(out, key=lambda x: x[0])]


def test_late_edits(spark, tmp_path):
    """Late by more than the watermark: dropped; by less: it changes the session's burst."""
    day = lambda d, h: datetime(2024, 1, d, h)
    first = [(1, 1, day(1, 10), "color", 0, 5), (1, 2, day(1, 12), "color", 0, 6), (2, 3, day(3, 10), "color", 0, 7)]
    second = [(1, 4, day(1, 11), "color", 0, 8), (2, 5, day(3, 8), "color", 0, 9)]  # the watermark is day 2, 10 o'clock
    between, third = [(4, 7, day(3, 9), "color", 0, 3)], [(3, 6, day(20, 0), "color", 0, 1)]  # a batch's watermark drops rows from the next but one on
    make = lambda stream: live.bursts(stream.withWatermark("ts", "1 day"), "6 hours")
    rows = [(r.session_id, r.first_ts, r.n_events, r.last_value) for r in in_turn(spark, tmp_path, EDIT, make, "append", first, between, second, third)]
    assert sorted(rows) == [(1, day(1, 10), 2, 6), (2, day(3, 8), 2, 7), (4, day(3, 9), 1, 3)]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_state_of_a_long_session_is_bounded(spark, tmp_path, rocks):
    """A hundred thousand edits of one session: what is kept are its layers and the edits of the last hour."""
    start = datetime(2024, 1, 1)
    rows = [(1, k, start + timedelta(seconds=3 * k), "toggle" if k % 3 else "color", k % 4, k % 1000) for k in range(100_000)]
    for k in range(4):
        spark.createDataFrame(rows[25_000 * k : 25_000 * (k + 1)], EDIT).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(EDIT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = []
    query = live.streamed_state_with_resets(stream, "1 hour").writeStream.outputMode("update").foreachBatch(lambda df, k: out.extend((k, tuple(r)) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators)
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal < 2000 < kept < 30_000
    last = {r[:2]: r for _, r in sorted(out)}
    assert sorted(last.values()) == sorted(tuple(r) for r in live.folded(spark.createDataFrame(rows, EDIT)).collect())


def test_repeated_batches_count_once(spark, sf, tmp_path):
    pixels = fixtures.thumbs(spark, sf).where("image_id < 6")
    write = live.batch_writer(palette.estimate_count, f"{tmp_path}/t")
    for number, part in ((0, "image_id < 3"), (1, "image_id >= 3"), (1, "image_id >= 3"), (2, "image_id < 0")):
        write(pixels.where(part), number)
    got = spark.read.parquet(f"{tmp_path}/t")
    assert sorted((r.image_id, r.n_colors, r.batch) for r in got.collect()) == sorted((*r, int(r[0] >= 3)) for r in palette.estimate_count(pixels).collect())


def test_streamed_state_with_resets(spark, sf, tmp_path, rocks):
    edits = fixtures.edit_events(spark, sf).where("setting <> 'blur' and session_id % 5 = 0")
    edits = edits.select(*[F.col(c).cast(t) for c, t in (x.split() for x in EDIT.split(", "))])
    rows = sorted((tuple(r) for r in edits.collect()), key=lambda r: (r[2], r[1]))
    cut = len(rows) // 3
    parts = rows[:cut] + rows[cut + 1 : cut + 9], rows[cut : cut + 1] + rows[cut + 9 : 2 * cut], rows[2 * cut :]  # one edit comes late
    last = {(r.session_id, r.layer_id): tuple(r) for r in in_turn(spark, tmp_path, EDIT, lambda e: live.streamed_state_with_resets(e, "400 days"), "update", *parts)}
    expect = [tuple(r) for r in live.folded(edits).collect()]
    assert expect and all(last[r[:2]] == r for r in expect)
    assert len({r[0] for r in rows if r[3] == "reset"}) > 1


def test_arriving_pictures(spark, sf, tmp_path):
    pixels = fixtures.thumbs(spark, sf).where("image_id < 9")
    pixels.repartition(3, "image_id").write.parquet(f"{tmp_path}/pixels")
    stream = spark.readStream.schema(pixels.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/pixels")
    live.arriving(stream, palette.estimate_count, f"{tmp_path}/counts", f"{tmp_path}/c").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/counts")
    assert got.select("batch").distinct().count() > 1
    assert sorted((r.image_id, r.n_colors) for r in got.collect()) == sorted(tuple(r) for r in palette.estimate_count(pixels).collect())


def test_bridged_stacks(spark, sf):
    """Bridges cut ink only, every layer and mode gets them, and enclosed pieces become fewer."""
    pixels = fixtures.thumbs(spark, sf).where("image_id < 12")
    images = neighborhood.images_of(pixels)

    def enclosed(masks):
        cut = components.label(components.complement(neighborhood.runs(masks), images, masks.select("image_id", "layer_id").distinct()), images)
        return components.facts(cut, images).groupBy("image_id", "layer_id").count().where("count > 1").count()

    for stack in (workloads.tone_stack(pixels, 4, cleanup=2, bridge=True), workloads.colour_stack(pixels, 3, bridge=True, least=1)):
        assert stack.masks.join(stack.clean, ["image_id", "layer_id", "x", "y"], "left_anti").count() == 0
        chosen = stack.listed.where("selected")
        assert chosen.select("layer_id").distinct().count() > 1 and chosen.where("layer_id = 0").count() > 0
        assert enclosed(stack.masks) < enclosed(stack.clean)
        drawn = compose.on_canvas(pixels, compose.composite(stack.masks, stack.layers))
        assert drawn.count() == pixels.count() and drawn.where("color is null").count() > 0


def test_own_number_of_colours(spark, sf):
    pixels = fixtures.swatches(spark, sf).where("image_id < 4")
    counts = {r.image_id: r.n_colors for r in palette.estimate_count(pixels).collect()}
    made = {r.image_id: r["count"] for r in workloads.colour_stack(pixels, None, bleed=0).layers.groupBy("image_id").count().collect()}
    assert made.keys() == counts.keys() and all(2 <= made[k] <= counts[k] for k in made)


@pytest.mark.parametrize("part", [9, 20, 1 << 18])
def test_png_in_blocks_of_rows(spark, tmp_path, part):
    """Blocks of one, two and all rows give the same picture; rows without pixels are transparent; the file's own checksums hold."""
    pixels = [(1, 0, x, y, x * 20, y * 30, 200 - x, 255) for x in range(9) for y in (1, 2, 5)]
    rows = spark.createDataFrame(pixels, "image_id long, layer_id int, x int, y int, r int, g int, b int, a int")
    images = spark.createDataFrame([(1, 9, 7)], "image_id long, width int, height int")
    (made,) = raster_io.to_png(rows, images, part).collect()
    expected = np.zeros((7, 9, 4), np.uint8)
    for _, _, x, y, *rgba in pixels:
        expected[y, x] = rgba
    assert (png.decode(bytes(made.png)) == expected).all()
    (tmp_path / "a.png").write_bytes(made.png)
    assert raster_io.pixels(raster_io.read_images(spark, str(tmp_path))).where("a = 255").count() == len(pixels)


def test_adler_of_parts():
    a, b = bytes(range(256)) * 300, b"\xff" * 70_000
    for x, y in ((a, b), (b, a), (b"", a), (a, b""), (b, b)):
        assert raster_io.adler_of_both(zlib.adler32(x), zlib.adler32(y), len(y)) == zlib.adler32(x + y)


def test_cartoon_stack_at_once_equals_layer_by_layer(spark, sf):
    """One pass over all layers chooses and erases what layers by themselves do, whatever the order of the layers."""
    rng = np.random.default_rng(5)
    shade = rng.integers(0, 3, (4, 14, 14))
    inked = [(k, int(shade[k, y, x]), x, y) for k in range(4) for y in range(14) for x in range(14) if (x * y + k) % 5]
    masks = spark.createDataFrame(inked, "image_id long, layer_id int, x int, y int")
    images = spark.createDataFrame([(k, 14, 14) for k in range(4)], "image_id long, width int, height int")
    order = [2, 0, 1]
    done, listed = bridges.bridge_stack(masks, images, order, False, 2, 1)
    kept, rows = set(), set()
    for place, layer in enumerate(order):
        later = order[place + 1 :]
        over = masks.where(F.col("layer_id").isin(later)) if later else None
        new, found = bridges.smart_bridges(masks.where(F.col("layer_id") == layer), images, over, 2, bridges=3 if place == 0 else 1, each=8, least=1, mainland_only=True, opposing=place == 0)
        kept |= {tuple(r) for r in new.collect()}
        rows |= {tuple(r) for r in found.collect()}
    assert {tuple(r) for r in done.collect()} == kept and len(kept) < len(inked)
    assert {tuple(r) for r in listed.collect()} == rows
    assert {r[1] for r in rows if r[-1]} == {0, 1, 2} and any(0 < r[10] < 1 for r in rows)


def test_places_of_many_rings(spark):
    """Rings of neighbouring paths never share an id, however many rings a path has; documents keep all of them in order."""
    d = "M 0 0 L 4 0 L 4 4 Z M 1 1 L 2 1 L 2 2 Z"
    found = spark.createDataFrame([(1, 0, d), (1, 1, d), (1, 2_000_000_000, d)], "doc_id long, path_id int, d string")
    ids = sorted({r.contour_id for r in vector.flatten(found).collect()})
    assert len(ids) == 6 and ids[2] - ids[0] > 1_000_000 and all(i >> 32 in (0, 1, 2_000_000_000) for i in ids)
    places = [r.place for r in vector.bridged_paths(vector.flatten(found)).collect() if r.place.startswith("c")]
    assert len(set(places)) == 6 and [int(p[1:]) for p in sorted(places)] == ids
