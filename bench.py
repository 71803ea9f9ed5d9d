"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one line of JSON. Each runs once warm and is then timed, median of $BENCH_RUNS (3)."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stratacut.functions.scalars import luma
from stratacut.operators import bridges, components, export, neighborhood, palette, vector
from stratacut.plans import queries
from stratacut.sources import fixtures


def headline(spark: SparkSession, sf: str):
    def components_of(pixels):
        images = neighborhood.images_of(pixels)
        mask = pixels.where(luma() >= 100).select("image_id", F.lit(0).alias("layer_id"), "x", "y")
        return components.facts(components.label(neighborhood.runs(mask), images), images)

    swatches, posters = (lambda: fixtures.swatches(spark, sf)), (lambda: fixtures.posters(spark, sf))
    both = {"swatches": swatches, "posters": posters}
    work = {
        "tone_preview": lambda pixels: queries.tone_preview(spark, sf, pixels),
        "components": components_of,
        "palette": lambda pixels: palette.quantize(pixels, 4),
        "blur": lambda pixels: neighborhood.blur(pixels.withColumn("luma", luma()), 3),
    }
    made = {f"{name}_{kind}": lambda f=f, view=view: f(view()) for name, f in work.items() for kind, view in both.items()}
    made["ring_bridges"] = lambda: vector.shortest_clear(fixtures.rings(spark, sf))
    made["corpus_palette_swatches"] = lambda: palette.corpus_palette(swatches(), 6)
    made["outlines_posters"] = lambda: export.outlines(posters().where(luma() < 100).select("image_id", F.lit(0).alias("layer_id"), "x", "y"))
    made["bridge_targets_swatches"] = lambda: queries.queries()["b02_b03_targets"](spark, sf)
    made["simple_bridges_swatches"] = lambda: bridges.simple_bridges(*queries.stack_inputs(spark, sf)[:2], 2)
    return made


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, make in headline(spark, sf).items():
        times = []
        for _ in range(1 + int(os.environ.get("BENCH_RUNS", "3"))):  # the first warms up
            began = time.time()
            make().write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
