"""The end of scene retrieval: chosen scenes to pixels of the requested box, typed analyses, answers and trace rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions.optical import reflectance_masks
from scenelake.functions.radar import backscatter_masks
from scenelake.operators.change import CHANGE_THRESHOLD
from scenelake.operators.display import normalize_reflectance, radar_to_db
from scenelake.operators.fusion import PIXELS_PER_STRUCTURE
from scenelake.plans.change_job import detect_change
from scenelake.plans.fusion_job import fuse
from scenelake.plans.retrieval import CHANGE_TASK, RADAR_TASK
from scenelake.session import cut_lineage

BOX = ("x0", "y0", "x1", "y1")
#: Side of the pixel blocks by which a pixel table is read.
BLOCK = 256
#: Chosen products whose ids are broadcast to the scan of the pixels at most; more are met in a shuffle.
BROADCAST_PRODUCTS = 100_000

# Steps of a retrieval with their tools, in order.
STEPS = [
    (1, "Place and dates from the request", "QueryParser"),
    (2, "Catalog search", "CatalogSearch"),
    (3, "Scene selection", "SceneSelector"),
    (4, "Pixels of the requested box", "PixelReader"),
    (5, "Analysis", "Analysis"),
]


class RetrievalAnswers(NamedTuple):
    """One answer per request, the rows of each branch by job, and the steps of each request."""

    answers: DataFrame
    change: DataFrame
    fusion: DataFrame
    evidence: DataFrame
    single: DataFrame
    trace: DataFrame


def branch() -> Column:
    """What a row of ``retrieve_pairs`` leads to: change, fusion, radar, optical, or nothing without its scenes."""
    have = {s: F.col(f"{s}_product_id").isNotNull() for s in ("before", "after", "partner")}
    change, radar = F.col("task") == CHANGE_TASK, F.col("task") == RADAR_TASK
    return (
        F.when(~have["before"] | (change & ~have["after"]), None)
        .when(change, "change")
        .when(radar & have["partner"], "fusion")
        .when(radar, "radar")
        .otherwise("optical")
    )


def plan_jobs(pairs: DataFrame) -> DataFrame:
    """Rows of ``retrieve_pairs`` with their branch and the key of the job that equal requests share."""
    kind = branch()
    second = F.when(kind == "change", F.col("after_product_id")).when(kind == "fusion", F.col("partner_product_id"))
    named = pairs.withColumn("branch", kind).withColumn("first_product", F.col("before_product_id")).withColumn("second_product", second)
    parts = ["branch", "first_product", F.coalesce("second_product", F.lit("")), *BOX]
    return named.withColumn("job", F.when(F.col("branch").isNotNull(), F.concat_ws("|", *parts)))


def job_blocks(jobs: DataFrame, headers: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of the chosen products that a job's box touches: job, branch, part, product_id, block_row, block_col, window.

    Window arithmetic on headers alone; products without a header, and boxes beside the raster, have no rows.
    """
    distinct = jobs.filter("job is not null").select("job", "branch", "first_product", "second_product", *BOX).distinct()
    parts = F.array(
        F.struct(F.lit("first").alias("part"), F.col("first_product").alias("product_id")),
        F.struct(F.lit("second").alias("part"), F.col("second_product").alias("product_id")),
    )
    sides = distinct.select("job", "branch", *BOX, F.inline(parts)).filter("product_id is not null")
    h = headers.select("product_id", "a", "c", "e", "f", "width", "height")
    placed = sides.join(h, "product_id")

    def span(low: Column, high: Column, size: str) -> tuple[Column, Column]:
        inside = lambda v: F.least(F.greatest(v, F.lit(0)), F.col(size)).cast("int")
        return inside(F.floor(F.least(low, high))), inside(F.ceil(F.greatest(low, high)))

    row0, row1 = span((F.col("y1") - F.col("f")) / F.col("e"), (F.col("y0") - F.col("f")) / F.col("e"), "height")
    col0, col1 = span((F.col("x0") - F.col("c")) / F.col("a"), (F.col("x1") - F.col("c")) / F.col("a"), "width")
    windows = placed.withColumns({"row0": row0, "row1": row1, "col0": col0, "col1": col1}).filter("row1 > row0 and col1 > col0")
    number = lambda v: F.floor(v / block).cast("int")
    rows = F.sequence(number(F.col("row0")), number(F.col("row1") - 1))
    cols = F.sequence(number(F.col("col0")), number(F.col("col1") - 1))
    tall = windows.withColumn("block_row", F.explode(rows))
    return tall.withColumn("block_col", F.explode(cols)).select(
        "job", "branch", "part", "product_id", "block_row", "block_col", *BOX, "a", "c", "e", "f", "row0", "row1", "col0", "col1"
    )


def box_pixels(px: DataFrame, blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pixels whose centre lies in the box of a job, on the grid of the job's first product.

    ``px``: product_id, row, col, bands, and block_row, block_col where the table has them (as ``write_pixel_blocks``
    makes them: their files are then pruned by the list of blocks while the job runs). The join is by product and block, so a
    product that many jobs ask for is no hot key. Both grids of a job must have the same pixel size.
    """
    if "block_row" not in px.columns:
        px = px.withColumns({"block_row": F.floor(F.col("row") / block).cast("int"), "block_col": F.floor(F.col("col") / block).cast("int")})
    bands = [c for c in px.columns if c not in ("product_id", "row", "col", "block_row", "block_col", "product_part")]
    keys = ["product_id", "block_row", "block_col"]
    if "product_part" in px.columns:
        blocks = blocks.withColumn("product_part", product_part(blocks.sparkSession, px))
        keys.append("product_part")
    # the condition always holds; Spark prunes folders at run time only by a side that it takes for a selection
    listed = blocks.filter("row1 > row0 and col1 > col0")
    # pixels of products that no job asks for are never shuffled while the list of products is small
    products = cut_lineage(listed.select("product_id").distinct())
    few = products.count() <= BROADCAST_PRODUCTS
    px = px.join(F.broadcast(products) if few else products, "product_id", "left_semi")
    met = px.join(listed, keys).filter("row >= row0 and row < row1 and col >= col0 and col < col1")
    x, y = F.col("c") + F.col("a") * (F.col("col") + 0.5), F.col("f") + F.col("e") * (F.col("row") + 0.5)
    inside = met.withColumns({"_x": x, "_y": y}).filter("_x >= x0 and _x <= x1 and _y >= y0 and _y <= y1")
    # cells are numbered from the corner of the box: the same ground cell has the same number in every product
    row, col = F.floor((F.col("_y") - F.col("y1")) / F.col("e")), F.floor((F.col("_x") - F.col("x0")) / F.col("a"))
    return inside.select("job", "branch", "part", "product_id", row.alias("row"), col.alias("col"), *bands)


def product_part(spark, px: DataFrame) -> Column:
    """The folder number of a product in a table of ``write_pixel_blocks``."""
    parts = px.schema["product_part"].metadata.get("parts")
    if parts is None:
        raise ValueError("product_part without its number of parts; read the table with read_pixel_blocks")
    return F.pmod(F.xxhash64("product_id"), F.lit(parts)).cast("int")


def _single(optical: DataFrame, radar: DataFrame) -> DataFrame:
    """Class shares and a sentence per single-scene job."""
    masks = normalize_reflectance(optical).select("scene_id", *[c.alias(n) for n, c in reflectance_masks().items()])
    share = lambda n: (F.avg(F.when(F.col(n), 100.0).when(F.col(n).isNotNull(), 0.0))).alias(f"{n}_pct")
    seen = masks.groupBy("scene_id").agg(F.count("*").alias("pixels"), *[share(n) for n in ("vegetation", "water", "urban", "cloud_or_haze")])
    told = F.format_string(
        "Vegetation covers %.1f%%, water %.1f%%, built-up surface %.1f%%; cloud or haze hides %.1f%%.",
        *[F.coalesce(f"{n}_pct", F.lit(0.0)) for n in ("vegetation", "water", "urban", "cloud_or_haze")],
    )
    echoes = radar_to_db(radar).select("scene_id", *[c.alias(n) for n, c in backscatter_masks().items()])
    heard = echoes.groupBy("scene_id").agg(F.count("*").alias("pixels"), *[F.count_if(n).alias(n) for n in ("double_bounce", "specular_water", "volume_scattering")])
    counted = heard.withColumn("structures", F.floor(F.col("double_bounce") / PIXELS_PER_STRUCTURE))
    said = F.format_string("Radar shows %d structures, %d pixels of smooth water and %d of volume scattering.", "structures", "specular_water", "volume_scattering")
    return seen.withColumn("answer", told).unionByName(counted.withColumn("answer", said), allowMissingColumns=True)


def answer_requests(
    pairs: DataFrame,
    px: DataFrame,
    headers: DataFrame,
    gsd: float = 10.0,
    threshold: float = CHANGE_THRESHOLD,
    block: int = BLOCK,
) -> RetrievalAnswers:
    """From the rows of ``retrieve_pairs`` to answers.

    ``px``: product_id, row, col, r, g, b, vv, vh (NULL where a product lacks them); ``headers``: product_id, a, c, e,
    f, width, height. Requests become jobs, equal ones share a job. All branches read their pixels by one join with
    the blocks that the jobs need: change compares two dates, fusion joins the radar scene with its optical partner, one
    scene alone is described. Requests without scenes or without pixels in their box keep a row with their status.
    """
    planned = cut_lineage(plan_jobs(pairs))
    blocks = job_blocks(planned, headers, block)
    pixels = cut_lineage(box_pixels(px, blocks, block))

    def part(branch_name: str, part_name: str, *bands: str) -> DataFrame:
        own = pixels.filter((F.col("branch") == branch_name) & (F.col("part") == part_name))
        return own.select(F.col("job").alias("scene_id"), "row", "col", *bands)

    sizes = pixels.filter("branch = 'change'").groupBy(F.col("job").alias("scene_id")).agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    change = detect_change(part("change", "first", "r", "g", "b"), part("change", "second", "r", "g", "b"), sizes, gsd, threshold).summary
    fused = fuse(part("fusion", "second", "r", "g", "b"), part("fusion", "first", "vv", "vh"), gsd)
    single = _single(part("optical", "first", "r", "g", "b"), part("radar", "first", "vv", "vh"))
    # the branches are aggregations: a row per job is all that goes on
    told = [
        change.select("scene_id", "pixels", F.col("change_percentage").alias("value"), F.col("description").alias("answer")),
        fused.summary.select("scene_id", "pixels", F.col("concordance_pct").alias("value"), "answer"),
        single.select("scene_id", "pixels", F.coalesce("vegetation_pct", F.col("structures").cast("double")).alias("value"), "answer"),
    ]
    results = cut_lineage(told[0].unionByName(told[1]).unionByName(told[2]).withColumnRenamed("scene_id", "job"))
    joined = planned.join(results, "job", "left")
    status = F.when(F.col("branch").isNull(), "NO_SCENE").when(F.col("pixels").isNull(), "NO_PIXELS").otherwise("COMPLETED")
    answers = joined.withColumn("status", status)
    return RetrievalAnswers(
        answers.select("query_id", "job", "task", "branch", "status", "first_product", "second_product", "pixels", "value", "answer"),
        change, fused.summary, fused.evidence, single, _trace(answers),
    )


def _trace(answers: DataFrame) -> DataFrame:
    """Five step rows per request; the fold and roll-up of histories take them as they are."""
    weighed = lambda s: F.coalesce(f"{s}_weighed", F.lit(0))
    texts = [
        F.format_string("Box %.4f %.4f %.4f %.4f, task %s.", *BOX, "task"),
        F.format_string("%d scenes for the first date, %d for the second, %d partners.", weighed("before"), weighed("after"), weighed("partner")),
        F.format_string("Chosen: %s, %s.", F.coalesce("first_product", F.lit("none")), F.coalesce("second_product", F.lit("none"))),
        F.format_string("%d pixels in the box.", F.coalesce("pixels", F.lit(0))),
        F.coalesce("answer", F.col("status")),
    ]
    done = [F.lit(True), F.lit(True), F.col("first_product").isNotNull(), F.col("pixels").isNotNull(), F.col("status") == "COMPLETED"]
    steps = [
        F.struct(F.lit(n).alias("step"), F.lit(name).alias("name"), F.lit(tool).alias("tool"), F.when(ok, "COMPLETED").otherwise("FAILED").alias("status"), text.alias("text"))
        for (n, name, tool), text, ok in zip(STEPS, texts, done)
    ]
    return answers.select("query_id", F.inline(F.array(*steps)))
