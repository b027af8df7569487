"""Imagery-shaped views over the shared test tables, once for Spark and once for DuckDB.

Each view exists as a Spark function ``name(spark, sf_dir)`` and as SQL text in ``VIEWS``.
Pixel values come from max / min only, so both engines start from equal bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def div(a: str | Column, n: int) -> Column:
    c = F.col(a) if isinstance(a, str) else a
    return F.call_function("div", c, F.lit(n)).cast("bigint")


# Epoch border between "before" and "after" observations in the line items.
EPOCH_BORDER = "1998-06-01 00:00:00"

VIEWS: dict[str, str] = {
    "px_multi": """
        select l_suppkey as scene_id, l_partkey // 50 as row, l_partkey % 50 as col,
               max(l_linenumber) / cast(7 as double) as b02, max(l_discount) * 10e0 as b03,
               max(l_quantity) / 50e0 as b04, max(l_extendedprice) / 105000e0 as b08,
               max(l_tax) * 12.5e0 as b11
        from lineitem group by 1, 2, 3""",
    "px_time": """
        select l_suppkey as scene_id, l_partkey // 500 as row, (l_partkey % 500) // 100 as col,
               cast(year(l_shipdate) as integer) as yr, max(l_quantity) / 50e0 as b04,
               max(l_extendedprice) / 105000e0 as b08, min(l_discount) * 10e0 as b03,
               min(l_tax) * 12.5e0 as b11
        from lineitem group by 1, 2, 3, 4""",
    "px_ms": """
        select l_suppkey as scene_id, l_partkey // 50 as row, (l_partkey % 50) // 5 as col,
               case when l_shipdate < timestamp '1998-06-01' then 1 else 2 end as ep,
               max(l_quantity) / 50e0 as b04, max(l_extendedprice) / 105000e0 as b08,
               min(l_discount) * 10e0 as b03, min(l_tax) * 12.5e0 as b11
        from lineitem group by 1, 2, 3, 4""",
    "px_obs": """
        select l_suppkey as scene_id, l_partkey // 50 as row, (l_partkey % 50) // 5 as col,
               case when l_shipdate < timestamp '1998-06-01' then 1 else 2 end as ep,
               cast(floor(max(l_quantity) * 5.1e0) as integer) as r,
               cast(floor(max(l_discount) * 2550e0) as integer) as g,
               cast(floor(max(l_tax) * 3187.5e0) as integer) as b
        from lineitem group by 1, 2, 3, 4""",
    "px_pair": """
        select a.scene_id, a.row, a.col, a.r as r1, a.g as g1, a.b as b1,
               z.r as r2, z.g as g2, z.b as b2
        from px_obs a join px_obs z
          on a.scene_id = z.scene_id and a.row = z.row and a.col = z.col
        where a.ep = 1 and z.ep = 2""",
    "px_sar": """
        select event_id // 2500 as scene_id, (event_id % 2500) // 50 as row, event_id % 50 as col,
               value / 500e0 as vv,
               case when event_type = 'error' then null else value / 2000e0 end as vh
        from events""",
    "px_grid": """
        select scene_id, pos // 8 as row, pos % 8 as col, v,
               case when v > 0.1e0 then 1 else 0 end as mask
        from (select vec_id as scene_id, unnest(generate_series(0, 63)) as pos,
                     cast(unnest(embedding) as double) as v
              from embeddings)""",
    "px_long": """
        select scene_id, cast(pos // 16 + 1 as integer) as band, (pos % 16) // 4 as row, pos % 4 as col, v as value
        from (select vec_id as scene_id, unnest(generate_series(0, 63)) as pos,
                     cast(unnest(embedding) as double) as v
              from embeddings)""",
    "px_rgb": """
        select scene_id, (pos // 8) * 3 + dy as row, (pos % 8) * 3 + dx as col,
               cast(greatest(0e0, least(255e0, floor((cast(e[pos + 1] as double) * 2e0 + 0.5e0) * 255e0))) as integer) as r,
               cast(greatest(0e0, least(255e0, floor((cast(e[(pos + 21) % 64 + 1] as double) * 2e0 + 0.5e0) * 255e0))) as integer) as g,
               cast(greatest(0e0, least(255e0, floor((cast(e[(pos + 42) % 64 + 1] as double) * 2e0 + 0.5e0) * 255e0))) as integer) as b
        from (select vec_id as scene_id, embedding as e, unnest(generate_series(0, 63)) as pos from embeddings)
             cross join (select unnest(generate_series(0, 2)) as dy)
             cross join (select unnest(generate_series(0, 2)) as dx)""",
    "bands": """
        select (p_partkey // 28) * 6 + k as scene_id,
               cast(m - case k when 0 then 0 when 1 then 1 when 2 then 3 when 3 then 6 when 4 then 10 else 16 end + 1 as integer) as band_idx,
               case k when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 4 when 4 then 6 else 12 end as total_bands,
               p_name as description,
               case (p_partkey // 28) % 5 when 0 then 'S1A_grd_vh.tif' when 1 then 'risat_scene.tif'
                    when 2 then 'landsat_b04.tif' when 3 then 'B08_band.tif' else 'upload.tif' end as filename
        from (select *, p_partkey % 28 as m,
                     case when p_partkey % 28 < 1 then 0 when p_partkey % 28 < 3 then 1 when p_partkey % 28 < 6 then 2
                          when p_partkey % 28 < 10 then 3 when p_partkey % 28 < 16 then 4 else 5 end as k
              from part)""",
    "catalog": """
        select (case o_orderstatus when 'F' then 'S2A_MSIL2A_' when 'O' then 'S2B_MSIL1C_' else 'S1A_IW_GRDH_' end)
                   || strftime(o_orderdate, '%Y%m%d') || '_' || o_orderkey as product_id,
               case o_orderstatus when 'F' then 'S2MSI2A' when 'O' then 'S2MSI1C' else 'S1_GRD' end as product_type,
               case when o_orderstatus in ('F', 'O') then 'Sentinel-2 MSI' else 'Sentinel-1 SAR C-Band' end as sensor,
               case when o_orderstatus in ('F', 'O') then 'SENTINEL-2' else 'SENTINEL-1' end as collection,
               o_orderdate as acquired_at,
               case when o_orderstatus in ('F', 'O') then cast(o_custkey % 61 as double) else 0e0 end as cloud,
               cast(o_orderkey % 101 as double) as overlap, o_custkey % 50 as request_id,
               timestamp '1998-01-15 00:00:00' as target_date, o_orderkey as ord,
               (o_custkey * 37 % 3500) / 10e0 - 180e0 as x0, (o_custkey * 53 % 1600) / 10e0 - 80e0 as y0,
               5e-1 + (o_custkey % 7) * 5e-1 as w
        from orders""",
    "footprints": """
        select c_custkey as id, (c_custkey * 37 % 3500) / 10e0 - 180e0 as x0,
               (c_custkey * 53 % 1600) / 10e0 - 80e0 as y0, 5e-1 + (c_custkey % 7) * 5e-1 as w,
               c_nationkey as grp
        from customer""",
    "cand": """
        select c_custkey as cand_id, c_nationkey as search_id, abs(c_acctbal) / 1000e0 as area_hectares,
               (c_custkey % 5 + 1) / 5e0 as persistence_ratio, (70 + c_custkey % 30) / 100e0 as confidence_score,
               (c_custkey * 37 % 3500) / 10e0 - 180e0 + (5e-1 + (c_custkey % 7) * 5e-1) / 2e0 as lon,
               (c_custkey * 53 % 1600) / 10e0 - 80e0 + (5e-1 + (c_custkey % 7) * 5e-1) / 2e0 as lat,
               c_name as name
        from customer""",
    "gaz": """
        select lower(n_name) as key, n_nationkey as ord, n_name as name,
               10e0 + n_nationkey * 5e-1 as lat, 75e0 + n_nationkey * 4e-1 as lon
        from nation""",
    "queries": """
        select c_custkey as query_id,
               case c_custkey % 10
                 when 0 then 'Find vacant land within ' || n || ' km of ' || n_name
                 when 1 then 'Compare ' || n_name || ' between January 201' || (n % 10) || ' and 202' || (n % 7)
                 when 2 then 'Show bare areas larger than ' || n || ' hectares near ' || n_name
                 when 3 then 'Where is the closest water around ' || n_name || '?'
                 when 4 then 'Is this parcel near ' || n_name || ' for sale at a low price?'
                 when 5 then 'Describe the scene over ' || n_name
                 when 6 then 'Use optical and SAR radar for ' || n_name
                 when 7 then 'Highlight dense trees and poor vegetation in ' || n_name || ' minimum ' || n || ' acres'
                 when 8 then 'Has vegetation decreased between dates in ' || n_name || ' since 202' || (n % 7)
                 else 'Persistent urban building growth, large sites at 1' || n || '.5, 7' || n || '.25' end as text
        from (select *, c_custkey % 20 + 1 as n from customer) join nation on c_nationkey = n_nationkey""",
    "boxes": """
        select o_orderkey as text_id, o_custkey as image_id,
               'Target at [' || a || ', ' || b || ', ' || (a + 1 + o_orderkey % 400) || ', ' || (b + 1 + o_custkey % 400) || '].' as text
        from (select *, o_orderkey % 500 as a, o_custkey % 500 as b from orders)""",
    "hist": """
        select conv_id as analysis_id, turn as step, role as tool, text, length(text) as duration_ms,
               (length(text) % 100) / 100e0 as confidence,
               case when length(text) % 10 = 0 then 'FAILED' else 'COMPLETED' end as status
        from conversations""",
}


def px_multi(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("scene_id"), div("l_partkey", 50).alias("row"), (F.col("l_partkey") % 50).alias("col")
        )
        .agg(
            (F.max("l_linenumber") / F.lit(7.0)).alias("b02"),
            (F.max("l_discount") * 10.0).alias("b03"),
            (F.max("l_quantity") / 50.0).alias("b04"),
            (F.max("l_extendedprice") / 105000.0).alias("b08"),
            (F.max("l_tax") * 12.5).alias("b11"),
        )
    )


def px_time(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("scene_id"),
            div("l_partkey", 500).alias("row"),
            div(F.col("l_partkey") % 500, 100).alias("col"),
            F.year("l_shipdate").alias("yr"),
        )
        .agg(
            (F.max("l_quantity") / 50.0).alias("b04"),
            (F.max("l_extendedprice") / 105000.0).alias("b08"),
            (F.min("l_discount") * 10.0).alias("b03"),
            (F.min("l_tax") * 12.5).alias("b11"),
        )
    )


def _epoch() -> Column:
    return F.when(F.col("l_shipdate") < F.lit(EPOCH_BORDER).cast("timestamp_ntz"), 1).otherwise(2)


def px_ms(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("scene_id"),
            div("l_partkey", 50).alias("row"),
            div(F.col("l_partkey") % 50, 5).alias("col"),
            _epoch().alias("ep"),
        )
        .agg(
            (F.max("l_quantity") / 50.0).alias("b04"),
            (F.max("l_extendedprice") / 105000.0).alias("b08"),
            (F.min("l_discount") * 10.0).alias("b03"),
            (F.min("l_tax") * 12.5).alias("b11"),
        )
    )


def px_obs(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("scene_id"),
            div("l_partkey", 50).alias("row"),
            div(F.col("l_partkey") % 50, 5).alias("col"),
            _epoch().alias("ep"),
        )
        .agg(
            F.floor(F.max("l_quantity") * 5.1).cast("int").alias("r"),
            F.floor(F.max("l_discount") * 2550.0).cast("int").alias("g"),
            F.floor(F.max("l_tax") * 3187.5).cast("int").alias("b"),
        )
    )


def px_sar(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        div("event_id", 2500).alias("scene_id"),
        div(F.col("event_id") % 2500, 50).alias("row"),
        (F.col("event_id") % 50).alias("col"),
        (F.col("value") / 500.0).alias("vv"),
        F.when(F.col("event_type") != "error", F.col("value") / 2000.0).alias("vh"),
    )


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("scene_id"), F.posexplode("embedding").alias("pos", "x"))


def px_grid(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("x").cast("double")
    return _cells(spark, sf).select(
        "scene_id",
        div("pos", 8).alias("row"),
        (F.col("pos") % 8).cast("bigint").alias("col"),
        v.alias("v"),
        F.when(v > 0.1, 1).otherwise(0).alias("mask"),
    )


def px_long(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf).select(
        "scene_id",
        (div("pos", 16) + 1).cast("int").alias("band"),
        div(F.col("pos") % 16, 4).alias("row"),
        (F.col("pos") % 4).cast("bigint").alias("col"),
        F.col("x").cast("double").alias("value"),
    )


def px_rgb(spark: SparkSession, sf: str) -> DataFrame:
    def channel(shift: int) -> Column:
        v = F.get("embedding", ((F.col("pos") + shift) % 64).cast("int")).cast("double")
        return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor((v * 2.0 + 0.5) * 255.0).cast("double"))).cast("int")

    return (
        table(spark, sf, "embeddings")
        .select("vec_id", "embedding", F.posexplode("embedding").alias("pos", "x"))
        .select(
            F.col("vec_id").alias("scene_id"),
            div("pos", 8).alias("br"),
            (F.col("pos") % 8).cast("bigint").alias("bc"),
            channel(0).alias("r"),
            channel(21).alias("g"),
            channel(42).alias("b"),
            F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"),
        )
        .select(
            "scene_id",
            (F.col("br") * 3 + div("k", 3)).alias("row"),
            (F.col("bc") * 3 + F.col("k") % 3).alias("col"),
            "r",
            "g",
            "b",
        )
    )


def bands(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("p_partkey") % 28
    k = F.when(m < 1, 0).when(m < 3, 1).when(m < 6, 2).when(m < 10, 3).when(m < 16, 4).otherwise(5)
    start = F.element_at(F.array(*[F.lit(v) for v in (0, 1, 3, 6, 10, 16)]), k + 1)
    total = F.element_at(F.array(*[F.lit(v) for v in (1, 2, 3, 4, 6, 12)]), k + 1)
    names = ("S1A_grd_vh.tif", "risat_scene.tif", "landsat_b04.tif", "B08_band.tif", "upload.tif")
    cycle = div("p_partkey", 28)
    return table(spark, sf, "part").select(
        (cycle * 6 + k).alias("scene_id"),
        (m - start + 1).cast("int").alias("band_idx"),
        total.alias("total_bands"),
        F.col("p_name").alias("description"),
        F.element_at(F.array(*[F.lit(v) for v in names]), (cycle % 5 + 1).cast("int")).alias("filename"),
    )


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    optical = status.isin("F", "O")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    prefix = F.when(status == "F", "S2A_MSIL2A_").when(status == "O", "S2B_MSIL1C_").otherwise("S1A_IW_GRDH_")
    return table(spark, sf, "orders").select(
        F.concat(prefix, day, F.lit("_"), F.col("o_orderkey").cast("string")).alias("product_id"),
        F.when(status == "F", "S2MSI2A").when(status == "O", "S2MSI1C").otherwise("S1_GRD").alias("product_type"),
        F.when(optical, "Sentinel-2 MSI").otherwise("Sentinel-1 SAR C-Band").alias("sensor"),
        F.when(optical, "SENTINEL-2").otherwise("SENTINEL-1").alias("collection"),
        F.col("o_orderdate").alias("acquired_at"),
        F.when(optical, (F.col("o_custkey") % 61).cast("double")).otherwise(0.0).alias("cloud"),
        (F.col("o_orderkey") % 101).cast("double").alias("overlap"),
        (F.col("o_custkey") % 50).alias("request_id"),
        F.lit("1998-01-15 00:00:00").cast("timestamp_ntz").alias("target_date"),
        F.col("o_orderkey").alias("ord"),
        ((F.col("o_custkey") * 37 % 3500) / 10.0 - 180.0).alias("x0"),
        ((F.col("o_custkey") * 53 % 1600) / 10.0 - 80.0).alias("y0"),
        (F.lit(0.5) + (F.col("o_custkey") % 7) * 0.5).alias("w"),
    )


def footprints(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("id"),
        ((key * 37 % 3500) / 10.0 - 180.0).alias("x0"),
        ((key * 53 % 1600) / 10.0 - 80.0).alias("y0"),
        (F.lit(0.5) + (key % 7) * 0.5).alias("w"),
        F.col("c_nationkey").alias("grp"),
    )


def cand(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    half = (F.lit(0.5) + (key % 7) * 0.5) / 2.0
    return table(spark, sf, "customer").select(
        key.alias("cand_id"),
        F.col("c_nationkey").alias("search_id"),
        (F.abs("c_acctbal") / 1000.0).alias("area_hectares"),
        ((key % 5 + 1) / 5.0).alias("persistence_ratio"),
        ((key % 30 + 70) / 100.0).alias("confidence_score"),
        ((key * 37 % 3500) / 10.0 - 180.0 + half).alias("lon"),
        ((key * 53 % 1600) / 10.0 - 80.0 + half).alias("lat"),
        F.col("c_name").alias("name"),
    )


def gaz(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.lower("n_name").alias("key"),
        F.col("n_nationkey").alias("ord"),
        F.col("n_name").alias("name"),
        (F.lit(10.0) + F.col("n_nationkey") * 0.5).alias("lat"),
        (F.lit(75.0) + F.col("n_nationkey") * 0.4).alias("lon"),
    )


def queries(spark: SparkSession, sf: str) -> DataFrame:
    key, name = F.col("c_custkey"), F.col("n_name")
    n = key % 20 + 1
    templates = [
        F.concat(F.lit("Find vacant land within "), n, F.lit(" km of "), name),
        F.concat(F.lit("Compare "), name, F.lit(" between January 201"), n % 10, F.lit(" and 202"), n % 7),
        F.concat(F.lit("Show bare areas larger than "), n, F.lit(" hectares near "), name),
        F.concat(F.lit("Where is the closest water around "), name, F.lit("?")),
        F.concat(F.lit("Is this parcel near "), name, F.lit(" for sale at a low price?")),
        F.concat(F.lit("Describe the scene over "), name),
        F.concat(F.lit("Use optical and SAR radar for "), name),
        F.concat(F.lit("Highlight dense trees and poor vegetation in "), name, F.lit(" minimum "), n, F.lit(" acres")),
        F.concat(F.lit("Has vegetation decreased between dates in "), name, F.lit(" since 202"), n % 7),
        F.concat(F.lit("Persistent urban building growth, large sites at 1"), n, F.lit(".5, 7"), n, F.lit(".25")),
    ]
    text = F.when(key % 10 == 0, templates[0])
    for i, template in enumerate(templates[1:], 1):
        text = text.when(key % 10 == i, template)
    customer = table(spark, sf, "customer")
    nation = table(spark, sf, "nation")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(key.alias("query_id"), text.alias("text"))


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("o_orderkey") % 500, F.col("o_custkey") % 500
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("text_id"),
        F.col("o_custkey").alias("image_id"),
        F.concat(
            F.lit("Target at ["),
            F.concat_ws(", ", a, b, a + 1 + F.col("o_orderkey") % 400, b + 1 + F.col("o_custkey") % 400),
            F.lit("]."),
        ).alias("text"),
    )


def hist(spark: SparkSession, sf: str) -> DataFrame:
    size = F.length("text")
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("analysis_id"),
        F.col("turn").alias("step"),
        F.col("role").alias("tool"),
        "text",
        size.cast("bigint").alias("duration_ms"),
        ((size % 100) / 100.0).alias("confidence"),
        F.when(size % 10 == 0, "FAILED").otherwise("COMPLETED").alias("status"),
    )


def px_pair(spark: SparkSession, sf: str) -> DataFrame:
    from scenelake.operators.change import pair_pixels

    obs = px_obs(spark, sf)
    return pair_pixels(obs.filter("ep = 1").drop("ep"), obs.filter("ep = 2").drop("ep"), ["r", "g", "b"])


def px_ms_pair(spark: SparkSession, sf: str) -> DataFrame:
    from scenelake.operators.change import pair_pixels

    obs = px_ms(spark, sf)
    return pair_pixels(obs.filter("ep = 1").drop("ep"), obs.filter("ep = 2").drop("ep"), ["b03", "b04", "b08", "b11"])


VIEWS["px_ms_pair"] = """
        select a.scene_id, a.row, a.col, a.b03 as b031, a.b04 as b041, a.b08 as b081, a.b11 as b111,
               z.b03 as b032, z.b04 as b042, z.b08 as b082, z.b11 as b112
        from px_ms a join px_ms z
          on a.scene_id = z.scene_id and a.row = z.row and a.col = z.col
        where a.ep = 1 and z.ep = 2"""

# Views that read other views.
NEEDS = {"px_pair": ["px_obs"], "px_ms_pair": ["px_ms"]}


def sql(views: str, body: str) -> str:
    """SQL text with the named views as leading CTEs."""
    names: list[str] = []
    for view in views.split():
        for needed in NEEDS.get(view, []) + [view]:
            if needed not in names:
                names.append(needed)
    ctes = [f"{name} as ({VIEWS[name]})" for name in names]
    text = body.strip()
    if text.lower().startswith("with recursive"):
        return "with recursive " + ", ".join(ctes) + ", " + text[len("with recursive"):]
    if text.lower().startswith("with"):
        return "with " + ", ".join(ctes) + ", " + text[len("with"):]
    return "with " + ", ".join(ctes) + " " + text


def fixed(c: str | Column, digits: int = 6) -> Column:
    """Scaled integer of a DOUBLE whose last bits depend on summation order or libm."""
    value = F.col(c) if isinstance(c, str) else c
    return F.floor(value * float(10**digits) + 0.5).cast("bigint")


def sfixed(expr: str, digits: int = 6) -> str:
    return f"cast(floor(({expr}) * 1e{digits} + 5e-1) as bigint)"
