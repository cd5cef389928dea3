"""Queries over masks and pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import masks as M
from ..functions.scalars import rounded
from . import fixtures as X
from .registry import query

_PX, _MK = "features pixels", "features pixels masks"


def r(name, digits=6):
    return rounded(name, digits).alias(name)


@query("a10_pixel_stats", "SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM pixels", _PX)
def a10(spark, sf):
    return M.pixel_stats(X.pixels(spark, sf)).select(r("mean"), r("std"))


@query("a11_image_stats", "SELECT round(avg(m), 6) AS mean, round(avg(d), 6) AS std FROM (SELECT avg(v) AS m, stddev_pop(v) AS d FROM pixels GROUP BY image)", _PX)
def a11(spark, sf):
    return M.image_stats(X.pixels(spark, sf)).select(r("mean"), r("std"))


@query("a20_psnr", "SELECT a.image, round(20 * log10(2) - 10 * log10(sum((a.v - b.v) ** 2 * (a.x < 6)::INT) / sum((a.x < 6)::INT)), 5) AS psnr FROM pixels a JOIN pixels b ON b.image = a.image + 1 AND a.y = b.y AND a.x = b.x GROUP BY a.image", _PX)
def a20(spark, sf):
    p = X.pixels(spark, sf)
    pairs = p.withColumnRenamed("v", "a").join(p.select((F.col("image") - 1).alias("image"), "y", "x", F.col("v").alias("b")), ["image", "y", "x"])
    return M.masked_psnr(pairs.withColumn("mask", (F.col("x") < 6).cast("int")), ["image"]).select("image", r("psnr", 5))


_BESSEL = "list_sum(list_transform(range(0, 40), lambda k: pow(16 * (1 - pow((n - 3.5) / 3.5, 2)), k) / pow(gamma(k + 1), 2)))"


@query("a21_spectrum", f""", kz AS (SELECT n::INT AS n, {_BESSEL} AS w FROM generate_series(0, 7) AS g(n)), win AS (SELECT n, w / sqrt((SELECT sum(w * w) FROM kz)) AS w FROM kz), q AS (SELECT image, y, x, v / 0.125 * a.w * b.w AS v FROM pixels JOIN win a ON a.n = y JOIN win b ON b.n = x),
s AS (SELECT image, ky, kx, sum(v * cos(2 * pi() * (ky * y + kx * x) / 8)) AS re, sum(v * sin(2 * pi() * (ky * y + kx * x) / 8)) AS im FROM q, generate_series(0, 7) AS g(ky), generate_series(0, 7) AS h(kx) GROUP BY ALL)
SELECT ky::INT AS ky, kx::INT AS kx, round(avg(re * re + im * im), 6) AS power FROM s GROUP BY ALL""", _PX)
def a21(spark, sf):
    return M.power_spectrum(X.features(spark, sf).select(F.col("x").alias("v")), 8, mean=0.0, std=0.125).select("ky", "kx", r("power"))


@query("a22_radial", "SELECT floor(sqrt((y - 4) ** 2 + (x - 4) ** 2))::INT AS radius, round(avg(v), 6) AS mean FROM pixels GROUP BY 1", _PX)
def a22(spark, sf):
    return M.radial_profile(X.pixels(spark, sf), 8).select("radius", r("mean"))


@query("a32_pooling", ", p AS (SELECT image, y, x, v, (x + y) % 2 AS m FROM pixels), q AS (SELECT image, d, sum(v[d] * w) / (sum(w) + 1e-6) AS m FROM (SELECT image, x AS pos, any_value((x % 2)::DOUBLE) AS w, list(v ORDER BY y) AS v FROM p GROUP BY image, x), unnest(generate_series(1, 8)) AS g(d) GROUP BY ALL) SELECT image, list(round(m, 6) ORDER BY d) AS v FROM q GROUP BY image", _PX)
def a32(spark, sf):
    columns = X.pixels(spark, sf).groupBy("image", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "v"))), lambda s: s["v"]).alias("v")).withColumn("m", F.col("x") % 2)
    return M.pooled(columns, "image", "v", "m").select("image", F.transform("v", lambda v: rounded(v, 6)).alias("v"))


@query("a33_mask_stats", "SELECT image, mask, count(*) AS area, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx, min(y) AS top, min(x) AS left, max(y) AS bottom, max(x) AS right, round(count(*) / ((max(y) - min(y) + 1) * (max(x) - min(x) + 1)), 6) AS fill FROM masks GROUP BY ALL", _MK)
def a33(spark, sf):
    return M.mask_stats(X.masks(spark, sf)).select("image", "mask", "area", r("cy"), r("cx"), "top", "left", "bottom", "right", r("fill"))


@query("j11_overlaps", "SELECT a.image, a.mask AS a, b.mask AS b, count(*) AS both FROM masks a JOIN masks b ON a.image = b.image AND a.y = b.y AND a.x = b.x AND a.mask < b.mask GROUP BY ALL", _MK)
def j11(spark, sf):
    return M.overlaps(X.masks(spark, sf))


@query("m01_scores", "SELECT image, y, x, round(v * v, 8) AS score FROM pixels", _PX)
def m01(spark, sf):
    return M.scored(X.pixels(spark, sf).withColumns({"predicted_iou": F.col("v"), "stability": F.col("v")})).select("image", "y", "x", r("score", 8))


@query("m02_dedup", """, ar AS (SELECT image, mask, max(score) AS score, count(*) AS n FROM masks GROUP BY ALL), b AS (SELECT a.image, a.mask AS a, b.mask AS b, count(*) AS n FROM masks a JOIN masks b ON a.image = b.image AND a.y = b.y AND a.x = b.x AND a.mask <> b.mask GROUP BY ALL),
nr AS (SELECT b.image, a, list(b) AS near FROM b JOIN ar p ON p.image = b.image AND p.mask = a JOIN ar q ON q.image = b.image AND q.mask = b WHERE b.n / (p.n + q.n - b.n) >= 0.5 GROUP BY ALL),
o AS (SELECT ar.image, mask, score, coalesce(near, []) AS near, row_number() OVER (PARTITION BY ar.image ORDER BY score DESC, mask) AS k, count(*) OVER (PARTITION BY ar.image) AS size FROM ar LEFT JOIN nr ON nr.image = ar.image AND nr.a = mask),
rec AS (SELECT image, 0::BIGINT AS k, []::INT[] AS kept FROM o WHERE k = 1 UNION ALL SELECT o.image, o.k, CASE WHEN len(kept) < 250 AND NOT list_has_any(kept, near) THEN list_append(kept, mask) ELSE kept END FROM rec JOIN o ON o.image = rec.image AND o.k = rec.k + 1)
SELECT o.image, o.mask, o.score FROM o JOIN rec ON rec.image = o.image AND rec.k = o.size WHERE list_contains(kept, o.mask)""", _MK)
def m02(spark, sf):
    return M.deduplicated(X.masks(spark, sf), most_iou=0.5)


@query("m03_label_map", "SELECT image, y, x, mask FROM (SELECT *, row_number() OVER (PARTITION BY image, y, x ORDER BY score DESC, mask) AS k FROM masks) WHERE k = 1", _MK)
def m03(spark, sf):
    return M.label_map(X.masks(spark, sf))


@query("m04_iou", ", o AS (SELECT a.image, a.mask AS a, b.mask AS b, count(*) AS shared FROM masks a JOIN masks b ON a.image = b.image AND a.y = b.y AND a.x = b.x AND a.mask < b.mask GROUP BY ALL), s AS (SELECT image, mask, count(*) AS n FROM masks GROUP BY ALL) SELECT o.image, a, b, round(shared / greatest(1, p.n + q.n - shared), 6) AS iou FROM o JOIN s p ON p.image = o.image AND p.mask = a JOIN s q ON q.image = o.image AND q.mask = b", _MK)
def m04(spark, sf):
    return M.ious(X.masks(spark, sf)).select("image", "a", "b", r("iou"))


@query("u03_holes", ", b AS (SELECT image, mask, min(y) AS lo, max(y) AS hi FROM masks GROUP BY ALL) SELECT image, mask, unnest(generate_series(lo, hi))::INT AS row FROM b EXCEPT SELECT image, mask, y FROM masks", _MK)
def u03(spark, sf):
    return M.holes(X.masks(spark, sf), 8)


@query("u04_intersection", "SELECT image, y, x FROM masks WHERE mask = 1 INTERSECT SELECT image, y, x FROM masks WHERE mask = 2", _MK)
def u04(spark, sf):
    m = X.masks(spark, sf)
    return m.where("mask = 1").select("image", "y", "x").intersect(m.where("mask = 2").select("image", "y", "x"))


@query("u05_merged_blocks", "SELECT image, list(DISTINCT y * 8 + x ORDER BY y * 8 + x) AS cells FROM masks GROUP BY image", _MK)
def u05(spark, sf):
    blocks = X.masks(spark, sf).groupBy("image", "mask").agg(F.collect_list((F.col("y") * 8 + F.col("x")).cast("int")).alias("cells"))
    return M.merged_blocks(blocks, "image", "cells")


@query("k06_mask_bank", "SELECT image, count(DISTINCT mask) AS n FROM masks GROUP BY image", _MK)
def k06(spark, sf):
    return M.mask_bank(X.masks(spark, sf)).select("image", F.size("masks").cast("long").alias("n"))
