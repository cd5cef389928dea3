"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vectors as V
from . import fixtures as X
from .registry import query


def r(x: Column, digits: int = 6) -> Column:
    return S.rounded(x, digits)


def rs(x: Column) -> Column:
    return F.transform(x, lambda v: S.rounded(v, 6))


_PAIR = """pair AS (SELECT a.id, a.x AS a, b.x AS b FROM features a JOIN features b ON b.id = a.id + 1)"""


def pair(spark, sf):
    f = X.features(spark, sf).select("id", "x")
    return f.select("id", F.col("x").alias("a")).join(f.select((F.col("id") - 1).alias("id"), F.col("x").alias("b")), "id")


@query("f01_vectors", f", {_PAIR} SELECT id, round(list_inner_product(a, b), 6) AS dot, round(list_cosine_similarity(a, b), 6) AS cosine, round(list_distance(a, b) ** 2, 6) AS d2, list_transform(a, lambda v: round(v / sqrt(list_inner_product(a, a)), 6)) AS unit FROM pair", "features")
def f01(spark, sf):
    return pair(spark, sf).select("id", r(V.dot("a", "b")).alias("dot"), r(V.cosine("a", "b")).alias("cosine"), r(V.squared_distance("a", "b")).alias("d2"), rs(V.unit("a")).alias("unit"))


@query("f02_interpolation", f""", {_PAIR}, u AS (SELECT id, a, b, list_transform(a, lambda v: v / sqrt(list_inner_product(a, a))) AS ua, list_transform(b, lambda v: v / sqrt(list_inner_product(b, b))) AS ub FROM pair),
w AS (SELECT *, list_inner_product(ua, ub) AS d FROM u), s AS (SELECT *, list_transform(list_zip(ua, ub), lambda z: z[2] - d * z[1]) AS raw FROM w),
t AS (SELECT *, list_transform(raw, lambda v: v / sqrt(list_inner_product(raw, raw))) AS side FROM s)
SELECT id, list_transform(list_zip(a, b), lambda z: round(z[1] + (z[2] - z[1]) * 0.25, 6)) AS lerp, list_transform(list_zip(ua, side), lambda z: round(z[1] * cos(0.25 * acos(d)) + z[2] * sin(0.25 * acos(d)), 6)) AS slerp FROM t""", "features")
def f02(spark, sf):
    return pair(spark, sf).select("id", rs(V.lerp("a", "b", F.lit(0.25))).alias("lerp"), rs(V.slerp("a", "b", F.lit(0.25))).alias("slerp"))


@query("f03_layer_norm", f", {_PAIR} SELECT id, list_transform(a, lambda v: round((v - list_avg(a)) / sqrt(list_var_pop(a) + 1e-6), 5)) AS ln FROM pair", "features")
def f03(spark, sf):
    return pair(spark, sf).select("id", F.transform(V.layer_norm("a"), lambda v: S.rounded(v, 5)).alias("ln"))


@query("f04_gather", f", {_PAIR} SELECT id, [round(a[64], 6), round(a[1], 6), round(a[1], 6)] AS taken, flatten(list_transform(a, lambda v: [round(v, 6), round(v, 6)])) AS twice FROM pair", "features")
def f04(spark, sf):
    taken = V.gather("a", F.array(F.lit(63), F.lit(0), F.lit(0)))
    return pair(spark, sf).select("id", rs(taken).alias("taken"), rs(V.repeat_interleave("a", 2)).alias("twice"))


@query("f05_one_hot", "SELECT id, list_transform(range(10), lambda i: (i = target)::INT::DOUBLE) AS hot, (list_position(z, list_max(z)) - 1)::INT AS top FROM logits", "features logits")
def f05(spark, sf):
    return X.logits(spark, sf).select("id", V.one_hot("target", 10).alias("hot"), V.argmax("z").alias("top"))


@query("f06_losses", "SELECT id, round(CASE WHEN abs(z[1] - z[2]) < 0.1 THEN 0.5 * (z[1] - z[2]) ** 2 / 0.1 ELSE abs(z[1] - z[2]) - 0.05 END, 6) AS sl1, round(ln(1 + exp(z[1])), 6) AS softplus, list_transform(z, lambda v: round(v - ln(list_sum(list_transform(z, lambda w: exp(w)))), 6)) AS log_softmax FROM logits", "features logits")
def f06(spark, sf):
    a, b = F.get("z", F.lit(0)), F.get("z", F.lit(1))
    return X.logits(spark, sf).select("id", r(V.smooth_l1(a, b, 0.1)).alias("sl1"), r(V.softplus(a)).alias("softplus"), rs(V.log_softmax("z")).alias("log_softmax"))


@query("f07_kernels", f", {_PAIR}, p AS (SELECT id, a, b, list_transform(a, lambda v: exp(v)) AS ea, list_transform(b, lambda v: exp(v)) AS eb FROM pair) SELECT id, round((list_inner_product(a, b) / 64 + 1) ** 3, 6) AS kernel, round(list_sum(list_transform(list_zip(ea, eb), lambda z: z[1] / list_sum(ea) * ln((z[1] / list_sum(ea)) / (z[2] / list_sum(eb))))), 6) AS kl FROM p", "features")
def f07(spark, sf):
    return pair(spark, sf).select("id", r(V.polynomial_kernel("a", "b")).alias("kernel"), r(V.kl_row(V.softmax("a"), V.softmax("b"))).alias("kl"))


@query("f08_schedules", "SELECT run, step, round(CASE WHEN step < 10 THEN 0.1 + 0.9 * step / 10 ELSE greatest(0.05, 0.05 + 0.95 * 0.5 * (1 + cos(pi() * (step - 10) / 90))) END, 6) AS lr, round(least(0.4, 0.4 + (0.04 - 0.4) * 0.5 * (1 + cos(pi() * step / 100))), 6) AS wd, round(0.996 + step * 0.004 / 100, 6) AS momentum FROM telemetry", "telemetry")
def f08(spark, sf):
    s = F.col("step")
    return X.telemetry(spark, sf).select("run", "step", r(S.warmup_cosine(s, warmup=10, total=100, start=0.1, peak=1.0, final=0.05)).alias("lr"), r(S.cosine_decay(s, total=100, start=0.04, final=0.4)).alias("wd"), r(S.linear_momentum(s, total=100, start=0.996)).alias("momentum"))


@query("f09_ramps", "SELECT run, tick, round(greatest(0, least(1, (nimg - 100) / 1900.0)), 6) AS ramp, round(greatest(1 - nimg / 2000.0, 0) * 10, 6) AS blur FROM ticks", "telemetry ticks")
def f09(spark, sf):
    return X.ticks(spark, sf).select("run", "tick", r(S.ramp(F.col("nimg"), 100, 2000)).alias("ramp"), r(S.blur_sigma(F.col("nimg"), start=10, fade_kimg=2)).alias("blur"))


@query("f10_betas", """, s AS (SELECT run, step, (step % 100)::DOUBLE AS t FROM telemetry)
SELECT run, step, round(0.0001 + 0.0199 * t / 99, 8) AS linear, round((0.01 + (sqrt(0.02) - 0.01) * t / 99) ** 2, 8) AS quad, 0.02 AS const, round(1 / (100 - t), 8) AS jsd, round(0.0001 + 0.0199 / (1 + exp(-(-6 + 12 * t / 99))), 8) AS sigmoid,
round(least(1 - cos(((t + 1) / 100 + 0.008) / 1.008 * pi() / 2) ** 2 / cos((t / 100 + 0.008) / 1.008 * pi() / 2) ** 2, 0.999), 8) AS cosine, round(1 - exp(-0.0001 / 100 - 0.5 * 0.0199 * (2 * (t + 1) - 1) / 10000), 8) AS continuous FROM s""", "telemetry")
def f10(spark, sf):
    t = (F.col("step") % 100).cast("double")
    return X.telemetry(spark, sf).select("run", "step", *[r(S.beta(k, t, 100), 8).alias(k) for k in ("linear", "quad", "const", "jsd", "sigmoid", "cosine", "continuous")])


@query("f10b_kept_share", """, b AS (SELECT run, step, ln(1 - (0.0001 + 0.0199 * (step - 1) / 99)) AS l FROM telemetry WHERE step <= 100) SELECT run, step, round(exp(sum(l) OVER (PARTITION BY run ORDER BY step)), 6) AS kept FROM b""", "telemetry")
def f10b(spark, sf):
    t = X.telemetry(spark, sf).where("step <= 100").select("run", "step", F.log(1 - S.beta("linear", F.col("step") - 1, 100)).alias("l"))
    return t.select("run", "step", r(F.exp(F.expr("sum(l) over (partition by run order by step)"))).alias("kept"))


@query("f11_noising", f", {_PAIR} SELECT id, list_transform(list_zip(a, b), lambda z: round(sqrt(0.7) * z[1] + sqrt(1 - 0.7) * z[2], 6)) AS x FROM pair", "features")
def f11(spark, sf):
    return pair(spark, sf).select("id", rs(S.noised(F.col("a"), F.col("b"), F.lit(0.7))).alias("x"))


@query("f12_crops", "SELECT idx, (width - least(width, height)) // 2 AS crop_left, (height - least(width, height)) // 2 AS crop_top, least(width, height) AS side, CASE WHEN width < 64 OR round(32 * width / 64.0) < 32 OR round(32 * width / 64.0) > height THEN NULL ELSE round(32 * width / 64.0)::INT END AS crop_rows, round(sqrt(width * height * 0.5 * 1.5))::INT AS w FROM manifest", "manifest")
def f12(spark, sf):
    w, h = F.col("width"), F.col("height")
    m = X.manifest(spark, sf).withColumns({"c": S.center_crop(w, h), "s": S.crop_size(w * h, F.lit(0.5), F.lit(1.5))})
    return m.select("idx", F.col("c.left").alias("crop_left"), F.col("c.top").alias("crop_top"), F.col("c.side").alias("side"), S.wide_crop(w, h, 64, 32).alias("crop_rows"), F.col("s.w").alias("w"))


@query("f13_block_size", "SELECT idx, least(round(sqrt(floor(196 * (0.15 + idx % 5 * 0.01)) * (0.75 + idx % 4 * 0.25))), 13)::INT AS h, least(round(sqrt(floor(196 * (0.15 + idx % 5 * 0.01)) / (0.75 + idx % 4 * 0.25))), 13)::INT AS w FROM manifest", "manifest")
def f13(spark, sf):
    b = S.block_size(14, 14, 0.15 + F.col("idx") % 5 * 0.01, 0.75 + F.col("idx") % 4 * 0.25)
    return X.manifest(spark, sf).select("idx", b.alias("b")).select("idx", "b.h", "b.w")


@query("f14_paths", "SELECT idx, lower(regexp_extract(path, '(\\.[^.]*)$', 1)) AS ext, regexp_replace(split_part(path, '/', 3), '\\.[^.]*$', '') AS stem, split_part(path, '/', 3) AS base, CASE WHEN starts_with(path, 'src0/') THEN substr(path, 6) ELSE path END AS rel, path AS slashed FROM manifest", "manifest")
def f14(spark, sf):
    p = F.col("path")
    return X.manifest(spark, sf).select("idx", S.extension(p).alias("ext"), S.stem(p).alias("stem"), S.basename(p).alias("base"), S.relative(p, "src0").alias("rel"), S.slashes(F.replace(p, F.lit("/"), F.lit("\\"))).alias("slashed"))


@query("f15_parsing", "SELECT idx, CASE WHEN idx % 3 < 2 THEN [width, height] END AS size, CASE WHEN idx % 5 = 0 THEN []::VARCHAR[] ELSE [class, 'x'] END AS items FROM manifest", "manifest")
def f15(spark, sf):
    sep = F.when(F.col("idx") % 3 == 0, "x").when(F.col("idx") % 3 == 1, ",").otherwise("*")
    text = F.when(F.col("idx") % 5 == 0, "None").otherwise(F.concat("class", F.lit(",x")))
    return X.manifest(spark, sf).select("idx", S.parse_size(F.concat(F.col("width").cast("string"), sep, F.col("height").cast("string"))).alias("size"), S.parse_list(text).alias("items"))


@query("f16_padded", "SELECT idx, lpad(idx::VARCHAR, 8, '0') AS padded, lpad((idx % 100)::VARCHAR, 5, '0') || '-' || class AS dir FROM manifest", "manifest")
def f16(spark, sf):
    return X.manifest(spark, sf).select("idx", S.zero_padded(F.col("idx"), 8).alias("padded"), S.run_dir(F.col("idx") % 100, F.col("class")).alias("dir"))


@query("f17_duration", """, s AS (SELECT id, round(runtime_s)::BIGINT AS s FROM runs) SELECT id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' WHEN s < 86400 THEN (s // 3600) || 'h ' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE (s // 86400) || 'd ' || lpad((s // 3600 % 24)::VARCHAR, 2, '0') || 'h ' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || 'm' END AS took FROM s""", "runs")
def f17(spark, sf):
    return X.runs(spark, sf).select("id", S.duration(F.col("runtime_s")).alias("took"))


@query("f18_args_key", "SELECT class, count(*) AS n, md5('{\"class\":\"' || class || '\",\"n\":' || count(*) || '}') AS key FROM manifest GROUP BY class", "manifest")
def f18(spark, sf):
    return X.manifest(spark, sf).groupBy("class").agg(F.count(F.lit(1)).alias("n")).withColumn("key", S.args_key_of("n", "class"))


@query("f19_math", "SELECT run, step, round(10 * log10(value), 6) AS db, greatest(0, least(255, floor(value * 10 + 0.5)))::INT AS u8, bit_count(n) = 1 AS pow2 FROM telemetry", "telemetry")
def f19(spark, sf):
    return X.telemetry(spark, sf).select("run", "step", r(S.decibels(F.col("value"))).alias("db"), S.clip_uint8(F.col("value") * 10).alias("u8"), S.is_power_of_two(F.col("n")).alias("pow2"))


@query("f20_maps", "SELECT id, 'run/' || k AS key, v AS value FROM (SELECT id, unnest(['dataset', 'state']) AS k, unnest([dataset, state]) AS v FROM runs)", "runs")
def f20(spark, sf):
    m = F.create_map(F.lit("dataset"), F.col("dataset"), F.lit("state"), F.col("state"), F.lit("_private"), F.col("name"))
    return X.runs(spark, sf).select("id", F.explode(S.prefixed(S.public_keys(m), "run/")))


@query("f21_positions", "SELECT image, y, x, list_transform([cos(y), cos(y * 0.01), sin(y), sin(y * 0.01)], lambda v: round(v, 6)) AS step, list_transform([sin(y), sin(y * 0.01), cos(y), cos(y * 0.01), sin(x), sin(x * 0.01), cos(x), cos(x * 0.01)], lambda v: round(v, 6)) AS grid FROM pixels", "features pixels")
def f21(spark, sf):
    y, x = F.col("y"), F.col("x")
    return X.pixels(spark, sf).select("image", "y", "x", rs(S.step_features(y, 4)).alias("step"), rs(S.grid_features(y, x, 8)).alias("grid"))


@query("f22_bits", "SELECT id, list_sum(list_transform(generate_series(1, 10), lambda i: CASE WHEN z[i] > 0 THEN 1 << (i - 1) ELSE 0 END))::BIGINT AS packed, list_transform(z, lambda v: v > 0) AS flags FROM logits", "features logits")
def f22(spark, sf):
    bits = X.logits(spark, sf).select("id", S.pack(F.transform("z", lambda v: v > 0)).alias("packed"))
    return bits.select("id", "packed", S.unpack(F.col("packed"), 10).alias("flags"))
