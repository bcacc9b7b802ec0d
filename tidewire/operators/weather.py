"""Weather payloads: forecasts of parallel arrays into rows, warnings, bands and moon phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Fixed value: days of a synodic month.
SYNODIC = 29.530588853
FORECAST = "current struct<time string, temperature_2m double, weather_code int, wind_speed_10m double>, hourly struct<time array<string>, temperature_2m array<double>, precipitation_probability array<double>, weather_code array<int>>, daily struct<time array<string>, temperature_2m_max array<double>, temperature_2m_min array<double>, precipitation_sum array<double>>, minutely_15 struct<time array<string>, precipitation array<double>>"
WARNINGS = "alerts struct<alert array<struct<event string, headline string, severity string, areas string, effective string, expires string>>>"


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding with halves up, also below zero."""
    p = 10**digits
    return F.floor(x * p + 0.5) / p


def forecast_hours(payloads: DataFrame, ahead: int = 48) -> DataFrame:
    """place, step, time, temp, rain_chance, code: the hours from the place's own now on, at most ``ahead``."""
    j = payloads.select("place", F.from_json("json", FORECAST).alias("j")).where(F.col("j.current.temperature_2m").isNotNull())
    rows = j.select("place", F.col("j.current.time").alias("now"), F.explode(F.arrays_zip(F.col("j.hourly.time").alias("time"), F.col("j.hourly.temperature_2m").alias("temp"), F.col("j.hourly.precipitation_probability").alias("rain"), F.col("j.hourly.weather_code").alias("code"))).alias("h"))
    coming = rows.where(F.col("h.time") >= F.col("now")).withColumn("step", F.row_number().over(W.partitionBy("place").orderBy("h.time")))
    return coming.where(F.col("step") <= ahead).select("place", "step", "h.time", half_up(F.col("h.temp")).alias("temp"), F.col("h.rain").alias("rain_chance"), F.coalesce("h.code", F.lit(-1)).alias("code"))


def forecast_days(payloads: DataFrame) -> DataFrame:
    """place, date, high, low, rain of each forecast day."""
    j = payloads.select("place", F.from_json("json", FORECAST).alias("j"))
    return j.select("place", F.explode(F.arrays_zip(F.col("j.daily.time").alias("date"), F.col("j.daily.temperature_2m_max").alias("high"), F.col("j.daily.temperature_2m_min").alias("low"), F.col("j.daily.precipitation_sum").alias("rain"))).alias("d")).select("place", "d.date", half_up(F.col("d.high")).alias("high"), half_up(F.col("d.low")).alias("low"), half_up(F.col("d.rain"), 2).alias("rain"))


def rain_steps(payloads: DataFrame, steps: int = 12) -> DataFrame:
    """place, step, time, rain: quarter hours from the current one on."""
    j = payloads.select("place", F.from_json("json", FORECAST).alias("j"))
    rows = j.select("place", F.col("j.current.time").alias("now"), F.explode(F.arrays_zip(F.col("j.minutely_15.time").alias("time"), F.col("j.minutely_15.precipitation").alias("rain"))).alias("m"))
    each = W.partitionBy("place").orderBy("m.time")
    open_ = rows.withColumn("next", F.lead("m.time").over(each)).where(F.col("next").isNull() | (F.col("next") > F.col("now")))
    return open_.withColumn("step", F.row_number().over(each)).where(F.col("step") <= steps).select("place", "step", "m.time", "m.rain")


def warnings(payloads: DataFrame) -> DataFrame:
    """place, rank, event, severity, areas, expires: each warning once, the severest first."""
    j = payloads.select("place", F.from_json("json", WARNINGS).alias("j")).select("place", F.posexplode("j.alerts.alert").alias("pos", "a")).select("place", "pos", "a.*")
    clip = lambda c, n: F.left(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), F.lit(n))
    event = F.coalesce(F.nullif(clip("event", 120), F.lit("")), clip("headline", 120))
    rows = j.select("place", "pos", event.alias("event"), clip("severity", 30).alias("severity"), clip("areas", 300).alias("areas"), clip("expires", 40).alias("expires")).where("event <> ''")
    firsts = rows.withColumn("_n", F.row_number().over(W.partitionBy("place", "event", "areas", "expires").orderBy("pos"))).where("_n = 1")
    order = F.when(F.lower("severity") == "extreme", 4).when(F.lower("severity") == "severe", 3).when(F.lower("severity") == "moderate", 2).when(F.lower("severity") == "minor", 1).otherwise(0)
    return firsts.select("place", F.row_number().over(W.partitionBy("place").orderBy(order.desc(), "pos")).alias("rank"), "event", "severity", "areas", "expires")


def warning_level(event: Column, severity: Column) -> Column:
    """'red', 'amber' or null of an official warning."""
    red = event.rlike(r"(?i)\b(?:flash flood|tornado|hurricane|tsunami|storm surge|extreme wind|severe thunderstorm|blizzard|ice storm) warning\b")
    return F.when(red | severity.rlike("(?i)^extreme$"), "red").when(event.rlike(r"(?i)\b(?:warning|emergency)\b") & severity.rlike("(?i)^severe$"), "amber")


def air_band(aqi: Column) -> Column:
    """The name of an air quality index."""
    return F.when(aqi.isNull(), "").when(aqi <= 50, "Good").when(aqi <= 100, "Moderate").when(aqi <= 150, "Unhealthy for sensitive groups").when(aqi <= 200, "Unhealthy").when(aqi <= 300, "Very unhealthy").otherwise("Hazardous")


def compass(degrees: Column) -> Column:
    """One of sixteen points."""
    points = F.array(*[F.lit(p) for p in "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()])
    return F.when(degrees.isNotNull(), F.get(points, F.pmod(F.floor(degrees / 22.5 + 0.5), F.lit(16)).cast("int")))


def moon_phase(ms: Column) -> Column:
    """Struct of the moon's age in days and its lit share at an epoch time (new moon of 2000-01-06 18:14 UTC)."""
    days = F.pmod((ms - 947_182_440_000) / 86_400_000.0, F.lit(SYNODIC))
    return F.struct(F.round(days, 4).alias("age"), F.round((1 - F.cos(2 * F.pi() * days / SYNODIC)) / 2, 4).alias("lit"))


def longest_run(hours: DataFrame, good: Column) -> DataFrame:
    """place, first_step, n: the longest unbroken run of hours that satisfy ``good``, the first of equal ones."""
    marked = hours.where(good).withColumn("island", F.col("step") - F.row_number().over(W.partitionBy("place").orderBy("step")))
    runs = marked.groupBy("place", "island").agg(F.min("step").alias("first_step"), F.count(F.lit(1)).alias("n"))
    return runs.withColumn("_r", F.row_number().over(W.partitionBy("place").orderBy(F.desc("n"), "first_step"))).where("_r = 1").select("place", "first_step", "n")

#: Fixed value: what makes a headline weather news.
WEATHER_WORDS = r"(?i)\b(?:flash flood|flood(?:ed|ing|s)?|hurricane|tropical storm|tornado|storm surge|severe storm|thunderstorms?|heavy rain|downpour|rainfall|waterspout|wildfire|heat wave|blizzard|weather)\b"


def official_coverage(warned: DataFrame, stories: DataFrame, now_ms: int, within_ms: int = 21_600_000) -> DataFrame:
    """place, event, level, ord, rank: local weather stories of the last hours that name a warned area, pictures first.

    ``warned`` are rows of `warnings` (a short official list); areas are split at ';' and ','.
    """
    level = warning_level(F.col("event"), F.col("severity"))
    areas = warned.select("place", "event", level.alias("level"), F.explode(F.split("areas", "[;,]")).alias("area")).where("level IS NOT NULL")
    named = areas.withColumn("area", F.lower(F.trim(F.regexp_replace(F.regexp_replace("area", r"\b[A-Z]{2}\b", ""), r"(?i)\b(?:county|inland|coastal|metro|western|eastern|northern|southern)\b", "")))).where(F.length("area") > 3).distinct()
    local = stories.where((F.col("feed_id") == "local") & F.coalesce("title", F.lit("")).rlike(WEATHER_WORDS) & (F.lit(now_ms) - F.coalesce("ts", F.lit(0)) <= within_ms))
    words = local.select("ord", "ts", (F.coalesce("image_url", F.lit("")) != "").cast("int").alias("pictured"), F.lower(F.concat_ws(" ", "title", "descr")).alias("said"), F.explode(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "title", "descr")), r"[^\p{L}\p{N}]+"))).alias("first"))
    # areas and stories meet on the area's first word, then the whole name is looked up
    met = named.withColumn("first", F.regexp_extract("area", r"^([\p{L}\p{N}]+)", 1)).join(words, "first").where(F.contains("said", F.col("area")))
    each = met.groupBy("place", "event", "level", "ord").agg(F.max("pictured").alias("pictured"), F.max("ts").alias("ts"))
    return each.withColumn("rank", F.row_number().over(W.partitionBy("place", "event").orderBy(F.desc("pictured"), F.desc("ts"), "ord"))).select("place", "event", "level", "ord", "rank")

AIR = "current struct<us_aqi double, pm2_5 double, alder_pollen double, birch_pollen double, grass_pollen double, mugwort_pollen double, olive_pollen double, ragweed_pollen double>"
MARINE = "now string, forecast struct<forecastday array<struct<hour array<struct<time string, sig_ht_mt double, swell_ht_ft double, swell_dir double, swell_period_secs double, water_temp_f double>>>>>"
RADAR = "radar struct<past array<struct<time bigint, path string>>, nowcast array<struct<time bigint, path string>>>"
#: The pollen kinds of the air payload.
POLLEN = ("alder", "birch", "grass", "mugwort", "olive", "ragweed")


def pollen(payloads: DataFrame) -> DataFrame:
    """place, rank, kind, grains: pollen above zero, most first; nothing where nothing is measured."""
    j = payloads.select("place", F.from_json("json", AIR).alias("j"))
    each = j.select("place", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), half_up(F.col(f"j.current.{k}_pollen")).alias("grains")) for k in POLLEN])).alias("p")).select("place", "p.*").where("grains > 0")
    return each.select("place", F.row_number().over(W.partitionBy("place").orderBy(F.desc("grains"), "kind")).alias("rank"), "kind", "grains")


def marine(payloads: DataFrame) -> DataFrame:
    """place, wave_ft, swell_ft, swell_from, period_s, water_f of the place's current hour, else its first."""
    j = payloads.select("place", F.from_json("json", MARINE).alias("j"))
    hours = F.coalesce(F.get(F.col("j.forecast.forecastday"), F.lit(0))["hour"], F.expr("array()").cast("array<struct<time string, sig_ht_mt double, swell_ht_ft double, swell_dir double, swell_period_secs double, water_temp_f double>>"))
    want = F.left(F.replace(F.coalesce("j.now", F.lit("")), F.lit("T"), F.lit(" ")), F.lit(13))
    h = F.coalesce(F.get(F.filter(hours, lambda x: F.left(x["time"], F.lit(13)) == want), F.lit(0)), F.get(hours, F.lit(0)))
    rows = j.select("place", h.alias("h")).where("h.sig_ht_mt IS NOT NULL OR h.swell_ht_ft IS NOT NULL OR h.water_temp_f IS NOT NULL")
    return rows.select("place", half_up(F.col("h.sig_ht_mt") * 3.28084, 1).alias("wave_ft"), half_up(F.col("h.swell_ht_ft"), 1).alias("swell_ft"), compass(F.col("h.swell_dir")).alias("swell_from"), half_up(F.col("h.swell_period_secs"), 1).alias("period_s"), half_up(F.col("h.water_temp_f")).alias("water_f"))


def radar_frames(payloads: DataFrame, most: int = 10) -> DataFrame:
    """place, step, ms, path: every other valid frame counted back from the newest of the past and of the forecast, the last ``most``."""
    j = payloads.select("place", F.from_json("json", RADAR).alias("j"))
    parts = j.select("place", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("j.radar.past").alias("frames")), F.struct(F.lit(1).alias("part"), F.col("j.radar.nowcast").alias("frames")))).alias("p"))
    good = parts.select("place", "p.part", F.posexplode(F.filter("p.frames", lambda f: f["time"].isNotNull() & f["path"].rlike(r"^/[A-Za-z0-9/_-]+$"))).alias("at", "f"))
    back = good.withColumn("back", F.row_number().over(W.partitionBy("place", "part").orderBy(F.desc("at")))).where(F.col("back") % 2 == 1)
    last = back.withColumn("r", F.row_number().over(W.partitionBy("place").orderBy(F.desc("part"), "back"))).where(F.col("r") <= most)
    return last.select("place", F.row_number().over(W.partitionBy("place").orderBy("part", "at")).alias("step"), (F.col("f.time") * 1000).alias("ms"), F.col("f.path").alias("path"))


def nowcast(steps: DataFrame, wet: float = 0.002) -> DataFrame:
    """place, text: the next hours of rain in words from `rain_steps`; no row without measurements or with one step."""
    start = F.min(F.to_timestamp("time")).over(W.partitionBy("place"))
    s = steps.withColumn("ahead", ((F.unix_timestamp(F.to_timestamp("time")) - F.unix_timestamp(start)) / 60).cast("int")).withColumn("wet", F.coalesce(F.col("rain") >= wet, F.lit(False)))
    g = s.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.count("rain").alias("known"), (F.max("ahead") + 15).alias("horizon"), F.min_by("wet", "step").alias("now"), F.min(F.when(F.col("wet"), F.col("ahead"))).alias("starts"), F.min(F.when(~F.col("wet"), F.col("ahead"))).alias("stops"))
    hours = lambda m: half_up(m / 60.0 * 2) / 2
    span = lambda m: F.when(m < 60, F.concat(m.cast("string"), F.lit(" minutes"))).when(hours(m) == 1, "1 hour").otherwise(F.concat(F.regexp_replace(hours(m).cast("string"), r"\.0$", ""), F.lit(" hours")))
    text = (
        F.when(F.col("starts").isNull(), F.concat(F.lit("No rain expected for the next "), span(F.col("horizon")), F.lit(".")))
        .when(F.col("now") & F.col("stops").isNull(), F.concat(F.lit("Raining, and it should continue for at least "), span(F.col("horizon")), F.lit(".")))
        .when(F.col("now"), F.concat(F.lit("Raining now, easing in about "), span(F.col("stops")), F.lit(".")))
        .otherwise(F.concat(F.lit("Rain likely in about "), span(F.col("starts")), F.lit(".")))
    )
    return g.where("n > 1 AND known > 0").select("place", text.alias("text"))


def normal_high(days: DataFrame, years: int = 5, least: int = 3) -> DataFrame:
    """place, date, normal, n: the mean high of the same calendar day in the ``years`` before; at least ``least`` of them known.

    ``days``: place, date (text), high.
    """
    d = days.select("place", "date", F.left("date", F.lit(4)).try_cast("int").alias("y"), F.substring("date", 6, 5).alias("md"), "high")
    past = d.where("high IS NOT NULL").select(F.col("place"), F.col("md"), F.col("y").alias("py"), F.col("high").alias("ph"))
    met = d.select("place", "date", "y", "md").join(past, ["place", "md"]).where((F.col("py") < F.col("y")) & (F.col("py") >= F.col("y") - years))
    return met.groupBy("place", "date").agg(half_up(F.avg("ph")).alias("normal"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
