"""Single-purpose engines: episode search, relative strength, triggers, Monte Carlo scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.alignment import reindex_ffill
from tidemark.operators.thinning import greedy_thin, thin_positions
from tidemark.operators.windows import position, rolling, series, trailing, with_streak
from tidemark.plans.outcomes import forward_paths
from tidemark.plans.technicals import swing_lows, tail_rank, up_down_volume


def annotate_episodes(episodes: DataFrame, library: DataFrame) -> DataFrame:
    """episodes (symbol, date) with cause and annotated from the library (asset, event_date, cause)."""
    lib = library.select(F.col("asset").alias("symbol"), F.col("event_date").alias("date"), "cause")
    return episodes.join(lib, ["symbol", "date"], "left").withColumn("annotated", F.col("cause").isNotNull())


def handoff_text(annotated: DataFrame) -> DataFrame:
    """symbol, prompt: the dates that still need a cause."""
    days = annotated.where("not annotated").groupBy("symbol").agg(F.sort_array(F.collect_list(F.date_format("date", "yyyy-MM-dd"))).alias("d"))
    return days.select("symbol", F.concat(F.lit("Explain these dates of "), "symbol", F.lit(": "), F.array_join("d", ", ")).alias("prompt"))


def find_analogs(bars: DataFrame, dd_band: float = 0.06, ext_band: float = 0.05, gap: int = 126, horizon: int = 126) -> DataFrame:
    """symbol, date, worst, days_to_trough, fwd: earlier days whose drawdown and extension are near the last day's, trend intact.

    A day without a whole horizon ahead is skipped before thinning.
    """
    x = bars.withColumn("pos", position()).withColumn("dd", F.col("close") / rolling(F.max, "close", 252, 60) - 1)
    x = x.withColumn("ma200", rolling(F.avg, "close", 200)).withColumn("ext", F.col("close") / F.col("ma200") - 1)
    x = x.withColumn("intact", F.col("ma200") >= F.lag("ma200", 20).over(series())).withColumn("fwd", F.lead("close", horizon).over(series()) / F.col("close") - 1)
    x = x.withColumn("back", tail_rank())
    now = x.where("back = 1").select("symbol", F.col("dd").alias("dd0"), F.col("ext").alias("ext0"))
    hit = x.join(now, "symbol").where((F.abs(F.col("dd") - F.col("dd0")) <= dd_band) & (F.abs(F.col("ext") - F.col("ext0")) <= ext_band) & F.col("intact") & F.col("fwd").isNotNull())
    kept = greedy_thin(hit, gap, ["symbol"])
    paths = forward_paths(bars, horizon, 5).select("symbol", "date", "worst", "days_to_trough")
    return hit.join(kept, ["symbol", "pos"]).join(paths, ["symbol", "date"]).select("symbol", "date", "worst", "days_to_trough", "fwd")


def relative_strength(bars: DataFrame, bench: DataFrame, windows=(5, 10, 20, 40, 63, 126)) -> DataFrame:
    """symbol, win, current, pct (share of the history strictly below, the last included in the history), z, state: the last day's reading."""
    j = bars.join(bench, "date").withColumn("rel", F.ln("close") - F.ln("bench"))
    parts = F.array(*[F.struct(F.lit(n).alias("win"), (F.col("rel") - F.lag("rel", n).over(series())).alias("r")) for n in windows])
    x = j.withColumn("p", parts).select("symbol", "date", F.explode("p").alias("p")).select("symbol", "date", "p.win", "p.r").where("r is not null")
    last = F.last("r").over(W.partitionBy("symbol", "win").orderBy("date").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    g = x.withColumn("cur", last).groupBy("symbol", "win").agg(
        F.count(F.lit(1)).alias("n"), F.first("cur").alias("current"), (F.avg(F.when(F.col("r") < F.col("cur"), 1.0).otherwise(0.0)) * 100).alias("pct"),
        ((F.first("cur") - F.avg("r")) / (F.stddev_samp("r") + 1e-9)).alias("z"),
    )
    return g.where("n >= 60").withColumn("state", S.percentile_state(F.col("pct")))


def most_extreme_hot(rs: DataFrame) -> DataFrame:
    """symbol, win: the highest percentile; the shorter window on ties."""
    r = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("pct"), "win"))
    return rs.withColumn("r", r).where("r = 1 and pct >= 75").select("symbol", "win", "pct")


def resolution(bars: DataFrame, bench: DataFrame, win: int = 20, horizon: int = 40, spacing: int = 40) -> DataFrame:
    """symbol, n, fell: of past extremes (at or above the 0.9 quantile of the history without today), how many were lower after the horizon."""
    j = bars.join(bench, "date").withColumn("rel", F.ln("close") - F.ln("bench")).withColumn("pos", position())
    x = j.withColumn("r", F.col("rel") - F.lag("rel", win).over(series())).withColumn("later", F.lead("rel", horizon).over(series()) - F.col("rel")).withColumn("back", tail_rank())
    cut = x.where("back > 1 and r is not null").groupBy("symbol").agg(F.percentile("r", 0.9).alias("cut"))
    hit = x.join(cut, "symbol").where("r >= cut and later is not null and back > 1")
    kept = greedy_thin(hit, spacing, ["symbol"])
    return hit.join(kept, ["symbol", "pos"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("later") < 0, 1)).alias("fell"))


def verdict_triggers(bars: DataFrame, bench: DataFrame, troughs: DataFrame | None = None) -> DataFrame:
    """symbol, id, direction, threshold, current, met: ten conditions of each symbol's last row that would raise or lower a verdict.

    troughs: symbol, q25 (a share) of simulated troughs; without them that trigger has no threshold and isn't met.
    """
    w = series()
    x = reindex_ffill(bars, bench, "bench").withColumn("back", tail_rank())
    x = x.withColumn("ma20", rolling(F.avg, "close", 20)).withColumn("ma200", rolling(F.avg, "close", 200)).withColumn("hi", rolling(F.max, "close", 252, 60))
    x = with_streak(x, F.col("close") >= F.col("ma20"), "streak").join(up_down_volume(bars), ["symbol", "date"])
    x = x.withColumn("slope", F.col("ma200") - F.lag("ma200", 20).over(w)).withColumn("r1", F.col("close") / F.lag("close").over(w) - 1)
    x = x.withColumn("vol", rolling(F.stddev_samp, "r1", 20)).withColumn("vol_before", F.lag("vol", 10).over(w))
    x = x.withColumn("rel", F.ln("close") - F.ln("bench")).withColumn("short", F.col("rel") - F.lag("rel", 10).over(w)).withColumn("long", F.col("rel") - F.lag("rel", 100).over(w))
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("low", F.when(F.col("short") <= F.min("short").over(so_far), position()))
    x = x.withColumn("quiet", F.when(F.count("short").over(so_far) > 10, position() - F.max("low").over(so_far)).otherwise(0))
    low20 = lambda c: F.col(c) <= F.min(c).over(trailing(20))
    x = x.withColumn("breaks", low20("close") & ~low20("bench"))
    x = x.withColumn("long_low", (F.count("long").over(trailing(126)) >= 126) & (F.col("long") <= F.min("long").over(trailing(126))))
    lows = swing_lows(bars)
    x = x.where("back = 1").join(lows.where("rk = 1").select("symbol", F.col("low").alias("latest")), "symbol", "left").join(lows.where("rk = 2").select("symbol", F.col("low").alias("prior")), "symbol", "left")
    x = x.withColumn("latest", F.when(F.col("prior").isNotNull(), F.col("latest")))
    x = x.join(troughs.select("symbol", "q25"), "symbol", "left") if troughs is not None else x.withColumn("q25", F.lit(None).cast("double"))
    number = lambda c: (F.lit(float(c)) if isinstance(c, (int, float)) else c.cast("double"))
    t = lambda name, way, limit, cur, met: F.struct(F.lit(name).alias("id"), F.lit(way).alias("direction"), number(limit).alias("threshold"), number(cur).alias("current"), F.coalesce(met, F.lit(False)).alias("met"))
    c, ratio, dd = F.col, F.col("ratio"), F.col("close") / F.col("hi") - 1
    rows = F.array(
        t("above_ma20_3d", "upgrade", 3, c("streak"), c("streak") >= 3), t("higher_swing_low", "upgrade", c("prior"), c("latest"), c("latest") > c("prior")),
        t("rs_short_stops_new_lows", "upgrade", 5, c("quiet"), c("quiet") >= 5), t("updown_vol_ratio_above_1.2", "upgrade", 1.2, ratio, ratio >= 1.2),
        t("vol20d_falling_above_low", "upgrade", c("vol_before"), c("vol"), (c("vol") < c("vol_before")) & (c("close") >= c("latest"))),
        t("new_low_benchmark_holds", "downgrade", 1, F.when(c("breaks"), 1).otherwise(0), c("breaks")), t("ma200_slope_negative", "downgrade", 0, c("slope"), c("slope") < 0),
        t("updown_vol_ratio_below_0.6_falling", "downgrade", 0.6, ratio, (ratio < 0.6) & (ratio < c("ratio_5_ago"))), t("drawdown_beyond_mc_p25", "downgrade", c("q25"), dd, dd < c("q25")),
        t("rs_long_new_6mo_low", "downgrade", 1, F.when(c("long_low"), 1).otherwise(0), c("long_low")),
    )
    return x.select("symbol", F.explode(rows).alias("t")).select("symbol", "t.*")


def weighted_quantile(values: DataFrame, by: list[str], q: float) -> DataFrame:
    """values (by..., v, w) -> by, value: the least v whose cumulative weight reaches q of the total."""
    order = W.partitionBy(*by).orderBy("v").rangeBetween(W.unboundedPreceding, 0)
    x = values.withColumn("c", F.sum("w").over(order)).withColumn("t", F.sum("w").over(W.partitionBy(*by)))
    return x.where(F.col("c") >= q * F.col("t") - 1e-12).groupBy(*by).agg(F.min("v").alias("value"))


def bottom_scenarios(bars: DataFrame, sims: int = 2000, days: int = 63, block: int = 5, seed: int = 42) -> DataFrame:
    """symbol, sim, trough, last: block-bootstrap paths of each symbol's daily returns from its last close.

    Draws are hashes of (seed, symbol, simulation, block), so they don't depend on partitioning. One row of
    returns per symbol meets sims * days / block draws, each of which takes a slice of it.
    """
    r = bars.withColumn("r", F.ln("close") - F.ln(F.lag("close").over(series()))).where("r is not null")
    hist = r.groupBy("symbol").agg(F.transform(F.sort_array(F.collect_list(F.struct("date", "r"))), lambda s: s["r"]).alias("h")).where(F.size("h") > block)
    draws = hist.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(-(-days // block) - 1))))
    at = F.pmod(F.xxhash64(F.lit(seed), "symbol", "sim", "k"), F.size("h") - block + 1)
    parts = draws.select("symbol", "sim", "k", F.slice("h", (at + 1).cast("int"), F.lit(block)).alias("s"))
    path = parts.groupBy("symbol", "sim").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))), lambda p: p["s"])).alias("l"))
    path = path.withColumn("l", F.slice("l", 1, days))
    run = F.aggregate("l", F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("m")), lambda a, v: F.struct((a["x"] + v).alias("x"), F.least(a["m"], a["x"] + v).alias("m")))
    return path.withColumn("e", run).select("symbol", "sim", (F.exp("e.m") - 1).alias("trough"), (F.exp("e.x") - 1).alias("last"))


def dip_states(bars: DataFrame, days: int = 63, threshold: float = -0.10, tolerance: float = 0.06, gap: int = 21, least: int = 120) -> DataFrame:
    """symbol, available (a drawdown of the threshold now, and enough rows), current_dd, price, returns (daily), episodes
    (complete paths of `days` cumulative returns after earlier days of a comparable drawdown, gap rows apart), n_episodes, w_history."""
    x = bars.select("symbol", "date", "close").withColumn("pos", position()).withColumn("dd", F.col("close") / rolling(F.max, "close", 252, 60) - 1)
    x = x.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("pos", "close", "dd"))).alias("l"))
    last = F.element_at("l", -1)
    x = x.select("symbol", "l", F.size("l").alias("rows"), last["dd"].alias("current_dd"), last["close"].alias("price"), F.transform("l", lambda r: r["close"]).alias("c"))
    x = x.withColumn("available", F.coalesce((F.col("rows") >= least) & (F.col("current_dd") <= threshold), F.lit(False)))
    near = F.filter("l", lambda r: (F.abs(r["dd"] - F.col("current_dd")) <= tolerance) & (r["pos"] + days < F.col("rows")))
    kept = F.when(F.col("available"), thin_positions(F.transform(near, lambda r: r["pos"].cast("bigint")), gap))
    after = lambda p: F.transform(F.slice("c", (p + 2).cast("int"), F.lit(days)), lambda v: v / F.element_at("c", (p + 1).cast("int")) - 1)
    steps = F.when(F.col("available"), F.transform(F.slice("c", F.lit(2), F.greatest(F.col("rows") - 1, F.lit(0))), lambda v, i: v / F.element_at("c", i + 1) - 1))
    x = x.withColumn("episodes", F.transform(kept, after)).withColumn("returns", steps).withColumn("n_episodes", F.when(F.col("available"), F.size("episodes")))
    return x.select("symbol", "available", "current_dd", "price", "returns", "episodes", "n_episodes", S.scenario_confidence(F.col("n_episodes")).alias("w_history"))


def _draw_paths(states: DataFrame, sims: int, history: Column, days: int, block: int, seed: int, tag: str) -> DataFrame:
    """symbol, sim, branch, path: draws of an episode where history holds, else of blocks of daily returns, compounded."""
    x = states.where("available").withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1)))).withColumn("of_history", history)
    draw = lambda k, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), "symbol", "sim", k), n)
    episode = F.element_at("episodes", (draw(F.lit(-1), F.size("episodes")) + 1).cast("int"))
    room = F.greatest(F.size("returns") - block, F.lit(1))
    parts = F.transform(F.sequence(F.lit(0), F.lit(-(-days // block) - 1)), lambda k: F.slice("returns", (draw(k, room) + 1).cast("int"), F.lit(block)))
    start = F.struct(F.lit(1.0).alias("x"), F.array().cast("array<double>").alias("p"))
    grow = lambda a, v: F.struct((a["x"] * (1 + v)).alias("x"), F.concat(a["p"], F.array(a["x"] * (1 + v) - 1)).alias("p"))
    blocks = F.aggregate(F.slice(F.flatten(parts), 1, days), start, grow, lambda a: a["p"])
    path = F.when(F.col("of_history"), episode).otherwise(blocks)
    return x.select("symbol", "sim", F.when(F.col("of_history"), "history").otherwise("break").alias("branch"), path.alias("path"))


def scenario_paths(states: DataFrame, sims: int = 2000, days: int = 63, block: int = 5, seed: int = 42) -> DataFrame:
    """symbol, sim, branch, path, trough of symbols in a dip: the share w_history resamples past episodes, the rest is a block bootstrap.

    Draws are hashes, so they don't depend on partitioning.
    """
    paths = _draw_paths(states, sims, F.col("sim") < F.bround(F.lit(float(sims)) * F.col("w_history")), days, block, seed, "mix")
    return paths.withColumn("trough", F.array_min("path"))


def fan_chart(paths: DataFrame) -> DataFrame:
    """symbol, day (from 1), p10 to p90 of the simulated returns."""
    x = paths.select("symbol", F.posexplode("path").alias("i", "v"))
    return x.groupBy("symbol", (F.col("i") + 1).alias("day")).agg(*[F.percentile("v", p / 100).alias(f"p{p}") for p in (10, 25, 50, 75, 90)])


def scenario_report(states: DataFrame, paths: DataFrame, days: int = 63, block: int = 5, seed: int = 42, pool: int = 600) -> DataFrame:
    """A row per symbol: available; in a dip also the trough statistics, a ladder of three tranches, and pure pools of each branch for the slider."""
    pools = {}
    for branch in ("history", "break"):
        p = _draw_paths(states, pool, (F.lit(branch == "history") & (F.col("n_episodes") > 0)), days, block, seed, branch)
        p = p.where(F.col("branch") == branch).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("sim", F.array_min("path").alias("t")))).alias("l"))
        pools[branch] = p.select("symbol", F.transform("l", lambda r: r["t"]).alias(f"{branch}_pool"))
    x = states.drop("returns", "episodes").join(trough_summary(paths), "symbol", "left").join(paths.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_sims")), "symbol", "left")
    x = x.join(pools["history"], "symbol", "left").join(pools["break"], "symbol", "left")
    empty = F.when(F.col("available"), F.array().cast("array<double>"))
    x = x.withColumn("history_pool", F.coalesce("history_pool", empty))
    rung = lambda n, pct, r: F.struct(F.lit(n).alias("tranche"), F.lit(pct).cast("int").alias("pctile"), r.alias("ret"), (F.col("price") * (1 + r)).alias("price"))
    return x.withColumn("ladder", F.when(F.col("available"), F.array(rung(1, None, F.lit(0.0)), rung(2, 25, F.col("q25")), rung(3, 10, F.col("q10")))))


def trough_summary(sims: DataFrame) -> DataFrame:
    return sims.groupBy("symbol").agg(
        F.avg(F.when(F.col("trough") >= -0.005, 1.0).otherwise(0.0)).alias("already_in"), F.percentile("trough", 0.5).alias("median"), F.percentile("trough", 0.1).alias("q10"), F.percentile("trough", 0.25).alias("q25")
    )
