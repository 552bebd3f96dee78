"""All queries of the engine and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import micros
from ..functions.rounding import rounded
from ..models.autoencoder import ConvAutoencoder
from ..models.forest import IsolationForest
from ..models.reconstruct import Reconstruction, validation_split, with_windows
from ..models.rules import RuleModel
from ..config import ForestSettings, ReconstructionSettings, ScalingSettings
from ..operators import chance, cycles, episodes, exploration, folds, intervals, ordered, rank, regimes, sampling, scaling
from ..schema import US_PER_DAY
from ..sources.telemetry import telemetry
from . import evaluation
from . import params as P
from .oracle import ORACLE_SQL

FLAGS = ["is_click", "is_error", "is_view"]
GAP = micros(P.FEATURES.gap)
SCALING = ScalingSettings(channels=("value",), passthrough=tuple(FLAGS), min_samples=10, active={"LOADED": ("value",), "OFFLOAD": ("value",), "STOPPED": ("value",), "TRANSITION": ()})


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return regimes.assign_regimes(telemetry(spark, d), P.REGIMES)


def scored(spark: SparkSession, d: str) -> DataFrame:
    """A plain score for episode queries: value / 100."""
    return telemetry(spark, d).withColumn("score", F.col("value") / 100)


def fold_plan() -> list[folds.Fold]:
    return folds.make_folds(P.EVENTS, P.WIDTHS, P.SPLIT, folds.at(P.DATA_START), folds.at(P.DATA_END))


def fold_df(spark: SparkSession) -> DataFrame:
    return folds.fold_table(spark, fold_plan())


def stretch_df(spark: SparkSession) -> DataFrame:
    found = folds.normal_stretches(P.EVENTS, P.SPLIT, P.EVALUATION, folds.at(P.DATA_START), folds.at(P.DATA_END))
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(found)], "scope_id int, start_us long, end_us long")


QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- regimes and runs -------------------------------------------------------


@query
def regime_labels(spark, d):
    return labelled(spark, d).select("asset_id", "us", "regime")


@query
def regime_occupancy(spark, d):
    return rounded(regimes.occupancy(labelled(spark, d)))


@query
def channel_stats(spark, d):
    return rounded(regimes.channel_stats(labelled(spark, d), ["value"]))


@query
def run_lengths(spark, d):
    runs = ordered.run_table(labelled(spark, d), "regime", GAP)
    return rounded(runs.select("asset_id", "run_id", "regime", "start_us", "end_us", "n", "duration_s", "gap_truncated", "start_is_gap_continuation"))


@query
def flag_semantics(spark, d):
    return rounded(regimes.flag_levels(telemetry(spark, d), FLAGS, ["value"]))


@query
def flag_agreement(spark, d):
    return rounded(regimes.flag_agreement(telemetry(spark, d), {"is_click": {0: "off", 1: "on"}, "is_error": {0: "on", 1: "off"}, "is_view": {1: "on"}}))


@query
def monthly_gap_runs(spark, d):
    return rounded(regimes.monthly_summary(labelled(spark, d), GAP))


# --- sampling and windows ---------------------------------------------------


@query
def sampling_profile(spark, d):
    # to whole minutes, so that a mode exists
    t = telemetry(spark, d).withColumn("us", (F.floor(F.col("us") / P.MIN) * P.MIN).cast("long")).dropDuplicates(["asset_id", "us"])
    return rounded(sampling.profile(t, GAP))


@query
def gap_list(spark, d):
    return sampling.gaps(telemetry(spark, d), GAP)


@query
def gap_adjacent(spark, d):
    return sampling.near_gap(telemetry(spark, d), 2 * P.HOUR, 30 * P.MIN).select("asset_id", "us", "gap_adjacent")


@query
def largest_gaps(spark, d):
    g = sampling.gaps(telemetry(spark, d), GAP)
    return g.orderBy((F.col("start_us") - F.col("end_us")), "asset_id", "start_us").limit(15)


@query
def interval_histogram(spark, d):
    i = sampling.intervals(telemetry(spark, d)).select(F.floor(F.col("interval_us") / P.MIN).alias("minutes"))
    return i.groupBy("minutes").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "minutes").limit(10)


@query
def resample_grid(spark, d):
    return rounded(sampling.resample(telemetry(spark, d), 20 * P.MIN, ["value"], ["is_click"]))


@query
def window_index(spark, d):
    w = sampling.windows(telemetry(spark, d), P.LENGTH, P.STRIDE, P.INTERVAL_US, P.TOLERANCE, ["value", "is_click"])
    return w.select("asset_id", "start_us", F.col("us").alias("end_us"))


@query
def window_stats(spark, d):
    s = sampling.window_stats(telemetry(spark, d), P.LENGTH, ["value"])
    w = sampling.windows(s, P.LENGTH, P.STRIDE, P.INTERVAL_US, P.TOLERANCE, ["value"])
    return rounded(w.select("asset_id", "us", "value_mean", "value_std", "value_min", "value_max", "value_slope"), 4)


# --- cycle features ---------------------------------------------------------


@query
def last_completed_duration(spark, d):
    df = labelled(spark, d)
    runs = ordered.last_completed(ordered.run_table(df, "regime", GAP), "regime", "STOPPED", F.col("duration_s"), "stopped_duration_last")
    return rounded(cycles.attach_to_rows(df, runs, ["stopped_duration_last", "stopped_duration_last_gap"], GAP).select("asset_id", "us", "stopped_duration_last", "stopped_duration_last_gap"))


@query
def running_elapsed(spark, d):
    return rounded(cycles.running(labelled(spark, d), "STOPPED", "value", 3, GAP).select("asset_id", "us", "running_elapsed_s"))


@query
def running_slope(spark, d):
    return rounded(cycles.running(labelled(spark, d), "STOPPED", "value", 3, GAP).select("asset_id", "us", "running_slope"))


@query
def last_run_slope(spark, d):
    runs = cycles.slopes(labelled(spark, d), "value", GAP)
    return rounded(ordered.last_completed(runs, "regime", "STOPPED", F.col("slope"), "decay_rate_last", void_if_truncated=False).select("asset_id", "run_id", "slope", "decay_rate_last"))


@query
def last_run_peak(spark, d):
    return rounded(cycles.last_peak(labelled(spark, d), "value", "OFFLOAD", GAP).select("asset_id", "us", "last_peak"))


@query
def cycle_period(spark, d):
    return rounded(cycles.cycle_period(ordered.run_table(labelled(spark, d), "regime", GAP)).select("asset_id", "run_id", "cycle_period_s"))


@query
def duty_ratio(spark, d):
    return rounded(labelled(spark, d).select("asset_id", "us", cycles.duty_ratio(micros(P.FEATURES.duty)).alias("duty_ratio")))


@query
def baseline_trailing(spark, d):
    return rounded(cycles.baseline_trailing(telemetry(spark, d), "value", P.DAY, "relative").select("asset_id", "us", "relative"))


@query
def baseline_lagged(spark, d):
    return rounded(cycles.baseline_lagged(telemetry(spark, d), "value", P.DAY, 2 * P.DAY, "relative").select("asset_id", "us", "relative"))


@query
def cycle_features(spark, d):
    out = cycles.cycle_features(labelled(spark, d), P.FEATURES)
    names = ["stopped_duration_last", "offload_duration_last", "loaded_duration_last", "run_gap_truncated", "stopped_elapsed", "cycle_period_last", "duty_ratio_trailing", "decay_rate_last", "decay_rate_running", "stopped_duration_last_rel_baseline", "cycle_period_last_rel_baseline", "decay_rate_last_rel_baseline"]
    return rounded(out.select("asset_id", "us", *names))


# --- scaling ----------------------------------------------------------------


def _scaler(method):
    return lambda spark, d: rounded(scaling.fit(telemetry(spark, d), ["value"], method, ["asset_id"]))


QUERIES["robust_scaler"], QUERIES["standard_scaler"], QUERIES["minmax_scaler"] = (_scaler(m) for m in scaling.METHODS)


@query
def scaler_by_regime(spark, d):
    return rounded(scaling.fit_by_regime(labelled(spark, d), SCALING, ["asset_id"]))


@query
def scaled_rows(spark, d):
    df = labelled(spark, d)
    return rounded(scaling.transform_by_regime(df, scaling.fit_by_regime(df, SCALING, ["asset_id"]), SCALING, ["asset_id"]).select("asset_id", "us", "regime", "value", "is_click"))


# --- intervals and folds ----------------------------------------------------


@query
def exclusion_union(spark, d):
    rows = [folds.exclusion(e, P.SPLIT) for e in P.EVENTS] + [(folds.at(r.start), folds.at(r.end)) for r in P.SPLIT.regions]
    return intervals.union(spark.createDataFrame(rows, "start_us long, end_us long"))


@query
def gap_union(spark, d):
    """Holes of the series, an hour wider on both sides, coalesced by series."""
    g = sampling.gaps(telemetry(spark, d), GAP).select("asset_id", (F.col("start_us") - P.HOUR).alias("start_us"), (F.col("end_us") + P.HOUR).alias("end_us"))
    return intervals.union(g, ["asset_id"])


@query
def normal_stretches(spark, d):
    return stretch_df(spark)


@query
def fold_plan_table(spark, d):
    f = fold_df(spark)
    days = F.aggregate("exclusions", F.lit(0).cast("long"), lambda a, x: a + x["end_us"] - x["start_us"])
    return rounded(f.select("event_id", "train_start", "train_end", "test_start", "test_end", F.size("exclusions").alias("n_exclusions"), ((F.col("train_end") - F.col("train_start") - days) / US_PER_DAY).alias("training_days")))


@query
def max_width(spark, d):
    return rounded(spark.createDataFrame(sorted(folds.max_width_h(P.EVENTS, P.SPLIT, folds.at(P.DATA_START)).items()), "event_id int, width_h double"))


@query
def train_slice(spark, d):
    return folds.train_rows(telemetry(spark, d), fold_df(spark)).groupBy("event_id", "asset_id").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query
def test_slice(spark, d):
    return folds.test_rows(telemetry(spark, d), fold_df(spark)).select("event_id", "asset_id", "us")


@query
def window_coverage(spark, d):
    return rounded(folds.window_coverage(telemetry(spark, d), P.EVENTS, P.WIDTHS, P.INTERVAL_US))


# --- ranks and thresholds ---------------------------------------------------


@query
def threshold_sweep(spark, d):
    train = folds.train_rows(scored(spark, d), fold_df(spark))
    return rounded(rank.thresholds(train, "score", P.QUANTILES, ["event_id", "asset_id"]))


@query
def percentile_rank(spark, d):
    f = fold_df(spark)
    t = telemetry(spark, d)
    out = rank.percentile_rank(folds.train_rows(t, f), folds.test_rows(t, f), "value", "percentile", ["event_id", "asset_id"])
    return rounded(out.select("event_id", "asset_id", "us", "percentile"))


@query
def score_shift(spark, d):
    f = fold_df(spark)
    s = scored(spark, d)
    return rounded(rank.score_shift(folds.train_rows(s, f), folds.test_rows(s, f), "score", ["event_id"]))


@query
def median_imputation(spark, d):
    t = telemetry(spark, d).withColumn("x", F.when(F.col("is_view") == 0, F.col("value")))
    m = t.groupBy("asset_id").agg(F.percentile("x", F.lit(0.5)).alias("m"))
    return rounded(t.join(m, "asset_id").select("asset_id", "us", F.coalesce("x", "m").alias("x")))


def rule_model() -> RuleModel:
    return RuleModel(P.FEATURES, P.RULES, ["asset_id"], ["asset_id"], P.REGIMES)


@query
def rule_severity(spark, d):
    df = telemetry(spark, d)
    m = rule_model().fit_until(folds.at(P.EVENTS[1].start))
    return rounded(m.contributions(df).select("asset_id", "us", *m.contributors))


@query
def rule_score(spark, d):
    df = telemetry(spark, d)
    m = rule_model().fit_until(folds.at(P.EVENTS[1].start))
    return rounded(m.score(df).select("asset_id", "us", "score"))


# --- episodes and evaluation ------------------------------------------------


HOLD, SCORE_GAP, _ = episodes.episode_settings(P.EVALUATION)


def flagged(spark, d, by=("asset_id",), rows=None, threshold: Column | None = None):
    threshold = F.lit(P.SCORE_THRESHOLD) if threshold is None else threshold
    return episodes.flag_episodes(scored(spark, d) if rows is None else rows, threshold, HOLD, SCORE_GAP, by)


@query
def alert_episodes(spark, d):
    return rounded(episodes.episodes(flagged(spark, d), ["asset_id"]))


@query
def episode_ranking(spark, d):
    return rounded(episodes.rank_contributions(flagged(spark, d), [*FLAGS, "score"], ["asset_id"]))


def fold_episodes(spark, d) -> tuple[DataFrame, DataFrame]:
    """Test rows and their episodes, keyed by event_id and asset_id."""
    rows = folds.test_rows(scored(spark, d), fold_df(spark))
    return rows, episodes.episodes(flagged(spark, d, ["event_id", "asset_id"], rows), ["event_id", "asset_id"])


@query
def episode_categories(spark, d):
    _, eps = fold_episodes(spark, d)
    masks = episodes.mask_table(spark, P.EVENTS, P.SPLIT)
    out = episodes.categorise(eps, episodes.event_table(spark, P.EVENTS), masks, F.lit(24.0))
    return out.select("event_id", "asset_id", "start_us", "end_us", "category")


def _days(spark, rows):
    periods = fold_df(spark).select("event_id", F.col("test_start").alias("lo"), F.col("test_end").alias("hi"))
    keys = rows.select("asset_id").distinct()
    return episodes.evaluated_days(rows, keys.crossJoin(F.broadcast(periods)), episodes.mask_table(spark, P.EVENTS, P.SPLIT), SCORE_GAP, ["event_id", "asset_id"])


@query
def evaluated_days(spark, d):
    return rounded(_days(spark, folds.test_rows(scored(spark, d), fold_df(spark))))


def _fold_results(spark, d):
    rows, eps = fold_episodes(spark, d)
    cats = episodes.categorise(eps, episodes.event_table(spark, P.EVENTS), episodes.mask_table(spark, P.EVENTS, P.SPLIT), F.lit(24.0))
    return rows, eps, episodes.fold_results(cats, _days(spark, rows), ["event_id", "asset_id"])


@query
def fold_evaluation(spark, d):
    return rounded(_fold_results(spark, d)[2])


def _pooled(spark, d):
    stretches = stretch_df(spark)
    rows = folds.scoped(scored(spark, d), stretches)
    by = ["asset_id", "scope_id"]
    periods = rows.select("asset_id").distinct().crossJoin(F.broadcast(stretches.select("scope_id", F.col("start_us").alias("lo"), F.col("end_us").alias("hi"))))
    none = spark.createDataFrame([], "start_us long, end_us long")
    days = episodes.evaluated_days(rows, periods, none, SCORE_GAP, by)
    qs = spark.createDataFrame([(0.8,), (0.9,), (1.0,), (1.2,)], "threshold double")
    many = rows.crossJoin(F.broadcast(qs))  # four thresholds
    eps = episodes.episodes(episodes.flag_episodes(many, F.col("threshold"), HOLD, SCORE_GAP, [*by, "threshold"]), [*by, "threshold"])
    return eps, days.crossJoin(F.broadcast(qs))


@query
def pooled_false_alarms(spark, d):
    eps, days = _pooled(spark, d)
    return rounded(episodes.pooled_rate(eps, days, ["asset_id", "threshold"]))


@query
def operating_point(spark, d):
    eps, days = _pooled(spark, d)
    rates = episodes.pooled_rate(eps, days, ["asset_id", "threshold"]).withColumnRenamed("threshold", "quantile")
    return chance.operating_point(rates, 3.0).select("found", "quantile")


@query
def chance_poisson(spark, d):
    r = _fold_results(spark, d)[2]
    return rounded(r.select("event_id", "asset_id", chance.poisson(F.col("false_alarms_per_day"), F.lit(24.0)).alias("p_poisson")))


def _permutation(spark, d, rows, eps):
    f = fold_df(spark).select("event_id", F.col("test_start").alias("lo"), F.col("test_end").alias("hi"), F.lit(12 * P.HOUR).alias("width_us"))
    periods = rows.select("asset_id").distinct().crossJoin(F.broadcast(f))
    return chance.permutation(eps, periods, P.EVALUATION.permutation_samples, ["event_id", "asset_id"])


@query
def chance_permutation(spark, d):
    rows, eps = fold_episodes(spark, d)
    return rounded(_permutation(spark, d, rows, eps))


@query
def skill_table(spark, d):
    rows, eps, results = _fold_results(spark, d)
    joined = results.join(_permutation(spark, d, rows, eps), ["event_id", "asset_id"])
    return rounded(chance.skill(joined, ["asset_id"]))


# --- whole evaluations of the rule model ------------------------------------


def _plan(spark, d) -> evaluation.Plan:
    return evaluation.plan(telemetry(spark, d), P.SETTINGS, P.US_START, P.US_END)


@query
def rule_evaluation(spark, d):
    return rounded(evaluation.rule_results(_plan(spark, d), P.QUANTILES))


@query
def rule_pooled(spark, d):
    return rounded(evaluation.rule_pooled(_plan(spark, d), P.QUANTILES))


@query
def rule_shift(spark, d):
    test, train = evaluation.rule_scores(_plan(spark, d))
    return rounded(rank.score_shift(train, test, "score", ["event_id"]))


@query
def rule_episodes(spark, d):
    flagged = evaluation.rule_flags(_plan(spark, d), P.QUANTILES)
    return episodes.episodes(flagged, [*evaluation.FOLD, "quantile"]).select(*evaluation.FOLD, "quantile", "episode", "start_us", "end_us")


@query
def rule_calibration(spark, d):
    return rounded(evaluation.rule_calibration(_plan(spark, d), 0.05))


@query
def train_validation(spark, d):
    train = folds.train_rows(telemetry(spark, d), fold_df(spark))
    return validation_split(train, P.SETTINGS.reconstruction.validation, evaluation.FOLD).select(*evaluation.FOLD, "us", "validation")


@query
def fold_history(spark, d):
    long = [folds.extended(f, P.EVENTS, P.SPLIT, folds.at(P.DATA_END)) for f in fold_plan()]
    return folds.fold_rows(telemetry(spark, d), folds.fold_table(spark, long)).groupBy(*evaluation.FOLD).agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


# --- further parts of the evaluations ---------------------------------------


@query
def since_change(spark, d):
    return ordered.since_change(labelled(spark, d), "regime", "held_us").select("asset_id", "us", "held_us")


@query
def plain_scaled_rows(spark, d):
    t = telemetry(spark, d)
    scaler = scaling.fit(t, ["value"], "robust", ["asset_id"])
    return rounded(scaling.transform(t, scaler, ["value"], FLAGS, ["asset_id"]).select("asset_id", "us", "value", "is_click"))


@query
def amplifying_scalers(spark, d):
    s = replace(SCALING, warn_factor=0.02)
    return rounded(scaling.amplifying(scaling.fit_by_regime(labelled(spark, d), s, ["asset_id"]), s).select("asset_id", "regime", "channel", "scale"))


@query
def episode_overview(spark, d):
    rows = flagged(spark, d)
    ranked = episodes.rank_contributions(rows, [*FLAGS, "score"], ["asset_id"])
    return rounded(evaluation.episode_summary(episodes.episodes(rows, ["asset_id"]), ranked, 30.0, ["asset_id"]))


@query
def top_contributors(spark, d):
    return rounded(evaluation.explain(flagged(spark, d), [*FLAGS, "score"], ["asset_id"], 2, "max").select("asset_id", "episode", "contributor", "value", "place"))


@query
def gap_shares(spark, d):
    rows = flagged(spark, d)
    near = sampling.near_gap(rows, 2 * P.HOUR, 3 * P.HOUR)
    return rounded(evaluation.gap_share(near, ["asset_id"]))


@query
def windows_off_gaps(spark, d):
    t = telemetry(spark, d)
    near = sampling.near_gap(t, 2 * P.HOUR, 3 * P.HOUR).where("gap_adjacent").select("asset_id", "us")
    w = sampling.windows(t, P.LENGTH, P.STRIDE, P.INTERVAL_US, P.TOLERANCE, ["value"])
    return w.select("asset_id", "us").join(near, ["asset_id", "us"], "left_anti")


@query
def feature_matrix(spark, d):
    rows = labelled(spark, d).withColumn("__raw", F.col("value"))
    out = evaluation.windowed_rows(rows, P.SETTINGS, P.INTERVAL_US, "train", ["asset_id"], ["value"], True)
    return rounded(out.select("asset_id", "us", "value_mean", "value_max", "cycle_stopped_duration_last", "cycle_duty_ratio_trailing", "cycle_stopped_duration_last_rel_baseline"), 4)


# --- exploration ------------------------------------------------------------


@query
def describe_channels(spark, d):
    return rounded(exploration.describe(telemetry(spark, d), ["value", "is_error"]))


@query
def flag_separation(spark, d):
    return rounded(exploration.flag_separation(telemetry(spark, d), FLAGS, F.col("value") < 35))


@query
def mode_shift(spark, d):
    return rounded(exploration.mode_shift(telemetry(spark, d), "value", F.col("is_click") == 1, (30.0, 40.0)))


@query
def stats_drift(spark, d):
    t = telemetry(spark, d)
    return rounded(exploration.stats_drift(t.where(F.col("us") < folds.at(P.EVENTS[1].start)), t, ["value"]))


@query
def smoothed_durations(spark, d):
    return rounded(exploration.smoothed_durations(labelled(spark, d), "STOPPED", GAP))


@query
def max_against_train(spark, d):
    f, s = fold_df(spark), scored(spark, d)
    return rounded(exploration.max_against_train(folds.train_rows(s, f), folds.test_rows(s, f), "score", ["event_id", "asset_id"]))


# --- models without an SQL form ---------------------------------------------


def _features(spark, d):
    s = sampling.window_stats(telemetry(spark, d), P.LENGTH, ["value", "is_error"])
    return sampling.windows(s, P.LENGTH, 1, P.INTERVAL_US, P.TOLERANCE, ["value"])


def forest(ablation: bool = False) -> IsolationForest:
    names = [f"{c}_{k}" for c in ("value", "is_error") for k in ("mean", "std", "min", "max", "slope")]
    return IsolationForest(names, ForestSettings(trees=50, ablation=ablation))


@query
def iforest_scores(spark, d):
    rows = _features(spark, d)
    return forest().fit(rows.where(F.col("us") < folds.at(P.EVENTS[1].start))).score(rows).select("asset_id", "us", "score")


@query
def iforest_ablation(spark, d):
    rows = _features(spark, d)
    m = forest(True).fit(rows.where(F.col("us") < folds.at(P.EVENTS[1].start)))
    return m.contributions(rows).select("asset_id", "us", *(f"c_{c}" for c in m.contributors))


@query
def reconstruction_scores(spark, d):
    rows = with_windows(telemetry(spark, d), ["value", "is_error"], P.LENGTH, ["asset_id"])
    m = Reconstruction(["value", "is_error"], P.LENGTH, ReconstructionSettings(bottleneck=4))
    return m.fit(rows.where(F.col("us") < folds.at(P.EVENTS[1].start))).score(rows).select("asset_id", "us", "score")


@query
def autoencoder_scores(spark, d):
    rows = with_windows(telemetry(spark, d), ["value", "is_error"], P.LENGTH, ["asset_id"])
    m = ConvAutoencoder(["value", "is_error"], P.LENGTH, P.SETTINGS.reconstruction)
    return m.fit(rows.where(F.col("us") < folds.at(P.EVENTS[1].start))).score(rows).select("asset_id", "us", "score")
