"""Whole evaluations: folds, models, thresholds, episodes, chance, pooled false alarms.

Folds, widths, quantiles and stretches are keys of one plan instead of loops:
a fold's rows carry event_id, thresholds are joined per fold and quantile, and a
score is computed once and shared by all widths and quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ReconstructionSettings, Settings, micros
from ..models.autoencoder import ConvAutoencoder
from ..models.forest import IsolationForest
from ..models.reconstruct import Reconstruction, with_windows
from ..models.rules import RuleModel
from ..operators import chance, cycles, episodes, folds, rank, sampling, scaling
from ..operators.regimes import assign_regimes
from ..operators.stretches import Scope
from ..schema import plan_table

FOLD = ["event_id", "asset_id"]
SCOPE = ["event_id", "scope_id", "asset_id"]


@dataclass
class Plan:
    """What all models of one run share."""

    #: The rows without regimes, for passes that find these themselves.
    raw: DataFrame
    folds: list[folds.Fold]
    extended: list[folds.Fold]
    #: The stretches by scope_id.
    normal: list[tuple[int, int]]
    settings: Settings
    kept: list[DataFrame] = field(default_factory=list)

    @cached_property
    def rows(self) -> DataFrame:
        """With regimes."""
        return self.keep(assign_regimes(self.raw, self.settings.regimes))

    @property
    def stretches(self) -> DataFrame:
        return plan_table(self.raw.sparkSession, [(k, a, b) for k, (a, b) in enumerate(self.normal)], "scope_id int, start_us long, end_us long")

    def keep(self, df: DataFrame) -> DataFrame:
        """df, cached, as many branches read it; release() lets it go."""
        self.kept.append(df.persist())
        return df

    def release(self) -> None:
        """To be called when no result of this plan will be read any more."""
        while self.kept:
            self.kept.pop().unpersist()


def plan(df: DataFrame, s: Settings, data_start: int, data_end: int, by_event_max: bool = False) -> Plan:
    """Regimes once over the full series, then folds and pooled stretches."""
    v = s.evaluation
    widths = folds.max_width_h(v.events, s.split, data_start) if by_event_max else None
    made = folds.make_folds(v.events, v.widths_h, s.split, data_start, data_end, widths)
    long = [folds.extended(f, v.events, s.split, data_end) for f in made]
    found = folds.normal_stretches(v.events, s.split, v, data_start, data_end)
    return Plan(df, made, made if by_event_max else long, found, s)


def flags(p: Plan, scores: DataFrame, train_scores: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """Scores by fold and quantile of the training scores, with their episodes."""
    hold, gap, _ = episodes.episode_settings(p.settings.evaluation)
    rows = scores.join(rank.thresholds(train_scores, "score", quantiles, FOLD), FOLD)
    return episodes.flag_episodes(rows, F.col("threshold"), hold, gap, [*FOLD, "quantile"])


def at_widths(p: Plan, scores: DataFrame, train_scores: DataFrame, quantiles: Sequence[float], widths: Sequence[float] | None) -> DataFrame:
    """Fold results by event, asset, width and quantile, with both chance comparisons. scores: test rows with event_id."""
    spark, s = scores.sparkSession, p.settings
    v = s.evaluation
    _, gap, least = episodes.episode_settings(v)
    eps = episodes.episodes(flags(p, scores, train_scores, quantiles), [*FOLD, "quantile"], least)
    folded = folds.fold_table(spark, p.extended)
    own = folded.select("event_id", "width_h") if widths is None else folded.select("event_id").crossJoin(F.broadcast(plan_table(spark, [(float(w),) for w in widths], "width_h double")))
    masks = episodes.mask_table(spark, v.events, s.split)
    cats = episodes.categorise(eps.join(F.broadcast(own), "event_id"), episodes.event_table(spark, v.events), masks, F.col("width_h"))
    assets = scores.select("asset_id").distinct()
    periods = assets.crossJoin(F.broadcast(folded.select("event_id", F.col("test_start").alias("lo"), F.col("test_end").alias("hi"))))
    days = episodes.evaluated_days(scores, periods, masks, gap, FOLD)
    grid = days.join(F.broadcast(own), "event_id").crossJoin(F.broadcast(plan_table(spark, [(float(q),) for q in quantiles], "quantile double")))
    keys = [*FOLD, "width_h", "quantile"]
    out = episodes.fold_results(cats, grid, keys)
    out = out.withColumn("p_poisson", chance.poisson(F.col("false_alarms_per_day"), F.col("width_h")))
    placed = grid.join(periods, FOLD).select(*keys, "lo", "hi", (F.col("width_h") * folds.HOUR).cast("long").alias("width_us"))
    found = chance.permutation(eps.join(F.broadcast(own), "event_id"), placed, v.permutation_samples, keys)
    return chance.compare(out.join(found, keys, "left"), v.chance_threshold)


def pooled(p: Plan, scores: DataFrame, train_scores: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """False alarms a day over all normal stretches, by event, asset and quantile. scores: rows with event_id and scope_id."""
    hold, gap, least = episodes.episode_settings(p.settings.evaluation)
    keys = [*SCOPE, "quantile"]
    cuts = rank.thresholds(train_scores, "score", quantiles, FOLD)
    rows = scores.join(cuts, FOLD)
    eps = episodes.episodes(episodes.flag_episodes(rows, F.col("threshold"), hold, gap, keys), keys, least)
    scopes = train_scores.select(*FOLD).distinct().crossJoin(F.broadcast(p.stretches.select("scope_id", F.col("start_us").alias("lo"), F.col("end_us").alias("hi"))))
    spark = p.raw.sparkSession
    days = episodes.evaluated_days(scores, scopes, plan_table(spark, [], "start_us long, end_us long"), gap, SCOPE)
    grid = days.crossJoin(F.broadcast(plan_table(spark, [(float(q),) for q in quantiles], "quantile double")))
    return episodes.pooled_rate(eps, grid, [*FOLD, "quantile"])


def _scopes(p: Plan) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training rows, scoring history and stretch rows, keyed by event_id (and scope_id)."""
    spark = p.rows.sparkSession
    f, longer = folds.fold_table(spark, p.folds), folds.fold_table(spark, p.extended)
    ids = F.broadcast(f.select("event_id"))
    return folds.train_rows(p.rows, f), folds.fold_rows(p.rows, longer), folds.scoped(p.rows, p.stretches).crossJoin(ids)  # stretches x folds


def in_test(p: Plan, scored: DataFrame) -> DataFrame:
    """Scored history rows that lie in their fold's (extended) test period."""
    f = F.broadcast(folds.fold_table(scored.sparkSession, p.extended).select("event_id", "test_start", "test_end"))
    return scored.join(f, "event_id").where(F.col("us").between(F.col("test_start"), F.col("test_end"))).drop("test_start", "test_end")


def _rules(p: Plan) -> RuleModel:
    return RuleModel(p.settings.features, p.settings.rules, ["asset_id"], FOLD, p.settings.regimes)


def _longest(made: Sequence[folds.Fold]) -> folds.Fold:
    """The fold of which the others are the past: the same start and, up to their end, the same exclusions."""
    last = max(made, key=lambda f: f.train_end)
    for f in made:
        past = tuple((a, min(b, f.train_end)) for a, b in last.exclusions if a < f.train_end)
        if (f.train_start, f.exclusions) != (last.train_start, past):
            raise ValueError(f"fold {f.event_id} is no past of fold {last.event_id}")
    return last


#: Scopes of the rule model's training rows and histories; that of a stretch is its scope_id.
TRAINING, HISTORY = -1, -2


def _training(p: Plan) -> tuple[Scope, list[tuple]]:
    """Every fold's training rows, and (scope, event_id, closed period) of each. A row's quantities depend on no later row
    and the folds train on one growing past, so the rows are measured once, for all folds."""
    return Scope(TRAINING, folds.training_periods(_longest(p.folds))), [(TRAINING, f.event_id, f.train_start, f.train_end - 1) for f in p.folds]


def _history(p: Plan) -> tuple[list[Scope], list[tuple]]:
    """Every fold's test rows, measured once over the longest history."""
    longest = max(p.extended, key=lambda f: f.test_end)
    if any(f.train_start != longest.train_start for f in p.extended):
        raise ValueError("the folds' histories begin at different times")
    return [Scope(HISTORY, ((longest.train_start, longest.test_end + 1),))], [(HISTORY, f.event_id, f.test_start, f.test_end) for f in p.extended]


def _normal(p: Plan) -> tuple[list[Scope], list[tuple]]:
    """The stretches' rows, measured once and judged by every fold."""
    scopes = [Scope(k, ((a, b + 1),)) for k, (a, b) in enumerate(p.normal)]
    return scopes, [(k, f.event_id, a, b) for k, (a, b) in enumerate(p.normal) for f in p.folds]


def _measured(p: Plan, tasks: Sequence[Sequence[Scope]], periods: Sequence[tuple]) -> DataFrame:
    """Packed quantities by fold: a row stands for __n rows with the same, from us to __until, without a coverage gap."""
    cuts = sorted({t for _, _, lo, hi in periods for t in (lo, hi + 1)})  # a packed row lies in a period or outside
    rows = _rules(p).quantities(p.raw, ["asset_id"], True, episodes.episode_settings(p.settings.evaluation)[1], cuts, tasks)
    f = F.broadcast(plan_table(p.raw.sparkSession, periods, "__scope int, event_id int, __lo long, __hi long"))
    return rows.join(f, "__scope").where(F.col("us").between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def _rated(p: Plan, others: tuple[list[Scope], list[tuple]], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Packed scores of the others and of the training rows, from one pass over both."""
    m, (training, periods) = _rules(p), _training(p)
    both = _measured(p, [[training], others[0]], [*periods, *others[1]])
    both = both.withColumn("__train", F.col("__scope") == TRAINING).withColumnRenamed("__scope", "scope_id")
    out = p.keep(m.scored(m.rated(both)).select(*keys, "us", "__until", "__n", "score", *m.contributors, "__train"))
    return out.where("not __train").drop("__train"), out.where("__train").select(*FOLD, "us", "__until", "__n", "score")


def rule_scores(p: Plan) -> tuple[DataFrame, DataFrame]:
    """Packed scores of the test and of the training rows."""
    return _rated(p, _history(p), FOLD)


def rule_normal(p: Plan) -> tuple[DataFrame, DataFrame]:
    """Packed scores of the stretches' and of the training rows."""
    normal, train = _rated(p, _normal(p), SCOPE)
    return normal.select(*SCOPE, "us", "__until", "__n", "score"), train


def rule_calibration(p: Plan, q: float) -> DataFrame:
    """(event_id, asset_id, rule, value): a quantile of each rule's quantity in each fold's training rows."""
    training, periods = _training(p)
    return _rules(p).calibration(_measured(p, [[training]], periods), q)


def rule_flags(p: Plan, quantiles: Sequence[float]) -> DataFrame:
    return flags(p, *rule_scores(p), quantiles)


def rule_results(p: Plan, quantiles: Sequence[float]) -> DataFrame:
    return at_widths(p, *rule_scores(p), quantiles, _widths(p))


def rule_pooled(p: Plan, quantiles: Sequence[float]) -> DataFrame:
    return pooled(p, *rule_normal(p), quantiles)


def _widths(p: Plan) -> Sequence[float] | None:
    return None if p.extended is p.folds else p.settings.evaluation.widths_h


def run_rules(p: Plan, quantiles: Sequence[float] | None = None) -> dict[str, DataFrame]:
    """The rule model: results at the common widths, pooled false alarms, and skill."""
    test, train = rule_scores(p)
    return _results(p, test, train, rule_normal(p)[0], quantiles or [p.settings.evaluation.quantile])


def _results(p: Plan, test: DataFrame, train: DataFrame, normal: DataFrame, quantiles: Sequence[float]) -> dict[str, DataFrame]:
    test, train, normal = (p.keep(x) for x in (test, train, normal))
    results = at_widths(p, test, train, quantiles, _widths(p))
    rates = pooled(p, normal, train, quantiles)
    return {"results": results, "pooled": rates, "skill": chance.skill(results, ["width_h", "quantile"]), "shift": rank.score_shift(train, test, "score", ["event_id"])}


def windowed_rows(rows: DataFrame, s: Settings, interval_us: int, mode: str, by: Sequence[str], channels: Sequence[str], cycle: bool) -> DataFrame:
    """Window statistics (on scaled channels) at window ends, with the cycle features of the raw decay channel."""
    length, stride = sampling.window_rows(s.windows, interval_us, mode)
    sampling.check_embargo(s.windows, s.split.embargo)
    out = sampling.window_stats(rows, length, channels, by, s.forest.stats)
    out = sampling.windows(out, length, stride, interval_us, s.windows.tolerance, channels, by)
    if not cycle:
        return out
    features = cycles.cycle_features(rows.select(*by, "us", "regime", F.col("__raw").alias(s.features.decay_channel)), s.features, by)
    names = [c for c in features.columns if c not in {*by, "us", "regime", "run_id", s.features.decay_channel}]
    features = features.select(*by, "us", *(F.col(c).cast("double").alias(f"cycle_{c}") for c in names))
    return out.join(features, [*by, "us"], "left")


def _scaled(p: Plan, train: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows scaled by the regime scalers of their fold's training rows; the raw decay channel stays in __raw."""
    s = p.settings.scaling
    fit = scaling.fit_by_regime(train, s, FOLD)
    return scaling.transform_by_regime(rows.withColumn("__raw", F.col(p.settings.features.decay_channel)), fit, s, FOLD)


def run_forest(p: Plan, interval_us: int, quantiles: Sequence[float] | None = None, drop_near_gaps: bool = False) -> dict[str, DataFrame]:
    """One isolation forest per fold on window statistics and cycle features."""
    s, quantiles = p.settings, quantiles or [p.settings.evaluation.quantile]
    train, history, normal = _scopes(p)
    channels = [*s.scaling.channels, *s.scaling.passthrough]
    make = lambda rows, mode, by: windowed_rows(_scaled(p, train, rows), s, interval_us, mode, by, channels, s.forest.cycle_features)
    fit_rows, test_rows, normal_rows = make(train, "train", FOLD), make(history, "score", FOLD), make(normal, "score", SCOPE)
    if drop_near_gaps:
        near = sampling.near_gap(history, micros(s.windows.gap), micros(s.windows.window), FOLD).where("gap_adjacent").select(*FOLD, "us")
        test_rows = test_rows.join(near, [*FOLD, "us"], "left_anti")
    names = [f"{c}_{k}" for c in channels for k in s.forest.stats] + [c for c in fit_rows.columns if c.startswith("cycle_")]
    parts, models = [], {}
    for f in p.folds:  # a handful of events, each with a model of its own
        mine = lambda df, f=f: df.where(F.col("event_id") == f.event_id)
        m = models[f.event_id] = IsolationForest(names, s.forest).fit(mine(fit_rows))
        parts.append([m.score(mine(df)) for df in (test_rows, fit_rows, normal_rows)])
    test, fitted, scored = (_stacked(list(x)) for x in zip(*parts, strict=True))
    out = _results(p, in_test(p, test), fitted, scored, quantiles)
    flagged = flags(p, in_test(p, test), fitted, quantiles)
    rows = in_test(p, test_rows)
    if drop_near_gaps is False:
        near = sampling.near_gap(history.select(*FOLD, "us"), micros(s.windows.gap), micros(s.windows.window), FOLD)
        out["gap_share"] = gap_share(flagged.join(near, [*FOLD, "us"]), [*FOLD, "quantile"])
    return out | {"explanations": explanations(p, models, rows, flagged, out["results"])}


def explanations(p: Plan, models: dict[int, IsolationForest], rows: DataFrame, flagged: DataFrame, results: DataFrame, top: int = 5) -> DataFrame:
    """The top contributors of the early warnings that permutation does not explain, by fold, asset, quantile and episode.
    Ablation, which is dear, sees the rows of these episodes alone, each once."""
    v = p.settings.evaluation
    keys = [*FOLD, "quantile"]
    eps = episodes.episodes(flagged, keys, episodes.episode_settings(v)[2])
    wanted = results.where(F.col("detected") & (F.col("p_permutation") < v.chance_threshold)).select(*keys, "width_h").distinct()
    found = episodes.categorise(eps.join(wanted, keys), episodes.event_table(rows.sparkSession, v.events), episodes.mask_table(rows.sparkSession, v.events, p.settings.split), F.col("width_h"))
    found = found.where(F.col("category") == episodes.EARLY).select(*keys, "episode", "start_us", "end_us").distinct()
    spans = found.select(*FOLD, F.col("start_us").alias("__a"), F.col("end_us").alias("__b")).distinct()
    inside = rows.join(spans, FOLD).where(F.col("us").between(F.col("__a"), F.col("__b"))).drop("start_us", "__a", "__b").dropDuplicates([*FOLD, "us"])
    parts = []
    for event, m in models.items():
        c = m.contributions(inside.where(F.col("event_id") == event), True)
        parts.append(c.select(*FOLD, "us", *(F.col(f"c_{n}").alias(n) for n in m.contributors)))
    measured = _stacked(parts).join(found, FOLD).where(F.col("us").between(F.col("start_us"), F.col("end_us"))).drop("start_us", "end_us")
    return explain(measured, next(iter(models.values())).contributors, keys, top, v.aggregation)


def reconstruction(channels: Sequence[str], length: int, s: ReconstructionSettings) -> Reconstruction:
    kinds = {"convolutional": ConvAutoencoder, "linear": Reconstruction}
    if s.kind not in kinds:
        raise ValueError(f"unknown reconstruction {s.kind!r}")
    return kinds[s.kind](channels, length, s)


def run_reconstruction(p: Plan, interval_us: int) -> dict[str, DataFrame]:
    """Reconstruction scores; the operating quantile is chosen on pooled false alarms alone, then detection is read there.

    Without an acceptable quantile only the diagnostics come back."""
    s, v = p.settings, p.settings.evaluation
    train, history, normal = _scopes(p)
    channels = [*s.scaling.channels, *s.scaling.passthrough]
    length, _ = sampling.window_rows(s.windows, interval_us)
    parts = []
    make = lambda rows, by: with_windows(_scaled(p, train, rows), channels, length, by)
    fit_rows, test_rows, normal_rows = make(train, FOLD), make(history, FOLD), make(normal, SCOPE)
    for f in p.folds:
        mine = lambda df, f=f: df.where(F.col("event_id") == f.event_id)
        m = reconstruction(channels, length, s.reconstruction).fit(mine(fit_rows))
        parts.append([m.score(mine(df)).drop("w") for df in (test_rows, fit_rows, normal_rows)])
    test, fitted, scored = (p.keep(_stacked(list(x))) for x in zip(*parts, strict=True))
    rates = pooled(p, scored, fitted, v.quantiles)
    out = {"pooled": rates, "shift": rank.score_shift(fitted, in_test(p, test), "score", ["event_id"]), "operating_point": chance.operating_point(rates, v.false_alarm_ceiling)}
    chosen = out["operating_point"].first()
    if chosen["found"]:
        out["results"] = at_widths(p, in_test(p, test), fitted, [chosen["quantile"]], v.widths_h)
    return out


def _stacked(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def explain(flagged: DataFrame, names: Sequence[str], by: Sequence[str], top: int = 5, method: str = "mean") -> DataFrame:
    """The `top` contributors of every episode."""
    return episodes.rank_contributions(flagged, names, by, method).where(F.col("place") <= top)


def gap_share(flagged: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of gap-adjacent rows, overall (episode NULL) and in every episode."""
    share = F.avg(F.col("gap_adjacent").cast("double")).alias("share")
    return flagged.groupBy(*by).agg(share).withColumn("episode", F.lit(None).cast("long")).unionByName(flagged.where("episode is not null").groupBy(*by, "episode").agg(share))


def episode_summary(eps: DataFrame, ranked: DataFrame, days: float, by: Sequence[str]) -> DataFrame:
    """Density a day, peaks, and contributors above one half, by series."""
    strong = ranked.where("value > 0.5").groupBy(*by, "episode").agg(F.count("*").alias("n_strong"))
    joined = eps.join(strong, [*by, "episode"], "left").join(ranked.where("place = 1").select(*by, "episode", F.col("contributor").alias("top")), [*by, "episode"], "left")
    return joined.groupBy(*by).agg((F.count("*") / days).alias("per_day"), F.avg("peak").alias("mean_peak"), F.max("peak").alias("max_peak"), F.avg(F.coalesce("n_strong", F.lit(0))).alias("mean_strong"), F.mode("top", True).alias("top"))
