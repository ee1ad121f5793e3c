"""Decisions against a line, their settlement, and reports over thresholds."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.config import (
    BETS,
    DEFAULT_MIN_THRESHOLD,
    STRICT_THRESHOLDS,
    UNPROFITABLE_LEAGUES,
    BetSettings,
)
from tipoff.operators import digests


def outcome(prob: Column, actual: Column, line: Column, threshold: Column) -> Column:
    """1 win, 0 push, -1 loss, NULL when no bet is placed. Over wins when both sides qualify."""
    side = F.when(prob >= threshold, F.lit(1)).when(prob <= 1.0 - threshold, F.lit(-1))
    result = F.signum(actual - line)
    return (
        F.when(side.isNull(), F.lit(None))
        .when(result == 0, F.lit(0))
        .when(result == side, F.lit(1))
        .otherwise(F.lit(-1))
        .cast("int")
    )


def settled(
    predictions: DataFrame, threshold: float | Column, cfg: BetSettings = BETS
) -> DataFrame:
    """Add ``label`` and ``pnl`` to rows with ``prob``, ``actual`` and ``line``."""
    at = threshold if isinstance(threshold, Column) else F.lit(threshold)
    label = outcome(F.col("prob"), F.col("actual"), F.col("line"), at)
    return predictions.withColumn("label", label).withColumn("pnl", pnl_of(F.col("label"), cfg))


def pnl_of(label: Column, cfg: BetSettings) -> Column:
    return (
        F.when(label == 1, F.lit(cfg.stake * (cfg.odds - 1.0)))
        .when(label == -1, F.lit(-cfg.stake))
        .otherwise(F.lit(0.0))
    )


def threshold_label(value: float) -> str:
    return f"{value:.2f}"


def sweep(
    predictions: DataFrame, by: Sequence[str], cfg: BetSettings = BETS
) -> DataFrame:
    """Report per group and threshold from one pass over the predictions.

    The predictions are not multiplied by the thresholds: each threshold is a set of
    conditional counts in a single aggregation, unpivoted afterwards on the tiny result.
    """
    aggs: list[Column] = []
    for i, t in enumerate(cfg.thresholds):
        label = outcome(F.col("prob"), F.col("actual"), F.col("line"), F.lit(t))
        for name, code in (("wins", 1), ("losses", -1), ("pushes", 0)):
            aggs.append(F.count(F.when(label == code, F.lit(1))).alias(f"{name}_{i}"))
    wide = predictions.groupBy(*by).agg(*aggs)
    cells = F.array(
        *[
            F.struct(
                F.lit(t).alias("threshold"),
                F.col(f"wins_{i}").alias("wins"),
                F.col(f"losses_{i}").alias("losses"),
                F.col(f"pushes_{i}").alias("pushes"),
            )
            for i, t in enumerate(cfg.thresholds)
        ]
    )
    long = wide.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")
    return with_ratios(long, cfg)


def with_ratios(counts: DataFrame, cfg: BetSettings = BETS) -> DataFrame:
    """Bet count, profit, win rate over decided bets and return over placed bets, in percent."""
    wins, losses, pushes = F.col("wins"), F.col("losses"), F.col("pushes")
    n = wins + losses + pushes
    decided = wins + losses
    profit = wins * (cfg.stake * (cfg.odds - 1.0)) - losses * cfg.stake
    return counts.withColumns(
        {
            "n": n,
            "profit": profit,
            "winrate": F.when(decided > 0, 100.0 * wins / F.nullif(decided, F.lit(0))).otherwise(0.0),
            "roi": F.when(n > 0, 100.0 * profit / F.nullif(n, F.lit(0))).otherwise(0.0),
        }
    )


def bet_report(settled_rows: DataFrame, by: Sequence[str], cfg: BetSettings = BETS) -> DataFrame:
    """The same report from rows that already carry ``label``."""
    counts = settled_rows.groupBy(*by).agg(
        *[
            F.count(F.when(F.col("label") == code, F.lit(1))).alias(name)
            for name, code in (("wins", 1), ("losses", -1), ("pushes", 0))
        ]
    )
    return with_ratios(counts, cfg)


def bootstrap_interval(
    report: DataFrame, by: Sequence[str], cfg: BetSettings = BETS
) -> DataFrame:
    """Percentile interval of the mean pnl, in percent, for every report row.

    A bet pays one of three amounts, so a resample of n bets with replacement is a draw of
    (wins, losses, pushes) from a multinomial with the observed shares. Drawing counts gives
    the same distribution as drawing n bets, at a cost that does not depend on n: each report
    row costs ``draws`` draws, and report rows are spread over tasks. Seeds come from the row's
    key, so a retried task repeats its draws. No bets give NULL bounds.
    """
    win, loss = cfg.stake * (cfg.odds - 1.0), -cfg.stake
    schema = report.schema

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lows, highs = [], []
            for seed, wins, losses, pushes in zip(
                frame["_seed"], frame["wins"], frame["losses"], frame["pushes"], strict=True
            ):
                n = wins + losses + pushes
                if n == 0:
                    lows.append(None)
                    highs.append(None)
                    continue
                rng = np.random.default_rng([cfg.seed, seed & 0x7FFFFFFF])
                counts = rng.multinomial(n, np.array([wins, losses, pushes]) / n, size=cfg.draws)
                means = (counts[:, 0] * win + counts[:, 1] * loss) / n
                low, high = np.percentile(means, [50 * cfg.alpha, 100 - 50 * cfg.alpha])
                lows.append(100.0 * low)
                highs.append(100.0 * high)
            yield frame.drop(columns="_seed").assign(roi_ci_low=lows, roi_ci_high=highs)

    key = [c for c in (*by, "threshold") if c in report.columns]
    seeded = report.withColumn("_seed", F.xxhash64(*key))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return seeded.mapInPandas(draw, f"{fields}, roi_ci_low double, roi_ci_high double")


#: Positions of a resample that are drawn in one piece, a multiple of the four that share a digest.
POSITIONS = 65_536


def _first_number(size: int, slot: int) -> int:
    """The smallest 32-bit number that draws ``slot`` of ``size`` or a later one; 2**32 if none does."""
    low, high = 0, 2**32
    while low < high:
        middle = (low + high) // 2
        if math.floor(middle / 4294967296.0 * size) >= slot:
            high = middle
        else:
            low = middle + 1
    return low


def _drawn(
    key: str, size: int, wins: int, losses: int, draws: np.ndarray, starts: np.ndarray, positions: int
) -> tuple[np.ndarray, np.ndarray]:
    """How often pieces of resamples, of ``positions`` positions each, draw a win, a slot before ``wins``,
    or a loss, one from ``losses`` on.

    Some pieces are digested at once, so that a small report fills the arrays too.
    """
    won, lost = (np.zeros(len(draws), np.int64) for _ in range(2))
    win_end, loss_from = _first_number(size, wins), _first_number(size, losses)
    prefix = f"{key}-".encode()
    many = max(1, 4 * digests.TEXTS_AT_ONCE // (min(size, positions) // 4 + 1))
    for i in range(0, len(draws), many):
        piece = slice(i, i + many)
        begin = starts[piece] // 4
        ends = np.minimum(size, starts[piece] + positions)
        each = (ends + 3) // 4 - begin
        first = np.cumsum(each) - each
        at = np.arange(each.sum()) - np.repeat(first - begin, each)
        left = np.minimum(np.repeat(ends, each) - 4 * at, 4).astype(np.uint8)
        hits = np.empty((2, len(at)), np.uint8)
        for rows, words in digests.of_pairs(prefix, np.repeat(draws[piece].astype(np.int64), each), at):
            inside = [left[rows] > p for p in range(4)]
            hits[0, rows] = sum(((word < win_end) & there).view(np.uint8) for word, there in zip(words, inside, strict=True))
            hits[1, rows] = sum(((word >= loss_from) & there).view(np.uint8) for word, there in zip(words, inside, strict=True))
        won[piece], lost[piece] = np.add.reduceat(hits, first, axis=1, dtype=np.int64)
    return won, lost


def bootstrap_interval_indexed(
    report: DataFrame, by: Sequence[str], draws: int, cfg: BetSettings = BETS
) -> DataFrame:
    """The same interval from an explicit resample whose indices come from a digest.

    Each (row, draw, position) takes a uniform number from ``md5(key-draw-position)``, one
    digest serving four positions, and the drawn index falls into the wins, pushes or losses.
    Work grows with draws times bets, in pieces of ``POSITIONS`` positions; use it where the
    resample must be repeatable in another system. Digests are array operations, see ``digests``, and of
    those of a piece only the counts come back.
    """
    n = F.col("wins") + F.col("losses") + F.col("pushes")
    name = F.concat_ws("-", *[F.col(c).cast("string") for c in by])
    keys = [f"_key{i}" for i in range(len(by))]
    # pieces are few bytes and much work: their number of tasks follows the cores, not the bytes
    tasks = 4 * report.sparkSession.sparkContext.defaultParallelism
    jobs = (
        report.where(n > 0)
        .select(
            *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)],
            name.alias("_k"),
            n.alias("_n"),
            F.col("wins").cast("bigint").alias("_win_end"),
            (F.col("wins") + F.col("pushes")).cast("bigint").alias("_loss_from"),
        )
        .withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(draws))))
        .withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(POSITIONS).cast("bigint"))))
        .repartition(tasks, F.col("_k"), F.col("_b"), F.col("_from"))
    )

    positions = POSITIONS

    def resample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            won, lost = (np.zeros(len(frame), np.int64) for _ in range(2))
            places = frame.groupby(["_k", "_n", "_win_end", "_loss_from"], sort=False).indices
            for (k, size, wins, losses), at in places.items():
                draws_of, starts = (frame[c].to_numpy()[at] for c in ("_b", "_from"))
                won[at], lost[at] = _drawn(k, int(size), int(wins), int(losses), draws_of, starts, positions)
            yield frame[[*keys, "_b", "_n"]].assign(_w=won, _l=lost)

    kinds = [f"{k} {jobs.schema[k].dataType.simpleString()}" for k in keys]
    means = (
        jobs.mapInPandas(resample, ", ".join([*kinds, "_b int", "_n bigint", "_w bigint", "_l bigint"]))
        .withColumnsRenamed(dict(zip(keys, by, strict=True)))
        .groupBy(*by, "_b", "_n")
        .agg(F.sum("_w").alias("_w"), F.sum("_l").alias("_l"))
        .withColumn(
            "_mean",
            (F.col("_w") * (cfg.stake * (cfg.odds - 1.0)) - F.col("_l") * cfg.stake) / F.col("_n"),
        )
    )
    bounds = means.groupBy(*by).agg(
        F.percentile("_mean", F.array(F.lit(cfg.alpha / 2), F.lit(1 - cfg.alpha / 2))).alias("_p")
    )
    intervals = bounds.select(
        *by, (F.col("_p")[0] * 100).alias("roi_ci_low"), (F.col("_p")[1] * 100).alias("roi_ci_high")
    )
    return report.join(intervals, list(by), "left")


def flag(report: DataFrame) -> DataFrame:
    """``flag``: significant, profit, loss, or none without bets."""
    return report.withColumn(
        "flag",
        F.when(F.col("n") == 0, F.lit("none"))
        .when(F.col("roi_ci_low") > 0, F.lit("significant"))
        .when(F.col("profit") > 0, F.lit("profit"))
        .otherwise(F.lit("loss")),
    )


def min_threshold(league: Column) -> Column:
    pairs = [F.lit(x) for item in STRICT_THRESHOLDS.items() for x in item]
    known = F.try_element_at(F.create_map(*pairs), league) if pairs else F.lit(None)
    return F.coalesce(known, F.lit(DEFAULT_MIN_THRESHOLD))


def is_unprofitable(league: Column) -> Column:
    return F.coalesce(league.isin(UNPROFITABLE_LEAGUES), F.lit(False))


def bet_gate(predictions: DataFrame, league: str = "league") -> DataFrame:
    """Rows of allowed leagues whose confidence on either side reaches the league's minimum."""
    confidence = F.greatest(F.col("prob"), 1 - F.col("prob"))
    return predictions.where(
        ~is_unprofitable(F.col(league)) & (confidence >= min_threshold(F.col(league)))
    )


def labelled(df: DataFrame, total: str = "game_total", line: str = "total_line") -> DataFrame:
    """Rows with a total and a line and no push, with ``over_hit``."""
    return (
        df.dropna(subset=[total, line])
        .where(F.col(total) != F.col(line))
        .withColumn("over_hit", (F.col(total) > F.col(line)).cast("int"))
    )
