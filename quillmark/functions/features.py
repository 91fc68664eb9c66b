"""Causal features of daily bars. Null means missing; nothing looks ahead but the target."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.scans import STEPS, affine_scan, block_of, ewm_steps

FEATURES = (
    [f"ret_lag_{k}" for k in (1, 2, 3, 5, 10)]
    + [f"momentum_{k}" for k in (5, 10, 21, 63)]
    + ["vol_5", "vol_21", "vol_ratio"]
    + [f"ma_gap_{k}" for k in (10, 21, 63)]
    + ["rsi_14", "macd", "macd_hist", "range_position_252", "atr_14", "intraday_range", "close_location", "volume_z_21", "volume_trend", "dow_sin", "dow_cos"]
)
TARGET = "target_next_log_return"


def by_day():
    """Each symbol's days in order."""
    return Window.partitionBy("symbol").orderBy("date")


def finite(x: Column) -> Column:
    """Null for what is not a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def by_block():
    """The same order, which also sorts each symbol's blocks of days (``_block``): steps in a block need no sort of their own."""
    return Window.partitionBy("symbol").orderBy("_block", "date")


def rolling(x: Column, k: int, what: str, days=None) -> Column:
    """mean, std (of a sample), min or max of the last ``k`` days; null unless all ``k`` are there."""
    frame = (days or by_day()).rowsBetween(1 - k, 0)
    function = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}[what]
    return F.when(F.count(x).over(frame) == k, function(x).over(frame))


def zero_null(x: Column) -> Column:
    return F.when(x != 0, x)


#: Exponentially weighted means: input, alpha, least number of values. The last one smooths what the two before it give.
SMOOTH = {"avg_gain": ("gain", 1 / 14, 14), "avg_loss": ("loss", 1 / 14, 14), "atr": ("true_range", 1 / 14, 14), "ema_12": ("c", 2 / 13, 0), "ema_26": ("c", 2 / 27, 0), "macd_signal": ("macd", 2 / 10, 0)}
#: Which of them a feature needs.
NEEDS = {"rsi_14": ("avg_gain", "avg_loss"), "atr_14": ("atr",), "macd": ("ema_12", "ema_26"), "macd_hist": ("ema_12", "ema_26", "macd_signal")}


def smoothed(df: DataFrame, names: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with exponentially weighted means, y = (1 - alpha) y + alpha x, scanned block by block: see
    :func:`quillmark.functions.scans.affine_scan`. ``df`` has the numbers of blocks in ``_block``."""
    rounds = [[n for n in names if n != "macd_signal"], [n for n in names if n == "macd_signal"]]
    kept = df.columns
    for chosen in filter(None, rounds):
        if chosen == ["macd_signal"]:
            df = df.withColumn("macd", (F.col("ema_12") - F.col("ema_26")) / F.col("c"))
        steps: dict[str, Column] = {}
        for name in chosen:
            source, alpha, _ = SMOOTH[name]
            steps |= dict(zip((f"a__{name}", f"b__{name}", f"n__{name}"), ewm_steps(source, alpha, ["symbol"], "bar_pos", ["_block", "date"]), strict=True))
        found = affine_scan(df.withColumns(steps), ["symbol"], "date", {f"y__{n}": (f"a__{n}", f"b__{n}") for n in chosen}, blocks="_block", parts=parts)
        kept = [*kept, *chosen]
        enough = [F.when(F.col(f"n__{n}") >= max(SMOOTH[n][2], 1), F.col(f"y__{n}")).alias(n) for n in chosen]
        df = found.select(*[c for c in kept if c not in chosen], *enough)
    return df


def features(bars: DataFrame, price_column: str = "adj_close", horizon: int = 1, columns: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """symbol, date, the day's number ``bar_pos`` from 0, and ``columns``: by default the 26 features and the target
    ``horizon`` days ahead.

    All windows share one partitioning and one sort by symbol and day. The smoothed features are scanned by blocks of days,
    and only where they are asked for. Nothing leaves the JVM. ``parts`` is the number of tasks that symbols are dealt to, for
    tables of many symbols; by default Spark's settings decide.
    """
    if horizon < 1:
        raise ValueError("horizon is at least 1")
    wanted = list(columns or [*FEATURES, TARGET])
    c = F.col("c")
    means = [m for m in SMOOTH if any(m in NEEDS.get(f, ()) for f in wanted)]
    days = by_block() if means else by_day()
    block = [block_of(F.col("date"), dict(bars.dtypes)["date"], STEPS).alias("_block")] if means else []
    base = bars.select("symbol", "date", *block, F.col(price_column).alias("c"), "high", "low", "close", "volume")
    if parts:
        base = base.repartition(parts, "symbol")
    lagged = base.withColumns({"r": F.ln(c) - F.ln(F.lag(c).over(days)), "change": c - F.lag(c).over(days), "close_before": F.lag("close").over(days), "v": zero_null(F.col("volume")), "bar_pos": F.row_number().over(days) - 1})
    r, v = F.col("r"), F.col("v")
    out: dict[str, Column] = {f"ret_lag_{k}": F.lag(r, k - 1).over(days) if k > 1 else r for k in (1, 2, 3, 5, 10)}
    for k in (5, 10, 21, 63):
        out[f"momentum_{k}"] = F.ln(c / F.lag(c, k).over(days)) / zero_null(rolling(r, k, "std", days) * math.sqrt(k))
    out |= {"vol_5": rolling(r, 5, "std", days), "vol_21": rolling(r, 21, "std", days), "vol_ratio": rolling(r, 5, "std", days) / zero_null(rolling(r, 21, "std", days))}
    for k in (10, 21, 63):
        out[f"ma_gap_{k}"] = (c - rolling(c, k, "mean", days)) / zero_null(rolling(c, k, "std", days))
    low, high = rolling(F.col("low"), 252, "min", days), rolling(F.col("high"), 252, "max", days)
    out["range_position_252"] = (c - low) / zero_null(high - low)
    spread = F.col("high") - F.col("low")
    out["intraday_range"] = spread / c
    out["close_location"] = F.coalesce((F.col("close") - F.col("low")) / zero_null(spread), F.lit(0.5))
    lv = F.ln(v)
    out["volume_z_21"] = (lv - rolling(lv, 21, "mean", days)) / zero_null(rolling(lv, 21, "std", days))
    out["volume_trend"] = F.ln(rolling(v, 5, "mean", days) / zero_null(rolling(v, 21, "mean", days)))
    angle = 2 * math.pi * F.weekday("date") / 5.0
    out |= {"dow_sin": F.sin(angle), "dow_cos": F.cos(angle)}
    out[TARGET] = F.ln(F.lead(c, horizon).over(days) / c)
    smooth_in = {
        "gain": F.when(F.col("change").isNotNull(), F.greatest("change", F.lit(0.0))),
        "loss": F.when(F.col("change").isNotNull(), F.greatest(-F.col("change"), F.lit(0.0))),
        "true_range": F.greatest(spread, F.abs(F.col("high") - F.col("close_before")), F.abs(F.col("low") - F.col("close_before"))),
        "c": c,
    }
    table = lagged.select("symbol", "date", "bar_pos", *["_block" for _ in block], *[x.alias(n) for n, x in out.items() if n in wanted], *([smooth_in[n].alias(n) for n in smooth_in if n == "c" or any(SMOOTH[m][0] == n for m in means)] if means else []))
    if means:
        strength = F.col("avg_gain") / zero_null(F.col("avg_loss"))
        macd = (F.col("ema_12") - F.col("ema_26")) / c
        final = {"rsi_14": F.coalesce(100 - 100 / (1 + strength), F.lit(50.0)) / 100, "macd": macd, "macd_hist": macd - F.col("macd_signal"), "atr_14": F.col("atr") / c}
        table = smoothed(table, means, parts).withColumns({n: x for n, x in final.items() if n in wanted})
    return table.select("symbol", "date", "bar_pos", *[finite(F.col(f)).alias(f) for f in wanted])


def dataset(bars: DataFrame, price_column: str = "adj_close", horizon: int = 1) -> DataFrame:
    """Complete rows only, numbered by ``pos`` from 0 in each symbol, with each symbol's number of them, ``n_pos``."""
    whole = features(bars, price_column, horizon).dropna(how="any")
    return whole.withColumns({"pos": F.row_number().over(by_day()) - 1, "n_pos": F.count("*").over(Window.partitionBy("symbol"))})


def lookahead_leaks(bars: DataFrame, make, cut_share: float = 0.7, rtol: float = 1e-9, atol: float = 1e-12, columns: list[str] | None = None) -> DataFrame:
    """Features that change before a cut when prices after it are replaced by noise: symbol, feature, n_rows.

    ``make`` builds features from bars. No row means no feature looks ahead.
    """
    columns = columns or FEATURES
    ranked = bars.withColumn("_share", F.percent_rank().over(by_day()))
    noise = 0.5 + 1.5 * F.pmod(F.xxhash64("symbol", "date"), F.lit(1_000_003)) / 1_000_003
    changed = ranked.withColumns({c: F.when(F.col("_share") >= cut_share, F.col(c) * noise).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "adj_close", "volume")})
    before = ranked.where(F.col("_share") < cut_share).select("symbol", "date")
    a, b = make(bars).select("symbol", "date", *columns), make(changed.drop("_share")).select("symbol", "date", *[F.col(c).alias(f"{c}__") for c in columns])
    both = before.join(a, ["symbol", "date"]).join(b, ["symbol", "date"])

    def differs(c: str) -> Column:
        x, y = F.col(c), F.col(f"{c}__")
        return x.isNull().eqNullSafe(y.isNull()).__invert__() | F.coalesce(F.abs(x - y) > atol + rtol * F.abs(y), F.lit(False))

    flags = F.array(*[F.struct(F.lit(c).alias("feature"), differs(c).alias("bad")) for c in columns])
    return both.select("symbol", F.explode(flags).alias("f")).where("f.bad").groupBy("symbol", F.col("f.feature").alias("feature")).agg(F.count("*").alias("n_rows"))
