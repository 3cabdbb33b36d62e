"""Rule tables as column expressions: tiered score, alert checks, run dates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import SCORE_THRESHOLD, STRONG_SECTORS
from tidemark.functions.values import (
    ISO_DATE,
    dedup_key,
    normalize_bool,
    normalize_ticker,
    number_text,
    safe_float,
    signal_date,
    text,
)

# Score floor, grade, action, capital; best first.
GRADES = (
    (90, "S", "買い候補", "120万円"),
    (80, "A", "買い候補", "60万円"),
    (70, "B", "監視", "0円"),
    (60, "C", "監視", "0円"),
    (40, "D", "見送り", "0円"),
    (0, "E", "見送り", "0円"),
)
MESSAGE_FLOOR = 60


def tiered_rules() -> list[tuple[Column, int, str]]:
    """(condition, points, reason) in report order."""
    num = lambda n: safe_float(n, 0.0)
    known = lambda n: F.lower(F.coalesce(F.col(n).cast("string"), F.lit("true"))) == "true"
    rsi_d, rsi_w, vol, gap = num("rsi_d"), num("rsi_w"), num("volume_ratio"), num("ma_d_diff")
    d_ok, w_ok = known("rsi_d_available"), known("rsi_w_available")
    is_ = lambda n, v: text(n) == v
    # Points and reason texts.
    return [
        (is_("macd_4h", "GC"), 10, "4H MACD GC +10"),
        (is_("macd_d", "GC"), 15, "日足MACD GC +15"),
        (is_("macd_w", "GC"), 15, "週足MACD GC +15"),
        (is_("ma_d_status", "above"), 15, "日足200MA上 +15"),
        (is_("ma_w_status", "above"), 15, "週足200MA上 +15"),
        (d_ok & rsi_d.between(40, 70), 5, "日足RSI良好 +5"),
        (w_ok & rsi_w.between(40, 75), 5, "週足RSI良好 +5"),
        (vol >= 2.0, 10, "出来高2倍以上 +10"),
        ((vol >= 1.5) & (vol < 2.0), 5, "出来高1.5倍以上 +5"),
        (is_("ma_d_status", "below"), -25, "日足200MA下 -25"),
        (is_("ma_w_status", "below"), -30, "週足200MA下 -30"),
        (vol == 0, -10, "出来高取得なし/0 -10"),
        (d_ok & (rsi_d >= 80), -10, "日足RSI80超 -10"),
        (w_ok & (rsi_w >= 80), -10, "週足RSI80超 -10"),
        (d_ok & (rsi_d <= 30), -10, "日足RSI30以下 -10"),
        (w_ok & (rsi_w <= 30), -10, "週足RSI30以下 -10"),
        (gap >= 100, -30, "日足200MA乖離100%以上 -30"),
        ((gap >= 60) & (gap < 100), -15, "日足200MA乖離60%以上 -15"),
        ((gap >= 40) & (gap < 60), -5, "日足200MA乖離40%以上 -5"),
    ]


def with_tiered_score(df: DataFrame) -> DataFrame:
    """Adds score (0..100), grade, action, capital and the two reason lists."""
    rules = tiered_rules()
    total = reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0) for c, p, _ in rules])
    reasons = lambda sign: F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, p, t in rules if p * sign > 0]))
    scored = df.withColumns(
        {"score": F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("long"), "plus": reasons(1), "minus": reasons(-1)}
    )

    def tier(i: int) -> Column:
        rows = [(g[0], g[i]) for g in GRADES]
        first = F.when(F.col("score") >= rows[0][0], rows[0][1])
        return reduce(lambda acc, r: acc.when(F.col("score") >= r[0], r[1]), rows[1:], first)

    return scored.withColumns({"grade": tier(1), "action": tier(2), "capital": tier(3)})


def advice(brand: str) -> Column:
    """Comment by grade."""
    idle = (text("ma_d_status") == "below") & (safe_float("volume_ratio", 0.0) == 0)
    # Advice texts.
    return (
        F.when(F.col("grade").isin("S", "A"), f"{brand}条件を満たす買い候補です。損切り-15%前提で検討。")
        .when(F.col("grade").isin("B", "C"), "条件は悪くありませんが、A評価未満のため監視です。")
        .when(idle, "MACDは良好でも、日足200MA下・出来高不足のため見送りです。")
        .otherwise("弱い条件が多いため、現時点では見送りです。")
    )


def bullets(xs: str) -> Column:
    lines = F.concat_ws("\n", F.transform(xs, lambda x: F.concat(F.lit("・"), x)))
    return F.when(F.size(xs) > 0, lines).otherwise("・なし")


def tiered_message(title: str, brand: str) -> Column:
    """Multi-line notification text of a scored row."""
    known = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("不明"))
    lines = [
        F.lit(f"【{title}】"), F.lit(""),
        F.concat(F.lit("銘柄: "), known("ticker")), F.concat(F.lit("価格: "), known("price")), F.concat(F.lit("時間足: "), known("timeframe")), F.lit(""),
        F.concat(F.lit("総合点: "), F.col("score").cast("string")), F.concat(F.lit("評価: "), F.col("grade")),
        F.concat(F.lit("対応: "), F.col("action")), F.concat(F.lit("推奨資金: "), F.col("capital")), F.lit(""),
        F.lit("【加点】"), bullets("plus"), F.lit(""), F.lit("【減点】"), bullets("minus"), F.lit(""),
        F.lit("損切り目安: -15%"), F.lit(""), F.lit("コメント:"), advice(brand), F.lit(""),
    ]
    return F.concat_ws("\n", *lines)


@dataclass(frozen=True)
class AlertRules:
    """Words an alert must carry; installations choose their own."""

    system: str
    signal_type: str
    version: str
    threshold: int = SCORE_THRESHOLD
    bucket: str = "Large"
    sectors: tuple[str, ...] = STRONG_SECTORS


ALERT_FLAGS = ("weekly_above_200ma", "weekly_macd_gc", "weekly_macd_uptrend", "daily_rsi_40_65", "daily_volume_1_5x")
ALERT_FIELDS = (
    "system", "type", "version", "ticker", "exchange", "price", "close", "stable_score", "score", *ALERT_FLAGS,
    "daily_rsi", "volume_ratio", "signal_date", "date", "bar_date", "time",
)
ALERT_SCHEMA = ", ".join(f"{n} string" for n in ALERT_FIELDS)


def parse_alerts(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Flat alert JSON to text columns; the raw text is kept."""
    return df.withColumn("__p", F.from_json(payload, ALERT_SCHEMA)).select("*", *[F.col(f"__p.{n}").alias(f"p_{n}") for n in ALERT_FIELDS]).drop("__p")


def score_alerts(df: DataFrame, rules: AlertRules, received: str = "received_at") -> DataFrame:
    """Normalised ticker, signal date, key, both scores of parsed alerts."""
    weights = (30, 30, 20, 20, 20)
    recomputed = reduce(lambda a, b: a + b, [F.when(normalize_bool(f"p_{n}"), w).otherwise(0) for n, w in zip(ALERT_FLAGS, weights)])
    cols = {
        "ticker": normalize_ticker("p_ticker"),
        "signal_date": signal_date(["p_signal_date", "p_date", "p_bar_date", "p_time"], received),
        "stable_score_payload": safe_float("p_stable_score", safe_float("p_score", 0.0)),
        "stable_score_recomputed": recomputed.cast("long"),
        "price": F.coalesce(F.nullif(text("p_price"), F.lit("")), text("p_close")),
    }
    return df.withColumns(cols).withColumn("dedup_key", dedup_key(rules.version, "ticker", "signal_date"))


def alert_reason(rules: AlertRules) -> Column:
    """First failing check, or 'accepted'; needs the metadata columns joined."""
    checks = [
        (text("p_system") != rules.system, "invalid_system"),
        (text("p_type") != rules.signal_type, "invalid_type"),
        (text("p_version") != rules.version, "invalid_version"),
        (F.col("ticker") == "", "missing_ticker"),
        (F.col("stable_score_payload") < rules.threshold, "payload_score_below_90"),
        (F.col("stable_score_recomputed") < rules.threshold, "recomputed_score_below_90"),
        (F.col("m_ticker").isNull(), "ticker_not_in_stable_universe"),
        (text("m_market_cap_bucket") != rules.bucket, "not_large_cap"),
        (~text("m_sector").isin(*rules.sectors), "not_strong_sector"),
    ]
    first = F.when(*checks[0])
    return reduce(lambda acc, c: acc.when(*c), checks[1:], first).otherwise("accepted")


def signal_message(title: str) -> Column:
    """Notification text of an accepted alert."""
    lines = [
        F.lit(title), F.lit(""),
        F.concat(F.lit("Ticker: "), F.col("ticker")), F.concat(F.lit("Name: "), text("m_name")),
        F.concat(F.lit("Score: "), F.col("stable_score_recomputed").cast("string")), F.concat(F.lit("Price: "), F.col("price")),
        F.concat(F.lit("RSI: "), text("p_daily_rsi")), F.concat(F.lit("Volume Ratio: "), text("p_volume_ratio")), F.lit(""),
        # Closing lines.
        F.lit("Entry: Next trading day open"), F.lit("Stop: -10%"), F.lit("Take Profit: +30%"), F.lit("Max Holding: 60 trading days"), F.lit(""),
        F.lit("Paper Trading Mode: record only"),
    ]
    return F.concat_ws("\n", *lines)


# Run-context words and formats.
SCHEDULE_CRON = "17 20 * * 1-5"
SCHEDULE_ZONE = "Asia/Tokyo"
CUTOFF = "20:17"
AWARE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"
DISPATCH_KEY = r"^cloudflare_cron:(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z)$"


def local_time(instant: Column | str) -> Column:
    """Wall clock of the schedule zone (session zone is UTC)."""
    return F.from_utc_timestamp(instant, SCHEDULE_ZONE)


def business_cutoff(local: Column) -> Column:
    """Latest weekday whose cutoff has passed; holidays are not rolled."""
    early = F.date_format(local, "HH:mm") < CUTOFF
    day = F.date_sub(F.to_date(local), F.when(early, 1).otherwise(0))
    return F.date_sub(day, F.when(F.weekday(day) == 5, 1).when(F.weekday(day) == 6, 2).otherwise(0))


def resolve_run_context(df: DataFrame) -> DataFrame:
    """requested_as_of, its source, or the first error of every dispatch row."""
    ev, origin, key, as_of = (F.trim(text(n)) for n in ("trigger_event", "trigger_origin", "dispatch_key", "as_of"))
    started_text = F.trim(text("run_started_at"))
    started = F.when(started_text.rlike(AWARE), started_text.try_cast("timestamp"))
    scheduled = F.regexp_extract(key, DISPATCH_KEY, 1).try_cast("timestamp")
    given = F.when(as_of.rlike(ISO_DATE), as_of.try_cast("date"))
    local = local_time(started)
    schedule, manual, own = ev == "schedule", ev == "workflow_dispatch", ev == "local"
    remote = manual & (origin == "cloudflare_cron")
    error = (
        F.when(~ev.isin("schedule", "workflow_dispatch", "local"), "unsupported_trigger_event")
        .when(started.isNull(), "bad_run_started_at")
        .when(schedule & (origin != "github_schedule"), "schedule_origin")
        .when(schedule & (key != ""), "schedule_dispatch_key")
        .when(schedule & (as_of != ""), "schedule_as_of")
        .when(schedule & (text("scheduled_cron") != SCHEDULE_CRON), "unsupported_cron")
        .when(schedule & (text("timezone") != SCHEDULE_ZONE), "unsupported_timezone")
        .when(manual & (as_of == ""), "as_of_required")
        .when(manual & given.isNull(), "as_of_format")
        .when(manual & ~origin.isin("manual_ui", "cloudflare_cron"), "dispatch_origin")
        .when(remote & scheduled.isNull(), "dispatch_key_format")
        .when(remote & (F.to_date(local_time(scheduled)) != given), "dispatch_key_date")
        .when(own & (origin != "local_cli"), "local_origin")
        .when(own & (key != ""), "local_dispatch_key")
        .when(own & (as_of != "") & given.isNull(), "as_of_format")
    )
    source = (
        F.when(schedule, "scheduled_cutoff").when(remote, "external_scheduler").when(manual, "manual_input")
        .when(own & (as_of != ""), "manual_input").otherwise("local_default_jst")
    )
    value = F.when(schedule, business_cutoff(local)).when(as_of != "", given).otherwise(F.to_date(local))
    return df.withColumn("error", error).withColumns(
        {
            "requested_as_of": F.when(F.col("error").isNull(), value),
            "requested_as_of_source": F.when(F.col("error").isNull(), source),
            "run_started_local": F.when(F.col("error").isNull(), F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss'+09:00'")),
        }
    )


# Status colours.
STATUS_COLORS = {"signal_detected": "yellow", "no_signal": "green", "data_stale": "yellow", "data_unavailable": "red"}


def status_color(status: str | Column) -> Column:
    c = F.col(status) if isinstance(status, str) else status
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_COLORS.items() for x in kv]), c), F.lit("gray"))


def kpi_rows(summary: DataFrame, updated_at: str, prefix: str) -> DataFrame:
    """Eight dashboard rows per summary row: section, metric, value, status, note."""
    blank = lambda n: F.coalesce(F.nullif(text(n), F.lit("")), F.lit("No Data"))
    color, gray, none = status_color("status"), F.lit("gray"), F.lit("")
    # Metric names and notes.
    cells = [
        ("Daily Score Check Status", F.col("status"), color, none),
        ("Latest Score Check Date", text("as_of"), gray, none),
        ("Signal Count", F.col("signal_count").cast("string"), color, F.lit("stable_score >= 90")),
        ("Max Score Ticker", blank("max_score_ticker"), gray, F.concat(F.lit("max_score="), number_text("max_score"))),
        ("Data Freshness", F.col("freshness_status"), color, F.concat(F.lit("requested_as_of="), text("as_of"), F.lit("; data_date="), blank("data_date"))),
        ("Paper Open Positions", F.lit("0"), gray, F.lit("Cloud Phase 1: score check only.")),
        ("Paper Equity", F.lit("No Data"), gray, F.lit("Cloud Phase 1: pending/register not enabled.")),
        ("Last Updated", F.lit(updated_at), gray, none),
    ]
    rows = F.array(*[F.struct(F.lit(f"{prefix} {m}").alias("metric"), v.alias("value"), s.alias("status"), n.alias("note")) for m, v, s, n in cells])
    return summary.select(F.inline(rows)).select(F.lit(prefix).alias("section"), "metric", "value", "status", F.lit(updated_at).alias("updated_at"), "note")


def daily_log_row(columns: tuple[str, ...], values: dict[str, Column]) -> list[Column]:
    """Fixed-width ledger row; absent fields are blank."""
    return [F.coalesce(values[n].cast("string"), F.lit("")).alias(n) if n in values else F.lit("").alias(n) for n in columns]
