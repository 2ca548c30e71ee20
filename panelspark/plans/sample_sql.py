"""DuckDB SQL for the registered sample queries.

The statements are written from the benchmark's definition and not from the
Spark plans: series are filled hour by hour and then summed, windows are range
joins per cutoff, percentiles and tiles are the built-in functions.
"""

from __future__ import annotations

from panelspark.constants import LEVELS, z_score
from panelspark.plans import layer_queries as layers
from panelspark.plans import sample_queries as q
from panelspark.plans import stored_queries as stored

METRIC_CASE = """CASE WHEN event_type = 'WatchEvent' THEN 'stars'
    WHEN event_type = 'PullRequestEvent' AND action = 'opened' THEN 'prs_opened'
    WHEN event_type = 'IssuesEvent' AND action = 'opened' THEN 'issues_opened'
    WHEN event_type = 'PushEvent' THEN 'pushes' END"""

# Named relations; a statement gets those it needs, in this order.
RELATIONS: dict[str, str] = {}

RELATIONS["raw"] = """
  SELECT CAST(event_id AS VARCHAR) AS event_id,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at,
    CASE event_type WHEN 'view' THEN 'WatchEvent' WHEN 'click' THEN 'PushEvent'
      WHEN 'purchase' THEN 'PullRequestEvent' WHEN 'signup' THEN 'IssuesEvent'
      WHEN 'error' THEN 'ErrorEvent' END AS event_type,
    user_id AS repo_id, 'user/' || user_id AS repo_name,
    CAST(k AS BIGINT) AS actor_id, 'actor' || k AS actor_login,
    CASE WHEN event_type IN ('purchase', 'signup') THEN
      CASE WHEN k < 25 THEN 'closed' ELSE 'opened' END END AS action,
    CASE WHEN event_type = 'click' THEN k END AS push_distinct_size,
    CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
    CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour,
    date_trunc('second', ts) AS ts, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS event_hour
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"""
RELATIONS["kept"] = """
  SELECT * FROM raw
  WHERE event_type IN ('WatchEvent', 'PullRequestEvent', 'IssuesEvent', 'PushEvent')"""
RELATIONS["entities"] = "SELECT DISTINCT repo_id, repo_name FROM kept"
RELATIONS["first_hours"] = """
  SELECT repo_id, min(event_hour) AS first_hour FROM kept GROUP BY repo_id"""
RELATIONS["hours"] = """
  SELECT unnest(generate_series(low, high, INTERVAL 1 HOUR)) AS hour
  FROM (SELECT min(event_hour) AS low, max(event_hour) AS high FROM kept)"""
RELATIONS["metric_names"] = """
  SELECT unnest(['stars', 'prs_opened', 'issues_opened', 'pushes']) AS metric"""
RELATIONS["sparse"] = f"""
  SELECT repo_id, metric, event_hour, count(*) AS y
  FROM (SELECT repo_id, event_hour, {METRIC_CASE} AS metric FROM kept)
  WHERE metric IS NOT NULL GROUP BY ALL"""
RELATIONS["hourly"] = """
  SELECT e.repo_id, e.repo_name, m.metric, e.repo_id || ':' || m.metric AS unique_id,
    h.hour AS ds, coalesce(s.y, 0) AS y
  FROM entities e JOIN first_hours f USING (repo_id)
  JOIN hours h ON h.hour >= f.first_hour
  CROSS JOIN metric_names m
  LEFT JOIN sparse s ON s.repo_id = e.repo_id AND s.metric = m.metric AND s.event_hour = h.hour"""


def _periods(unit: str, threshold: float) -> str:
    return f"""
  SELECT date_trunc('{unit}', hour) AS p FROM hours GROUP BY 1
  HAVING count(*) / (date_diff('hour', date_trunc('{unit}', min(hour)),
    date_trunc('{unit}', min(hour)) + INTERVAL 1 {unit})) >= {threshold}"""


RELATIONS["days"] = _periods("day", 0.90)
RELATIONS["weeks"] = _periods("week", 0.95)
RELATIONS["daily"] = """
  SELECT repo_id, repo_name, metric, unique_id, CAST(p AS TIMESTAMP) AS ds, CAST(sum(y) AS BIGINT) AS y
  FROM hourly JOIN days ON date_trunc('day', ds) = p GROUP BY ALL"""
RELATIONS["weekly"] = """
  SELECT repo_id, repo_name, metric, unique_id, CAST(p + INTERVAL 6 DAY AS TIMESTAMP) AS ds,
    CAST(sum(y) AS BIGINT) AS y
  FROM hourly JOIN weeks ON date_trunc('week', ds) = p GROUP BY ALL"""
RELATIONS["order_months"] = """
  SELECT o_orderstatus || '-' || o_orderpriority || ':orders' AS unique_id,
    CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ds, count(*) AS y
  FROM orders GROUP BY ALL"""
RELATIONS["order_grid"] = """
  SELECT unique_id, unnest(generate_series(min(ds),
    (SELECT date_trunc('month', max(o_orderdate)) - INTERVAL 1 MONTH FROM orders), INTERVAL 1 MONTH)) AS ds
  FROM order_months GROUP BY unique_id"""
RELATIONS["monthly"] = """
  SELECT g.unique_id, CAST(g.ds AS TIMESTAMP) AS ds, coalesce(m.y, 0) AS y
  FROM order_grid g LEFT JOIN order_months m USING (unique_id, ds)"""

_UNIT = {"hourly": "HOUR", "daily": "DAY", "weekly": "WEEK", "monthly": "MONTH"}
_SEASON = {"hourly": 24, "daily": 7, "weekly": 1, "monthly": 12}
_H = {"hourly": 24, "daily": 7, "weekly": 1, "monthly": 1}


def _stamps(values) -> str:
    return ", ".join(f"TIMESTAMP '{v} 00:00:00'" for v in values)


def _history(freq: str, cutoffs, window: int, unit: str = "") -> str:
    return f"""
  SELECT c.cutoff, p.unique_id, p.ds, p.y
  FROM (SELECT unnest([{_stamps(cutoffs)}]) AS cutoff) c
  JOIN {freq} p ON p.ds > c.cutoff - INTERVAL {window} {unit or _UNIT[freq]} AND p.ds <= c.cutoff"""


def _actuals(freq: str, cutoffs) -> str:
    return f"""
  SELECT c.cutoff, p.unique_id, p.ds, p.y
  FROM (SELECT unnest([{_stamps(cutoffs)}]) AS cutoff) c
  JOIN {freq} p ON p.ds > c.cutoff AND p.ds <= c.cutoff + INTERVAL {_H[freq]} {_UNIT[freq]}"""


def _stats(history: str, season: int) -> str:
    return f"""
  SELECT cutoff, unique_id, count(*) AS n_obs, avg(y) AS mean_y, avg(abs(y)) AS mean_abs_y,
    coalesce(stddev_samp(y), 0) AS sd_y, avg(abs(d)) AS mean_abs_diff,
    coalesce(sqrt(avg(sd * sd)), 0) AS sd_season
  FROM (SELECT *, y - lag(y, 1) OVER w AS d, y - lag(y, {season}) OVER w AS sd
    FROM {history} WINDOW w AS (PARTITION BY cutoff, unique_id ORDER BY ds))
  GROUP BY cutoff, unique_id"""


def _forecasts(freq: str, stats: str, history: str, models=q.forecasting.BASELINES) -> str:
    unit, season = _UNIT[freq], _SEASON[freq]
    steps = f"{stats} s, (SELECT unnest(range(1, {_H[freq] + 1})) AS k)"
    ds = f"CAST(s.cutoff + to_{unit.lower()}s(CAST(k AS INTEGER)) AS TIMESTAMP) AS ds"
    parts = {
        "zero_model": f"""
    SELECT 'zero_model' AS model, 'ZeroModel' AS model_alias, s.cutoff, s.unique_id, {ds},
      0.0::DOUBLE AS yhat, 0.0::DOUBLE AS sigma FROM {steps}""",
        "historic_average": f"""
    SELECT 'historic_average', 'HistoricAverage', s.cutoff, s.unique_id, {ds},
      mean_y, sd_y * sqrt(1 + 1 / n_obs) FROM {steps}""",
        "seasonal_naive": f"""
    SELECT 'seasonal_naive', 'SeasonalNaive', s.cutoff, s.unique_id, {ds},
      CASE WHEN n_obs >= {season} THEN h.y::DOUBLE END, sd_season * sqrt((k - 1) // {season} + 1)
    FROM {steps} LEFT JOIN {history} h ON h.cutoff = s.cutoff AND h.unique_id = s.unique_id
      AND h.ds = s.cutoff - to_{unit.lower()}s(CAST({season} - 1 - (k - 1) % {season} AS INTEGER))""",
    }
    union = " UNION ALL ".join(parts[m] for m in models)
    levels = ", ".join(f"yhat + ({z_score(p)}) * sigma AS q_{p}" for p in LEVELS)
    return f"""
  SELECT model, model_alias, '{freq}' AS frequency, cutoff, unique_id, ds, yhat, {levels}
  FROM ({union})"""


def _pinball(level: int, column: str = "") -> str:
    d = f"({column or f'q_{level}'} - y)"
    return f"greatest({level / 100} * {d}, ({level / 100} - 1) * {d})"


_MEAN_LOSS = "(" + " + ".join(_pinball(p) for p in LEVELS) + f") / {len(LEVELS)}"


def _scores(forecasts: str, actual: str, stats: str, freq: str) -> str:
    """Metrics of keys in which every actual has a forecast."""
    return f"""
  SELECT s.unique_id, s.model, s.model_alias, strftime(s.cutoff, '%Y-%m-%d-%H') AS cutoff,
    '{freq}' AS frequency, split_part(s.unique_id, ':', -1) AS subdataset,
    mae / greatest(mean_abs_diff, 0.01) AS mase, crps / greatest(mean_abs_y, 1.0) AS scaled_crps
  FROM (SELECT f.model, f.model_alias, a.cutoff, a.unique_id, avg(abs(y - yhat)) AS mae,
      2 * sum({_MEAN_LOSS}) AS crps
    FROM {actual} a JOIN {forecasts} f USING (cutoff, unique_id, ds) GROUP BY ALL) s
  JOIN {stats} t USING (cutoff, unique_id)"""


def _add_backtest(prefix: str, freq: str, cutoffs, window: int, models=q.forecasting.BASELINES) -> None:
    RELATIONS[f"{prefix}_hist"] = _history(freq, cutoffs, window)
    RELATIONS[f"{prefix}_act"] = _actuals(freq, cutoffs)
    RELATIONS[f"{prefix}_stats"] = _stats(f"{prefix}_hist", _SEASON[freq])
    RELATIONS[f"{prefix}_fc"] = _forecasts(freq, f"{prefix}_stats", f"{prefix}_hist", models)
    RELATIONS[f"{prefix}_scores"] = _scores(f"{prefix}_fc", f"{prefix}_act", f"{prefix}_stats", freq)


_add_backtest("d", "daily", q.DAILY_CUTOFFS, q.DAILY_WINDOW)
_add_backtest("w", "weekly", q.WEEKLY_CUTOFFS, q.WEEKLY_WINDOW)
_add_backtest("m", "monthly", q.MONTHLY_CUTOFFS, q.MONTHLY_WINDOW)
_add_backtest("h", "hourly", q.DAILY_CUTOFFS, q.HOURLY_WINDOW)
_add_backtest("g", "daily", q.GUARD_CUTOFFS, q.DAILY_WINDOW)
_add_backtest("e", "daily", q.EARLY_CUTOFFS, q.EARLY_WINDOW, ("zero_model", "historic_average"))

RELATIONS["own_cuts"] = f"""
  SELECT unique_id, unnest(generate_series(min(ds), max(ds), INTERVAL {q.OWN_STEP} DAY)) AS cutoff FROM daily GROUP BY unique_id"""
RELATIONS["own_hist"] = f"""
  SELECT c.cutoff, unique_id, p.ds, p.y FROM own_cuts c JOIN daily p USING (unique_id)
  WHERE p.ds > c.cutoff - INTERVAL {q.DAILY_WINDOW} DAY AND p.ds <= c.cutoff"""
RELATIONS["own_stats"] = _stats("own_hist", 7)
RELATIONS["shares"] = """
  SELECT unique_id, ds, CASE WHEN sum(y) OVER same > 0 THEN y / sum(y) OVER same ELSE 0.0 END AS y
  FROM hourly WINDOW same AS (PARTITION BY repo_id, ds)"""
RELATIONS["share_hist"] = _history("shares", q.DAILY_CUTOFFS, q.HOURLY_STATS_WINDOW, "HOUR")
RELATIONS["share_stats"] = _stats("share_hist", 24)
RELATIONS["joined"] = """
  SELECT f.*, a.y FROM d_fc f JOIN d_act a USING (cutoff, unique_id, ds)"""
RELATIONS["flat_joined"] = """
  SELECT * REPLACE (CASE WHEN q_90 = q_10 THEN NULL ELSE q_90 END AS q_90) FROM joined"""
RELATIONS["sparsity"] = """
  SELECT unique_id, metric, n_obs, n_zero, zero_rate,
    CASE ntile(3) OVER (PARTITION BY metric ORDER BY zero_rate, md5(unique_id), unique_id)
      WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' END AS sparsity_level
  FROM (SELECT unique_id, max(metric) AS metric, count(*) AS n_obs, count_if(y = 0)::BIGINT AS n_zero,
      CAST(count_if(y = 0) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS zero_rate
    FROM daily GROUP BY unique_id)"""
RELATIONS["metrics"] = """
  SELECT * FROM d_scores UNION ALL SELECT * FROM w_scores UNION ALL SELECT * FROM m_scores"""
RELATIONS["raw_long"] = """
  SELECT 'gh-archive' AS dataset, u.*, coalesce(s.sparsity_level, 'unknown') AS sparsity_level
  FROM (SELECT unique_id, model, model_alias, cutoff, frequency, subdataset, metric, value
    FROM metrics UNPIVOT (value FOR metric IN (mase, scaled_crps))) u
  LEFT JOIN (SELECT unique_id, sparsity_level FROM sparsity) s USING (unique_id)"""
RELATIONS["med"] = """
  SELECT dataset, subdataset, sparsity_level, frequency, cutoff, metric, model, model_alias,
    median(value) AS v
  FROM raw_long GROUP BY ALL"""
RELATIONS["denoms"] = """
  SELECT frequency, cutoff, metric, subdataset, sparsity_level, median(value) AS median_zero,
    quantile_cont(value, 0.1) FILTER (WHERE value > 0) AS pct_z,
    greatest(coalesce(median(value), 0.0),
      coalesce(quantile_cont(value, 0.1) FILTER (WHERE value > 0), 0.001)) AS denom
  FROM raw_long WHERE model = 'zero_model' GROUP BY ALL"""
_STRATUM = "frequency, cutoff, metric, subdataset, sparsity_level"
RELATIONS["scaled"] = f"""
  SELECT m.* EXCLUDE (v), d.median_zero, d.pct_z, d.denom,
    CASE WHEN d.denom > 0 THEN m.v / d.denom END AS value
  FROM med m LEFT JOIN denoms d USING ({_STRATUM})"""
RELATIONS["grid"] = """
  SELECT 'gh-archive' AS dataset, frequency, cutoff, unnest(list_sort(names.metrics)) AS metric, subdataset, sparsity_level,
    o.model, o.model_alias
  FROM (
    SELECT frequency, cutoff, names, subdataset, sparsity_level, unnest(names.models) AS o
    FROM (
      SELECT frequency, cutoff, names, subdataset, unnest(names.levels) AS sparsity_level
      FROM (
        SELECT frequency, cutoff, names, unnest(names.subdatasets) AS subdataset
        FROM (SELECT DISTINCT frequency, cutoff FROM raw_long), (
          SELECT {'subdatasets': list(DISTINCT subdataset), 'levels': list(DISTINCT sparsity_level),
            'metrics': list(DISTINCT metric), 'models': list(DISTINCT {'model': model, 'model_alias': model_alias})} AS names
          FROM raw_long))))"""
RELATIONS["board"] = f"""
  SELECT g.dataset, g.subdataset, g.sparsity_level, g.frequency, g.cutoff, g.metric, g.model,
    g.model_alias, r.value, d.median_zero, d.pct_z, d.denom
  FROM grid g LEFT JOIN (SELECT {_STRATUM}, model, value FROM scaled) r USING ({_STRATUM}, model)
  LEFT JOIN denoms d USING ({_STRATUM})"""
RELATIONS["entity_year"] = """
  SELECT repo_id, max(repo_name) AS repo_name,
    count_if(event_type = 'WatchEvent')::BIGINT AS stars,
    count_if(event_type = 'PullRequestEvent' AND action = 'opened')::BIGINT AS prs_opened,
    count_if(event_type = 'IssuesEvent' AND action = 'opened')::BIGINT AS issues_opened,
    count_if(event_type = 'PushEvent')::BIGINT AS pushes,
    count(*) AS total_events,
    count(DISTINCT CASE WHEN ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-29'
      THEN date_trunc('week', ts) END) AS active_units
  FROM kept WHERE year = 2024 GROUP BY repo_id"""
RELATIONS["eligible"] = f"""
  SELECT * FROM entity_year WHERE active_units = {q.REQUIRED_WEEKS} AND stars > 0"""
RELATIONS["ranked"] = f"""
  SELECT *, CASE WHEN star_prank_upper < 0.20 THEN 'low'
      WHEN star_prank_upper >= 0.40 AND star_prank_upper < 0.60 THEN 'medium'
      WHEN star_prank_upper >= 0.90 THEN 'large' END AS size_bucket
  FROM (SELECT *, percent_rank() OVER (ORDER BY stars) AS star_prank_upper
    FROM (SELECT *, percent_rank() OVER (ORDER BY stars) AS star_prank_all FROM eligible)
    WHERE star_prank_all >= {q.TOP_SHARE})"""
RELATIONS["purchase_hours"] = """
  SELECT event_hour AS hour, count(*) AS n FROM raw
  WHERE event_type = 'PullRequestEvent' GROUP BY 1"""
RELATIONS["ledger"] = """
  SELECT strftime(h.hour, '%Y-%m-%d-%H') AS key, coalesce(p.n, 0) AS num_rows,
    CASE WHEN p.n IS NULL THEN 'missing' ELSE 'ok' END AS status,
    CASE WHEN p.n IS NULL THEN 'not found' END AS error
  FROM hours h LEFT JOIN purchase_hours p USING (hour)"""


# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261,
)
_ALL = 1 << 64


def _times(value: str, factor: int) -> str:
    """Product modulo 2**64; factors of 64 bits fit the wide integer."""
    return f"(({value}) * {factor}::UHUGEINT % {_ALL}::UHUGEINT)"


def _turned(value: str, by: int) -> str:
    """Bits rotated to the left; the one-element list names the value once."""
    return f"list_transform([{value}], lambda v: v * {1 << by}::UHUGEINT % {_ALL}::UHUGEINT + v // {1 << (64 - by)}::UHUGEINT)[1]"


def _folded(value: str, by: int) -> str:
    return f"list_transform([{value}], lambda v: xor(v, v // {1 << by}::UHUGEINT))[1]"


def _xxh64(relation: str, text: str) -> str:
    """``relation`` with the XXH64 (seed 0) of a text of fewer than 32 bytes as ``h``."""
    number = lambda at, size: (
        f"('0x' || array_to_string(list_transform(range({size} - 1, -1, -1), lambda k: substr(digits, 2 * ({at} + k) + 1, 2)), ''))::UBIGINT::UHUGEINT"
    )
    eight = _times(_turned(f"xor(h, {_times(_turned(_times('x', _P2), 31), _P1)})", 27), _P1)
    four = _times(_turned(f"xor(h, {_times('x', _P1)})", 23), _P2)
    one = _times(_turned(f"xor(h, {_times('x', _P5)})", 11), _P1)
    return f"""(
  SELECT * EXCLUDE (digits, size, lanes, words, bytes, h2, h3), {_folded(_times(_folded(_times(_folded("h3", 33), _P2), 29), _P3), 32)} AS h
  FROM (SELECT *, list_reduce(bytes, lambda h, x: {one}, h2) AS h3 FROM (
    SELECT * EXCLUDE (h1), list_reduce(words, lambda h, x: ({four} + {_P3}::UHUGEINT) % {_ALL}::UHUGEINT, h1) AS h2 FROM (
      SELECT *, list_reduce(lanes, lambda h, x: ({eight} + {_P4}::UHUGEINT) % {_ALL}::UHUGEINT,
          {_P5}::UHUGEINT + size::UHUGEINT) AS h1 FROM (
        SELECT *, list_transform(range(0, size // 8), lambda i: {number("8 * i", 8)}) AS lanes,
          list_transform(range(0, size % 8 // 4), lambda i: {number("size // 8 * 8", 4)}) AS words,
          list_transform(range(size // 4 * 4, size), lambda i: {number("i", 1)}) AS bytes
        FROM (SELECT *, hex(encode({text})) AS digits, length(hex(encode({text}))) // 2 AS size FROM {relation}))))))"""


def _with(body: str) -> str:
    """Prefix a statement with the relations it uses, directly or not."""
    import re

    needed: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", todo.pop()))
        for name in words & set(RELATIONS) - needed:
            needed.add(name)
            todo.append(RELATIONS[name])
    parts = [f"{name} AS ({RELATIONS[name]})" for name in RELATIONS if name in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def _round(columns: str, source: str, doubles: str, suffix: str = "") -> str:
    rounded = [f"round({c.strip()}, 6) AS {c.strip()}" for c in doubles.split(",") if c.strip()]
    return f"SELECT {', '.join([columns, *rounded])} FROM {source} {suffix}"


_Q = ", ".join(f"q_{p}" for p in LEVELS)
_FC = "model, model_alias, frequency, cutoff, unique_id, ds"
_SERIES = "model, model_alias, cutoff, unique_id"
_RAW = (
    "event_id, created_at, event_type, repo_id, repo_name, actor_id, actor_login, action, "
    "push_distinct_size, year, month, day, hour"
)
_ENTITY = "repo_id, repo_name, stars, prs_opened, issues_opened, pushes, total_events"


def _forecast_of(model: str) -> str:
    return _round(_FC, "d_fc", f"yhat, {_Q}", f"WHERE model = '{model}'")


def _bounds() -> str:
    parts = []
    for name, unit in (("daily", "day"), ("weekly", "week"), ("monthly", "month")):
        start = f"date_trunc('{unit}', hour) - INTERVAL 1 {unit}"
        label = f"date_trunc('{unit}', hour) - INTERVAL 1 DAY" if unit == "week" else start
        parts += [
            f"CAST({start} AS TIMESTAMP) AS {name}_start",
            f"CAST(date_trunc('{unit}', hour) - INTERVAL 1 HOUR AS TIMESTAMP) AS {name}_end",
            f"CAST({label} AS TIMESTAMP) AS {name}_ds",
            f"date_diff('hour', CAST({start} AS TIMESTAMP), CAST(date_trunc('{unit}', hour) AS TIMESTAMP)) AS {name}_hours",
        ]
    return f"SELECT hour, {', '.join(parts)} FROM hours"


def _completeness(freq: str, unit: str, threshold: float) -> str:
    label = "p + INTERVAL 6 DAY" if unit == "week" else "p"
    return f"""
  SELECT '{freq}' AS frequency, p AS period_start,
    CAST(p + INTERVAL 1 {unit} - INTERVAL 1 HOUR AS TIMESTAMP) AS period_end,
    CAST({label} AS TIMESTAMP) AS ds, found_hours,
    date_diff('hour', p, CAST(p + INTERVAL 1 {unit} AS TIMESTAMP)) AS expected_hours,
    round(found_hours / date_diff('hour', p, CAST(p + INTERVAL 1 {unit} AS TIMESTAMP)), 6) AS completeness_ratio,
    found_hours / date_diff('hour', p, CAST(p + INTERVAL 1 {unit} AS TIMESTAMP)) >= {threshold} AS is_complete,
    last_found
  FROM (SELECT CAST(date_trunc('{unit}', hour) AS TIMESTAMP) AS p, count(*) AS found_hours,
    max(hour) AS last_found FROM purchase_hours GROUP BY 1)"""


def _bodies() -> dict[str, str]:
    b: dict[str, str] = {}
    b["flatten_filter_events"] = f"SELECT {_RAW} FROM kept"
    b["flatten_json_events"] = b["flatten_filter_events"]
    b["archive_files"] = b["flatten_filter_events"]
    b["hour_grid"] = """SELECT hour, strftime(hour, '%Y-%m-%d-%H') AS hour_key,
      strftime(hour, '%Y-%m-%d-') || CAST(hour(hour) AS VARCHAR) AS stamp FROM hours"""
    b["period_bounds"] = _bounds()
    b["iso_partitions"] = """SELECT DISTINCT o_orderdate AS ts,
      CAST(isoyear(o_orderdate) AS INTEGER) AS iso_year, CAST(week(o_orderdate) AS INTEGER) AS iso_week,
      CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
      CAST(day(o_orderdate) AS INTEGER) AS day FROM orders"""
    b["cutoff_grid"] = """SELECT unique_id, cutoff, strftime(cutoff, '%Y-%m-%d-%H') AS cutoff_key
      FROM (SELECT unique_id, unnest(generate_series(min(ds), max(ds), INTERVAL 7 DAY)) AS cutoff
        FROM daily GROUP BY unique_id)"""
    b["parse_cutoffs"] = """SELECT event_id, text, coalesce(try_strptime(text, '%Y-%m-%d-%H'),
        try_strptime(text, '%Y-%m-%d %H:%M:%S'), try_strptime(text, '%Y-%m-%d')) AS cutoff
      FROM (SELECT event_id, CASE event_type WHEN 'view' THEN strftime(ts, '%Y-%m-%d-%H')
        WHEN 'click' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 'signup' THEN strftime(ts, '%Y-%m-%d')
        ELSE event_type END AS text FROM events)"""
    b["entity_stats"] = f"SELECT {_ENTITY} FROM entity_year"
    b["active_periods"] = "SELECT repo_id, active_units FROM entity_year"
    b["eligible_entities"] = f"SELECT {_ENTITY}, active_units FROM eligible"
    b["entity_percent_rank"] = _round(
        "repo_id, stars, size_bucket", "ranked", "star_prank_all, star_prank_upper"
    )
    limits = " OR ".join(f"(size_bucket = '{k}' AND rn <= {n})" for k, n in q.SAMPLE_SIZES.items())
    b["entity_sample"] = _round(
        f"{_ENTITY}, size_bucket, active_units",
        f"""(SELECT *, row_number() OVER (PARTITION BY size_bucket
          ORDER BY md5(repo_id || ':v0.1.0'), repo_id) AS rn FROM ranked WHERE size_bucket IS NOT NULL)""",
        "star_prank_all, star_prank_upper",
        f"WHERE {limits}",
    )
    b["entity_sample_xxh64"] = _round(
        f"{_ENTITY}, size_bucket, active_units",
        f"""(SELECT *, row_number() OVER (PARTITION BY size_bucket
          ORDER BY h, repo_id) AS rn FROM {_xxh64("ranked", "repo_id || ':v0.1.0'")} WHERE size_bucket IS NOT NULL)""",
        "star_prank_all, star_prank_upper",
        f"WHERE {limits}",
    )
    b["first_events"] = """SELECT repo_id, min(event_hour) AS first_hour
      FROM raw JOIN eligible USING (repo_id) GROUP BY repo_id"""
    b["hourly_counts_sparse"] = """SELECT repo_id, metric, repo_id || ':' || metric AS unique_id,
      event_hour AS ds, y FROM sparse"""
    b["hourly_series"] = "SELECT * FROM hourly"
    b["daily_series"] = "SELECT * FROM daily"
    b["weekly_series"] = "SELECT * FROM weekly"
    b["monthly_series"] = "SELECT * FROM monthly"
    b["rollup_series"] = "SELECT * FROM daily"
    b["completeness"] = (
        _completeness("daily", "day", 0.90) + " UNION ALL " + _completeness("weekly", "week", 0.95)
    )
    b["series_sparsity"] = _round("unique_id, metric, n_obs, n_zero, sparsity_level", "sparsity", "zero_rate")
    first = f"cutoff = TIMESTAMP '{q.DAILY_CUTOFFS[0]}'"
    b["series_preview"] = f"""SELECT count(*) AS n_rows, count(DISTINCT unique_id) AS n_series,
      min(ds) AS min_ds, max(ds) AS max_ds FROM d_hist WHERE {first}"""
    b["series_head"] = f"""SELECT unique_id, ds, y FROM d_hist WHERE {first}
      ORDER BY unique_id, ds LIMIT {q.PREVIEW_ROWS}"""
    b["history_window"] = "SELECT cutoff, unique_id, ds, y FROM d_hist"
    b["actuals_window"] = "SELECT cutoff, unique_id, ds, y FROM d_act"
    b["rolling_stats"] = _round(
        "cutoff, unique_id, n_obs", "d_stats", "mean_y, mean_abs_y, sd_y, mean_abs_diff, sd_season"
    )
    day, hour = q.RENAMED_AT[:10], q.RENAMED_AT[11:]
    b["renamed_series"] = f"""SELECT repo_id, CASE WHEN d.repo_id % 2 = 0 AND EXISTS (
          SELECT 1 FROM kept k WHERE k.repo_id = d.repo_id AND k.event_hour >= TIMESTAMP '{day} {hour}:00:00'
            AND k.event_hour < d.ds + INTERVAL 1 DAY) THEN 'moved/' || repo_id ELSE repo_name END AS repo_name,
        metric, unique_id, ds, y FROM daily d"""
    b["repeated_entities"] = "SELECT repo_id, 2::BIGINT AS n FROM entities WHERE repo_id % 3 = 0"
    measures = "mean_y, mean_abs_y, sd_y, mean_abs_diff, sd_season"
    b["own_cutoff_history"] = "SELECT cutoff, unique_id, ds, y FROM own_hist"
    b["own_cutoff_actuals"] = """SELECT c.cutoff, unique_id, p.ds, p.y FROM own_cuts c JOIN daily p USING (unique_id)
      WHERE p.ds > c.cutoff AND p.ds <= c.cutoff + INTERVAL 7 DAY"""
    b["own_cutoff_stats"] = _round("cutoff, unique_id, n_obs", "own_stats", measures)
    b["hourly_fraction_stats"] = _round("cutoff, unique_id, n_obs", "share_stats", measures)
    b["hourly_backtest"] = _round(_FC, "h_fc", f"yhat, {_Q}")
    b["hourly_metrics"] = _round("unique_id, model, model_alias, cutoff, frequency, subdataset", "h_scores", "mase, scaled_crps")
    b["guard_window"] = f"""SELECT c.cutoff, count(DISTINCT CASE WHEN d.ds <= c.cutoff THEN d.ds END) AS found_periods,
        {q.DAILY_WINDOW}::BIGINT AS expected_periods,
        count(DISTINCT CASE WHEN d.ds > c.cutoff THEN d.ds END) AS found_actuals,
        count(DISTINCT CASE WHEN d.ds <= c.cutoff THEN d.ds END) = {q.DAILY_WINDOW} AS window_ok
      FROM (SELECT unnest([{_stamps(q.EDGE_CUTOFFS)}]) AS cutoff) c
      LEFT JOIN daily d ON d.ds > c.cutoff - INTERVAL {q.DAILY_WINDOW} DAY AND d.ds <= c.cutoff + INTERVAL 7 DAY
      GROUP BY c.cutoff"""
    b["guard_alignment"] = f"""SELECT cutoff, count(*) AS n_series,
        count_if(last_ds <> cutoff)::BIGINT AS n_misaligned, count_if(last_ds <> cutoff) = 0 AS aligned
      FROM (SELECT c.cutoff, repo_id, metric, max(date_trunc('day', event_hour)) AS last_ds
        FROM (SELECT unnest([{_stamps(q.DAILY_CUTOFFS)}]) AS cutoff) c
        JOIN sparse s ON date_trunc('day', event_hour) > c.cutoff - INTERVAL {q.DAILY_WINDOW} DAY
          AND date_trunc('day', event_hour) <= c.cutoff
        GROUP BY ALL) GROUP BY cutoff"""
    b["forecast_zero"] = _forecast_of("zero_model")
    b["forecast_historic_average"] = _forecast_of("historic_average")
    b["forecast_seasonal_naive"] = _forecast_of("seasonal_naive")
    b["forecast_backtest"] = _round(_FC, "d_fc", f"yhat, {_Q}")
    b["forecast_monthly"] = _round(_FC, "m_fc", f"yhat, {_Q}")
    b["forecast_model_file"] = b["forecast_historic_average"]
    empirical = ", ".join(f"quantile_cont(y, {p / 100}) AS q_{p}" for p in LEVELS)
    b["forecast_udf"] = _round(
        "'window_median' AS model, 'WindowMedian' AS model_alias, 'daily' AS frequency, cutoff, unique_id, "
        "CAST(cutoff + to_days(CAST(k AS INTEGER)) AS TIMESTAMP) AS ds",
        f"""(SELECT cutoff, unique_id, median(y) AS yhat, {empirical} FROM d_hist GROUP BY ALL),
          (SELECT unnest(range(1, 8)) AS k)""",
        f"yhat, {_Q}",
    )
    b["forecast_point_only"] = """SELECT 'last_value' AS model, cutoff, unique_id,
        CAST(cutoff + to_days(CAST(k AS INTEGER)) AS TIMESTAMP) AS ds, y::DOUBLE AS yhat,
        0::INTEGER AS n_quantiles
      FROM d_hist, (SELECT unnest(range(1, 8)) AS k) WHERE ds = cutoff"""
    b["mae_by_series"] = f"SELECT {_SERIES}, round(avg(abs(y - yhat)), 6) AS mae FROM joined GROUP BY ALL"
    b["mase_by_series"] = f"""SELECT {_SERIES}, round(mae / greatest(mean_abs_diff, 0.01), 6) AS mase
      FROM (SELECT {_SERIES}, avg(abs(y - yhat)) AS mae FROM joined GROUP BY ALL)
      JOIN d_stats USING (cutoff, unique_id)"""
    standard = "greatest(level / 100 * (y - f), (level / 100 - 1) * (y - f))"
    ours = "greatest(level / 100 * (f - y), (level / 100 - 1) * (f - y))"
    b["pinball_by_quantile"] = f"""SELECT {_SERIES}, level, round(sum({ours}), 6) AS loss,
        round(sum({standard}), 6) AS standard_loss
      FROM (SELECT {_SERIES}, y, CAST(substr(name, 3) AS INTEGER) AS level, f
        FROM (SELECT {_SERIES}, y, {_Q} FROM joined) UNPIVOT (f FOR name IN ({_Q})))
      GROUP BY ALL"""
    b["scaled_crps"] = f"""SELECT {_SERIES}, round(crps / greatest(mean_abs_y, 1.0), 6) AS scaled_crps
      FROM (SELECT {_SERIES}, 2 * sum({_MEAN_LOSS}) AS crps FROM joined GROUP BY ALL)
      JOIN d_stats USING (cutoff, unique_id)"""
    filled = ", ".join(f"round(coalesce(q_{p}, yhat), 6) AS q_{p}" for p in LEVELS)
    b["quantile_fill"] = f"SELECT {_FC}, y, round(yhat, 6) AS yhat, {filled} FROM flat_joined"
    b["guard_quantiles"] = """SELECT model, cutoff, count(*) AS n_rows,
        count_if(yhat IS NOT NULL AND q_90 IS NULL)::BIGINT AS n_fill,
        count_if(yhat IS NOT NULL AND q_90 IS NULL) < 0.05 * count(*) AS fillable
      FROM flat_joined GROUP BY ALL"""
    metric = "unique_id, model, model_alias, cutoff, frequency, subdataset"
    b["evaluate_metrics"] = _round(metric, "d_scores", "mase, scaled_crps")
    b["guard_leakage"] = """SELECT model, model_alias, cutoff, min(ds) AS min_ds, min(ds) < cutoff AS leaks
      FROM d_fc GROUP BY model, model_alias, cutoff"""
    first, second = (f"TIMESTAMP '{c} 00:00:00'" for c in q.DAILY_CUTOFFS)
    gone = f"model = 'historic_average' AND cutoff = {first}"
    some = f"""ds = cutoff + INTERVAL 1 DAY AND model = 'seasonal_naive'
          AND (cutoff = {first} OR cutoff = {second} AND unique_id = (SELECT min(unique_id) FROM daily))"""
    spoilt = ", ".join(f"CASE WHEN {gone}{f' OR {some}' if p == 50 else ''} THEN NULL ELSE q_{p} END AS q_{p}" for p in LEVELS)
    nulls = " OR ".join(f"q_{p} IS NULL" for p in LEVELS)
    b["guard_status"] = f"""SELECT model, cutoff, CASE WHEN min_ds < cutoff THEN 'leakage' WHEN n_past < {q.DAILY_WINDOW} THEN 'missing_history'
        WHEN n_actual = 0 THEN 'no_actuals' WHEN n_next < 7 THEN 'missing_actuals' WHEN n_quantiled = 0 THEN 'no_quantiles'
        WHEN n_matched < n_actual OR n_fill > 0 AND n_fill >= 0.05 * (n_rows + n_actual - n_matched) THEN 'null_values' ELSE 'ok' END AS status
      FROM (
        SELECT model, f.cutoff, min(f.ds) AS min_ds, count(a.y) AS n_matched, count(a.y) AS n_rows,
          count_if(coalesce({", ".join(f"q_{p}" for p in LEVELS)}) IS NOT NULL) AS n_quantiled,
          count_if(a.y IS NOT NULL AND yhat IS NOT NULL AND ({nulls})) AS n_fill
        FROM (SELECT * REPLACE (CASE WHEN model = 'zero_model' AND cutoff = {first} AND ds = cutoff + INTERVAL 1 DAY
              THEN cutoff - INTERVAL 1 DAY ELSE ds END AS ds, {spoilt}) FROM g_fc
            WHERE NOT (model = 'historic_average' AND cutoff = {second} AND unique_id = (SELECT min(unique_id) FROM daily))) f
        LEFT JOIN g_act a ON a.cutoff = f.cutoff AND a.unique_id = f.unique_id AND a.ds = f.ds GROUP BY ALL)
      JOIN (SELECT c.cutoff, count(DISTINCT CASE WHEN d.ds <= c.cutoff THEN d.ds END) AS n_past,
          count(DISTINCT CASE WHEN d.ds > c.cutoff THEN d.ds END) AS n_next, count_if(d.ds > c.cutoff) AS n_actual
        FROM (SELECT unnest([{_stamps(q.GUARD_CUTOFFS)}]) AS cutoff) c
        LEFT JOIN daily d ON d.ds > c.cutoff - INTERVAL {q.DAILY_WINDOW} DAY AND d.ds <= c.cutoff + INTERVAL 7 DAY GROUP BY 1) USING (cutoff)"""
    b["guard_nulls"] = """SELECT model, a.cutoff, count(*) AS n_actual, count(f.yhat) AS n_matched,
        count(*) - count(f.yhat) AS n_unmatched,
        CASE WHEN count(*) > count(f.yhat) THEN 'null_values'
          WHEN any_value(a.n_short) > 0 THEN 'nan_metrics' ELSE 'ok' END AS status
      FROM (SELECT e_act.*, m.model, t.n_short
        FROM e_act, (SELECT DISTINCT model FROM e_fc) m,
          (SELECT cutoff AS c, count_if(n_obs < 2) AS n_short FROM e_stats GROUP BY cutoff) t
        WHERE t.c = e_act.cutoff) a
      LEFT JOIN e_fc f USING (model, cutoff, unique_id, ds) GROUP BY model, a.cutoff"""
    b["guard_nan"] = f"""SELECT model, cutoff, count(*) AS n_series,
        count_if(mase IS NULL OR isnan(mase))::BIGINT AS n_undefined
      FROM e_scores WHERE cutoff = '{q.EARLY_CUTOFFS[-1]}-00' GROUP BY ALL"""
    b["metrics_unpivot"] = _round(f"dataset, {metric}, metric, sparsity_level", "raw_long", "value")
    group = f"dataset, {_STRATUM}, model, model_alias"
    b["stratum_median"] = _round(group, "med", "v")
    b["zero_denominator"] = _round(_STRATUM, "denoms", "median_zero, pct_z, denom")
    b["scaled_scores"] = _round(group, "scaled", "median_zero, pct_z, denom, value")
    b["leaderboard_grid"] = f"SELECT {group} FROM grid"
    b["leaderboard"] = _round(group, "board", "value, median_zero, pct_z, denom")
    b["leaderboard_gaps"] = "SELECT count(*) AS total, count(*) - count(value) AS missing FROM board"
    b["ledger_status"] = """SELECT key, num_rows,
        CASE WHEN status <> 'ok' AND key LIKE '2024-01-01-%' THEN 'known_issue' ELSE status END AS status,
        CASE WHEN status <> 'ok' AND key LIKE '2024-01-01-%' THEN 'known upstream issue' ELSE error END AS error
      FROM ledger"""
    b["ledger_counts"] = """SELECT count(*) AS total, count_if(status = 'ok')::BIGINT AS ok,
        count_if(status = 'missing')::BIGINT AS missing, 0::BIGINT AS empty, 0::BIGINT AS unreadable,
        0::BIGINT AS known_issue, count_if(status <> 'ok') = 0 AS all_ok FROM ledger"""
    b["pending_keys"] = "SELECT key FROM ledger WHERE status <> 'ok'"
    b["stream_hourly_counts"] = """SELECT repo_id, event_hour,
        count_if(event_type = 'WatchEvent')::BIGINT AS stars,
        count_if(event_type = 'PullRequestEvent' AND action = 'opened')::BIGINT AS prs_opened,
        count_if(event_type = 'IssuesEvent' AND action = 'opened')::BIGINT AS issues_opened,
        count_if(event_type = 'PushEvent')::BIGINT AS pushes, count(*) AS n_events
      FROM kept GROUP BY repo_id, event_hour"""
    monthly = lambda panel, cutoffs, window: _history("monthly", cutoffs, window).replace("JOIN monthly p", f"JOIN {panel} p")
    b |= stored.bodies(METRIC_CASE, _stats, _round, monthly)
    b["stored_forecasts"] = b["forecast_backtest"]
    b |= layers.bodies()
    b["incremental_leaderboard"] = b["leaderboard"]
    model, cutoff = stored.RESCORED
    b["rescored_metrics"] = f"SELECT * FROM ({b['evaluate_metrics']}) WHERE NOT (model = '{model}' AND cutoff = '{cutoff}-00')"
    return b


def all_sql() -> dict[str, str]:
    """SQL by query name."""
    return {name: _with(body) for name, body in _bodies().items()}
