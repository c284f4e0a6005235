"""DuckDB SQL for the retail queries that SQL can express."""

from __future__ import annotations

from granary.operators.customers import ACTIONS, LABELS, OTHER_ACTION

#: Centers in scaled space for the assignment that needs no random start.
CENTERS = [(0.0, -1.5, -1.5), (1.0, -0.5, -0.5), (0.0, 0.5, 0.5), (-1.0, 1.0, 1.0)]

#: Steps of K-Means from these centers, and coefficients of the seasonal model that need no fit.
STEPS, COEFFICIENTS = 5, (0.3, -0.2, 0.4)

RAW = """
raw AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(l_orderkey AS VARCHAR) AS invoice_no, CAST(l_partkey AS VARCHAR) AS stock_code, p_name AS description,
         CAST(l_quantity AS INTEGER) AS quantity, o_orderdate AS invoice_date, l_extendedprice / l_quantity AS unit_price, CAST(o_custkey AS DOUBLE) AS customer_id, n_name AS country
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), t AS (
  SELECT * FROM raw WHERE customer_id IS NOT NULL AND NOT starts_with(invoice_no, 'C') AND quantity > 0 AND unit_price > 0
)"""
WEEK = "CAST(date_trunc('week', {}) + INTERVAL 6 DAY AS TIMESTAMP)"
WEEKLY = f"""{RAW}, best AS (
  SELECT stock_code, CAST(sum(quantity) AS BIGINT) AS total_quantity FROM t GROUP BY stock_code ORDER BY total_quantity DESC, stock_code LIMIT 100
), weekly AS (
  SELECT {WEEK.format("invoice_date")} AS week, stock_code, CAST(sum(quantity) AS BIGINT) AS weekly_sales
  FROM t WHERE stock_code IN (SELECT stock_code FROM best) GROUP BY 1, 2
)"""
FEATURES = f"""{WEEKLY}, lags AS (
  SELECT week, stock_code, weekly_sales, CAST(lag(weekly_sales, 1) OVER w AS DOUBLE) AS lag_1_week, CAST(lag(weekly_sales, 2) OVER w AS DOUBLE) AS lag_2_week,
         avg(weekly_sales) OVER (PARTITION BY stock_code ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS rolling_4_wk_avg, CAST(month(week) AS INTEGER) AS month
  FROM weekly WINDOW w AS (PARTITION BY stock_code ORDER BY week)
), f AS (
  SELECT * FROM lags WHERE lag_1_week IS NOT NULL AND lag_2_week IS NOT NULL AND rolling_4_wk_avg IS NOT NULL
), recent AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY stock_code ORDER BY week DESC) AS INTEGER) AS nth FROM f QUALIFY nth <= 4
), means AS (
  SELECT stock_code, avg(weekly_sales) AS mean FROM recent GROUP BY stock_code
)"""
MONEY = "CAST(sum(CAST({} AS DECIMAL(18,4))) AS DOUBLE)"


def _profiles(source: str, customer: str, order: str, time: str, amount: str) -> str:
    return f"""
  SELECT {customer} AS customer_id, CAST(date_sub('day', max({time}), (SELECT max({time}) + INTERVAL 1 DAY FROM {source})) AS BIGINT) AS recency,
         CAST(count(DISTINCT {order}) AS BIGINT) AS frequency, {MONEY.format(amount)} AS monetary
  FROM {source} WHERE {customer} IS NOT NULL GROUP BY {customer}"""


def _scaled() -> str:
    parts = ", ".join(f"CASE WHEN stddev_pop(ln(1 + {m})) OVER () = 0 THEN 0.0 ELSE (ln(1 + {m}) - avg(ln(1 + {m})) OVER ()) / stddev_pop(ln(1 + {m})) OVER () END AS z_{m}" for m in ("recency", "frequency", "monetary"))
    far = [" + ".join(f"pow(round(z_{m}, 6) - CAST({c} AS DOUBLE), 2.0)" for m, c in zip(("recency", "frequency", "monetary"), center, strict=True)) for center in CENTERS]
    columns = ", ".join(f"round({d}, 6) AS d{i}" for i, d in enumerate(far))
    which = " ".join(f"WHEN d{i} = least(d0, d1, d2, d3) THEN {i}" for i in range(len(CENTERS)))
    return f"""{RAW}, r AS ({_profiles("t", "customer_id", "invoice_no", "invoice_date", "quantity * unit_price")}
), z AS (
  SELECT *, {parts} FROM r
), d AS (
  SELECT *, {columns} FROM z
), c AS (
  SELECT customer_id, recency, frequency, monetary, CAST(CASE {which} END AS INTEGER) AS cluster FROM d
), labels AS (
  SELECT cluster, avg(monetary) AS mean_monetary, [{", ".join(f"'{x}'" for x in LABELS)}][row_number() OVER (ORDER BY avg(monetary), cluster)] AS segment_label FROM c GROUP BY cluster
), s AS (
  SELECT customer_id, recency, frequency, monetary, cluster, segment_label FROM c JOIN labels USING (cluster)
)"""


SCALED = _scaled()
ACTION = "CASE segment_label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items()) + f" ELSE '{OTHER_ACTION}' END"
AHEAD = "SELECT stock_code, CAST(h AS INTEGER) AS week_horizon, round_even(greatest(0.0::DOUBLE, mean * (1.0::DOUBLE + 0.02::DOUBLE * h)) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS predicted_quantity FROM means, range(1, {}) AS x(h)"
PARTS = f"""{FEATURES}, parts AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY stock_code ORDER BY week) <= floor(count(*) OVER (PARTITION BY stock_code) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS part FROM f
)"""



def _lloyd(steps: int) -> str:
    """Steps of K-Means as one chain of table expressions: centers, assignment, means."""
    names = ("recency", "frequency", "monetary")
    far = [" + ".join(f"pow(round(z_{m}, 6) - c{i}_{m}, 2.0)" for m in names) for i in range(len(CENTERS))]
    parts = ["k0 AS (SELECT " + ", ".join(f"CAST({v} AS DOUBLE) AS c{i}_{m}" for i, c in enumerate(CENTERS) for m, v in zip(names, c, strict=True)) + ")"]
    for s in range(steps + 1):
        which = " ".join(f"WHEN d{i} = least(d0, d1, d2, d3) THEN {i}" for i in range(len(CENTERS)))
        parts.append(f"a{s} AS (SELECT *, CASE {which} END AS cluster FROM (SELECT z.*, k{s}.*, {', '.join(f'round({d}, 6) AS d{i}' for i, d in enumerate(far))} FROM z, k{s}))")
        parts.append(f"m{s} AS (SELECT cluster, {', '.join(f'round(avg(round(z_{m}, 6)), 6) AS {m}' for m in names)} FROM a{s} GROUP BY cluster)")
        parts.append(f"k{s + 1} AS (SELECT " + ", ".join(f"coalesce((SELECT {m} FROM m{s} WHERE cluster = {i}), c{i}_{m}) AS c{i}_{m}" for i in range(len(CENTERS)) for m in names) + f" FROM k{s})")
    own = " ".join(f"WHEN {i} THEN {d}" for i, d in enumerate(far))
    return f"{', '.join(parts)} SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS customer_count, round(CAST(sum(CAST(CASE cluster {own} END AS DECIMAL(18,10))) AS DOUBLE), 4) AS cost FROM a{steps} GROUP BY cluster"


def _k_means(k: int = 4, starts: int = 10, seed: int = 42, steps: int = 300) -> str:
    """k-means++ starts, steps of all of them until they stay, the best one, and labels by mean monetary value."""
    far = lambda c: " + ".join(f"(u{i} - {c}[{i + 1}]) * (u{i} - {c}[{i + 1}])" for i in range(3))
    parts = ["""u AS (SELECT *, CAST(CAST(customer_id AS DECIMAL(20,2)) AS VARCHAR) AS key, CAST(round_even(round(z_recency, 6) * 1000000, 0) AS BIGINT) AS u0,
        CAST(round_even(round(z_frequency, 6) * 1000000, 0) AS BIGINT) AS u1, CAST(round_even(round(z_monetary, 6) * 1000000, 0) AS BIGINT) AS u2 FROM z)"""]
    chance = "(CAST('0x' || substr(sha256('{}:' || CAST(s AS VARCHAR) || ':{}:' || key), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296"
    parts.append(f"c0 AS (SELECT s, [arg_min([u0, u1, u2], -ln({chance.format(seed, 0)}))] AS cs FROM u, range({starts}) r(s) GROUP BY s)")
    for n in range(1, k):
        least = ", ".join(far(f"cs[{i + 1}]") for i in range(n))
        parts.append(f"""c{n} AS (SELECT s, list_append(any_value(cs), arg_min([u0, u1, u2], -ln({chance.format(seed, n)}) / rate) FILTER (WHERE rate > 0)) AS cs
            FROM (SELECT u.*, s, cs, least({least}) AS rate FROM u, c{n - 1}) GROUP BY s)""")
    which = " ".join(f"WHEN {far(f'cs[{i + 1}]')} = least({', '.join(far(f'cs[{j + 1}]') for j in range(k))}) THEN {i}" for i in range(k))
    mean = "CAST((2 * sum(u{0}) FILTER (WHERE own = {1}) + count(*) FILTER (WHERE own = {1}) + 2 * count(*) FILTER (WHERE own = {1}) * 1000000000::HUGEINT) // (2 * count(*) FILTER (WHERE own = {1})) - 1000000000 AS BIGINT)"
    means = ", ".join(f"CASE WHEN count(*) FILTER (WHERE own = {i}) = 0 THEN any_value(cs)[{i + 1}] ELSE [{', '.join(mean.format(j, i) for j in range(3))}] END" for i in range(k))
    parts.append(f"""moves AS (SELECT 0 AS step, s, cs, true AS moved FROM c{k - 1} UNION ALL
        SELECT step + 1, s, new, new != cs FROM (SELECT any_value(step) AS step, s, any_value(cs) AS cs, [{means}] AS new FROM (SELECT u0, u1, u2, step, s, cs, CASE {which} END AS own FROM u, moves WHERE moved AND step < {steps}) GROUP BY s))""")
    parts.append("ends AS (SELECT s, arg_max(cs, step) AS cs FROM moves GROUP BY s)")
    parts.append(f"best AS (SELECT cs FROM (SELECT s, any_value(cs) AS cs, sum(least({', '.join(far(f'cs[{j + 1}]') for j in range(k))})) AS cost FROM u, ends GROUP BY s) ORDER BY cost, s LIMIT 1)")
    parts.append(f"kc AS (SELECT customer_id, recency, frequency, monetary, CAST(CASE {which} END AS INTEGER) AS cluster FROM u, best)")
    names = ", ".join(f"'{x}'" for x in LABELS)
    parts.append(f"kl AS (SELECT cluster, [{names}][row_number() OVER (ORDER BY avg(monetary), cluster)] AS segment_label FROM kc GROUP BY cluster)")
    return f"WITH RECURSIVE {SCALED}, {', '.join(parts)} SELECT customer_id, recency, frequency, monetary, cluster, segment_label FROM kc JOIN kl USING (cluster)"


def _first_tree(depth: int = 4, rate: float = 0.05, penalty: float = 1.0) -> str:
    """A tree by trying every cut of every feature at every node, a level after the other."""
    parts = [f"""{PARTS}, tr AS (SELECT stock_code, [lag_1_week, lag_2_week, rolling_4_wk_avg, CAST(month AS DOUBLE)] AS x, CAST(weekly_sales AS DOUBLE) AS y FROM parts WHERE part = 'train'),
        cv AS (SELECT stock_code, f, cut FROM (SELECT DISTINCT stock_code, f, x[f + 1] AS cut FROM tr, range(4) r(f)) QUALIFY row_number() OVER (PARTITION BY stock_code, f ORDER BY cut) > 1),
        r0 AS (SELECT stock_code, 0 AS node, x, avg(y) OVER (PARTITION BY stock_code) - y AS g FROM tr)"""]
    score = lambda g, n: f"pow({g}, 2) / ({n} + {penalty})"
    for d in range(depth):
        parts.append(f"""t{d} AS (SELECT stock_code, node, f, cut, sum(g) AS g, count(*) AS n, sum(g) FILTER (WHERE x[f + 1] < cut) AS lg, count(*) FILTER (WHERE x[f + 1] < cut) AS ln_ FROM r{d} JOIN cv USING (stock_code) GROUP BY ALL),
            s{d} AS (SELECT stock_code, node, f, cut, n FROM (SELECT *, round({score("lg", "ln_")} + {score("(g - lg)", "(n - ln_)")} - {score("g", "n")}, 6) AS gain FROM t{d} WHERE ln_ > 0 AND ln_ < n)
              WHERE gain > 1e-6 QUALIFY row_number() OVER (PARTITION BY stock_code, node ORDER BY gain DESC, f, cut) = 1),
            r{d + 1} AS (SELECT stock_code, 2 * node + 1 + CASE WHEN x[f + 1] >= cut THEN 1 ELSE 0 END AS node, x, g FROM r{d} JOIN s{d} USING (stock_code, node))""")
    inner = " UNION ALL ".join(f"SELECT stock_code, CAST(node AS INTEGER) AS node, CAST(f AS INTEGER) AS feature, round(cut, 6) AS cut, CAST(NULL AS DOUBLE) AS value, n FROM s{d}" for d in range(depth))
    leaves = " UNION ALL ".join(f"SELECT stock_code, node, g FROM r{d}" + (f" ANTI JOIN s{d} USING (stock_code, node)" if d < depth else "") for d in range(depth + 1))
    return f"WITH {', '.join(parts)} {inner} UNION ALL SELECT stock_code, CAST(node AS INTEGER), NULL, NULL, round(-{rate} * sum(g) / (count(*) + {penalty}), 6), count(*) FROM ({leaves}) GROUP BY stock_code, node"


def _sarima() -> str:
    """The recursion of residuals and of forecasts of the seasonal model with given coefficients."""
    phi, seasonal, theta = (f"CAST({c} AS DOUBLE)" for c in COEFFICIENTS)
    w = lambda k: f"coalesce(w[len(w) - {k - 1}], 0)"
    past = lambda k: f"CASE WHEN t > {k} THEN w[t - {k}] ELSE 0 END"
    return f"""WITH RECURSIVE {PARTS}, y AS (
  SELECT stock_code, list(CAST(weekly_sales AS DOUBLE) ORDER BY week) FILTER (WHERE part = 'train') AS y FROM parts GROUP BY 1
), d AS (
  SELECT *, list_transform(range(1, len(y)), lambda i: y[i + 1] - y[i]) AS d FROM y WHERE len(y) > 0
), w AS (
  SELECT *, list_transform(range(1, len(d) - 3), lambda i: d[i + 4] - d[i]) AS w FROM d
), u AS (
  SELECT *, list_transform(range(1, len(w) + 1), lambda t: w[t] - {phi} * ({past(1)}) - {seasonal} * ({past(4)}) + {phi} * {seasonal} * ({past(5)})) AS u FROM w
), e AS (
  SELECT stock_code, y, w, CASE WHEN len(u) > 0 THEN list_reduce(u, lambda e, x: x - {theta} * e) ELSE 0 END AS e FROM u
), test AS (
  SELECT stock_code, week, weekly_sales, row_number() OVER (PARTITION BY stock_code ORDER BY week) AS step FROM parts WHERE part = 'test'
), steps AS (
  SELECT stock_code, 0 AS step, len(y) < 7 AS short, y, w, e FROM e
  UNION ALL
  SELECT stock_code, step + 1, short,
         list_append(y, CASE WHEN short THEN y[len(y)] ELSE y[len(y)] + (y[len(y) - 3] - y[len(y) - 4]) + {phi} * {w(1)} + {seasonal} * {w(4)} - {phi} * {seasonal} * {w(5)} + {theta} * e END),
         list_append(w, {phi} * {w(1)} + {seasonal} * {w(4)} - {phi} * {seasonal} * {w(5)} + {theta} * e), 0.0
  FROM steps WHERE step < (SELECT max(step) FROM test)
)
SELECT t.stock_code, t.week, t.weekly_sales, round(s.y[len(s.y)], 6) AS prediction FROM test t JOIN steps s ON t.stock_code = s.stock_code AND t.step = s.step"""


def _likelihood() -> str:
    """The Kalman filter of the seasonal model with given coefficients, a value a step; the first covariance by repetition."""
    phi, seasonal, theta = COEFFICIENTS
    c, r = (f"[{', '.join(f'{float(x)!r}::DOUBLE' for x in xs)}]" for xs in ((phi, 0, 0, seasonal, -phi * seasonal), (1, theta, 0, 0, 0)))
    at = lambda m, i, j: f"CASE WHEN {i} > 4 OR {j} > 4 THEN 0 ELSE {m}[5 * ({i}) + {j} + 1] END"
    i, j = "(k // 5)", "(k % 5)"
    moved = f"list_transform(range(25), lambda k: {c}[{i} + 1] * {c}[{j} + 1] * m[1] + {c}[{i} + 1] * ({at('m', 0, f'{j} + 1')}) + {c}[{j} + 1] * ({at('m', f'{i} + 1', 0)}) + {at('m', f'{i} + 1', f'{j} + 1')} + {r}[{i} + 1] * {r}[{j} + 1])"
    return f"""WITH RECURSIVE {PARTS}, d AS (
  SELECT stock_code, week, weekly_sales - lag(weekly_sales) OVER w AS d FROM parts WHERE part = 'train' WINDOW w AS (PARTITION BY stock_code ORDER BY week)
), w AS (
  SELECT stock_code, list(w ORDER BY week) FILTER (WHERE w IS NOT NULL) AS w FROM (SELECT *, CAST(d - lag(d, 4) OVER (PARTITION BY stock_code ORDER BY week) AS DOUBLE) AS w FROM d) GROUP BY 1 HAVING count(w) > 0
), begun AS (
  SELECT 0 AS n, list_transform(range(25), lambda k: 0.0::DOUBLE) AS m UNION ALL SELECT n + 1, {moved} FROM begun WHERE n < 150
), steps AS (
  SELECT stock_code, w, 0 AS t, list_transform(range(5), lambda k: 0.0::DOUBLE) AS a, (SELECT arg_max(m, n) FROM begun) AS p, 0.0::DOUBLE AS squares, 0.0::DOUBLE AS logs FROM w
  UNION ALL
  SELECT stock_code, w, t + 1, list_transform(range(5), lambda i: {c}[i + 1] * b[1] + CASE WHEN i < 4 THEN b[i + 2] ELSE 0 END), {moved}, squares + v * v / p[1], logs + ln(p[1])
  FROM (SELECT *, w[t + 1] - a[1] AS v, list_transform(range(5), lambda i: a[i + 1] + p[5 * i + 1] * (w[t + 1] - a[1]) / p[1]) AS b,
        list_transform(range(25), lambda k: p[k + 1] - p[5 * {i} + 1] * p[{j} + 1] / p[1]) AS m FROM steps WHERE t < len(w))
)
SELECT stock_code, round(squares / t, 4) AS variance, round(-0.5 * (t * (ln(2 * pi()) + 1 + ln(greatest(squares / t, 1e-9))) + logs), 5) AS log_likelihood FROM steps WHERE t = len(w)"""


def _trend_design(changes: int = 25, share: float = 0.8, waves: int = 10) -> str:
    angles = ", ".join(f"{f}(2 * pi() * {k} * d / 365.25::DOUBLE)" for k in range(1, waves + 1) for f in ("sin", "cos"))
    time = "CASE WHEN {0}[len({0})] > {0}[1] THEN ({1} - {0}[1]) / ({0}[len({0})] - {0}[1]) ELSE 0 END".format
    return f"""WITH {PARTS}, x AS (
  SELECT stock_code, week, d, list(d) FILTER (WHERE part = 'train') OVER (PARTITION BY stock_code ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ds FROM (SELECT *, epoch(week) / 86400.0::DOUBLE AS d FROM parts)
), y AS (
  SELECT *, CAST(floor(len(ds) * {share}::DOUBLE) AS BIGINT) AS early, greatest(least({changes}, early - 1), 0) AS m FROM x WHERE len(ds) > 0
), z AS (
  SELECT stock_code, week, m, [1.0::DOUBLE, {time("ds", "d")}] || list_transform(range(1, m + 1), lambda j: greatest({time("ds", "d")} - {time("ds", "ds[CAST(floor(j * (early - 1) / CAST(m AS DOUBLE) + 0.5::DOUBLE) AS BIGINT) + 1]")}, 0.0::DOUBLE)) || [{angles}] AS terms FROM y
)
SELECT stock_code, week, CAST(m AS INTEGER) AS n_changes, CAST(i - 1 AS INTEGER) AS i, round(terms[i], 6) + 0.0::DOUBLE AS value FROM z, range(1, {changes + 2 * waves + 3}) r(i) WHERE i <= len(terms)"""


def _normal_equations(order: int = 3) -> str:
    waves = ", ".join(f"{f}(2 * pi() * {k} * t)" for k in range(1, order + 1) for f in ("sin", "cos"))
    return f"""WITH {PARTS}, s AS (
  SELECT stock_code, week, part, CAST(weekly_sales AS DOUBLE) AS y, min(week) FILTER (WHERE part = 'train') OVER (PARTITION BY stock_code) AS first FROM parts
), x AS (
  SELECT stock_code, y, [1.0::DOUBLE, t, {waves}] AS x FROM (SELECT *, (epoch(week) - epoch(first)) / (365.25::DOUBLE * 86400) AS t FROM s WHERE part = 'train')
)
SELECT stock_code, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(x[i + 1] * CASE WHEN j < 0 THEN y ELSE x[j + 1] END), 5) AS value
FROM x, range({2 + 2 * order}) AS a(i), range(-1, {2 + 2 * order}) AS b(j) WHERE j < 0 OR j >= i GROUP BY 1, 2, 3"""


ORACLES: dict[str, str] = {
    "clean_transactions": f"WITH {RAW} SELECT *, quantity * unit_price AS total_sales FROM t",
    "monthly_revenue": f"""WITH {RAW}, m AS (SELECT last_day(invoice_date) AS month_end, {MONEY.format("quantity * unit_price")} AS revenue FROM t GROUP BY 1),
        spine AS (SELECT last_day(CAST(x AS DATE)) AS month_end FROM (SELECT unnest(generate_series(date_trunc('month', min(month_end)), date_trunc('month', max(month_end)), INTERVAL 1 MONTH)) AS x FROM m))
        SELECT month_end, coalesce(revenue, 0.0) AS revenue FROM spine LEFT JOIN m USING (month_end)""",
    "top10_products": f"WITH {RAW} SELECT description, CAST(sum(quantity) AS BIGINT) AS total_quantity FROM t WHERE description IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "top100_skus": f"WITH {WEEKLY} SELECT stock_code, total_quantity FROM best",
    "weekly_demand": f"WITH {WEEKLY} SELECT * FROM weekly",
    "dense_weekly_demand": f"""WITH {WEEKLY}, spine AS (SELECT stock_code, unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS week FROM weekly GROUP BY 1)
        SELECT week, stock_code, coalesce(weekly_sales, 0) AS weekly_sales FROM spine LEFT JOIN weekly USING (stock_code, week)""",
    "weekly_features": f"WITH {FEATURES} SELECT * FROM f",
    "top_sku": f"WITH {FEATURES} SELECT stock_code, CAST(sum(weekly_sales) AS BIGINT) AS total_sales FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "sku_history_latest4": f"WITH {FEATURES} SELECT stock_code, week, weekly_sales, nth FROM recent",
    "forecast_horizon": f"WITH {FEATURES} {AHEAD.format(13)}",
    "forecast_responses": f"""WITH {FEATURES}, ahead AS ({AHEAD.format(5)})
        SELECT stock_code, CAST(4 AS INTEGER) AS forecast_horizon_weeks, string_agg(CAST(week_horizon AS VARCHAR) || ':' || printf('%.2f', predicted_quantity), ',' ORDER BY week_horizon) AS predictions FROM ahead GROUP BY 1""",
    "rfm": f"WITH {RAW} {_profiles('t', 'customer_id', 'invoice_no', 'invoice_date', 'quantity * unit_price')}",
    "rfm_events": _profiles("events", "user_id", "event_type", "ts", "value"),
    "weekly_events": f"SELECT {WEEK.format('ts')} AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "rfm_scaled": f"WITH {SCALED} SELECT customer_id, round(z_recency, 6) AS z_recency, round(z_frequency, 6) AS z_frequency, round(z_monetary, 6) AS z_monetary FROM z",
    "assign_fixed_centroids": f"WITH {SCALED} SELECT customer_id, cluster FROM c",
    "label_clusters": f"WITH {SCALED} SELECT cluster, round(mean_monetary, 2) AS mean_monetary, segment_label FROM labels",
    "customer_segments": f"WITH {SCALED} SELECT * FROM s",
    "segment_summary": f"WITH {SCALED} SELECT segment_label, round(avg(recency), 4) AS recency, round(avg(frequency), 4) AS frequency, round(avg(monetary), 4) AS monetary, count(customer_id) AS customer_count FROM s GROUP BY 1",
    "segment_lookup": f"WITH {SCALED} SELECT customer_id, recency, frequency, monetary, segment_label, {ACTION} AS strategic_next_action FROM s WHERE customer_id = 7.0",
    "segment_actions": f"WITH {SCALED} SELECT customer_id, CAST(recency AS INTEGER) AS days_since_last_purchase, CAST(frequency AS INTEGER) AS total_lifetime_orders, segment_label AS assigned_bucket, {ACTION} AS strategic_next_action, CAST(format('{{:.2f}}', monetary) AS DOUBLE) AS total_monetary_spend FROM s",
    "net_quantities": f"WITH {RAW} SELECT stock_code, CAST(sum(CASE WHEN starts_with(invoice_no, 'C') THEN -abs(quantity) ELSE quantity END) AS BIGINT) AS net_quantity FROM raw GROUP BY 1",
    "train_test_split": f"WITH {PARTS} SELECT stock_code, week, weekly_sales, part FROM parts",
    "naive_metrics": f"""WITH {PARTS} SELECT stock_code, round(avg(abs(weekly_sales - lag_1_week) / greatest(abs(CAST(weekly_sales AS DOUBLE)), 2.220446049250313e-16)), 6) AS mape,
        round(sqrt(avg(pow(weekly_sales - lag_1_week, 2.0))), 6) AS rmse FROM parts WHERE part = 'test' GROUP BY 1""",
    "row_counts": f"WITH {RAW} SELECT 'raw' AS what, count(*) AS n FROM raw UNION ALL SELECT 'clean', count(*) FROM t",
    "projected_transactions": f"WITH {RAW} SELECT customer_id, invoice_no, invoice_date, quantity, unit_price FROM t",
    "inline_rows": f"""WITH {SCALED}, given AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{x}', '{ACTIONS[x]}')" for i, x in enumerate(LABELS))}) AS v(step, segment_label, strategic_next_action))
        SELECT step, segment_label, strategic_next_action, count(customer_id) AS customers FROM given LEFT JOIN s USING (segment_label) GROUP BY 1, 2, 3""",
    "known_products": f"WITH {FEATURES} SELECT CAST(p_partkey AS VARCHAR) AS stock_code, CAST(p_partkey AS VARCHAR) IN (SELECT stock_code FROM f) AS found FROM part",
    "ordered_features": f"WITH {FEATURES} SELECT row_number() OVER (ORDER BY week, stock_code) AS position, week, stock_code, weekly_sales FROM f",
    "keyed_transactions": f"WITH {RAW} SELECT row_number() OVER (ORDER BY invoice_no, stock_code, quantity, unit_price, customer_id, invoice_date) AS id, invoice_no, stock_code, quantity, unit_price, customer_id, invoice_date FROM t",
    "stored_answers": f"""{f"WITH {SCALED}"}, {FEATURES.removeprefix(RAW + ", ")}, ahead AS ({AHEAD.format(5)})
        SELECT 'segment' AS answer, '7' AS key, CAST(0 AS INTEGER) AS step, segment_label AS label, CAST(format('{{:.2f}}', monetary) AS DOUBLE) AS value FROM s WHERE customer_id = 7.0
        UNION ALL SELECT 'forecast', stock_code, week_horizon, NULL, predicted_quantity FROM ahead WHERE stock_code = (SELECT stock_code FROM f GROUP BY 1 ORDER BY sum(weekly_sales) DESC, 1 LIMIT 1)""",
    "repeated_append": f"""WITH {RAW} SELECT 'first' AS step, true AS added, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS total_quantity FROM t WHERE quantity <= 25
        UNION ALL SELECT 'again', false, count(*), CAST(sum(quantity) AS BIGINT) FROM t WHERE quantity <= 25 UNION ALL SELECT 'more', true, count(*), CAST(sum(quantity) AS BIGINT) FROM t""",
    "features_preview": f"WITH {FEATURES} SELECT * FROM f ORDER BY stock_code, week LIMIT 5",
    "stored_tables": f"""WITH {RAW} SELECT 'created' AS step, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS total_quantity UNION ALL SELECT 'appended', count(*), CAST(sum(quantity) AS BIGINT) FROM t
        UNION ALL SELECT 'appended again', 2 * count(*), CAST(2 * sum(quantity) AS BIGINT) FROM t UNION ALL SELECT 'replaced', count(*), CAST(sum(quantity) AS BIGINT) FROM t WHERE quantity > 25""",
    "k_means_fixed_start": f"WITH {SCALED}, {_lloyd(STEPS)}",
    "k_means_segments": _k_means(),
    "boosted_first_tree": _first_tree(),
    "trend_design": _trend_design(),
    "sarima_fixed": _sarima(),
    "sarima_likelihood": _likelihood(),
    "yearly_normal_equations": _normal_equations(),
}
