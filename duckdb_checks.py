"""DuckDB SQL that computes every registered query by its plain definition.

The statements build the full grids and left joins that the definitions speak of; the Spark
side reaches the same rows by other plans, so the two check each other.
"""

from __future__ import annotations

NOW = "TIMESTAMP '2001-06-01 10:00:00'"
TODAY = "DATE '2001-06-01'"
SENSOR_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def rint(x: str) -> str:
    """Nearest whole number of a double, ties to even."""
    low = f"floor({x})"
    return (
        f"({low} + CASE WHEN ({x}) - {low} > 0.5 THEN 1 WHEN ({x}) - {low} < 0.5 THEN 0 "
        f"ELSE abs(CAST({low} AS BIGINT)) % 2 END)"
    )


def half_even(x: str, digits: int) -> str:
    scale = f"CAST({10**digits} AS DOUBLE)"
    return f"({rint(f'(({x}) * {scale})')} / {scale})"


def comparable(x: str) -> str:
    """Round to 24 binary digits, which hides the order of summation."""
    grid = f"CAST({2**24} AS DOUBLE)"
    return f"({rint(f'(({x}) * {grid})')} / {grid})"


def score(t: str, v: str, r: str) -> str:
    heat = f"least(greatest(({t} - 75.0::DOUBLE) / 20.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) * 0.35::DOUBLE"
    shake = (
        f"least(greatest(({v} - 0.05::DOUBLE) / (0.12::DOUBLE - 0.05::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE)"
        " * 0.45::DOUBLE"
    )
    speed = f"least(abs({r} - 1500.0::DOUBLE) / 300.0::DOUBLE, 1.0::DOUBLE) * 0.20::DOUBLE"
    return f"least(greatest(1.0::DOUBLE - {heat} - {shake} - {speed}, 0.0::DOUBLE), 1.0::DOUBLE)"


BLEND = "least(greatest(coalesce(avg(h) * 0.7::DOUBLE + min(h) * 0.3::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE)"
STAMP = "'%Y-%m-%d %H:%M:%S'"

# Common table expressions in dependency order; every statement gets all of them and DuckDB
# evaluates the ones it uses.
STEPS: dict[str, str] = {
    # Logical inputs
    "s_orders": "SELECT o_orderkey AS id, o_orderdate AS created_at, "
    "CASE WHEN o_orderstatus = 'P' THEN 'cancelled' ELSE 'completed' END AS status FROM orders",
    "s_items": "SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity "
    "FROM lineitem",
    "s_header": "SELECT p_partkey AS bom_id, CAST(p_partkey AS VARCHAR) AS product_code FROM part",
    "s_detail": "SELECT p_partkey AS bom_id, 'PART-' || ((p_partkey * 7 + k * 13) % (SELECT count(*) FROM part)) "
    "AS part_no, CAST(1 + (p_partkey + k) % 4 AS INTEGER) AS qty FROM part, (VALUES (0), (1), (2)) v(k)",
    "s_parts": "SELECT 'PART-' || p_partkey AS part_no, p_size AS stock_qty, "
    "CAST(p_partkey % 20 AS INTEGER) AS safety_stock FROM part",
    "s_purchase": "SELECT 'PART-' || l_partkey AS part_no, CAST(l_shipdate AS DATE) AS delivery_date, "
    "CAST(l_quantity AS INTEGER) AS order_qty, CASE WHEN l_linestatus = 'O' THEN 'pending' ELSE 'received' END "
    "AS status FROM lineitem",
    "s_events": "SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "s_readings": "SELECT 'M-' || user_id AS machine_id, "
    "60.0::DOUBLE + least(value, 350.0::DOUBLE) / 10.0::DOUBLE AS temperature, "
    "0.01::DOUBLE + k / 1000.0::DOUBLE AS vibration, 1000 + 6 * k AS rpm, ts AS created_at FROM s_events",
    # Telemetry
    "recent": f"SELECT * FROM s_readings WHERE created_at >= {SENSOR_NOW} - INTERVAL 24 HOUR",
    "retained": f"SELECT * FROM s_readings WHERE created_at >= {SENSOR_NOW} - INTERVAL 30 MINUTE",
    "latest": "SELECT * FROM s_readings ORDER BY created_at DESC, machine_id, temperature, vibration, rpm LIMIT 50",
    "scored": f"SELECT *, {score('temperature', 'vibration', 'rpm')} AS health_score FROM recent",
    "scored_all": f"SELECT *, {score('temperature', 'vibration', 'rpm')} AS health_score FROM s_readings",
    "scored_step": "SELECT *, greatest(1.0::DOUBLE - CASE WHEN temperature > 85 THEN 0.2::DOUBLE ELSE 0 END "
    "- CASE WHEN vibration > 0.08::DOUBLE THEN 0.3::DOUBLE ELSE 0 END, 0.5::DOUBLE) AS health_score FROM latest",
    "machines": "SELECT machine_id, avg(health_score) AS h FROM scored GROUP BY machine_id",
    "factor": "SELECT coalesce(avg(h), 1.0::DOUBLE) AS avg_health, coalesce(min(h), 1.0::DOUBLE) AS min_health, "
    f"{BLEND} AS capacity_factor FROM machines",
    "factor_step": "SELECT coalesce(avg(health_score), 1.0::DOUBLE) AS avg_health, "
    "coalesce(avg(health_score), 1.0::DOUBLE) AS capacity_factor FROM scored_step",
    # History and forecast
    "history": "SELECT CAST(o.created_at AS DATE) AS order_date, i.product_id, "
    "CAST(sum(i.quantity) AS BIGINT) AS qty FROM s_orders o JOIN s_items i ON o.id = i.order_id "
    f"WHERE o.status <> 'cancelled' AND o.created_at >= {NOW} - INTERVAL 30 DAY GROUP BY 1, 2",
    "past_days": f"SELECT CAST({TODAY} - CAST(n AS INTEGER) AS DATE) AS order_date FROM range(1, 31) r(n)",
    "next_days": f"SELECT CAST({TODAY} + CAST(n AS INTEGER) AS DATE) AS forecast_date, CAST(n AS INTEGER) AS day_no "
    "FROM range(1, 8) r(n)",
    "products": "SELECT DISTINCT product_id FROM history",
    "grid": "SELECT order_date, product_id FROM past_days, products",
    "full_history": "SELECT g.order_date, g.product_id, coalesce(CAST(h.qty AS DOUBLE), 0.0::DOUBLE) AS qty, "
    "CAST(isodow(g.order_date) - 1 AS INTEGER) AS dow FROM grid g LEFT JOIN history h "
    "ON h.order_date = g.order_date AND h.product_id = g.product_id",
    "by_weekday": "SELECT product_id, dow, avg(qty) AS weekday_mean_qty FROM full_history GROUP BY 1, 2",
    "by_product": "SELECT product_id, avg(qty) AS overall_mean_qty FROM full_history GROUP BY 1",
    "sparse": "SELECT *, CAST(isodow(order_date) - 1 AS INTEGER) AS dow FROM history",
    "sparse_weekday": "SELECT product_id, dow, avg(qty) AS weekday_mean_qty FROM sparse GROUP BY 1, 2",
    "sparse_product": "SELECT product_id, avg(qty) AS overall_mean_qty FROM sparse GROUP BY 1",
    **{
        name: "SELECT d.forecast_date, CAST(isodow(d.forecast_date) - 1 AS INTEGER) AS dow, p.product_id, "
        "w.weekday_mean_qty, o.overall_mean_qty, "
        f"CAST({rint('coalesce(w.weekday_mean_qty, o.overall_mean_qty, 0.0::DOUBLE)')} AS BIGINT) "
        f"AS forecast_demand_qty FROM next_days d CROSS JOIN products p LEFT JOIN {week} w "
        "ON w.product_id = p.product_id AND w.dow = isodow(d.forecast_date) - 1 "
        f"LEFT JOIN {overall} o ON o.product_id = p.product_id"
        for name, week, overall in (
            ("forecast", "by_weekday", "by_product"),
            ("forecast_sparse", "sparse_weekday", "sparse_product"),
        )
    },
    "capacity": "SELECT forecast_date, product_id, forecast_demand_qty, capacity_factor, "
    f"CAST({rint('forecast_demand_qty * capacity_factor')} AS BIGINT) AS expected_output_qty "
    "FROM forecast CROSS JOIN factor",
    "capacity_plan": "SELECT *, greatest(forecast_demand_qty - expected_output_qty, 0) AS gap_qty FROM capacity",
    "capacity_adjusted": "SELECT forecast_date, product_id, forecast_demand_qty AS original_forecast_qty, "
    f"capacity_factor, CAST({rint('forecast_demand_qty * capacity_factor')} AS BIGINT) AS forecast_qty "
    "FROM forecast_sparse CROSS JOIN factor_step",
    # Parts
    "bom": "SELECT CAST(regexp_extract(trim(h.product_code), '^[0-9]+') AS BIGINT) AS product_id, d.part_no, "
    "CAST(d.qty AS DOUBLE) AS bom_qty FROM s_header h JOIN s_detail d ON d.bom_id = h.bom_id",
    "incoming": "SELECT part_no, delivery_date AS eta_date, CAST(sum(order_qty) AS DOUBLE) AS incoming_qty "
    "FROM s_purchase WHERE lower(status) = 'pending' AND delivery_date IS NOT NULL GROUP BY 1, 2",
    "explosion": "SELECT c.forecast_date, c.product_id, b.part_no, b.bom_qty, "
    "c.forecast_demand_qty * b.bom_qty AS part_demand_for_customer_demand, "
    "c.expected_output_qty * b.bom_qty AS part_demand_for_planned_output "
    "FROM capacity c JOIN bom b ON b.product_id = c.product_id",
    "part_days": "SELECT forecast_date, part_no, sum(part_demand_for_customer_demand) AS part_demand, "
    "sum(part_demand_for_planned_output) AS planned_output_part_demand FROM explosion GROUP BY 1, 2",
    "sim_grid": "SELECT d.forecast_date, d.day_no, p.part_no, coalesce(n.part_demand, 0.0::DOUBLE) AS part_demand, "
    "coalesce(n.planned_output_part_demand, 0.0::DOUBLE) AS planned_output_part_demand, "
    "coalesce(i.incoming_qty, 0.0::DOUBLE) AS incoming_qty, CAST(p.stock_qty AS DOUBLE) AS stock_qty, "
    "CAST(p.safety_stock AS DOUBLE) AS safety_qty FROM next_days d CROSS JOIN s_parts p "
    "LEFT JOIN part_days n ON n.part_no = p.part_no AND n.forecast_date = d.forecast_date "
    "LEFT JOIN incoming i ON i.part_no = p.part_no AND i.eta_date = d.forecast_date",
    "projection": "SELECT *, stock_qty + sum(incoming_qty - part_demand) OVER "
    "(PARTITION BY part_no ORDER BY forecast_date) AS end_available FROM sim_grid",
    "mrp": "SELECT *, end_available + part_demand AS start_available, end_available < safety_qty AS below_safety, "
    "end_available < 0 AS below_zero, greatest(0.0::DOUBLE, 0.0::DOUBLE - end_available) AS shortage_qty, "
    "greatest(0.0::DOUBLE, safety_qty - end_available) AS recommended_po_qty, "
    "CASE WHEN safety_qty - end_available > 0 THEN CAST(forecast_date - 3 AS DATE) END AS suggested_order_date, "
    "CASE WHEN safety_qty - end_available > 0 THEN forecast_date END AS required_eta_date FROM projection",
    "risk": "SELECT part_no, count(*) FILTER (WHERE below_safety) AS days_below_safety, "
    "count(*) FILTER (WHERE below_zero) AS days_below_zero, min(end_available) AS min_available, "
    "max(shortage_qty) AS max_shortage_qty, sum(recommended_po_qty) AS total_recommended_qty FROM mrp GROUP BY 1",
    "risk_list": "SELECT row_number() OVER (ORDER BY days_below_zero DESC, days_below_safety DESC, "
    "max_shortage_qty DESC, part_no) AS rank, part_no, days_below_zero, days_below_safety, max_shortage_qty "
    "FROM risk WHERE days_below_safety > 0 OR days_below_zero > 0",
    "po": "SELECT m.part_no, sum(recommended_po_qty) AS total_recommended_qty, "
    "min(forecast_date) AS first_shortage_date, min(suggested_order_date) AS first_suggested_order_date, "
    "min(required_eta_date) AS first_required_eta, max(shortage_qty) AS max_shortage_qty "
    "FROM mrp m WHERE recommended_po_qty > 0 GROUP BY 1",
    "po_full": "SELECT p.*, r.days_below_safety, r.days_below_zero, r.min_available FROM po p "
    "LEFT JOIN risk r ON r.part_no = p.part_no",
    "po_ranked": "SELECT row_number() OVER (ORDER BY total_recommended_qty DESC, part_no) AS rank, * FROM po_full",
    "compare": "SELECT forecast_date, CAST(sum(forecast_demand_qty) AS BIGINT) AS forecast_demand_qty, "
    "CAST(sum(expected_output_qty) AS BIGINT) AS expected_output_qty, CAST(sum(gap_qty) AS BIGINT) AS gap_qty "
    "FROM capacity_plan GROUP BY 1",
    "kpis": f"SELECT {half_even('f.avg_health', 3)} AS avg_health, {half_even('f.min_health', 3)} AS min_health, "
    f"{half_even('f.capacity_factor', 3)} AS capacity_factor, "
    "(SELECT CAST(coalesce(sum(forecast_demand_qty), 0) AS BIGINT) FROM capacity_plan) AS total_forecast_demand, "
    "(SELECT CAST(coalesce(sum(expected_output_qty), 0) AS BIGINT) FROM capacity_plan) AS total_expected_output, "
    "(SELECT CAST(coalesce(sum(gap_qty), 0) AS BIGINT) FROM capacity_plan) AS total_gap_qty, "
    "(SELECT count(*) FROM risk_list) AS risk_count, "
    "(SELECT CAST(trunc(coalesce(sum(total_recommended_qty), 0)) AS BIGINT) FROM po) AS total_po_qty, "
    "(SELECT count(*) FROM risk WHERE days_below_zero > 0) AS days_below_zero_parts FROM factor f",
    "totals": "SELECT CAST(30 AS INTEGER) AS lookback_days, CAST(7 AS INTEGER) AS forecast_days, "
    "(SELECT count(*) FROM po) AS po_count, "
    "coalesce(sum(part_demand_for_customer_demand), 0.0::DOUBLE) AS total_demand_part_qty, "
    "coalesce(sum(part_demand_for_planned_output), 0.0::DOUBLE) AS total_output_part_qty FROM explosion",
    # Feedback variant. The row carries the orders of the last three days; the oldest one
    # arrives on the following day.
    "adjusted_need": "SELECT c.forecast_date, b.part_no, sum(c.forecast_qty * b.bom_qty) AS part_demand "
    "FROM capacity_adjusted c JOIN bom b ON b.product_id = c.product_id GROUP BY 1, 2",
    "adjusted_grid": "SELECT d.forecast_date, d.day_no, p.part_no, coalesce(n.part_demand, 0.0::DOUBLE) AS part_demand, "
    "coalesce(i.incoming_qty, 0.0::DOUBLE) AS incoming_qty, CAST(p.stock_qty AS DOUBLE) AS stock_qty, "
    "CAST(p.safety_stock AS DOUBLE) AS safety_qty FROM next_days d CROSS JOIN s_parts p "
    "LEFT JOIN adjusted_need n ON n.part_no = p.part_no AND n.forecast_date = d.forecast_date "
    "LEFT JOIN incoming i ON i.part_no = p.part_no AND i.eta_date = d.forecast_date",
    "fold": "SELECT g.part_no, g.day_no, 0.0::DOUBLE AS arrival, "
    "g.stock_qty + g.incoming_qty - g.part_demand AS end_available, "
    "greatest(0.0::DOUBLE, g.safety_qty - (g.stock_qty + g.incoming_qty - g.part_demand)) AS po, "
    "0.0::DOUBLE AS po_1, 0.0::DOUBLE AS po_2 FROM adjusted_grid g WHERE g.day_no = 1 "
    "UNION ALL SELECT g.part_no, g.day_no, f.po_2, f.end_available + g.incoming_qty + f.po_2 - g.part_demand, "
    "greatest(0.0::DOUBLE, g.safety_qty - (f.end_available + g.incoming_qty + f.po_2 - g.part_demand)), "
    "f.po, f.po_1 FROM fold f JOIN adjusted_grid g ON g.part_no = f.part_no AND g.day_no = f.day_no + 1",
    "feedback": "SELECT g.forecast_date, g.part_no, g.part_demand, g.incoming_qty, f.arrival AS po_arrival_qty_today, "
    "g.stock_qty, g.safety_qty, f.end_available + g.part_demand AS start_available, f.end_available, "
    "f.end_available < g.safety_qty AS shortage, f.po AS recommended_po_qty, "
    "CASE WHEN f.po > 0 THEN CAST(g.forecast_date + 3 AS DATE) END AS po_eta_date "
    "FROM adjusted_grid g JOIN fold f ON f.part_no = g.part_no AND f.day_no = g.day_no",
    "risk_fb": "SELECT row_number() OVER (ORDER BY part_no) AS rank, part_no FROM "
    "(SELECT part_no FROM feedback GROUP BY 1 HAVING bool_or(shortage))",
    "po_fb": "SELECT part_no, sum(recommended_po_qty) AS total_recommended_qty, "
    "min(forecast_date) AS first_order_date, min(po_eta_date) AS first_eta FROM feedback "
    "WHERE recommended_po_qty > 0 GROUP BY 1",
    "po_fb_ranked": "SELECT row_number() OVER (ORDER BY total_recommended_qty DESC, part_no) AS rank, * FROM po_fb",
    "compare_fb": "SELECT forecast_date, CAST(sum(original_forecast_qty) AS BIGINT) AS original_forecast_qty, "
    "CAST(sum(forecast_qty) AS BIGINT) AS forecast_qty FROM capacity_adjusted GROUP BY 1",
    "kpis_fb": f"SELECT {half_even('f.avg_health', 2)} AS avg_health, "
    f"{half_even('f.capacity_factor', 2)} AS capacity_factor, "
    "(SELECT CAST(coalesce(sum(original_forecast_qty), 0) AS BIGINT) FROM capacity_adjusted) AS total_original_qty, "
    "(SELECT CAST(coalesce(sum(forecast_qty), 0) AS BIGINT) FROM capacity_adjusted) AS total_forecast_qty, "
    "(SELECT count(*) FROM risk_fb) AS risk_count, "
    "(SELECT CAST(trunc(coalesce(sum(total_recommended_qty), 0)) AS BIGINT) FROM po_fb) AS total_po_qty "
    "FROM factor_step f",
    # Continuous planning stores readings with two and four decimals before it scores them.
    "stored": "SELECT machine_id, CAST(CAST(CAST(temperature AS VARCHAR) AS DECIMAL(6,2)) AS DOUBLE) AS temperature, "
    "CAST(CAST(CAST(vibration AS VARCHAR) AS DECIMAL(8,4)) AS DOUBLE) AS vibration, rpm, created_at FROM recent",
    "stored_machines": "SELECT machine_id, avg("
    + score("temperature", "vibration", "rpm")
    + ") AS h FROM stored GROUP BY 1",
    "stored_factor": f"SELECT avg(h) AS avg_health, min(h) AS min_health, {BLEND} AS capacity_factor FROM stored_machines",
}

_PREFIX = "WITH RECURSIVE " + ", ".join(f"{name} AS ({body})" for name, body in STEPS.items()) + " "


def _iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d') AS {c}"


_READING = "machine_id, temperature, vibration, rpm, created_at"
_SCORED = f"machine_id, temperature, vibration, CAST(rpm AS DOUBLE) AS rpm, created_at, {comparable('health_score')} AS health_score"
_FACTOR = f"{comparable('avg_health')} AS avg_health, {comparable('min_health')} AS min_health, {comparable('capacity_factor')} AS capacity_factor"
_MRP = (
    "forecast_date, part_no, part_demand, planned_output_part_demand, incoming_qty, stock_qty, safety_qty, "
    "start_available, end_available, below_safety, below_zero, shortage_qty, recommended_po_qty, "
    "suggested_order_date, required_eta_date"
)
_FEEDBACK = (
    "forecast_date, part_no, part_demand, incoming_qty, po_arrival_qty_today, stock_qty, safety_qty, "
    "start_available, end_available, shortage, recommended_po_qty, po_eta_date"
)
_FORECAST = (
    f"forecast_date, dow, product_id, {comparable('weekday_mean_qty')} AS weekday_mean_qty, "
    f"{comparable('overall_mean_qty')} AS overall_mean_qty, forecast_demand_qty"
)


def _profile(name: str, table: str, time: str | None) -> str:
    ends = f"CAST(min({time}) AS TIMESTAMP), CAST(max({time}) AS TIMESTAMP)" if time else "NULL, NULL"
    return f"SELECT '{name}' AS source_name, count(*) AS row_count, {ends} FROM {table}"


_SOURCE_PROFILE = (
    "SELECT source_name, row_count, CAST(a AS TIMESTAMP) AS first_time, CAST(b AS TIMESTAMP) AS last_time FROM ("
    + " UNION ALL ".join(
        _profile(*row)
        for row in (
            ("bom", "bom", None),
            ("parts", "s_parts", None),
            ("incoming", "incoming", "eta_date"),
            ("readings", "recent", "created_at"),
            ("order_history", "history", "order_date"),
            ("order_history_today", f"(SELECT * FROM history WHERE order_date = {TODAY})", "order_date"),
            ("forecast", "forecast", "forecast_date"),
            ("bom_explosion", "explosion", "forecast_date"),
            ("daily_part_demand", "part_days", "forecast_date"),
            ("mrp_plan", "mrp", "forecast_date"),
            ("po_summary", "po", "first_shortage_date"),
        )
    )
    + ") t(source_name, row_count, a, b)"
)

_ZH = {
    "日期": "forecast_date",
    "零件圖號": "part_no",
    "需求量": "part_demand",
    "既有在途到貨量": "incoming_qty",
    "MRP採購到貨量(今日)": "po_arrival_qty_today",
    "安全庫存量": "safety_qty",
    "當日可用量(含到貨)": "start_available",
    "當日結束可用量": "end_available",
    "低於安全庫存": "shortage",
    "當日建議下單量": "recommended_po_qty",
    "本日下單預計到貨日": "po_eta_date",
}

_TOTALS_FB = (
    "CAST(30 AS INTEGER) AS lookback_days, CAST(7 AS INTEGER) AS forecast_days, (SELECT count(*) FROM po_fb) AS po_count"
)


def _listed(column: str, table: str, name: str, limit: int | None = None, order: str = "rank") -> str:
    """One list of a snapshot as text."""
    head = f" WHERE rank <= {limit}" if limit else ""
    return f"(SELECT string_agg(CAST({column} AS VARCHAR), ',' ORDER BY {order}) FROM {table}{head}) AS {name}"


def _hundredths(x: str) -> str:
    return f"CAST({rint(f'({x}) * 100')} AS BIGINT)"


_BODIES: dict[str, str] = {
    "order_history": "SELECT * FROM history",
    "order_history_stored": "SELECT * FROM history",
    "order_history_today": f"SELECT * FROM history WHERE order_date = {TODAY}",
    "bom": "SELECT * FROM bom",
    "parts_clean": "SELECT part_no, CAST(stock_qty AS DOUBLE) AS stock_qty, "
    "CAST(safety_stock AS DOUBLE) AS safety_qty FROM s_parts",
    "incoming_by_day": "SELECT * FROM incoming",
    "recent_readings": f"SELECT {_READING} FROM recent",
    "latest_readings": f"SELECT {_READING} FROM latest",
    "retain_recent": f"SELECT {_READING} FROM retained",
    "source_profile": _SOURCE_PROFILE,
    "coerce_inputs": "SELECT machine_id, coalesce(TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' "
    "ELSE CAST(temperature AS VARCHAR) END AS DOUBLE), 75.0::DOUBLE) AS temperature, "
    "CASE WHEN event_type = 'click' THEN 0.05::DOUBLE ELSE vibration END AS vibration, "
    "CASE WHEN event_type = 'view' THEN 1500.0::DOUBLE ELSE CAST(rpm AS DOUBLE) END AS rpm, created_at FROM "
    "(SELECT event_type, 'M-' || user_id AS machine_id, "
    "60.0::DOUBLE + least(value, 350.0::DOUBLE) / 10.0::DOUBLE AS temperature, "
    "0.01::DOUBLE + k / 1000.0::DOUBLE AS vibration, 1000 + 6 * k AS rpm, ts AS created_at FROM s_events)",
    "input_checks": "SELECT 'order_history' AS check_name, count(*) AS row_count, count(*) > 0 AS passed, "
    "CASE WHEN count(*) = 0 THEN 'no orders in the last 30 days' END AS message FROM history UNION ALL "
    "SELECT 'parts', count(*), count(*) > 0, CASE WHEN count(*) = 0 THEN "
    "'the parts table is empty, inventory cannot be projected' END FROM s_parts",
    "reading_health": f"SELECT {_SCORED} FROM scored",
    "reading_health_step": f"SELECT {_READING}, {comparable('health_score')} AS health_score FROM scored_step",
    "machine_health": f"SELECT machine_id, {comparable('h')} AS machine_health FROM machines",
    "machine_series": f"SELECT machine_id, strftime(created_at, {STAMP}) AS x, {half_even('temperature', 2)} AS temperature, "
    f"{half_even('vibration', 4)} AS vibration, CAST(rpm AS DOUBLE) AS rpm, {half_even('health_score', 3)} AS health_score FROM scored",
    "latest_series": f"SELECT strftime(created_at, {STAMP}) AS x, {half_even('temperature', 2)} AS temperature, "
    f"{half_even('vibration', 4)} AS vibration FROM latest",
    "capacity_factor": f"SELECT {_FACTOR} FROM factor",
    "capacity_factor_step": f"SELECT {comparable('avg_health')} AS avg_health, "
    f"{comparable('capacity_factor')} AS capacity_factor FROM factor_step",
    "history_grid": "SELECT order_date, product_id FROM grid",
    "complete_history": "SELECT * FROM full_history",
    "weekday_mean": f"SELECT product_id, dow, {comparable('weekday_mean_qty')} AS weekday_mean_qty FROM by_weekday",
    "overall_mean": f"SELECT product_id, {comparable('overall_mean_qty')} AS overall_mean_qty FROM by_product",
    "forecast": f"SELECT {_FORECAST} FROM forecast",
    "forecast_sparse": f"SELECT {_FORECAST} FROM forecast_sparse",
    "capacity_plan": "SELECT forecast_date, product_id, forecast_demand_qty, "
    f"{comparable('capacity_factor')} AS capacity_factor, expected_output_qty, gap_qty FROM capacity_plan",
    "capacity_plan_feedback": "SELECT forecast_date, product_id, original_forecast_qty, "
    f"{comparable('capacity_factor')} AS capacity_factor, forecast_qty FROM capacity_adjusted",
    "demand_compare": "SELECT * FROM compare",
    "demand_compare_feedback": "SELECT * FROM compare_fb",
    "bom_explosion": "SELECT * FROM explosion",
    "daily_part_demand": "SELECT * FROM part_days",
    "daily_part_demand_feedback": "SELECT * FROM adjusted_need",
    "sim_grid": "SELECT forecast_date, part_no, part_demand, planned_output_part_demand, incoming_qty, stock_qty, "
    "safety_qty FROM sim_grid",
    "inventory_projection": "SELECT forecast_date, part_no, part_demand, planned_output_part_demand, incoming_qty, "
    "stock_qty, safety_qty, end_available, end_available + part_demand AS start_available FROM projection",
    "mrp_plan": f"SELECT {_MRP} FROM mrp",
    "mrp_feedback": f"SELECT {_FEEDBACK} FROM feedback",
    "mrp_plan_labelled": "SELECT " + ", ".join(f'{c} AS "{label}"' for label, c in _ZH.items()) + " FROM feedback",
    "part_risk_summary": "SELECT * FROM risk",
    "risk_parts": "SELECT * FROM risk_list WHERE rank <= 20",
    "risk_parts_feedback": "SELECT * FROM risk_fb WHERE rank <= 20",
    "po_summary": "SELECT * FROM po_full",
    "po_summary_older_names": "SELECT * FROM po_full",
    "po_summary_feedback": "SELECT * FROM po_fb",
    "po_top10": f"SELECT rank, part_no AS label, {half_even('total_recommended_qty', 2)} AS value FROM po_ranked WHERE rank <= 10",
    "po_top10_feedback": f"SELECT rank, part_no AS label, {half_even('total_recommended_qty', 2)} AS value FROM po_fb_ranked WHERE rank <= 10",
    "po_table": f"SELECT rank, part_no, total_recommended_qty, {_iso('first_shortage_date')}, "
    f"{_iso('first_suggested_order_date')}, {_iso('first_required_eta')}, max_shortage_qty, days_below_safety, "
    "days_below_zero, min_available FROM po_ranked WHERE rank <= 15",
    "po_table_feedback": f"SELECT rank, part_no, total_recommended_qty, {_iso('first_order_date')}, {_iso('first_eta')} "
    "FROM po_fb_ranked WHERE rank <= 15",
    "kpis": "SELECT * FROM kpis",
    "kpis_feedback": "SELECT * FROM kpis_fb",
    "plan_totals": "SELECT * FROM totals",
    "plan_totals_feedback": f"SELECT {_TOTALS_FB}",
    "dashboard_snapshot": "SELECT '2001-06-01 10:00:00' AS updated_at, k.*, t.*, "
    + ", ".join(
        [
            _listed("part_no", "risk_list", "risk_parts", 20),
            *[
                _listed(c, "compare", f"{name}_series", order="forecast_date")
                for c, name in (
                    ("forecast_date", "x"),
                    ("forecast_demand_qty", "demand"),
                    ("expected_output_qty", "output"),
                    ("gap_qty", "gap"),
                )
            ],
            _listed("part_no", "po_ranked", "po_labels", 10),
            _listed(_hundredths("total_recommended_qty"), "po_ranked", "po_values", 10),
            *[
                _listed(c, "po_ranked", f"table_{c}", 15)
                for c in "part_no first_shortage_date first_suggested_order_date first_required_eta days_below_safety "
                "days_below_zero".split()
            ],
            *[
                _listed(_hundredths(c), "po_ranked", f"table_{c}", 15)
                for c in ("total_recommended_qty", "max_shortage_qty", "min_available")
            ],
        ]
    )
    + " FROM kpis k, totals t",
    "dashboard_snapshot_feedback": f"SELECT '2001-06-01 10:00:00' AS updated_at, k.*, {_TOTALS_FB}, "
    + ", ".join(
        [
            _listed("part_no", "risk_fb", "risk_parts", 20),
            *[
                _listed(c, "compare_fb", f"{name}_series", order="forecast_date")
                for c, name in (("forecast_date", "x"), ("original_forecast_qty", "original"), ("forecast_qty", "adjusted"))
            ],
            _listed("part_no", "po_fb_ranked", "po_labels", 10),
            _listed(_hundredths("total_recommended_qty"), "po_fb_ranked", "po_values", 10),
            *[_listed(c, "po_fb_ranked", f"table_{c}", 15) for c in ("part_no", "first_order_date", "first_eta")],
            _listed(_hundredths("total_recommended_qty"), "po_fb_ranked", "table_total_recommended_qty", 15),
        ]
    )
    + " FROM kpis_fb k",
    "stream_scores": f"SELECT {_SCORED} FROM scored_all",
    # A window is emitted once the newest reading is half an hour past its end.
    "stream_rolling_health": "SELECT machine_id, window_end - INTERVAL 24 HOUR AS window_start, window_end, "
    f"{comparable('avg(health_score)')} AS machine_health, count(*) AS readings FROM "
    "(SELECT machine_id, health_score, date_trunc('hour', created_at) + to_hours(CAST(n AS INTEGER)) AS window_end "
    "FROM scored_all, range(1, 25) r(n)) WHERE window_end <= (SELECT max(created_at) - INTERVAL 30 MINUTE "
    "FROM s_readings) GROUP BY machine_id, window_end",
    "stream_replan": f"SELECT 'factor' AS kind, '' AS name, {comparable('capacity_factor')} AS value FROM stored_factor "
    "UNION ALL SELECT 'demand', forecast_date || ' ' || product_id, CAST(forecast_demand_qty AS DOUBLE) FROM forecast "
    "UNION ALL SELECT 'output', forecast_date || ' ' || product_id, "
    f"CAST({rint('forecast_demand_qty * f.capacity_factor')} AS DOUBLE) FROM forecast CROSS JOIN stored_factor f "
    "UNION ALL SELECT 'purchase', part_no, total_recommended_qty FROM po",
}


def oracle() -> dict[str, str]:
    return {name: _PREFIX + body for name, body in _BODIES.items()}
