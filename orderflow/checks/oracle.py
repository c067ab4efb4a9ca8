"""The registered queries in SQL, for comparing results with an independent engine."""

from __future__ import annotations

from itertools import combinations

from orderflow.checks import queries as q
from orderflow.functions.text import WHITESPACE
from orderflow.plans import gold


def rnd(x: str, scale: int) -> str:
    """Half-even rounding of a double."""
    f = f"{10**scale}.0::DOUBLE"
    return f"(round_even(CAST({x} AS DOUBLE) * {f}, 0) / {f})"


def added(x: str) -> str:
    """The sum of doubles to a trillionth: whole parts, millionths and trillionths apart."""
    above = f"(({x} - floor({x})) * 1000000.0::DOUBLE)"
    micros = f"CAST(round_even({above}, 0) AS BIGINT)"
    picos = f"CAST(round_even(({above} - round_even({above}, 0)) * 1000000.0::DOUBLE, 0) AS BIGINT)"
    whole = f"CAST(SUM(CAST(floor({x}) AS HUGEINT)) AS DOUBLE)"
    return f"({whole} + CAST(SUM({micros}) * 1000000 + SUM({picos}) AS DOUBLE) / 1000000000000.0::DOUBLE)"


def total(x: str, scale: int = 2) -> str:
    return rnd(f"COALESCE({added(x)}, 0.0)", scale)


def mean(x: str, scale: int) -> str:
    return rnd(f"{added(x)} / COUNT({x})", scale)


SALES = """sales_lines AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id,
         o_orderkey AS order_id,
         CAST(o_orderdate AS DATE) AS order_date,
         CAST(l_shipdate AS DATE) AS ship_date,
         o_orderpriority AS ship_mode,
         c_custkey AS customer_id,
         c_name AS customer_name,
         c_mktsegment AS segment,
         concat(CAST(c_custkey AS VARCHAR), '.0') AS postal_code,
         n_name AS country,
         r_name AS region,
         p_partkey AS product_id,
         p_type AS category,
         p_brand AS sub_category,
         p_name AS product_name,
         l_extendedprice * (1.0::DOUBLE - l_discount) AS sales,
         CAST(l_quantity AS BIGINT) AS quantity,
         CASE WHEN l_discount = 0 THEN 0.0::DOUBLE ELSE l_discount END AS discount,
         l_extendedprice * (1.0::DOUBLE - l_discount)
           - 1.5::DOUBLE * p_retailprice * l_quantity AS profit
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey)"""

FACT = f"""{SALES},
featured AS (
  SELECT *,
         CAST(year(order_date) AS BIGINT) AS order_year,
         CAST(month(order_date) AS BIGINT) AS order_month,
         strftime(order_date, '%b') AS order_month_name,
         CAST(quarter(order_date) AS BIGINT) AS order_quarter,
         CAST(isodow(order_date) - 1 AS BIGINT) AS order_day_of_week,
         CAST(ship_date - order_date AS BIGINT) AS shipping_days,
         CASE WHEN sales = 0 THEN 0.0 ELSE {rnd("profit / sales * 100.0::DOUBLE", 2)} END
           AS profit_margin_pct,
         {rnd("sales * discount", 2)} AS discount_amount,
         CASE WHEN quantity = 0 THEN 0.0 ELSE {rnd("sales / quantity", 2)} END AS revenue_per_unit,
         CASE WHEN quantity = 0 THEN 0.0 ELSE {rnd("profit / quantity", 2)} END AS profit_per_unit,
         COALESCE(profit > 0, FALSE) AS is_profitable
  FROM sales_lines),
fact AS (
  SELECT *,
         CASE WHEN profit_margin_pct < 0 THEN 'Loss'
              WHEN profit_margin_pct < 10 THEN 'Low'
              WHEN profit_margin_pct < 20 THEN 'Medium'
              WHEN profit_margin_pct >= 20 THEN 'High'
              ELSE 'Unknown' END AS profit_tier,
         CASE WHEN shipping_days <= 1 THEN 'Same Day'
              WHEN shipping_days <= 3 THEN 'Express'
              WHEN shipping_days <= 6 THEN 'Standard'
              WHEN shipping_days >= 7 THEN 'Slow'
              ELSE 'Unknown' END AS shipping_speed
  FROM featured)"""

_SALE = "l_extendedprice * (1.0::DOUBLE - l_discount)"
_PROFIT = f"{_SALE}\n           - 1.5::DOUBLE * p_retailprice * l_quantity AS profit"
DEAR_FACT = FACT.replace(
    _PROFIT, f"({_PROFIT.removesuffix(' AS profit')}) - {q.EXTRA_COST}::DOUBLE * ({_SALE}) AS profit"
)
HOLED_FACT = FACT.replace("FROM sales_lines)", "FROM holed)").replace(
    "featured AS (",
    """holed AS (
  SELECT * REPLACE (
    CASE WHEN ship_mode = '1-URGENT' THEN 0.0::DOUBLE ELSE sales END AS sales,
    CASE WHEN ship_mode = '2-HIGH' THEN 0 WHEN ship_mode <> '3-MEDIUM' THEN quantity END AS quantity,
    CASE WHEN ship_mode <> '5-LOW' THEN profit END AS profit,
    CASE WHEN ship_mode <> '4-NOT SPECIFIED' THEN ship_date END AS ship_date)
  FROM sales_lines),
featured AS (""",
    1,
)

MEASURES = {
    "total_sales": total("sales"),
    "total_profit": total("profit"),
    "total_units": "CAST(SUM(quantity) AS BIGINT)",
    "total_orders": "COUNT(DISTINCT order_id)",
    "total_customers": "COUNT(DISTINCT customer_id)",
    "total_rows": "COUNT(row_id)",
    "avg_discount": mean("discount", 4),
    "avg_order_value": mean("sales", 2),
    "avg_profit_margin": mean("profit_margin_pct", 2),
}


def gold_select(table: gold.GoldTable, source: str = "fact") -> str:
    keys = ", ".join(table.keys)
    measures = ", ".join(f"{MEASURES[m]} AS {m}" for m in table.measures)
    return f"SELECT {keys}, {measures} FROM {source} GROUP BY {keys}"


def over(table: gold.GoldTable, select: str, source: str = FACT) -> str:
    """A report on an aggregate table, named g."""
    return f"WITH {source}, g AS ({gold_select(table)}) {select}"


def on_fact(select: str) -> str:
    return f"WITH {FACT} {select}"


def on_sales(select: str) -> str:
    return f"WITH {SALES} {select}"


def title(x: str) -> str:
    return (
        rf"array_to_string(list_transform(regexp_extract_all({x}, '(\p{{L}}+|[^\p{{L}}]+)', 1), "
        "lambda w: upper(w[1]) || lower(w[2:])), '')"
    )


# Columns of the cleaned raw lines.  Padding was put around segment and region only.
_PAD = "trim({x}, ' " + WHITESPACE[0] + "')"
CLEANED = {
    "ship_mode": title("ship_mode"),
    "segment": title(_PAD.format(x="concat('  ', segment, ' ')")),
    "region": title(_PAD.format(x="concat('  ', region, ' ')")),
    "category": title("category"),
    "sub_category": title("sub_category"),
    "country": title("country"),
}
ZIP = (
    "CASE WHEN regexp_matches(regexp_replace(postal_code, '\\.0$', ''), '^[0-9]+$') "
    "AND length(regexp_replace(postal_code, '\\.0$', '')) < 5 "
    "THEN lpad(regexp_replace(postal_code, '\\.0$', ''), 5, '0') "
    "ELSE regexp_replace(postal_code, '\\.0$', '') END"
)
CLEAN_ROWS = f"""SELECT DISTINCT row_id, CAST(order_id AS VARCHAR) AS order_id, order_date, ship_date,
  {CLEANED["ship_mode"]} AS ship_mode, CAST(customer_id AS VARCHAR) AS customer_id, customer_name,
  {CLEANED["segment"]} AS segment, {ZIP} AS postal_code, {CLEANED["country"]} AS country,
  {CLEANED["region"]} AS region, CAST(product_id AS VARCHAR) AS product_id,
  {CLEANED["category"]} AS category, {CLEANED["sub_category"]} AS sub_category, product_name,
  sales, quantity, discount, profit
FROM sales_lines"""

COERCED = """coerced AS (
  SELECT o_orderkey,
         o_totalprice AS sales,
         TRY_CAST(o_orderpriority AS DOUBLE) AS discount,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS profit,
         CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS quantity
  FROM orders)"""

REPEATED = """repeated AS (
  SELECT * REPLACE (CASE WHEN l_discount = 0 THEN 0.0::DOUBLE ELSE l_discount END AS l_discount)
  FROM lineitem
  UNION ALL
  SELECT * REPLACE (CASE WHEN l_discount = 0 THEN 0.0::DOUBLE ELSE l_discount END AS l_discount)
  FROM lineitem WHERE l_returnflag = 'R')"""

SINCE = f"order_date >= DATE '{q.WATERMARK}' - INTERVAL 3 DAY"
INCREMENTED = f"""{FACT},
old AS (SELECT * FROM fact WHERE order_date < DATE '{q.FACT_END}'),
fresh AS (
  SELECT * FROM fact b WHERE {SINCE}
  AND NOT EXISTS (SELECT 1 FROM old WHERE old.row_id = b.row_id)),
loaded AS (SELECT * FROM old UNION ALL SELECT * FROM fresh)"""

DOUBTFUL = f"""{SALES},
doubtful AS (
  SELECT * FROM sales_lines UNION ALL SELECT * FROM sales_lines WHERE ship_mode = '1-URGENT')"""


HOLED = f"""{SALES},
doubtful AS (
  SELECT * EXCLUDE (country) REPLACE (
    CASE WHEN ship_mode <> '1-URGENT' THEN order_id END AS order_id,
    CASE WHEN ship_mode NOT IN ('1-URGENT', '2-HIGH') THEN sales END AS sales)
  FROM sales_lines)"""


def _quality(source: str = DOUBTFUL, missing: str = "") -> str:
    """The report on the relation doubtful, in which one declared column may be missing."""
    rules = [r for r in q.STRICT_SCHEMA.rules if r.name != missing]
    nulls, ranges, rogue = [], [], []
    for r in rules:
        if not r.nullable:
            nulls.append((f"COUNT(*) FILTER (WHERE {r.name} IS NULL)", f"{r.name}: ", " nulls"))
        for side, bound, op in (("min", r.min_value, "<"), ("max", r.max_value, ">")):
            if bound is not None:
                where = "below" if side == "min" else "above"
                shown = int(bound) if r.name == "quantity" else float(bound)
                ranges.append(
                    (
                        f"COUNT(*) FILTER (WHERE {r.name} {op} {bound})",
                        f"{r.name}: ",
                        f" rows {where} {side} {shown}",
                    )
                )
        if r.allowed:
            allowed = ", ".join(f"'{v}'" for v in r.allowed)
            rogue.append(
                f"(SELECT CASE WHEN COUNT(*) > 0 THEN concat('{r.name}: ', COUNT(DISTINCT {r.name}), "
                f"' unexpected values in ', COUNT(*), ' rows') END "
                f"FROM doubtful WHERE {r.name} IS NOT NULL AND {r.name} NOT IN ({allowed}))"
            )

    def check(number: int, name: str, texts: list[str], source: str) -> str:
        listed = ", ".join(texts)
        return (
            f"SELECT {number} AS check_no, '{name}' AS check_name, len(m) = 0 AS passed, "
            f"CAST(len(m) AS BIGINT) AS failures, array_to_string(m, '; ') AS details "
            f"FROM (SELECT list_filter([{listed}], lambda x: x IS NOT NULL) AS m {source})"
        )

    def counted(parts: list[tuple[str, str, str]]) -> list[str]:
        return [
            f"CASE WHEN {n} > 0 THEN concat('{before}', {n}, '{after}') END" for n, before, after in parts
        ]

    surplus = "SELECT CAST(SUM(n - 1) AS BIGINT) AS n FROM (SELECT COUNT(*) AS n FROM doubtful GROUP BY ALL)"
    columns = ", ".join(r.name for r in rules)
    surplus = surplus.replace("SELECT COUNT(*) AS n FROM", f"SELECT {columns}, COUNT(*) AS n FROM")
    told = f"missing columns: [''{missing}'']" if missing else ""
    return f"""WITH {source}
      SELECT 1 AS check_no, 'schema_columns' AS check_name, {not missing} AS passed,
             CAST({int(bool(missing))} AS BIGINT) AS failures, '{told}' AS details
      UNION ALL {check(2, "null_check", counted(nulls), "FROM doubtful")}
      UNION ALL {check(3, "value_ranges", counted(ranges), "FROM doubtful")}
      UNION ALL {check(4, "allowed_values", rogue, "")}
      UNION ALL SELECT 5, 'duplicate_rows', n = 0, n,
        CASE WHEN n > 0 THEN concat(n, ' fully-duplicated rows detected') ELSE '' END FROM ({surplus})
      UNION ALL SELECT 6, 'ship_after_order', n = 0, n,
        CASE WHEN n > 0 THEN concat(n, ' rows where ship_date < order_date') ELSE '' END
        FROM (SELECT COUNT(*) FILTER (WHERE ship_date < order_date) AS n FROM doubtful)"""


def _rogue_values() -> str:
    selects = [
        f"SELECT '{r.name}' AS column_name, {r.name} AS value, COUNT(*) AS rows FROM sales_lines "
        f"WHERE {r.name} NOT IN ({', '.join(repr(v) for v in r.allowed)}) GROUP BY {r.name}"
        for r in q.STRICT_SCHEMA.rules
        if r.allowed
    ]
    return on_sales(" UNION ALL ".join(selects))


def _stats(source: str, columns: int = 32) -> str:
    """The drift statistics of a relation as (metric, value, text) rows."""
    values = {"row_count": "COUNT(*)", "column_count": f"MAX({columns})"}
    for m in ("sales", "profit", "discount"):
        values[f"{m}_mean"] = mean(m, 4)
        values[f"{m}_std"] = rnd(f"stddev_samp({m})", 4)
        values[f"{m}_null_rate"] = rnd(f"COUNT(*) FILTER (WHERE {m} IS NULL) / COUNT(*)", 6)
    values["unique_customers"] = "COUNT(DISTINCT customer_id)"
    values["unique_products"] = "COUNT(DISTINCT product_id)"
    values["unique_regions"] = "COUNT(DISTINCT region)"
    rows = [
        f"SELECT '{m}' AS metric, CAST({v} AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text FROM {source}"
        for m, v in values.items()
    ]
    rows += [
        f"SELECT 'order_date_{s}', NULL, strftime({s}(order_date), '%Y-%m-%d') FROM {source}"
        for s in ("min", "max")
    ]
    return " UNION ALL ".join(rows)


def _drift_findings() -> str:
    delta = "abs(c.value - r.value) / abs(r.value)"
    return f"""WITH {FACT},
      before AS (SELECT * FROM fact WHERE order_date < DATE '{q.DRIFT_CUT}'),
      c AS ({_stats("fact")}), r AS ({_stats("before")})
      SELECT c.metric, r.value AS reference_value, c.value AS current_value,
             {rnd(f"{delta} * 100.0::DOUBLE", 2)} AS relative_delta_pct, 5.0::DOUBLE AS threshold_pct
      FROM c JOIN r ON c.metric = r.metric
      WHERE c.value IS NOT NULL AND r.value <> 0 AND {delta} > 0.05::DOUBLE"""


_NUMBERS = {
    "customer_id": "bigint", "order_id": "bigint", "product_id": "bigint", "quantity": "bigint",
    "order_year": "bigint", "order_month": "bigint", "order_quarter": "bigint",
    "order_day_of_week": "bigint", "shipping_days": "bigint", "sales": "double",
    "discount": "double", "profit": "double", "profit_margin_pct": "double",
    "discount_amount": "double", "revenue_per_unit": "double", "profit_per_unit": "double",
    "order_date": "date", "ship_date": "date",
}
# As the columns stand in the fact.
_ORDERED_NUMBERS = (
    "order_id order_date ship_date customer_id product_id sales quantity discount profit order_year order_month "
    "order_quarter order_day_of_week shipping_days profit_margin_pct discount_amount revenue_per_unit profit_per_unit"
).split()
_TEXTS = {
    "row_id": "string", "ship_mode": "string", "customer_name": "string", "segment": "string",
    "postal_code": "string", "country": "string", "region": "string", "category": "string",
    "sub_category": "string", "product_name": "string", "order_month_name": "string",
    "profit_tier": "string", "shipping_speed": "string", "is_profitable": "boolean",
}


def _number(name: str) -> str:
    """A column as a double; dates as days since 1970-01-01."""
    if _NUMBERS[name] == "date":
        return f"CAST({name} - DATE '1970-01-01' AS DOUBLE)"
    return f"CAST({name} AS DOUBLE)"


def _profile_columns() -> str:
    rows = []
    for name, kind in {**_NUMBERS, **_TEXTS}.items():
        number = name in _NUMBERS
        v = _number(name) if number else f"CAST({name} AS VARCHAR)"
        common = f"(SELECT {v} AS v, COUNT(*) AS n FROM fact WHERE {name} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1)"
        stats = {
            "mean": mean(v, 4),
            "std": rnd(f"stddev_samp({v})", 4) if kind != "date" else "NULL",
            "min": f"min({v})",
            "p25": rnd(f"quantile_cont({v}, 0.25)", 4),
            "p50": rnd(f"quantile_cont({v}, 0.5)", 4),
            "p75": rnd(f"quantile_cont({v}, 0.75)", 4),
            "max": f"max({v})",
        }
        if not number:
            stats = dict.fromkeys(stats, "NULL")
        listed = ", ".join(f"CAST({x} AS DOUBLE) AS {s}" for s, x in stats.items())
        rows.append(
            f"SELECT '{name}' AS column_name, '{kind}' AS data_type, COUNT({name}) AS count, "
            f"COUNT(*) - COUNT({name}) AS null_count, "
            f"{rnd(f'(COUNT(*) - COUNT({name})) / COUNT(*)', 6)} AS null_rate, "
            f"COUNT(DISTINCT {v}) AS unique, "
            f"{'CAST(NULL AS VARCHAR)' if number else f'(SELECT v FROM {common})'} AS top, "
            f"{f'(SELECT v FROM {common})' if number else 'CAST(NULL AS DOUBLE)'} AS top_value, "
            f"(SELECT n FROM {common}) AS freq, {listed} FROM fact"
        )
    return on_fact(" UNION ALL ".join(rows))


def _profile_histogram() -> str:
    bins = f"{q.BINS}.0::DOUBLE"
    rows = []
    for name in _NUMBERS:
        v = _number(name)
        bounds = f"(SELECT min({v}) AS low, max({v}) AS high FROM fact)"
        guess = f"least(floor((v - low) / (high - low) * {bins}), {q.BINS - 1})"
        rows.append(
            f"SELECT '{name}' AS column_name, bin, "
            f"{rnd('low + bin * width', 4)} AS bin_start, "
            f"{rnd('low + (bin + 1) * width', 4)} AS bin_end, COUNT(*) AS rows "
            "FROM (SELECT low, width, CAST(CASE WHEN v < low + guess * width THEN guess - 1 "
            f"WHEN v >= low + (guess + 1) * width AND guess < {q.BINS - 1} THEN guess + 1 "
            "ELSE guess END AS BIGINT) AS bin "
            f"FROM (SELECT v, low, (high - low) / {bins} AS width, {guess} AS guess "
            f"FROM (SELECT {v} AS v FROM fact), {bounds})) GROUP BY bin, low, width"
        )
    return on_fact(" UNION ALL ".join(rows))


def _profile_correlation() -> str:
    rows = [
        f"SELECT '{a}' AS left_column, '{b}' AS right_column, "
        f"{rnd(f'corr({_number(a)}, {_number(b)})', 4)} AS correlation FROM fact"
        for a, b in combinations(_ORDERED_NUMBERS, 2)
    ]
    return on_fact(" UNION ALL ".join(rows))


_R0 = {c: rnd(c, 0) for c in ("total_sales", "total_profit")}
_MONEY0 = f"{_R0['total_sales']} AS total_sales, {_R0['total_profit']} AS total_profit"
_COUNTS = " UNION ALL ".join(
    [f"SELECT '{n}' AS table_name, COUNT(*) AS n FROM {n}" for n in ["fact_sales"]]
    + [f"SELECT 'agg_{t.name}', COUNT(*) FROM agg_{t.name}" for t in gold.GOLD]
)
_ALL_GOLD = ", ".join(f"agg_{t.name} AS ({gold_select(t)})" for t in gold.GOLD)

ORACLE = {
    **{t.name: on_fact(gold_select(t)) for t in gold.GOLD},
    "regions": over(
        gold.REGION,
        "SELECT region, total_sales, total_profit, total_orders, avg_discount, avg_profit_margin FROM g",
    ),
    "trends_all_years": over(gold.MONTH, "SELECT * FROM g"),
    "trends_for_year": over(gold.MONTH, f"SELECT * FROM g WHERE order_year = {q.YEAR}"),
    "top_products": over(
        gold.PRODUCT,
        "SELECT product_id, product_name, category, sub_category, total_sales, total_profit, total_orders, "
        "avg_profit_margin FROM g ORDER BY total_sales DESC, product_id, product_name, category, sub_category LIMIT 25",
    ),
    "segments": over(gold.SEGMENT, "SELECT * FROM g"),
    "regional_performance": over(
        gold.REGION,
        f"SELECT region, {_MONEY0}, total_orders, {rnd('avg_profit_margin', 2)} AS avg_profit_margin_pct FROM g",
    ),
    "regions_by_profit": over(gold.REGION, "SELECT region, total_sales, total_profit FROM g"),
    "top_subcategories": over(
        gold.CATEGORY,
        f"SELECT category, sub_category, {_MONEY0}, {rnd('avg_profit_margin', 2)} AS margin_pct "
        "FROM (SELECT * FROM g ORDER BY g.total_sales DESC, category, sub_category LIMIT 10)",
    ),
    "loss_subcategories": over(
        gold.CATEGORY,
        source=DEAR_FACT,
        select=f"SELECT category, sub_category, {_MONEY0}, {rnd('avg_discount * 100.0::DOUBLE', 1)} AS avg_discount_pct "
        "FROM g WHERE g.total_profit < 0",
    ),
    "most_profitable_subcategories": over(
        gold.CATEGORY,
        f"SELECT sub_category, {rnd('total_profit', 2)} AS profit "
        "FROM g ORDER BY total_profit DESC, category, sub_category LIMIT 5",
    ),
    "segment_kpis": over(
        gold.SEGMENT,
        f"SELECT segment, total_customers, total_orders, {_MONEY0}, "
        f"{rnd('avg_order_value', 2)} AS avg_order_value, {rnd('avg_profit_margin', 2)} AS avg_margin_pct FROM g",
    ),
    "segment_margin": over(
        gold.SEGMENT, f"SELECT segment, {rnd('avg_profit_margin', 2)} AS margin_pct FROM g"
    ),
    "trend_with_period": over(
        gold.MONTH,
        "SELECT order_year, order_month, order_month_name, total_sales, total_profit, total_orders, "
        "make_date(order_year, order_month, 1) AS period FROM g",
    ),
    "year_revenue_trend": over(
        gold.MONTH,
        f"SELECT order_month, order_month_name, total_sales FROM g WHERE order_year = {q.YEAR}",
    ),
    "seasonality": over(
        gold.MONTH,
        "SELECT m AS order_month, strftime(make_date(2000, m, 1), '%b') AS order_month_name, "
        f"(SELECT {mean('total_sales', 2)} FROM g WHERE order_month = m) AS mean_sales "
        "FROM (SELECT unnest(range(1, 13)) AS m)",
    ),
    "top_products_rounded": over(
        gold.PRODUCT,
        f"SELECT product_name AS product, category, sub_category, {_MONEY0}, total_units "
        "FROM (SELECT * FROM g ORDER BY g.total_sales DESC, product_id, product_name, category, sub_category LIMIT 10)",
    ),
    "bottom_products": over(
        gold.PRODUCT,
        f"SELECT product_name AS product, sub_category, {_MONEY0}, "
        f"{rnd('avg_discount * 100.0::DOUBLE', 1)} AS avg_discount_pct "
        "FROM (SELECT * FROM g ORDER BY g.total_profit, product_id, product_name, category, sub_category LIMIT 10)",
    ),
    "loss_products": over(
        gold.PRODUCT,
        "SELECT product_name, total_profit FROM g WHERE total_profit < 0 "
        "ORDER BY total_profit, product_id, product_name, category, sub_category LIMIT 10",
    ),
    "region_rollup_fact": on_fact(
        f"SELECT region, {total('sales', 0)} AS total_sales FROM fact GROUP BY region"
    ),
    "sample_fact": on_fact(
        "SELECT sales, profit, discount, profit_margin_pct, profit_tier FROM fact "
        "ORDER BY md5(concat('0|', row_id)), row_id LIMIT 2000"
    ),
    "adhoc_sql": on_fact(
        "SELECT f.region, f.profit_tier, COUNT(*) AS line_count, MAX(g.total_orders) AS region_orders "
        "FROM fact f JOIN (SELECT region, COUNT(DISTINCT order_id) AS total_orders FROM fact GROUP BY region) g "
        "ON f.region = g.region GROUP BY f.region, f.profit_tier"
    ),
    "clean_strip_title": on_sales(
        "SELECT row_id, " + ", ".join(f"{x} AS {c}" for c, x in CLEANED.items()) + " FROM sales_lines"
    ),
    "clean_postal_code": on_sales(f"SELECT row_id, {ZIP} AS postal_code FROM sales_lines"),
    "date_parse_roundtrip": on_sales(
        "SELECT row_id, strftime(order_date, '%Y-%m-%d') AS order_date, "
        "strftime(ship_date, '%Y-%m-%d') AS ship_date FROM sales_lines"
    ),
    "coerce_numerics": f"WITH {COERCED} SELECT * FROM coerced",
    "clean_rows": on_sales(CLEAN_ROWS),
    "dedup_full_rows": f"WITH {REPEATED} SELECT DISTINCT * FROM repeated",
    "duplicate_count": f"WITH {REPEATED} SELECT (SELECT COUNT(*) FROM repeated) - "
    "(SELECT COUNT(*) FROM (SELECT DISTINCT * FROM repeated)) AS duplicate_rows",
    "time_features": on_fact(
        "SELECT row_id, order_year, order_month, order_month_name, order_quarter, order_day_of_week, "
        "shipping_days FROM fact"
    ),
    "financial_features": on_fact(
        "SELECT row_id, profit_margin_pct, discount_amount, revenue_per_unit, profit_per_unit, "
        "is_profitable FROM fact"
    ),
    "categorical_features": on_fact("SELECT row_id, profit_tier, shipping_speed FROM fact"),
    "engineered_fact": on_fact("SELECT * FROM fact"),
    "tier_counts": on_fact("SELECT profit_tier, COUNT(*) AS rows FROM fact GROUP BY profit_tier"),
    "shipping_speed_counts": on_fact(
        "SELECT shipping_speed, COUNT(*) AS rows FROM fact GROUP BY shipping_speed"
    ),
    "watermark_filter": on_sales(f"SELECT row_id, order_date FROM sales_lines WHERE {SINCE}"),
    "watermark_candidate": on_sales(
        "SELECT strftime(MAX(order_date), '%Y-%m-%d') AS watermark FROM sales_lines"
    ),
    "watermark_state": "SELECT CAST(MAX(o_orderdate) AS DATE) AS last_watermark, "
    f"'{q.WATERMARK}' AS last_run_id FROM orders",
    "anti_join_new_rows": f"WITH {INCREMENTED} SELECT row_id, order_id, order_date, sales FROM fresh",
    "incremental_fact": f"WITH {INCREMENTED} SELECT row_id, order_date, sales, profit_tier FROM loaded",
    "gold_after_increment": f"WITH {INCREMENTED} {gold_select(gold.MONTH, 'loaded')}",
    **{
        f"{t.name}_after_increment": f"WITH {INCREMENTED} {gold_select(t, 'loaded')}"
        for t in gold.GOLD
        if t is not gold.MONTH
    },
    "maintained_tables": f"WITH {INCREMENTED} SELECT region, total_sales, total_profit, total_orders FROM "
    f"({gold_select(gold.REGION, 'loaded')}) UNION ALL SELECT order_month_name, total_sales, total_profit, total_orders "
    f"FROM ({gold_select(gold.MONTH, 'loaded')})",
    "recovered_fact": on_sales("SELECT row_id, order_date, quantity, sales FROM sales_lines"),
    "second_run_fact": on_sales("SELECT row_id, order_date, quantity, sales FROM sales_lines"),
    "run_reports": on_sales(
        """SELECT * FROM (VALUES (1, 'success'), (2, 'success'), (3, 'success'), (4, 'failed')) AS r(run, overall_status),
        (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE order_date >= (SELECT MAX(order_date) FROM sales_lines)
         - INTERVAL 3 DAY) AS recent FROM sales_lines)"""
    ).replace(
        "SELECT * FROM (VALUES",
        "SELECT CAST(run AS BIGINT) AS run, overall_status, CASE WHEN run = 2 THEN recent ELSE n END AS extracted, "
        "CASE run WHEN 2 THEN recent WHEN 4 THEN NULL ELSE n END AS cleaned, "
        "CASE run WHEN 2 THEN 0 WHEN 4 THEN NULL ELSE n END AS inserted, "
        "CASE WHEN run < 4 THEN n END AS loaded, TRUE AS extract_timed, FALSE AS profiled FROM (VALUES",
    ),
    "guarded_features": f"WITH {HOLED_FACT} SELECT row_id, profit_margin_pct, discount_amount, revenue_per_unit, "
    "profit_per_unit, is_profitable, profit_tier, shipping_days, shipping_speed FROM fact",
    "tiny_sums": on_sales(
        "SELECT region, "
        f"{rnd('SUM(discount * 4e-7::DOUBLE) * 1e6::DOUBLE', 3)} AS total, "
        f"{rnd('AVG(discount * 4e-7::DOUBLE) * 1e6::DOUBLE', 3)} AS mean FROM sales_lines GROUP BY region"
    ),
    "quality_holes": _quality(HOLED, missing="country"),
    "gate_outcome": f"SELECT 'holes' AS stage, bool_and(passed) AS passed, COUNT(*) AS total, "
    f"COUNT(*) FILTER (WHERE NOT passed) AS failed, TRUE AS stopped FROM ({_quality(HOLED, missing='country')}) "
    "WHERE check_no < 6 UNION ALL SELECT 'clean', TRUE, 5, 0, FALSE",
    "raised_conditions": "SELECT * FROM (VALUES ('missing file', 'SourceNotFound'), ('missing columns', 'MissingColumns'), "
    "('year out of bounds', 'ValueError'), ('limit out of bounds', 'ValueError'), ('table not loaded', 'TableNotFound'), "
    "('whole file', 'none')) AS r(condition, raised)",
    "unexpected_brands": on_sales(
        "SELECT 'sub_category' AS column_name, sub_category AS value, COUNT(*) AS rows FROM sales_lines "
        "WHERE sub_category NOT IN ('Brand#1', 'Brand#2') GROUP BY sub_category"
    ),
    "mixed_header_csv": on_sales(
        "SELECT row_id, strftime(order_date, '%-m/%-d/%Y') AS order_date, concat('  ', region, ' ') AS region, "
        f"product_name, sales, quantity, CASE WHEN order_date >= DATE '{q.WATERMARK}' THEN row_id END AS Note "
        "FROM sales_lines"
    ),
    "append_by_name": "SELECT o_orderkey, o_custkey, o_orderstatus, "
    f"CASE WHEN o_orderdate < DATE '{q.WATERMARK}' THEN o_totalprice END AS o_totalprice, "
    "CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders",
    "quality_report": _quality(),
    "quality_summary": f"SELECT COUNT(*) AS total_checks, COUNT(*) FILTER (WHERE passed) AS passed_checks, "
    f"COUNT(*) FILTER (WHERE NOT passed) AS failed_checks, bool_and(passed) AS overall_passed FROM ({_quality()})",
    "rogue_values": _rogue_values(),
    "drift_stats": on_fact(_stats("fact")),
    "drift_findings": _drift_findings(),
    "drift_between_runs": _drift_findings(),
    "row_minimum": on_sales(
        "SELECT run::BIGINT AS run, rows_output, run = 2 AS below_min_rows FROM (VALUES (1), (2)) AS runs(run), "
        f"(SELECT COUNT(*) AS rows_output FROM sales_lines WHERE order_date < DATE '{q.LEDGER_CUT}')"
    ),
    "profile_columns": _profile_columns(),
    "profile_histogram": _profile_histogram(),
    "profile_correlation": _profile_correlation(),
    "profile_missing": f"WITH {COERCED} SELECT concat_ws(',', "
    + ", ".join(
        f"CASE WHEN {c} IS NULL THEN '{c}' END"
        for c in ("o_orderkey", "sales", "discount", "profit", "quantity")
    )
    + " ) AS missing_columns, COUNT(*) AS rows FROM coerced GROUP BY 1",
    "csv_extract": on_sales(
        "SELECT row_id, CAST(order_id AS VARCHAR) AS order_id, strftime(order_date, '%-m/%-d/%Y') AS order_date, "
        "strftime(ship_date, '%-m/%-d/%Y') AS ship_date, ship_mode, CAST(customer_id AS VARCHAR) AS customer_id, "
        "customer_name, concat('  ', segment, ' ') AS segment, postal_code, country, "
        "concat('  ', region, ' ') AS region, CAST(product_id AS VARCHAR) AS product_id, category, sub_category, "
        f"product_name, sales, quantity, discount, profit FROM sales_lines WHERE {SINCE}"
    ),
    "ledger_extract": on_sales(
        "SELECT row_id, strftime(order_date, '%-m/%-d/%Y') AS order_date, sales, "
        "SUM(1) OVER ()::BIGINT AS batch_rows, source_rows, TRUE AS files_left_closed FROM sales_lines, "
        f"(SELECT count(*) + count(*) FILTER (WHERE order_date >= DATE '{q.WATERMARK}' AND order_date < DATE "
        f"'{q.FACT_END}') AS source_rows FROM sales_lines), (VALUES (1), (2)) AS delivery(n) "
        f"WHERE {SINCE} AND (n = 1 OR order_date >= DATE '{q.WATERMARK}' AND order_date < DATE '{q.FACT_END}')"
    ),
    "extract_counts": on_sales(
        f"SELECT COUNT(*) AS rows_before_filter, COUNT(*) FILTER (WHERE {SINCE}) AS row_count, "
        "CAST(19 AS BIGINT) AS column_count FROM sales_lines"
    ),
    "export_parity": f"WITH {FACT}, fact_sales AS (SELECT * FROM fact), {_ALL_GOLD} "
    f"SELECT table_name, n AS source_rows, n AS target_rows, TRUE AS matches FROM ({_COUNTS})",
    "export_layout": on_fact(
        f"SELECT CAST(date_trunc('month', order_date) AS DATE) AS month_start, COUNT(*) AS rows, "
        f"{total('sales')} AS total_sales FROM fact GROUP BY 1"
    ),
    "sanitised_names": over(
        gold.CATEGORY,
        "SELECT category, sub_category, total_sales AS _1st_total_sales, total_profit AS _1st_total_profit, "
        "total_units AS _1st_total_units, total_orders AS _1st_total_orders, avg_discount, avg_profit_margin FROM g",
    ),
    "next_row_ids": on_sales(
        "SELECT (SELECT MAX(o_orderkey) FROM orders) + row_number() OVER (ORDER BY row_id) AS row_id, "
        "row_id AS line, order_id FROM sales_lines"
    ),
    "end_to_end_regions": on_fact(
        gold_select(gold.REGION).replace("SELECT region,", f"SELECT {title('region')} AS region,", 1)
    ),
}
