"""SQL building blocks for the DuckDB side of the checks."""

from __future__ import annotations

from collections.abc import Sequence


def q(x: str, digits: int = 8) -> str:
    """Rounded, without negative zero."""
    return f"CASE WHEN round({x}, {digits}) = 0 THEN 0.0 ELSE round({x}, {digits}) END"


def names(values: Sequence[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def with_(ctes: Sequence[tuple[str, str]], select: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes) + "\n" + select


def recursive(ctes, select: str) -> str:
    return with_(ctes, select).replace("WITH ", "WITH RECURSIVE ", 1)


def _level(x: str) -> str:
    return f"CAST(sum(CAST(round({x} * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100)"


_ITEMS = "lineitem JOIN part ON l_partkey = p_partkey"
_ORDERS = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"

PANELS = {
    "brand": f"SELECT last_day(l_shipdate) AS period, p_brand AS entity, {_level('l_extendedprice')} AS level FROM {_ITEMS} GROUP BY 1, 2",
    "type": f"SELECT last_day(l_shipdate) AS period, p_type AS entity, {_level('l_extendedprice')} AS level FROM {_ITEMS} GROUP BY 1, 2",
    "priority": f"SELECT last_day(o_orderdate) AS period, o_orderpriority AS entity, {_level('o_totalprice')} AS level FROM orders GROUP BY 1, 2",
    "priority_day": f"SELECT CAST(o_orderdate AS DATE) AS period, o_orderpriority AS entity, {_level('o_totalprice')} AS level FROM orders GROUP BY 1, 2",
    "segment": f"SELECT last_day(o_orderdate) AS period, c_mktsegment AS entity, {_level('o_totalprice')} AS level FROM {_ORDERS} GROUP BY 1, 2",
    "nation": f"SELECT last_day(o_orderdate) AS period, n_name AS entity, {_level('o_totalprice')} AS level FROM {_ORDERS} GROUP BY 1, 2",
    "region": f"SELECT last_day(o_orderdate) AS period, r_name AS entity, {_level('o_totalprice')} AS level FROM {_ORDERS} GROUP BY 1, 2",
    "event_day": f"SELECT CAST(ts AS DATE) AS period, event_type AS entity, {_level('value')} AS level FROM events GROUP BY 1, 2",
}

NATION_DIM = """SELECT n_name AS entity, 'Nation ' || n_nationkey AS name,
 CASE n_regionkey WHEN 0 THEN 'Sector-' || r_name WHEN 1 THEN 'Equity (single stock)' ELSE r_name END AS asset_class,
 CASE n_regionkey WHEN 0 THEN 'Sector-' || r_name ELSE r_name END AS sector
 FROM nation JOIN region ON n_regionkey = r_regionkey"""


def levels(panel: str, name: str = "lv") -> list[tuple[str, str]]:
    return [(name, PANELS[panel])]


def calendar(source: str = "lv", name: str = "cal") -> tuple[str, str]:
    return (name, f"SELECT period, lag(period) OVER (ORDER BY period) AS prev_period, "
                  f"row_number() OVER (ORDER BY period) AS cal_idx FROM (SELECT DISTINCT period FROM {source})")


def returns_of(lv: str = "lv", cal: str = "cal", name: str = "ret_all") -> tuple[str, str]:
    return (name, f"SELECT {lv}.period, entity, CASE WHEN lag({lv}.period) OVER w = prev_period "
                  f"THEN level / nullif(lag(level) OVER w, 0) - 1 END AS ret "
                  f"FROM {lv} JOIN {cal} USING (period) WHERE level IS NOT NULL "
                  f"WINDOW w AS (PARTITION BY entity ORDER BY {lv}.period)")


def returns(panel: str, name: str = "ret") -> list[tuple[str, str]]:
    """CTEs ending in ``ret``: the non-null returns of a panel."""
    p = "" if name == "ret" else name + "_"
    return [(f"{p}lv", PANELS[panel]), calendar(f"{p}lv", f"{p}cal"),
            returns_of(f"{p}lv", f"{p}cal", f"{p}ret_all"),
            (name, f"SELECT * FROM {p}ret_all WHERE ret IS NOT NULL")]
