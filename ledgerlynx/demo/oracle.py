"""Independent ANSI SQL for every registered query (run by DuckDB in the checks).

Written from the operator definitions, not from the Spark plans: prices use
plain range joins, ranks use plain windows, quantiles the built-in function.
"""

from __future__ import annotations

from . import tables as t

# Written out here, so that a wrong constant of the engine shows up.
# fmt: off
CONCEPT_ALIASES = {'revenue': ['Revenues', 'RevenueFromContractWithCustomerExcludingAssessedTax', 'SalesRevenueNet'],
 'net_income': ['NetIncomeLoss'],
 'operating_income': ['OperatingIncomeLoss'],
 'gross_profit': ['GrossProfit'],
 'tax_expense': ['IncomeTaxExpenseBenefit'],
 'interest_expense': ['InterestExpense', 'InterestAndDebtExpense'],
 'rd_expense': ['ResearchAndDevelopmentExpense'],
 'sga_expense': ['SellingGeneralAndAdministrativeExpense'],
 'total_assets': ['Assets'],
 'current_assets': ['AssetsCurrent'],
 'cash': ['CashAndCashEquivalentsAtCarryingValue'],
 'receivables': ['AccountsReceivableNetCurrent'],
 'inventory': ['InventoryNet'],
 'ppe_net': ['PropertyPlantAndEquipmentNet'],
 'total_liabilities': ['Liabilities'],
 'current_liabilities': ['LiabilitiesCurrent'],
 'long_term_debt': ['LongTermDebt', 'LongTermDebtNoncurrent'],
 'retained_earnings': ['RetainedEarningsAccumulatedDeficit'],
 'equity': ['StockholdersEquity'],
 'operating_cash_flow': ['NetCashProvidedByUsedInOperatingActivities'],
 'capex': ['PaymentsToAcquirePropertyPlantAndEquipment'],
 'depreciation': ['DepreciationDepletionAndAmortization', 'Depreciation'],
 'total_expenses': ['CostsAndExpenses'],
 'shares_outstanding': ['CommonStockSharesOutstanding'],
 'eps_basic': ['EarningsPerShareBasic'],
 'eps_diluted': ['EarningsPerShareDiluted'],
 'dividends_per_share': ['CommonStockDividendsPerShareDeclared']}
PANEL_CONCEPTS = ['Revenues', 'RevenueFromContractWithCustomerExcludingAssessedTax', 'SalesRevenueNet',
 'NetIncomeLoss', 'OperatingIncomeLoss', 'GrossProfit', 'IncomeTaxExpenseBenefit',
 'InterestExpense', 'InterestAndDebtExpense', 'ResearchAndDevelopmentExpense',
 'SellingGeneralAndAdministrativeExpense', 'Assets', 'AssetsCurrent',
 'CashAndCashEquivalentsAtCarryingValue', 'AccountsReceivableNetCurrent', 'InventoryNet',
 'PropertyPlantAndEquipmentNet', 'Liabilities', 'LiabilitiesCurrent', 'LongTermDebt',
 'LongTermDebtNoncurrent', 'RetainedEarningsAccumulatedDeficit', 'StockholdersEquity',
 'NetCashProvidedByUsedInOperatingActivities', 'PaymentsToAcquirePropertyPlantAndEquipment',
 'DepreciationDepletionAndAmortization', 'Depreciation', 'CostsAndExpenses',
 'CommonStockSharesOutstanding', 'EarningsPerShareBasic', 'EarningsPerShareDiluted',
 'CommonStockDividendsPerShareDeclared']
SNAPSHOT_CONCEPTS = {'net_income': 'NetIncomeLoss',
 'gross_profit': 'GrossProfit',
 'operating_income': 'OperatingIncomeLoss',
 'ebit': 'OperatingIncomeLoss',
 'total_assets': 'Assets',
 'current_assets': 'AssetsCurrent',
 'current_liabilities': 'LiabilitiesCurrent',
 'total_liabilities': 'Liabilities',
 'long_term_debt': 'LongTermDebt',
 'retained_earnings': 'RetainedEarningsAccumulatedDeficit',
 'shares_outstanding': 'CommonStockSharesOutstanding',
 'receivables': 'AccountsReceivableNetCurrent',
 'inventory': 'InventoryNet',
 'ppe_net': 'PropertyPlantAndEquipmentNet',
 'operating_cash_flow': 'NetCashProvidedByUsedInOperatingActivities',
 'capex': 'PaymentsToAcquirePropertyPlantAndEquipment',
 'depreciation': 'DepreciationDepletionAndAmortization'}
SNAPSHOT_REVENUE = ('Revenues', 'RevenueFromContractWithCustomerExcludingAssessedTax')
GOING_CONCERN_CONCEPTS = ('SubstantialDoubtAboutGoingConcernTextBlock', 'GoingConcernDisclosureTextBlock')
BIG4 = ['deloitte', 'ernst & young', 'kpmg', 'pricewaterhousecoopers']
OTHER_MAJOR = ['bdo ', 'grant thornton', 'rsm us', 'rsm llp', 'mazars', 'crowe', 'baker tilly', 'cohnreznick',
 'moss adams', 'plante moran', 'cherry bekaert', 'forvis', 'dixon hughes', 'eide bailly', 'marcum',
 'citrin', 'withum', 'weaver', 'cbiz', 'wipfli', 'armanino', 'friedman', 'rkl', 'svb alliant',
 'sensiba', 'mgq']
# fmt: on

AS_OF = f"DATE '{t.AS_OF}'"


def rnd(x: str, d: int = 4) -> str:
    if d == 0:
        return f"(round_even({x}, 0) + 0.0)"
    return f"(round_even(({x}) * 1e{d}, 0) / 1e{d} + 0.0)"


def sd(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def z(x: str) -> str:
    return f"coalesce({x}, 0.0)"


def texts(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def when_positive(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN {x} END)"


# -- source views -------------------------------------------------------------

_TICKER = "'T' || lpad(CAST(CAST(floor({0} / 4.0) AS BIGINT) AS VARCHAR), 6, '0')"

_FILING = """
  l_suppkey AS cik,
  CASE l_returnflag WHEN 'R' THEN '10-K' WHEN 'A' THEN '10-K/A' ELSE '10-Q' END AS form,
  CAST(year(CAST(l_shipdate AS DATE) - 30) AS INTEGER) AS fy,
  CASE l_returnflag WHEN 'R' THEN 'FY' WHEN 'A' THEN 'FY' ELSE 'Q3' END AS fp,
  CAST(l_shipdate AS DATE) - 60 AS end_date,
  CAST(l_shipdate AS DATE) AS filed,
  l_orderkey * 8 + l_linenumber AS pos"""

_CONCEPT = f"""CASE WHEN l_partkey % 4001 = 7 THEN '{GOING_CONCERN_CONCEPTS[0]}'
    WHEN l_partkey % 4003 = 9 THEN '{GOING_CONCERN_CONCEPTS[1]}'
    ELSE list_extract([{texts(PANEL_CONCEPTS)}], CAST(l_partkey % 32 AS INTEGER) + 1) END"""

CTES: dict[str, str] = {}

CTES["co"] = f"""
SELECT s_suppkey AS cik, s_name AS name,
  CASE WHEN s_suppkey % 17 <> 5 THEN {_TICKER.format('s_suppkey')} END AS ticker,
  n_name AS exchange,
  CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 13 = 0 THEN 0.0
    ELSE s_acctbal * 1e6 END AS market_cap
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey"""

CTES["fa"] = f"""
SELECT *, CASE WHEN concept = '{t.SHARES_CONCEPT}' THEN 'shares'
    WHEN concept IN ({texts(t.PER_SHARE)}) THEN 'USD/shares' ELSE 'USD' END AS unit,
  amount * CASE WHEN concept = '{t.SHARES_CONCEPT}' THEN CAST(1000.0 AS DOUBLE)
    WHEN concept IN ({texts(t.PER_SHARE)}) THEN CAST(0.001 AS DOUBLE)
    ELSE CAST(10000.0 AS DOUBLE) END AS val
FROM (SELECT {_FILING}, {_CONCEPT} AS concept,
  CASE WHEN l_tax >= 0.07 THEN -l_extendedprice ELSE l_extendedprice END AS amount
  FROM lineitem)"""

CTES["au"] = f"""
SELECT {_FILING},
  list_extract([{texts(t.AUDITORS)}], CAST((l_partkey * 7 + l_suppkey) % 8 AS INTEGER) + 1) AS auditor
FROM lineitem"""

_CLOSE = (
    "CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) / count(*) / CAST(100 AS DOUBLE)"
)
CTES["ba"] = f"""
SELECT {_TICKER.format('l_suppkey')} AS ticker, CAST(l_shipdate AS DATE) AS date,
  {_CLOSE} AS close, sum(l_quantity) * 250 AS volume
FROM lineitem GROUP BY 1, 2"""
CTES["be"] = f"""
SELECT CAST(l_shipdate AS DATE) AS date, {_CLOSE} AS close FROM lineitem GROUP BY 1"""
CTES["qu"] = f"""
SELECT {_TICKER.format('s_suppkey')} AS ticker,
  CASE WHEN max(s_acctbal) > 5000 THEN max(s_acctbal) * 1e5 END AS market_cap,
  CASE WHEN max(s_nationkey) < 22 THEN sum(s_nationkey) / CAST(37.0 AS DOUBLE) END AS beta,
  min(s_acctbal) / 10 AS bid, max(s_acctbal) / 10 - 100 AS ask
FROM supplier GROUP BY 1"""

_ACC = "lpad(CAST(user_id AS VARCHAR), 10, '0') || strftime(ts, '%Y%m%d')"
CTES["tx"] = f"""
SELECT user_id AS cik, {_ACC} AS accession, CAST(ts AS DATE) AS filed,
  CASE event_type WHEN 'purchase' THEN 'P' WHEN 'error' THEN 'S' ELSE 'A' END AS code,
  round_even(value * 100, 0) AS shares
FROM events"""
CTES["fs"] = """
SELECT cik, accession, filed,
  CAST(coalesce(sum(shares) FILTER (code = 'S'), 0) AS BIGINT) AS sales,
  CAST(coalesce(sum(shares) FILTER (code = 'P'), 0) AS BIGINT) AS purchases
FROM tx GROUP BY 1, 2, 3"""
CTES["ins"] = """
SELECT *, coalesce(net_insider_shares < -10000 AND insider_sale_count > insider_buy_count, false)
    AS insider_selling_flag
FROM (
  SELECT cik, count(*) FILTER (sales > 0) AS insider_sale_count,
    count(*) FILTER (purchases > 0) AS insider_buy_count,
    CAST(sum(purchases) - sum(sales) AS BIGINT) AS net_insider_shares
  FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filed DESC) AS rn FROM fs
        WHERE filed >= DATE '2001-11-04' - 365)
  WHERE rn <= 20 GROUP BY cik)"""

# -- facts --------------------------------------------------------------------

CTES["lv"] = """
SELECT cik, concept, unit, val, end_date FROM (
  SELECT *, row_number() OVER (PARTITION BY cik, concept, unit ORDER BY end_date DESC, pos DESC) AS rn
  FROM fa WHERE form = '10-K')
WHERE rn = 1"""


def _pick(concept: str) -> str:
    return f"max(val) FILTER (concept = '{concept}' )"


CTES["gc"] = f"""
SELECT cik, coalesce(bool_or(concept IN ({texts(GOING_CONCERN_CONCEPTS)})), false) AS going_concern
FROM fa GROUP BY cik"""
CTES["sn"] = f"""
SELECT gc.cik, coalesce(nullif(r0, 0), r1) AS revenue, {", ".join(SNAPSHOT_CONCEPTS)}, going_concern
FROM gc LEFT JOIN (
  SELECT cik, {_pick(SNAPSHOT_REVENUE[0])} AS r0, {_pick(SNAPSHOT_REVENUE[1])} AS r1,
  {", ".join(f"{_pick(con)} AS {f}" for f, con in SNAPSHOT_CONCEPTS.items())}
  FROM lv GROUP BY cik) w ON gc.cik = w.cik"""
CTES["ad"] = """
SELECT cik, auditor AS auditor_name FROM (
  SELECT *, row_number() OVER (PARTITION BY cik ORDER BY end_date DESC, pos DESC) AS rn
  FROM au WHERE form <> '10-Q')
WHERE rn = 1"""

_LO = max(t.FLOOR, t.AS_OF.year - t.YEARS)
CTES["an"] = f"""
SELECT cik, concept, fy AS fiscal_year, val, filed FROM (
  SELECT *, row_number() OVER (PARTITION BY cik, concept, fy ORDER BY filed DESC, pos ASC) AS rn
  FROM fa WHERE form IN ('10-K', '10-K/A') AND fp = 'FY'
    AND fy BETWEEN {_LO} AND {t.AS_OF.year + 1} AND concept IN ({texts(PANEL_CONCEPTS)}))
WHERE rn = 1"""
CTES["aw"] = f"""
SELECT cik, fiscal_year, max(filed) AS filed_date,
{", ".join("coalesce(" + ", ".join(_pick(n) for n in names) + f") AS {field}"
           for field, names in CONCEPT_ALIASES.items())}
FROM an GROUP BY cik, fiscal_year"""

GROWTH = [
    ("revenue_growth_yoy", "revenue"), ("asset_growth_yoy", "total_assets"),
    ("receivables_growth_yoy", "receivables"), ("inventory_growth_yoy", "inventory"),
    ("net_income_growth_yoy", "net_income"), ("gross_profit_growth_yoy", "gross_profit"),
    ("capex_growth_yoy", "capex"), ("ocf_growth_yoy", "operating_cash_flow"),
    ("shares_dilution", "shares_outstanding"), ("eps_growth_yoy", "eps_diluted"),
    ("equity_change_yoy", "equity"), ("debt_growth_yoy", "long_term_debt"),
    ("cash_change_yoy", "cash"), ("rd_growth_yoy", "rd_expense"),
    ("sga_growth_yoy", "sga_expense"),
]
DELTAS = [
    ("gross_margin_change", "gross_profit", "revenue"),
    ("operating_margin_change", "operating_income", "revenue"),
    ("net_margin_change", "net_income", "revenue"),
    ("ar_to_revenue_change", "receivables", "revenue"),
    ("asset_turnover_change", "revenue", "total_assets"),
    ("cash_conversion_change", "operating_cash_flow", "net_income"),
]
CTES["yo"] = f"""
SELECT a.*,
{", ".join(f"{rnd(f'(a.{f} - p.{f}) / nullif(abs(p.{f}), 0)')} AS {n}" for n, f in GROWTH)},
{", ".join(f"{rnd(f'{sd('a.' + x, 'a.' + y)} - {sd('p.' + x, 'p.' + y)}')} AS {n}"
           for n, x, y in DELTAS)}
FROM aw a LEFT JOIN aw p ON p.cik = a.cik AND p.fiscal_year = a.fiscal_year - 1"""

# -- market -------------------------------------------------------------------


def market_sql(days: int = 90, spike: float = 3.0, pump: float = 0.5) -> str:
    return f"""
SELECT ticker, {rnd('avg_all', 0)} AS avg_volume_90d, {rnd('nullif(spike, 0)', 3)} AS volume_spike_ratio,
  {rnd('CASE WHEN c_first > 0 THEN (c_last - c_first) / c_first END')} AS price_change_90d,
  coalesce(avg_all < 10000, false) AS illiquid_flag,
  coalesce(spike > {spike} AND base > 0 AND (c_last - base) / base > {pump}, false) AS pump_dump_flag,
  {rnd('CASE WHEN returns >= 10 THEN dev * sqrt(CAST(252 AS DOUBLE)) END')} AS volatility_90d
FROM (
  SELECT *, CASE WHEN avg_all > 0 THEN (CASE WHEN n >= 30 THEN avg_30 ELSE avg_all END) / avg_all END
      AS spike, CASE WHEN n >= 30 THEN c_30 ELSE c_first END AS base
  FROM (
    SELECT ticker, count(*) AS n, avg(volume) AS avg_all, avg(volume) FILTER (rn <= 30) AS avg_30,
      min_by(close, date) AS c_first, max_by(close, date) AS c_last,
      max(close) FILTER (rn = 30) AS c_30, count(ret) AS returns, stddev_samp(ret) AS dev
    FROM (
      SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn,
        close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret
      FROM ba WHERE date > {AS_OF} - {days} AND date <= {AS_OF})
    GROUP BY ticker))
WHERE n >= 10"""


CTES["mk"] = market_sql()
CTES["qs"] = f"""
SELECT ticker, {rnd('beta', 3)} AS beta,
  {rnd('CASE WHEN bid > 0 AND ask > 0 AND ask >= bid THEN (ask - bid) / ((bid + ask) / 2) END')}
    AS bid_ask_spread
FROM qu"""

# -- financials, signals, report ----------------------------------------------

CTES["fi"] = """
SELECT co.cik, co.name, co.ticker, co.exchange, co.market_cap, sn.* EXCLUDE (cik)
FROM co JOIN sn ON co.cik = sn.cik
WHERE nullif(sn.total_assets, 0) IS NOT NULL AND nullif(sn.revenue, 0) IS NOT NULL"""


def auditor_sql(name: str, cap: str) -> tuple[str, str]:
    n = f"lower({name})"
    big = " OR ".join(f"contains({n}, '{p}')" for p in BIG4)
    big = f"({big} OR contains({n}, 'ey llp') OR trim({n}) IN ('ey', 'e&y'))"
    rest = " OR ".join(f"contains({n}, '{p}')" for p in OTHER_MAJOR)
    major = f"({big} OR {rest} OR contains({n}, 'pwc llp') OR trim({n}) = 'pwc')"
    named = f"coalesce({name} <> '', false)"
    return (
        f"({named} AND coalesce({big}, false))",
        f"({named} AND NOT coalesce({major}, false) AND coalesce({cap}, 0) > 50000000)",
    )


_BIG4, _SMALL = auditor_sql("auditor_name", "market_cap")
CTES["fin"] = f"""
SELECT *, {_BIG4} AS big4_auditor, {_SMALL} AS small_auditor_flag
FROM (
  SELECT fi.* REPLACE (coalesce(nullif(fi.market_cap, 0), nullif(qu.market_cap, 0), fi.market_cap)
      AS market_cap), ad.auditor_name,
    mk.* EXCLUDE (ticker), CASE WHEN mk.ticker IS NOT NULL THEN qs.beta END AS beta,
    CASE WHEN mk.ticker IS NOT NULL THEN qs.bid_ask_spread END AS bid_ask_spread,
    ins.* EXCLUDE (cik)
  FROM fi LEFT JOIN qu ON fi.ticker = qu.ticker LEFT JOIN mk ON fi.ticker = mk.ticker
  LEFT JOIN qs ON fi.ticker = qs.ticker LEFT JOIN ins ON fi.cik = ins.cik
  LEFT JOIN ad ON fi.cik = ad.cik)"""


BENEISH_PARTS = {
    "dsri": (0.920, sd("receivables", "revenue")),
    "gmi": (0.528, sd("gross_profit", "revenue")),
    "aqi": (0.404, sd(f"{z('total_assets')} - {z('current_assets')} - {z('ppe_net')}", "total_assets")),
    "sgi": (0.892, sd("revenue", "total_assets")),
    "depi": (0.115, sd("depreciation", f"({z('depreciation')} + {z('ppe_net')})")),
    "tata": (4.679, sd(f"{z('net_income')} - {z('operating_cash_flow')}", "total_assets")),
    "lvgi": (-0.327, sd(f"{z('long_term_debt')} + {z('current_liabilities')}", "total_assets")),
}


def accounting_raw() -> str:
    """Unrounded signal numbers, one SELECT list."""
    terms = " + ".join(f"coalesce(CAST({w} AS DOUBLE) * {x}, 0)" for w, x in BENEISH_PARTS.values())
    ta1 = "coalesce(nullif(total_assets, 0), 1.0)"
    cl1 = "coalesce(nullif(current_liabilities, 0), 1.0)"
    rev1 = "coalesce(nullif(revenue, 0), 1.0)"
    ni, ocf = z("net_income"), z("operating_cash_flow")
    tests = [
        f"{ni} / {ta1} > 0", f"{ocf} > 0", f"{ocf} > {ni}", f"({ocf} - {ni}) / {ta1} > 0",
        f"{z('long_term_debt')} / {ta1} < 0.4", f"{z('current_assets')} / {cl1} > 1", "true",
        f"{z('gross_profit')} / {rev1} > 0.2", f"{rev1} / {ta1} > 0.5",
    ]
    debt = f"coalesce(nullif(total_liabilities, 0), {z('long_term_debt')} + {z('current_liabilities')})"
    ta = "nullif(total_assets, 0)"
    alt = [
        (1.2, sd(f"{z('current_assets')} - {z('current_liabilities')}", ta)),
        (1.4, sd("retained_earnings", ta)), (3.3, sd("operating_income", ta)),
        (0.6, sd("nullif(market_cap, 0)", debt)), (1.0, sd("revenue", ta)),
    ]
    used = " + ".join(f"CAST({x} IS NOT NULL AS INTEGER)" for _, x in alt)
    total = " + ".join(f"coalesce(CAST({w} AS DOUBLE) * {x}, 0)" for w, x in alt)
    return f"""
  CAST(-4.84 AS DOUBLE) + {terms} AS m_raw,
  {" + ".join(f"CAST({x} AS INTEGER)" for x in tests)} AS piotroski_score,
  {sd(f"{ni} - {ocf}", "total_assets")} AS acc_raw,
  {sd(f"net_income - {ocf}", "abs(net_income)")} AS cfd_raw,
  CASE WHEN {used} >= 3 THEN {total} END AS z_raw,
  {sd("receivables", "nullif(revenue, 0)")} AS ar_raw,
  {sd("net_income - operating_income", "abs(net_income)")} AS nop_raw"""


ACCOUNTING = f"""
  {rnd('m_raw')} AS beneish_score, m_raw > -1.78 AS beneish_flag,
  piotroski_score, piotroski_score <= 2 AS piotroski_weak,
  {rnd('acc_raw')} AS accruals_ratio, coalesce(acc_raw > 0.05, false) AS accruals_flag,
  {rnd('cfd_raw')} AS cfd_ratio, coalesce(cfd_raw > 0.25, false) AS cfd_flag,
  {rnd('z_raw')} AS altman_score,
  CASE WHEN z_raw > 2.99 THEN 'safe' WHEN z_raw > 1.81 THEN 'grey'
    WHEN z_raw IS NOT NULL THEN 'distress' END AS altman_zone,
  coalesce(z_raw <= 1.81, false) AS altman_flag,
  {rnd('ar_raw')} AS ar_ratio, {rnd('ar_raw * 365', 1)} AS dso,
  coalesce(ar_raw > 0.25 OR ar_raw * 365 > 90, false) AS revenue_quality_flag,
  {rnd('nop_raw')} AS non_op_ratio, coalesce(nop_raw > 0.30, false) AS earnings_quality_flag"""

_CAP = "nullif(market_cap, 0)"
_EQ = "(total_assets - total_liabilities)"
_DEBT = z("long_term_debt")
_CA = z("current_assets")
_CASH = f"greatest(0.0, {_CA} - {z('receivables')} - {z('inventory')})"
_EV = f"(market_cap + {_DEBT} - {_CASH})"
_EVC = f"(CASE WHEN operating_income IS NOT NULL THEN {_EV} END)"
_EBITDA = f"(operating_income + {z('depreciation')})"
_FCF = f"(CASE WHEN market_cap > 0 THEN operating_cash_flow - {z('capex')} END)"
_OPCAP = f"(CASE WHEN {_EVC} IS NOT NULL THEN {_CA} - {z('current_liabilities')} + {z('ppe_net')} END)"
_INV = f"({_EQ} + {_DEBT})"
_NCAV = f"(CASE WHEN {_CA} <> 0 THEN {_CA} - total_liabilities END)"
VALUE: dict[str, str] = {
    "pe_ratio": rnd(sd(_CAP, when_positive("net_income")), 2),
    "pb_ratio": rnd(sd(_CAP, when_positive(_EQ)), 2),
    "ev": rnd(f"CASE WHEN {_CAP} IS NOT NULL AND operating_income IS NOT NULL THEN {_EV} END", 0),
    "ebitda": rnd(f"CASE WHEN {_CAP} IS NOT NULL THEN {_EBITDA} END", 0),
    "ev_ebitda": rnd(
        f"CASE WHEN {_CAP} IS NOT NULL AND operating_income IS NOT NULL AND {_EBITDA} > 0 "
        f"THEN {_EV} / {_EBITDA} END", 2),
    "fcf_yield": rnd(sd(_FCF, "market_cap")),
    "fcf": rnd(_FCF, 0),
    "roe": rnd(sd("net_income", when_positive(_EQ))),
    "roa": rnd(sd("net_income", when_positive("total_assets"))),
    "gross_margin": rnd(sd("gross_profit", when_positive("revenue"))),
    "net_margin": rnd(sd("net_income", when_positive("revenue"))),
    "debt_to_equity": rnd(sd(_DEBT, when_positive(_EQ))),
    "current_ratio": rnd(sd(f"nullif({_CA}, 0)", when_positive("current_liabilities")), 2),
    "ev_clean": rnd(_EVC, 0),
    "earnings_yield": rnd(sd("operating_income", when_positive(_EVC))),
    "return_on_capital": rnd(sd("operating_income", when_positive(_OPCAP))),
    "acquirers_multiple": rnd(sd(_EVC, when_positive("operating_income")), 2),
    "ncav": rnd(_NCAV, 0),
    "ncav_ratio": rnd(sd(_CAP, when_positive(_NCAV)), 2),
    "net_net_flag": f"coalesce({_CAP} IS NOT NULL AND {_NCAV} > 0 AND {_CAP} < {_NCAV}, false)",
    "gross_profitability": rnd(sd("gross_profit", when_positive("total_assets"))),
    "croic": rnd(sd(f"operating_cash_flow - {z('capex')}", when_positive(_INV))),
    "invested_capital": rnd(f"nullif({_INV}, 0)", 0),
    "market_cap_segment": "CASE WHEN market_cap IS NULL THEN NULL WHEN market_cap < 150e6 THEN 'micro' "
    "WHEN market_cap < 1e9 THEN 'small' WHEN market_cap < 10e9 THEN 'mid' ELSE 'large' END",
}
REPORT_VALUES = [v for v in VALUE if v not in ("ev", "ebitda", "ev_clean")]

# Composite: points and weights written out per signal.
_POINTS = """
  CASE WHEN beneish_flag THEN 20 * (0.5 + 0.5 * least((beneish_score + 1.78e0) / 3, 1)) ELSE 0 END
  + 10 * (1 - piotroski_score / CAST(9 AS DOUBLE))
  + CASE WHEN accruals_flag THEN 10 * least(accruals_ratio / 0.2e0, 1) ELSE 0 END
  + CASE WHEN cfd_flag THEN 10 * least(cfd_ratio, 1) ELSE 0 END
  + CASE WHEN altman_score < 1.81 THEN 20 * least((1.81e0 - altman_score) / 3.81e0, 1)
         WHEN altman_score < 2.99 THEN 10 * ((2.99e0 - altman_score) / (2.99e0 - 1.81e0)) ELSE 0 END
  + CASE WHEN revenue_quality_flag THEN 10 * greatest(
      CASE WHEN ar_ratio > 0.25 THEN least((ar_ratio - 0.25e0) / 0.5e0, 1) ELSE 0 END,
      CASE WHEN dso > 90 THEN least((dso - 90) / CAST(270 AS DOUBLE), 1) ELSE 0 END) ELSE 0 END
  + CASE WHEN earnings_quality_flag THEN 10 * least((non_op_ratio - 0.3e0) / 0.7e0, 1) ELSE 0 END
  + CASE WHEN going_concern_flag THEN 10 ELSE 0 END
  + CASE WHEN avg_volume_90d IS NOT NULL AND illiquid_flag THEN 5 ELSE 0 END
  + CASE WHEN volume_spike_ratio IS NOT NULL AND pump_dump_flag
      THEN 5 * (0.5 + 0.5 * least((volume_spike_ratio - 3e0) / 7e0, 1)) ELSE 0 END
  + CASE WHEN net_insider_shares IS NOT NULL AND insider_selling_flag THEN 5 ELSE 0 END
  + CASE WHEN auditor_name IS NOT NULL AND small_auditor_flag THEN 5 ELSE 0 END"""
_WEIGHTS = " + ".join(
    f"CASE WHEN {col} IS NOT NULL THEN {w} ELSE 0 END"
    for col, w in [
        ("beneish_score", 20), ("piotroski_score", 10), ("accruals_ratio", 10), ("cfd_ratio", 10),
        ("altman_score", 20), ("ar_ratio", 10), ("non_op_ratio", 10), ("going_concern_flag", 10),
        ("avg_volume_90d", 5), ("volume_spike_ratio", 5), ("net_insider_shares", 5),
        ("auditor_name", 5),
    ]
)
RED_FLAGS = [
    "beneish_flag", "piotroski_weak", "accruals_flag", "cfd_flag", "altman_flag",
    "revenue_quality_flag", "earnings_quality_flag", "going_concern_flag",
    "small_auditor_flag", "pump_dump_flag", "illiquid_flag", "insider_selling_flag",
]

CTES["sg"] = f"""
SELECT cik, ticker, name, exchange, market_cap, total_assets, revenue, {ACCOUNTING},
  coalesce(going_concern, false) AS going_concern_flag,
  auditor_name, big4_auditor, small_auditor_flag, avg_volume_90d, volume_spike_ratio,
  price_change_90d, coalesce(illiquid_flag, false) AS illiquid_flag,
  coalesce(pump_dump_flag, false) AS pump_dump_flag, volatility_90d, beta, bid_ask_spread,
  net_insider_shares, insider_sale_count, insider_buy_count,
  coalesce(insider_selling_flag, false) AS insider_selling_flag,
  {", ".join(f"{x} AS {n}" for n, x in VALUE.items())}
FROM (SELECT *, {accounting_raw()} FROM fin)"""
CTES["sc"] = f"""
SELECT *, CASE WHEN fraud_score IS NULL THEN 'INSUFFICIENT DATA' WHEN fraud_score >= 70
    THEN 'HIGH RISK' WHEN fraud_score >= 45 THEN 'MEDIUM RISK' ELSE 'LOW RISK' END AS risk
FROM (SELECT *, {rnd(f"(({_POINTS}) / nullif(CAST({_WEIGHTS} AS DOUBLE), 0)) * 100", 1)} AS fraud_score,
  {" + ".join(f"CAST({f} AS INTEGER)" for f in RED_FLAGS)} AS red_flags_count FROM sg)"""
CTES["rp"] = """
SELECT sc.*, ey.r AS earnings_yield_rank, rc.r AS roc_rank, ey.r + rc.r AS magic_formula_rank
FROM sc
LEFT JOIN (SELECT cik, row_number() OVER (ORDER BY earnings_yield DESC, cik) AS r
  FROM sc WHERE earnings_yield IS NOT NULL) ey ON sc.cik = ey.cik
LEFT JOIN (SELECT cik, row_number() OVER (ORDER BY return_on_capital DESC, cik) AS r
  FROM sc WHERE return_on_capital IS NOT NULL) rc ON sc.cik = rc.cik"""

# -- panel prices -------------------------------------------------------------


def _asof(date: str) -> str:
    """First close within ten days from a date expression."""
    return (
        f"(SELECT min_by(b.close, b.date) FROM ba b WHERE b.ticker = f.ticker "
        f"AND b.date >= {date} AND b.date < {date} + 10)"
    )


CTES["fl"] = """
SELECT yo.*, co.ticker, co.name, co.exchange, co.market_cap AS current_cap
FROM yo JOIN co ON yo.cik = co.cik WHERE co.ticker IS NOT NULL AND co.ticker <> ''"""
CTES["fd"] = "SELECT DISTINCT ticker, filed_date FROM fl"
CTES["ex"] = f"""
SELECT f.*, {_asof('f.filed_date')} AS e0, {_asof('(f.filed_date + 365)')} AS e12,
  {_asof('(f.filed_date + 730)')} AS e24
FROM fd f"""


def _bench(days: int) -> str:
    return f"""
SELECT d.filed_date, CASE WHEN count(*) >= 2 AND min_by(be.close, be.date) > 0
    THEN (max_by(be.close, be.date) - min_by(be.close, be.date)) / min_by(be.close, be.date) END AS r
FROM (SELECT DISTINCT filed_date FROM fd) d
JOIN be ON be.date >= d.filed_date AND be.date < d.filed_date + {days} + 5 GROUP BY 1"""


CTES["b12"] = _bench(365)
CTES["b24"] = _bench(730)
CTES["hb"] = """
SELECT f.ticker, f.filed_date, b.date, b.close,
  row_number() OVER (PARTITION BY f.ticker, f.filed_date ORDER BY b.date DESC) AS back,
  b.close / nullif(lag(b.close) OVER (PARTITION BY f.ticker, f.filed_date ORDER BY b.date), 0) - 1 AS ret
FROM fd f JOIN ba b ON b.ticker = f.ticker AND b.date >= f.filed_date - 430 AND b.date <= f.filed_date"""
CTES["hn"] = """
SELECT f.ticker, f.filed_date, count(*) AS n_history
FROM fd f JOIN ba b ON b.ticker = f.ticker AND b.date >= f.filed_date - 430 AND b.date < f.filed_date + 5
GROUP BY 1, 2"""
CTES["hs"] = """
SELECT ticker, filed_date, count(*) AS n, max(close) FILTER (back <= 252) AS high,
  max(close) FILTER (back = 253) AS c252, max(close) FILTER (back = 127) AS c126,
  max(close) FILTER (back = 64) AS c63, count(ret) AS n_ret, stddev_samp(ret) AS dev
FROM hb GROUP BY 1, 2"""


def _ok(n: int, e: str) -> str:
    return f"(filed_date <= {AS_OF} - {n} AND e0 > 0 AND {e} IS NOT NULL AND {e} <> 0)"


_OK12, _OK24 = _ok(365, "e12"), _ok(730, "e24")
CTES["pr"] = f"""
SELECT *,
  CASE WHEN entry_price > 0 AND n_history >= 30 AND n >= 1 AND c252 > 0
    THEN {rnd('(entry_price - c252) / c252')} END AS momentum_12m_prior,
  CASE WHEN entry_price > 0 AND n_history >= 30 AND n >= 1 AND c126 > 0
    THEN {rnd('(entry_price - c126) / c126')} END AS momentum_6m_prior,
  CASE WHEN entry_price > 0 AND n_history >= 30 AND n >= 1 AND c63 > 0
    THEN {rnd('(entry_price - c63) / c63')} END AS momentum_3m_prior,
  CASE WHEN entry_price > 0 AND n_history >= 30 AND n >= 1 AND high > 0
    THEN {rnd('entry_price / high')} END AS price_to_52w_high,
  CASE WHEN entry_price > 0 AND n_history >= 30 AND n >= 1 AND n_ret >= 20
    THEN {rnd('dev * sqrt(CAST(252 AS DOUBLE))')} END AS vol_prior_12m,
  coalesce(nullif(entry_price, 0) * nullif(shares_outstanding, 0), current_cap) AS market_cap
FROM (
  SELECT fl.*, hn.n_history, hs.n, hs.high, hs.c252, hs.c126, hs.c63, hs.n_ret, hs.dev,
    CASE WHEN {_OK12} THEN {rnd('e0')} END AS entry_price,
    CASE WHEN {_OK12} THEN {rnd('e12')} END AS exit_price,
    CASE WHEN {_OK12} THEN {rnd('(e12 - e0) / e0')} END AS forward_return_12m,
    CASE WHEN {_OK12} THEN {rnd('nullif(b12.r, 0)')} END AS sp500_return_12m,
    CASE WHEN {_OK12} THEN coalesce((e12 - e0) / e0 > b12.r, false) END AS beat_sp500,
    CASE WHEN {_OK24} THEN {rnd('(e24 - e0) / e0')} END AS forward_return_24m,
    CASE WHEN {_OK24} THEN {rnd('nullif(b24.r, 0)')} END AS sp500_return_24m,
    CASE WHEN {_OK24} THEN coalesce((e24 - e0) / e0 > b24.r, false) END AS beat_sp500_24m
  FROM fl LEFT JOIN ex USING (ticker, filed_date) LEFT JOIN hn USING (ticker, filed_date)
  LEFT JOIN hs USING (ticker, filed_date) LEFT JOIN b12 USING (filed_date)
  LEFT JOIN b24 USING (filed_date))"""

_PEBITDA = "(operating_income + depreciation)"
EXT: dict[str, str] = {
    "operating_margin": rnd(sd("operating_income", "revenue")),
    "ebitda_margin": rnd(sd(_PEBITDA, "revenue")),
    "rd_to_revenue": rnd(sd("rd_expense", "revenue")),
    "sga_to_revenue": rnd(sd("sga_expense", "revenue")),
    "tax_rate": rnd(sd("tax_expense", "(net_income + tax_expense)")),
    "ocf_to_assets": rnd(sd("operating_cash_flow", "total_assets")),
    "fcf_to_assets": rnd(sd("operating_cash_flow - capex", "total_assets")),
    "asset_turnover": rnd(sd("revenue", "total_assets")),
    "inventory_days": rnd("CASE WHEN inventory <> 0 AND revenue > 0 THEN inventory / (revenue / 365) END", 1),
    "receivables_turnover": rnd(sd("revenue", "receivables")),
    "cash_to_assets": rnd(sd("cash", "total_assets")),
    "cash_to_debt": rnd(sd("cash", when_positive("long_term_debt"))),
    "nwc_to_assets": rnd(sd("current_assets - current_liabilities", "total_assets")),
    "equity_ratio": rnd(sd("equity", "total_assets")),
    "equity_multiplier": rnd(sd("total_assets", "equity")),
    "liabilities_to_equity": rnd(sd("total_liabilities", "equity")),
    "debt_to_ebitda": rnd(sd("long_term_debt", _PEBITDA)),
    "net_debt_to_ebitda": rnd(sd("long_term_debt - cash", _PEBITDA)),
    "interest_coverage": rnd(sd("operating_income", when_positive("interest_expense")), 2),
    "retained_earnings_ratio": rnd(sd("retained_earnings", "total_assets")),
    "capex_to_assets": rnd(sd("capex", "total_assets")),
    "capex_to_revenue": rnd(sd("capex", "revenue")),
    "capex_intensity": rnd(sd("capex", when_positive("operating_cash_flow"))),
    "reinvestment_rate": rnd(sd("nullif(capex, 0) - nullif(depreciation, 0)", when_positive("operating_income"))),
    "depreciation_to_assets": rnd(sd("depreciation", "total_assets")),
    "ppe_to_assets": rnd(sd("ppe_net", "total_assets")),
    "cash_conversion": rnd(sd("operating_cash_flow", when_positive("net_income"))),
    "accruals_to_assets": rnd(sd("nullif(net_income, 0) - nullif(operating_cash_flow, 0)", "total_assets")),
    "ev_to_ocf": rnd(sd("nullif(market_cap, 0) + long_term_debt - cash", when_positive("operating_cash_flow"))),
}
EXT_FLAGS: dict[str, str] = {
    "high_dilution_flag": "coalesce(shares_dilution > 0.05, false)",
    "cash_burning_flag": "coalesce(cash_change_yoy < -0.30, false)",
    "high_rd_flag": "coalesce(rd_expense <> 0 AND revenue > 0 AND rd_expense / nullif(revenue, 0) > 0.15, false)",
    "revenue_vs_ar_flag": "coalesce(revenue_growth_yoy IS NOT NULL AND "
    "receivables_growth_yoy > 2 * greatest(revenue_growth_yoy, 0.01e0), false)",
    "earnings_ocf_diverge_flag": "coalesce(net_income > 0 AND operating_cash_flow > 0 "
    "AND net_income > 2 * operating_cash_flow, false)",
}
CTES["pn"] = f"""
SELECT * EXCLUDE (m_raw, acc_raw, cfd_raw, z_raw, ar_raw, nop_raw, piotroski_score), {ACCOUNTING},
  {", ".join(f"{VALUE[n]} AS {n}" for n in REPORT_VALUES)},
  {", ".join(f"{x} AS {n}" for n, x in EXT.items())},
  {", ".join(f"{x} AS {n}" for n, x in EXT_FLAGS.items())}
FROM (SELECT *, {accounting_raw()} FROM pr)"""

# Dependencies in definition order; every statement gets only what it needs.
_NEEDS = {
    "co": [], "fa": [], "au": [], "ba": [], "be": [], "qu": [], "tx": [], "fs": ["tx"],
    "ins": ["fs"], "lv": ["fa"], "gc": ["fa"], "sn": ["gc", "lv"], "ad": ["au"], "an": ["fa"],
    "aw": ["an"], "yo": ["aw"], "mk": ["ba"], "qs": ["qu"], "fi": ["co", "sn"],
    "fin": ["fi", "qu", "mk", "qs", "ins", "ad"], "sg": ["fin"], "sc": ["sg"], "rp": ["sc"],
    "fl": ["yo", "co"], "fd": ["fl"], "ex": ["fd", "ba"], "b12": ["fd", "be"],
    "b24": ["fd", "be"], "hb": ["fd", "ba"], "hn": ["fd", "ba"], "hs": ["hb"],
    "pr": ["fl", "ex", "hn", "hs", "b12", "b24"], "pn": ["pr"],
}


def query(final: str, *needs: str) -> str:
    """WITH clause of everything ``needs`` depends on, then ``final``."""
    wanted: set[str] = set()
    stack = list(needs)
    while stack:
        n = stack.pop()
        if n not in wanted:
            wanted.add(n)
            stack.extend(_NEEDS[n])
    order = [n for n in _NEEDS if n in wanted]
    if not order:
        return final
    body = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]}\n)" for n in order)
    return f"WITH {body}\n{final}"
