"""Queries of the whole-lot back-test: lots, positions and value with the wealth that the lots lead to, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators import backtest
from panelyard.plans.research import BASE, R, labelled, neat
from panelyard.sources.panel import kept, panel

BOOK = """ca AS (SELECT portfolio, date, max(wealth) - sum(lots * 100 * price) AS cash, max(wealth) AS a FROM lt GROUP BY 1, 2), dv AS (SELECT portfolio, date, sum(value) AS value FROM ps GROUP BY 1, 2),
bk AS (SELECT portfolio, date, value, last_value(cash IGNORE NULLS) OVER w AS cash, first_value(a IGNORE NULLS) OVER w AS a FROM dv LEFT JOIN ca USING (portfolio, date) WINDOW w AS (PARTITION BY portfolio ORDER BY date))"""

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _weights(spark, sf_dir) -> DataFrame:
    """A portfolio for each industry and half of its codes, long its top group in equal parts; every code has a row at
    every rebalance at which it has a price."""
    rows = labelled(spark, sf_dir).where("industry IS NOT NULL AND volume > 0 AND label IS NOT NULL").withColumn("portfolio", F.col("industry") * 2 + F.col("code") % 2)
    top = (F.col("label") == 4).cast("int")
    return rows.select("portfolio", "date", "code", F.coalesce(F.try_divide(top, F.sum(top).over(Window.partitionBy("portfolio", "date"))), F.lit(0.0)).alias("weight"), F.try_divide("amount", "volume").alias("price"))


#: From `pw` (portfolio, date, code, price, weight) and `panel`: lots and wealth (lt), positions (ps) and the book (bk).
LOT_STEPS = """pd AS MATERIALIZED (SELECT portfolio, date, row_number() OVER w AS k, lead(date) OVER w AS next FROM (SELECT DISTINCT portfolio, date FROM pw) WINDOW w AS (PARTITION BY portfolio ORDER BY date)),
hd AS MATERIALIZED (SELECT a.portfolio, k, a.weight AS w, a.price AS p, coalesce(b.price / a.price - 1, 0) AS r FROM pw a JOIN pd USING (portfolio, date) LEFT JOIN pw b ON b.portfolio = a.portfolio AND b.code = a.code AND b.date = pd.next WHERE a.weight <> 0 AND a.price > 0),
we AS (SELECT portfolio, k, CAST(1e6 AS DOUBLE) AS a FROM pd WHERE k = 1 UNION ALL
  SELECT we.portfolio, we.k + 1, we.a + coalesce((SELECT sum(trunc(w * we.a / (p * 100)) * 100 * p * r) FROM hd WHERE hd.portfolio = we.portfolio AND hd.k = we.k), 0) FROM we JOIN pd ON pd.portfolio = we.portfolio AND pd.k = we.k + 1),
lt AS MATERIALIZED (SELECT pw.portfolio, date, code, price, CAST(trunc(weight * a / (price * 100)) AS BIGINT) AS lots, a AS wealth FROM pw JOIN pd USING (portfolio, date) JOIN we USING (portfolio, k)),
fd AS (SELECT portfolio, code, min(date) AS f FROM lt GROUP BY 1, 2),
br AS (SELECT fd.portfolio, fd.code, f, c.date, last_value(c.vwap IGNORE NULLS) OVER w AS close, coalesce(last_value(lots IGNORE NULLS) OVER w, 0) * 100 AS shares FROM fd JOIN panel c ON c.code = fd.code LEFT JOIN lt ON lt.portfolio = fd.portfolio AND lt.code = fd.code AND lt.date = c.date WINDOW w AS (PARTITION BY fd.portfolio, fd.code ORDER BY c.date)),
ps AS MATERIALIZED (SELECT * FROM (SELECT portfolio, date, code, f, shares, close, coalesce(shares * close, 0) AS value, coalesce(lag(shares) OVER w * (close - lag(close) OVER w), 0) AS pnl FROM br WINDOW w AS (PARTITION BY portfolio, code ORDER BY date)) WHERE date >= f)"""


def _closes(spark, sf_dir) -> DataFrame:
    return panel(spark, sf_dir).select("code", "date", F.col("vwap").alias("close"))


_LOTS = f"""{BASE.replace('WITH ', 'WITH RECURSIVE ', 1)}, pw AS MATERIALIZED (SELECT industry * 2 + code % 2 AS portfolio, date, code, amount / volume AS price,
  coalesce(CAST(label = 4 AS INTEGER) / nullif(CAST(sum(CAST(label = 4 AS INTEGER)) OVER (PARTITION BY industry * 2 + code % 2, date) AS DOUBLE), 0), 0) AS weight FROM labels WHERE industry IS NOT NULL AND volume > 0 AND label IS NOT NULL),
{LOT_STEPS}"""


@query(f"{_LOTS} SELECT portfolio, date, code, {R('price', 'price')}, lots, {R('lots * 100 * price / wealth', 'actual')}, {R('wealth', 'wealth')} FROM lt")
def integer_lot_backtest(spark, sf_dir):
    return neat(backtest.integer_lots(_weights(spark, sf_dir), 1e6), "portfolio", "date", "code", "lots")


@query(f"{_LOTS} SELECT portfolio, date, code, shares, {R('value', 'value')}, {R('pnl', 'pnl')} FROM ps WHERE shares <> 0 OR pnl <> 0")
def lot_positions(spark, sf_dir):
    lots = kept(backtest.integer_lots(_weights(spark, sf_dir), 1e6))
    return neat(backtest.lot_positions(lots, _closes(spark, sf_dir)).where("shares <> 0 OR pnl <> 0").drop("close"), "portfolio", "date", "code", "shares")


@query(f"""{_LOTS}, {BOOK}
SELECT portfolio, date, {R('value', 'value')}, {R('cash / nullif(value + cash, 0)', 'cash_share')}, {R('(value + cash) / a', 'nav')} FROM bk""")
def lot_book(spark, sf_dir):
    """A portfolio's value on every bar; at a rebalance it is the wealth of the recursion."""
    lots = kept(backtest.integer_lots(_weights(spark, sf_dir), 1e6))
    book = backtest.lot_book(lots, backtest.lot_positions(lots, _closes(spark, sf_dir)))
    return neat(book.withColumn("cash_share", F.try_divide("cash", F.nullif(F.col("value") + F.col("cash"), F.lit(0.0)))).drop("cash"), "portfolio", "date")


@query(f"{_LOTS}, tb AS (SELECT portfolio, date, code, lots - coalesce(lag(lots) OVER (PARTITION BY portfolio, code ORDER BY date), 0) AS change FROM lt) SELECT portfolio, date, code, CASE WHEN change > 0 THEN 'buy' ELSE 'sell' END AS side, change FROM tb WHERE change <> 0")
def lot_trades(spark, sf_dir):
    return backtest.trades(backtest.integer_lots(_weights(spark, sf_dir), 1e6))
