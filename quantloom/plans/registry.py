"""All registered queries and their SQL twins."""

from __future__ import annotations

from quantloom.plans import advice_queries, feature_queries, indicator_queries, label_queries, ledger_queries, market, market_queries, platform_queries, reader_queries, research_queries, screening_queries
from quantloom.sources import tables
from quantloom.streaming import queries as streaming_queries

QUERIES: dict = {"flagship": market.flagship, **indicator_queries.QUERIES, **screening_queries.QUERIES, **market_queries.QUERIES, **research_queries.QUERIES, **ledger_queries.QUERIES, **platform_queries.QUERIES, **feature_queries.QUERIES, **label_queries.QUERIES, **reader_queries.QUERIES, **advice_queries.QUERIES, **streaming_queries.QUERIES}

_W = lambda n: f"CASE WHEN count(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN avg(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
FLAGSHIP_SQL = f"""WITH {tables.BARS_SQL}, m AS (SELECT *, {_W(5)} AS a5, {_W(20)} AS a20, {_W(60)} AS a60, count(*) OVER (PARTITION BY code) AS rows FROM bars),
l AS (SELECT *, CASE WHEN rows >= 60 THEN a60 ELSE a20 END AS b60, close / a20 - 1 AS ds FROM m QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1),
s AS (SELECT *, coalesce(close > a20, false) AS above, CASE WHEN ds IS NULL THEN 0 ELSE (rank() OVER (ORDER BY ds NULLS LAST) + (count(ds) OVER (PARTITION BY ds) - 1) / 2) / count(ds) OVER () * 100 END AS score FROM l)
SELECT code, date, round(close, 4) AS close, round(a5, 4) AS ma5, round(a20, 4) AS ma20, round(b60, 4) AS ma60, above, round(score, 4) AS score FROM s ORDER BY s.score DESC, code LIMIT 20"""

ORACLES: dict = {"flagship": FLAGSHIP_SQL, **indicator_queries.ORACLES, **screening_queries.ORACLES, **market_queries.ORACLES, **research_queries.ORACLES, **ledger_queries.ORACLES, **platform_queries.ORACLES, **feature_queries.ORACLES, **label_queries.ORACLES, **reader_queries.ORACLES, **advice_queries.ORACLES, **streaming_queries.ORACLES}
