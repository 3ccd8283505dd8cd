"""Collects the queries and their SQL counterparts from the plan modules."""

from .plans import ads, appraisals, captures, comparables, feeds, keeping, market, portals, texts

QUERIES = {**market.QUERIES, **texts.QUERIES, **comparables.QUERIES, **feeds.QUERIES, **portals.QUERIES, **ads.QUERIES, **captures.QUERIES, **appraisals.QUERIES, **keeping.QUERIES}
ORACLE_SQL = {**market.ORACLE_SQL, **texts.ORACLE_SQL, **comparables.ORACLE_SQL, **feeds.ORACLE_SQL, **portals.ORACLE_SQL, **ads.ORACLE_SQL, **captures.ORACLE_SQL, **appraisals.ORACLE_SQL, **keeping.ORACLE_SQL}
FLAGSHIP = "market_rollup"
