"""Registered queries: the operators bound to the given tables, each with the SQL it is compared with."""

from pastmark.plans import canonical, evaluation, history, ingest, market, modelling, payouts, place, quality, relative, snapshot

MODULES = (ingest, market, quality, canonical, payouts, history, relative, evaluation, snapshot, place, modelling)
QUERIES = {name: query for m in MODULES for name, query in m.register.queries.items()}
SQL = {name: sql for m in MODULES for name, sql in m.register.sql.items()}
