"""Registered queries, their SQL counterparts and the table projections they run on."""
