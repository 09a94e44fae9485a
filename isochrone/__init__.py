"""Time-series research and portfolio analytics as Spark DataFrame operators.

Everything works on long tables ``(ts, asset, value)``; extra key columns (fold, path,
configuration, signal, horizon) ride along through the ``scope`` arguments, so many runs share
one job. See README.md for conventions and for how each operator behaves at scale.
"""
