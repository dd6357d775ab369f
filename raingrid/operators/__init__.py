"""Operators: DataFrame in, DataFrame out, keyed by ``by`` and ordered by ``ds``.

A series holds at most one row per ``by`` key and ``ds``, so its length is bounded
by the calendar however many raw rows were reduced into it. Windows and per-series
arrays rest on that bound.
"""
