"""Operators over unbounded tables: the daily maximum, the hourly spike fix and first rows, with bounded state."""
