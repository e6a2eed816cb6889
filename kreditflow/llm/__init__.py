"""Operators of a training-data pipeline over document tables.

Nothing outside this folder imports it.  Every operator selects and renames the
columns it needs first, so extra columns, whatever their names, never clash.
"""
