"""Spark-native invoice / timesheet reconciliation and spend analytics.

Every public function takes DataFrames (or Columns) and returns DataFrames (or Columns); nothing is
collected to the driver and nothing is computed eagerly unless the function's name says ``write``.
"""
