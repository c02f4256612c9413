"""Equity-panel analytics on Spark: DataFrame-to-DataFrame operators on declared schemas."""
