"""Sensor-station series, forecasts and alerts as PySpark DataFrame operators."""
