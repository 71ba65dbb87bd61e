"""vigil: Spark-native analytics for model-serving telemetry.

Every operator takes DataFrames plus an explicit ``as_of`` timestamp and
returns a DataFrame; nothing is collected to the driver.
"""

__all__ = ["session", "config", "windows"]
