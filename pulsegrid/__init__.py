"""pulsegrid: multi-sensor time-series features and evaluation on Spark DataFrames."""

__version__ = "0.1.0"
