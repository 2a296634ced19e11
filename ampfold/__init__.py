"""ampfold: charging-session features and battery-life modelling on Spark DataFrames and Spark ML."""

__version__ = "0.1.0"
