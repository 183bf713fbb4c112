"""Market analytics on Spark: bars, news and macro tables in, features, backtests and audits out."""

__version__ = "0.1.0"
