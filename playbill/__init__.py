"""Event-feed analytics on Spark: crawl frontier, page text, record clean-up,
entity matching and event listings as DataFrame functions."""

__version__ = "0.1.0"
