"""Project-proposal analytics on Spark: pricing, teams, text, timelines, history, uploads."""
