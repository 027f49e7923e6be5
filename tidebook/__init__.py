"""Order-book, trade and market-graph analytics as Spark jobs."""
