"""Analytics over content-addressed snapshot stores, on Spark."""
