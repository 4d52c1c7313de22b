"""Analytics on app-store, review and network-capture tables, written as Spark DataFrame operators."""
