"""tidewater: graph, vector-search and access-trace analytics on PySpark."""
