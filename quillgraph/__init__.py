"""Graph analytics over triples and tables, planned by Spark SQL."""
