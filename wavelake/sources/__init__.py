"""Media containers and raw samples as tables: parsers, writers, and Spark data sources over them."""
