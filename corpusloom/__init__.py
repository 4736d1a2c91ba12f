"""Table-in, table-out operators for document corpora on Spark."""
