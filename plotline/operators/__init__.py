"""Table-to-table steps: DataFrame in, DataFrame out."""
