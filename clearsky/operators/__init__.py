"""Table-to-table operators: DataFrame in, DataFrame out."""
