"""Table operators: DataFrame -> DataFrame. Order is never implied: an ``ordinal`` column carries it."""
