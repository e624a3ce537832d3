"""Training-data operators: one module per operator, each taking and returning DataFrames."""
