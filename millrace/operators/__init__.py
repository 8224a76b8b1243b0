"""Flow operators and message transforms over DataFrames."""
