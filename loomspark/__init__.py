"""loomspark: geometry analytics for fibre architectures on Spark DataFrames."""
