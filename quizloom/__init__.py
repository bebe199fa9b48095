"""Study documents in, graded multiple-choice material out, as Spark DataFrames."""
