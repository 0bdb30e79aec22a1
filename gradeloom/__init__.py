"""gradeloom: DataFrame operators for building, profiling, selecting and evaluating graded text datasets."""
