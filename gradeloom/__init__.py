"""Assessment analytics on Spark: marks in, graded results and reports out.

Every public function takes DataFrames and returns a DataFrame, so whole
institutions are described as one lazy plan and computed together.
"""
