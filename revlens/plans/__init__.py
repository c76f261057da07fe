"""Plans: compositions of operators over the review views.

Each public function takes ``(spark, sf_dir)`` and returns a lazy DataFrame.
"""
