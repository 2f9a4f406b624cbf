"""Customer-finance analytics as Spark DataFrame plans.

Finance tables in, DataFrames out: every public function takes DataFrames (or a
``dict[str, DataFrame]`` keyed by table name) and returns a lazy DataFrame. The
only functions that run jobs are the writers in ``sources``, the quality gate
and the exact-rank operators, which checkpoint their sorted keys.
"""
