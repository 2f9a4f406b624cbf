"""Column expressions; all of them native, none a UDF."""
