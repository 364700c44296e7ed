"""DuckDB SQL that states, independently of the Spark plans, what each query must return."""
