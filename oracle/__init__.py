"""DuckDB SQL equivalents of the registered queries."""
