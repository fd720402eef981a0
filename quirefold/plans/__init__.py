"""Registered queries and the same in DuckDB SQL."""
