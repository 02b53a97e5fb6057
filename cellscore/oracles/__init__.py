"""DuckDB SQL with which the jobs in ``cellscore.plans`` are checked."""
