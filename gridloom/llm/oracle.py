"""DuckDB SQL of the text operators that SQL can express."""

from gridloom.llm import decontamination, line_dedup

ORACLE_SQL: dict[str, str] = {"op6_line_dedup": line_dedup.ORACLE_SQL, "op10_decontamination": decontamination.ORACLE_SQL}
