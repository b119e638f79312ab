"""navloom: fund analytics as table-to-table PySpark operators."""
