"""Reading contract tables, writing logs and reports."""
