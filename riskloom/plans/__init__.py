"""End-to-end jobs and the SQL oracle texts."""
