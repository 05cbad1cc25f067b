"""Sources, sinks and contract checks."""
