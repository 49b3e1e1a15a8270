"""An engine for evidence-backed fact graphs on Spark."""
