"""Link-telemetry analytics on Spark."""
