"""Sources and sinks of the engine."""
