"""Sources and sinks of frames, settings and logs."""
