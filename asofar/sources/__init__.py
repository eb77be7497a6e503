"""Tables by role, scans, and sinks."""
