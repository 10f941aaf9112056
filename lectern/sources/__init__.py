"""Sources and sinks for page XML (ALTO and PAGE)."""
