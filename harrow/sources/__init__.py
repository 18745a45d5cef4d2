"""Sources (targets, captured pages, robots) and sinks."""
