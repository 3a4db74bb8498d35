"""Sources and sinks: replayed responses, stored bodies, JSON state, projects and archives."""
