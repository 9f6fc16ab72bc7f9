"""Sources and sinks. A file is read by one task under a budget; what a file breaks becomes a row with an issue."""
